"""Exact, near and line dedup against plain Python."""

import hashlib
import random
import re

from factorloom.llm import exact, lines, minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join("w%d" % rng.randrange(400) for _ in range(n))


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i, _ in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = [i for i, _ in texts]
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_exact_dedup_matches_python_and_splits_off_heavy_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "ab ", "a  b\n", "x", "", None, "y z"]) if i % 3 else f"only {i}") for i in range(300)]
    got = {r.doc_id: r for r in exact.exact_dedup(table(spark, rows), counters=4).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    assert len(got) == len(rows)
    for key, members in groups.items():
        best = min(members)[1]
        for _, i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best, len(members), i == best)
            assert got[i].text_sha256 == hashlib.sha256(key.encode()).hexdigest()


def test_exact_dedup_of_nothing_and_of_repeated_rows(spark):
    assert exact.exact_dedup(table(spark, []).limit(0)).count() == 0
    got = exact.exact_dedup(spark.createDataFrame([(1, "a", 5), (1, "a", 6), (None, "aa", 7)], "doc_id long, text string, group_size int")).collect()
    assert sorted((r.doc_id or 0, r.group_size, r.kept) for r in got) == [(0, 1, True), (1, 2, True), (1, 2, True)]


def test_misra_gries_keeps_what_is_frequent():
    counts = {}
    for _ in range(50):
        counts = exact.misra_gries(counts, {"hot": 5, **{object(): 1 for _ in range(5)}}, 3)
    assert counts["hot"] >= 500 / 3 - 1 and len(counts) <= 3


def test_near_dedup_matches_all_pairs(spark):
    rng = random.Random(2)
    rows, next_id = [], 0
    for _ in range(25):
        base = words(rng, rng.choice([1, 2, 5, 30, 120])).split()
        for _ in range(rng.choice([1, 2, 4])):
            copy = list(base)
            for _ in range(len(copy) // 30):
                copy[rng.randrange(len(copy))] = "z%d" % rng.randrange(99)
            rows.append((next_id, "  ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
            next_id += 7
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE "), (5005, words(rng, 20000))]
    for size in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(table(spark, rows), words=size).collect()}
        assert got == brute_components(rows, size, 80)


def test_near_dedup_finds_a_star_whose_leaves_are_not_near(spark):
    rng = random.Random(3)
    hub = words(rng, 200).split()
    rows = [(0, " ".join(hub))]
    for leaf in range(1, 40):
        copy = list(hub)
        for k in rng.sample(range(200), 9):
            copy[k] = f"leaf{leaf}x{k}"
        rows.append((leaf, " ".join(copy)))
    got = minhash.near_dedup(table(spark, rows), words=2).collect()
    assert {r.component_id for r in got} == {0}


def test_near_dedup_links_leaves_of_a_star_with_what_is_not_near_its_centre(spark):
    """Chains hub - x - y in one bucket: x is taken by the hub, y is near x only, and so on."""
    rng = random.Random(4)
    rows = []
    for family in range(8):
        chain = [words(rng, 200).split()]
        for step in range(4):
            copy = list(chain[-1])
            for k in range(step + 1, 200, 22):
                copy[k] = f"f{family}s{step}k{k}"
            chain.append(copy)
        rows += [(100 * family + i, " ".join(c)) for i, c in enumerate(chain)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(table(spark, rows), words=2, bands=2, rows=1).collect()}
    want = brute_components(rows, 2, 80)
    sketches = minhash.sketch(spark.createDataFrame(rows, "id long, text string"), 2, 2, 1).collect()
    keys = {r.id: set(r["keys"]) for r in sketches}
    joined = [f for f in range(8) if all(keys[100 * f + i] & keys[100 * f + i + 1] for i in range(4))]
    assert len(joined) > 3 and all(want[100 * f + i][1] == 100 * f for f in joined for i in range(5))
    assert all(got[100 * f + i] == want[100 * f + i] for f in joined for i in range(5))


def family(rng, shape, members, tag):
    """Texts of 220 words that are linked as a chain, a tree or a dense tree: each member is an edited copy of an earlier one."""
    texts = [["%s%d" % (rng.choice("abcdefgh"), rng.randrange(5000)) for _ in range(220)]]
    for k in range(1, members):
        before = {"chain": k - 1, "tree": rng.randrange(k), "dense": max(0, k - 1 - rng.randrange(4))}[shape]
        copy = list(texts[before])
        for at in rng.sample(range(220), 8 if shape != "dense" else 3):
            copy[at] = f"{tag}x{k}x{at}"
        texts.append(copy)
    return [" ".join(t) for t in texts]


def test_near_dedup_joins_chains_and_trees_like_all_pairs(spark):
    rng = random.Random(14)
    texts = [t for n, shape in enumerate(("chain", "tree", "dense", "chain")) for t in family(rng, shape, 60, f"f{n}")]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(table(spark, rows), words=2).collect()}
    assert got == brute_components(rows, 2, 80)


def test_near_dedup_finds_links_between_members_of_mixed_buckets(spark):
    """One band of one row: large buckets of several families, whose members meet by their sets in small blocks."""
    rng = random.Random(15)
    rows = [(1000 * n + k, t) for n in range(3) for k, t in enumerate(family(rng, "tree", 25, f"g{n}"))]
    shared = " ".join("common%d" % k for k in range(150))
    rows = [(i, shared + " " + t) for i, t in rows]
    block, minhash.BLOCK = minhash.BLOCK, 4000
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_dedup(table(spark, rows), words=2, bands=30, rows=1).collect()}
    finally:
        minhash.BLOCK = block
    assert got == {i: c for i, (_, c) in brute_components(rows, 2, 80).items()}


def test_near_dedup_takes_rows_of_one_id_as_one_vertex(spark):
    rows = [(5, "a b c d e f"), (5, "u v w x y z"), (7, "a b c d e f"), (3, "u v w x y z"), (9, "q q q")]
    df = spark.createDataFrame([(i, t, True, 1) for i, t in rows], "doc_id long, text string, kept boolean, component_id int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(df, words=2).collect())
    assert got == [(3, 5, 3, True), (5, 5, 3, False), (5, 5, 3, False), (7, 5, 3, False), (9, 1, 9, True)]


def test_near_dedup_of_nothing_and_null_ids(spark):
    assert minhash.near_dedup(table(spark, []).limit(0)).count() == 0
    got = minhash.near_dedup(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, True), (3, 3, True), (3, 3, True)]


def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_lines(rows):
    all_lines = [(i, p, line) for i, t in rows for p, line in enumerate((t or "").split("\n")) if line.strip(" \t\n\x0b\x0c\r")]
    first = {}
    for i, p, line in sorted(all_lines):
        first.setdefault(line, (i, p))
    out = {}
    for i, t in rows:
        kept = []
        for p, line in enumerate(t.split("\n") if t is not None else []):
            solid = line.strip(" \t\n\x0b\x0c\r")
            near = [f for other, f in first.items() if f < (i, p) and (other == line or (len(other) >= 20 and len(line) >= 20 and edit_at_most_one(other, line)))]
            if not solid or not near:
                kept.append(line)
        out[i] = None if t is None else "\n".join(kept)
    return out


def test_line_dedup_matches_all_pairs(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abé ") for _ in range(rng.choice([3, 19, 20, 21, 31, 32, 33, 64, 65, 100]))) for _ in range(12)] + ["", " ", "short"]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(pool)
            k, op = rng.randrange(len(line) + 1), rng.random()
            if op < 0.2:
                line = line[:k] + "x" + line[k:]
            elif op < 0.4:
                line = line[:k] + line[k + 1 :]
            elif op < 0.6:
                line = line[:k] + rng.choice("xyz") + line[k + 1 :]
            parts.append(line)
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "q" * 3000 + "\nend"), (104, "q" * 2999)]
    got = {r.doc_id: r.text for r in lines.line_dedup(table(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_with_other_bounds(spark):
    rows = [(1, "abcd\nx"), (2, "abcx\ny"), (3, "abcd")]
    short = {r.doc_id: r.text for r in lines.line_dedup(table(spark, rows), per_edit=4).collect()}
    none = {r.doc_id: r.text for r in lines.line_dedup(table(spark, rows), edits=0).collect()}
    assert short == {1: "abcd\nx", 2: "y", 3: ""} and none == {1: "abcd\nx", 2: "abcx\ny", 3: ""}
    twice = lines.line_dedup(table(spark, [(1, "a line of its own"), (1, "a line of its own"), (2, "a line of its own")])).collect()
    assert sorted((r.doc_id, r.text) for r in twice)[-1] == (2, "")


def test_line_dedup_leaves_clean_documents_alone(spark):
    rows = [(1, "first line of one\r\n\nand more"), (2, "another text\nfirst line of one\r"), (None, "first line of one\r")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_dropped int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.line_dedup(df).collect()}
    assert got == {1: (rows[0][1], 3, 0), 2: ("another text", 2, 1), None: ("first line of one\r", 1, 0)}
    assert lines.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_of_several_texts_under_one_id_loses_no_line(spark):
    rows = [(0, "a dup line that stands in both of them"), (1, "first text of one\na dup line that stands in both of them"), (1, "second text of one\nA UNIQUE LINE THAT IS NOWHERE ELSE"), (2, "first text of one")]
    got = lines.line_dedup(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in got) == [
        (0, "a dup line that stands in both of them", 0), (1, "first text of one", 1), (1, "second text of one\nA UNIQUE LINE THAT IS NOWHERE ELSE", 0), (2, "", 1)
    ]


def test_exact_dedup_minds_no_columns_named_like_its_own(spark):
    df = spark.createDataFrame([(1, "a b", 9, "x", "y"), (2, "ab", 8, "x", "y"), (3, "c", 7, "x", "y")], "doc_id long, text string, n long, digest string, keep_id string")
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(df).collect())
    assert got == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)]
