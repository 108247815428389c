"""Sharding, whitening and the conversation trie against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import sharding, trie, whitening

DOCS = "doc_id long, text string, shard string, slot int, size string, lang string"


def docs_of(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "own", 7, "large", "en") for i, t in rows], DOCS).repartition(parts)


def least_capacity(sizes, shards):
    """The smallest largest shard over all cuttings of an order, by dynamic programming."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[a], ends[b] - ends[a]) for a in range(b + 1)) for b in range(len(ends))]
    return best[-1]


def test_shards_are_gapless_keep_equal_texts_and_are_as_small_as_can_be(spark):
    rng = random.Random(3)
    texts = ["x" * rng.choice([0, 3, 50, 400, 900]) + str(rng.randrange(60)) + "é" * rng.randrange(4) for _ in range(220)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (None, "nobody's"), (502, "same"), (502, "same")]
    got = sharding.shard_documents(docs_of(spark, rows), shards=7).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by_shard, text_of = defaultdict(list), dict(rows)
    for r in got:
        data = (text_of[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        by_shard[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values()) and set(by_shard) == set(range(7))
    shard_of = defaultdict(set)
    for r in got:
        shard_of[text_of[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 16
    keys = {r.text: r.k for r in spark.createDataFrame([(t,) for t in groups], "text string").select("text", sharding.group_key(F.col("text")).alias("k")).collect()}
    sizes = [groups[t] for t in sorted(groups, key=keys.get)]
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    assert max(sums.values()) == least_capacity(sizes, 7)
    assert max(sums.values()) - min(sums.values()) <= 2 * max(sizes)
    again = sharding.shard_documents(docs_of(spark, rows, parts=2), shards=7).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


@pytest.mark.parametrize("bits", [(4, 3), (16, 6)])
def test_the_search_divides_ranges_until_the_capacity_is_exact(spark, bits):
    rng = random.Random(sum(bits))
    rows = [(rng.randrange(-(2**63), 2**63), rng.choice([1, 5, 40, 300])) for _ in range(400)] + [(2**40 + i, 30) for i in range(90)]
    groups = spark.createDataFrame(rows, "key long, size long")
    plan = sharding.plan_shards(groups, 9, *bits)
    sizes = [s for _, s in sorted(rows)]
    assert plan.capacity == least_capacity(sizes, 9) and not plan.alone
    sums = Counter(sum(k > c for c in plan.cuts) for k, s in rows for _ in range(s))
    assert max(sums.values()) == plan.capacity and len(sums) == 9


def test_a_group_above_an_even_share_has_a_shard_of_its_own(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(1000 + i, "copied " * 9) for i in range(200)]
    got = sharding.shard_documents(docs_of(spark, rows), shards=6).collect()
    heavy = {r.shard for r in got if r.doc_id >= 1000}
    assert len(heavy) == 1 and not heavy & {r.shard for r in got if r.doc_id < 1000}
    counts = Counter(r.shard for r in got if r.doc_id < 1000)
    assert len(counts) == 5 and max(counts.values()) <= 62


def test_sharding_of_nothing_of_one_row_and_of_fewer_groups_than_shards(spark):
    assert sharding.shard_documents(docs_of(spark, []).limit(0)).count() == 0
    assert [(r.shard < 40, r.slot) for r in sharding.shard_documents(docs_of(spark, [(1, None)])).collect()] == [(True, 0)]
    got = sharding.shard_documents(docs_of(spark, [(1, "a"), (2, "b" * 100_000), (3, "a"), (4, "c")]))
    assert sorted(r.slot for r in got.collect()) == [0, 0, 0, 1]


def test_written_shards_hold_all_documents(spark, tmp_path):
    rows = [(i, f"text {i % 70}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows and back.select("shard").distinct().count() == 4
    assert back.groupBy("text").agg({"shard": "max"}).count() == 70


# whitening

VECTORS = "vec_id long, embedding array<float>, component string, label int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1) for i, v in rows], VECTORS).repartition(4)


def brute_whitening(rows, k):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n = len(x)
    sums = x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    y = np.array((n * x - sums) / n, dtype=float)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, deviation, y @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("d,n", [(40, 300), (90, 400), (6, 50)])
def test_whitening_matches_a_dense_solver(spark, d, n):
    rng = np.random.default_rng(d)
    scales = np.linspace(0.2, 1.5, d)
    rows = [(i, (rng.standard_normal(d) * scales).astype(np.float32).tolist()) for i in range(n)]
    bad = [(-1, None), (-2, [0.5] * (d - 1) + [None]), (-3, [float("nan")] * d), (-4, [float("inf")] + [0.0] * (d - 1)), (-5, [0.5] * (d + 2)), (-6, [])]
    k = min(d, 32)
    got = whitening.whiten(vectors_of(spark, rows + bad)).collect()
    count, deviation, white, shares = brute_whitening(rows, k)
    assert len(got) == n * k and {r.n for r in got} == {count}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    found = np.zeros((n, k))
    for r in got:
        found[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and abs(r.explained - shares[r.component - 1]) < 1e-9 * shares[0]
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found * signs - white).max() < 1e-6


def test_whitening_iterates_to_double_precision_in_many_dimensions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(160) * np.linspace(0.5, 2, 160)).astype(np.float32).tolist()) for i in range(400)]
    vectors, d = whitening.whole_numbers(vectors_of(spark, rows), "vec_id", "embedding")
    fitted = whitening.fit(vectors, d, 5)
    x = np.array([r.x for r in vectors.collect()], dtype=float)
    values, vecs = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(fitted.values, values[::-1][:5], rtol=1e-12) and (fitted.residuals < 1e-11 * values[-1]).all()
    assert np.abs(np.abs((vecs[:, ::-1][:, :5] * fitted.vectors).sum(axis=0)) - 1).max() < 1e-10


def test_whitening_without_variance_rows_or_dimensions(spark):
    assert whitening.whiten(vectors_of(spark, []).limit(0)).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    same = whitening.whiten(vectors_of(spark, [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [0.1, 0.2])])).collect()
    assert len(same) == 6 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, 0.0, 0.0)}
    few = whitening.whiten(vectors_of(spark, [(1, [0.0, 0.0, 1.0]), (2, [0.0, 0.0, 3.0]), (2, [0.0, 0.0, 3.0])])).collect()
    assert len(few) == 9 and sum(r.whitened is not None for r in few) == 3 and all(abs(r.explained - 1) < 1e-12 for r in few if r.component == 1)


def test_minres_solves_indefinite_systems_column_by_column():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    a = q @ np.diag([-3, -1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10.0]) @ q.T
    b = rng.standard_normal((12, 3))
    assert np.allclose(a @ whitening.minres(lambda m: a @ m, b, 12), b, atol=1e-6)


# conversations

TURNS = "conv_id long, turn int, role string, text string, depth string, n_convs int"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t[2] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}

    def visit(p):
        leaves, saved = int(not children[p]), (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        for q in children[p]:
            a, b = visit(q)
            leaves, saved = leaves + a, saved + b
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out[p] = (min(members[p]), len(p), parent, len(members[p]), len(children[p]), leaves, saved, digest)
        return leaves, saved

    if members:
        visit(())
    return Counter(out.values())


def trie_of(spark, rows, parts=4, **more):
    turns = spark.createDataFrame([(*r, "deep", 3) for r in rows], TURNS).repartition(parts)
    got = trie.prefix_trie(trie.rebuilt(trie.gathered(turns)), **more).collect()
    return Counter(tuple(r) for r in got)


@pytest.mark.parametrize("shard_turns", [1, 7, 100_000])
def test_trie_matches_plain_python_however_it_is_sharded(spark, shard_turns):
    rng = random.Random(shard_turns)
    rows = []
    for c in list(range(0, 130)) + [1000, 1001, 1050, 2001]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(["hello", "hello there", "é" * 5, "", None]) if c % 3 else "common"
            rows.append((c, rng.choice([turn, turn, None]) if c % 7 == 0 else turn, rng.choice(["user", None]) if c % 5 == 0 else "user", text))
    rows += [(None, 1, "user", "nobody"), (3, 1, "user", "twice"), (3, 1, "user", "twice")]
    assert trie_of(spark, rows, shard_turns=shard_turns) == brute_trie(rows)


def test_trie_of_many_copies_and_of_one_long_conversation(spark):
    rows = [(100 * c, t, "user", f"copied {t}") for c in range(60) for t in range(6)]
    rows += [(7, t, "user", f"turn {t % 3}") for t in range(700)] + [(8, t, "user", f"turn {t % 3}") for t in range(650)]
    assert trie_of(spark, rows, shard_turns=40) == brute_trie(rows)


def test_trie_of_nothing_and_of_conversations_that_lose_all_turns(spark):
    assert not trie_of(spark, [])
    rows = [(c, 0, "user", "only") for c in (201, 202, 203, 204, 205, 206)]
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, [(None, 0, "user", "only")]) == Counter()


@pytest.mark.parametrize("seed", range(4))
def test_parentheses_close_where_a_stack_says(seed):
    rng = random.Random(seed)
    bits, depth = [1], 1
    while depth:
        if len(bits) < 900 * seed + 1 and (rng.random() < (0.5, 0.52, 0.7, 0.95)[seed] or depth == 1):
            bits.append(1)
            depth += 1
        else:
            bits.append(0)
            depth -= 1
    stack, close, leaves = [], {}, 0
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    tree = trie.Parentheses(np.array(bits, dtype=np.uint8))
    assert tree.find_close(tree.opens).tolist() == [close[i] for i in tree.opens.tolist()]
    leaves = sum(a == 1 and b == 0 for a, b in zip(bits, bits[1:]))
    assert tree.leaves[-1] == leaves
