"""Embedding dedup against all pairs; the pipeline's stages against their operators' promises."""

import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece

import corpus_pipeline
from factorloom.llm import common, neighbours, pieces
from factorloom.llm.common import WordHasher, components
from tests.llm.test_copies import brute_components


def test_components_reach_the_smallest_id(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20] + [(rng.randrange(100, 130), rng.randrange(100, 130)) for _ in range(25)]
    label = {v: v for e in edges for v in e}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_components_of_a_shuffled_chain_take_few_rounds(spark, monkeypatch):
    ids = list(range(2000))
    random.Random(2).shuffle(ids)
    written, plain = [], common.checkpoint
    monkeypatch.setattr(common, "checkpoint", lambda df: written.append(df.columns) or plain(df))
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    got = components(edges, few=0).collect()
    assert len(got) == 2000 and {r.component_id for r in got} == {0}
    assert sum(c == ["a", "b"] for c in written) - 1 <= 15


def test_components_by_rounds_match_those_of_one_task(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1060)] + [(7000, 7000)]
    frame = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, components(frame, few=0).collect())) == sorted(map(tuple, components(frame).collect()))
    assert components(frame.limit(0)).count() == 0


def test_word_hashes_tell_words_not_their_place():
    h = WordHasher()
    hashes, counts = h.words([b"one two", b"", b" two\x0bONE "])
    assert counts.tolist() == [2, 0, 2] and hashes[0] == hashes[3] and hashes[1] == hashes[2] and hashes[0] != hashes[1]
    assert np.array_equal(h.words([b"x" * 200_000 + b" one"])[0][1:], hashes[:1])
    long = [b"one " * 300_000 + b"y" * 700_000 + b" two one", b"", b"two"]
    hashes_, counts_ = h.words(long)
    assert counts_.tolist() == [300_003, 0, 1] and (hashes_[:300_000] == hashes[0]).all() and np.array_equal(hashes_[[300_001, 300_003]], hashes[[1, 1]])


def test_embedding_dedup_matches_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        base = rng.standard_normal(16)
        for _ in range(1 if k % 3 else 30 if k == 0 else 4):
            rows.append(base + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12]))
    rows = [[float(x) for x in r] for r in rows]
    rows += [rows[0], [2.5 * x for x in rows[0]], None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, kept int")
    usable = [i for i, r in enumerate(rows) if r and len(r) == 16 and None not in r and np.isfinite(r).all() and np.any(r)]
    x = np.array([rows[i] for i in usable])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    label = np.array(usable)
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
    want = {i: (0, i) for i in range(len(rows))} | {i: (int(near[k].sum()), int(label[k])) for k, i in enumerate(usable)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.embedding_dedup(df).collect()}
    assert got == want
    assert neighbours.embedding_dedup(df.limit(0)).count() == 0


def bridged(groups, size, seed=11):
    """Pairs of tight groups of distinct vectors; one vector of each group is linked with one of the other, no others are."""
    rng, rows = np.random.default_rng(seed), []
    angle = np.arccos(0.905)
    for _ in range(groups):
        q = np.linalg.qr(rng.standard_normal((16, 16)))[0]
        ends = [q[0], np.cos(angle) * q[0] + np.sin(angle) * q[1]]
        for end, away in zip(ends, (-q[1], q[1])):
            side = away - (away @ end) * end
            rows.append(end)
            for _ in range(size - 1):
                noise = rng.standard_normal(16) * 0.01
                v = end + 0.12 * side / np.linalg.norm(side) + noise
                rows.append(v / np.linalg.norm(v))
    return np.array(rows)


def split_groups(spark, x):
    """The component and the number of links of each vector by embedding_dedup, and by all pairs."""
    near = x @ x.T >= 0.9
    want = np.arange(len(x))
    while True:
        new = np.array([want[near[i]].min() for i in range(len(x))])
        if (new == want).all():
            break
        want = new
    order = np.random.default_rng(5).permutation(len(x))
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.component_id, r.n_links) for r in neighbours.embedding_dedup(df).collect()}
    return [out[i] for i in range(len(x))], list(zip(want.tolist(), (near.sum(axis=1) - 1).tolist()))


def test_embedding_dedup_keeps_the_one_link_between_tight_groups(spark, monkeypatch):
    x = bridged(2, 60)
    got, want = split_groups(spark, x)
    assert len({c for c, _ in want}) == 2
    assert got == want


def test_embedding_dedup_does_not_settle_for_a_short_audit(spark, monkeypatch):
    """Vectors by twos in leaves of two: one tree and no rounds leave pairs out, which the audit sees; then all pairs are compared."""
    for name, value in (("LEAF", 2), ("TREES", 1), ("MISS", 0.99), ("MORE", 0), ("ROUNDS", 0)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base + 0.3 * rng.standard_normal(base.shape)])
    got, want = split_groups(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    assert got == want


def test_embedding_dedup_grows_the_trees_that_its_pairs_need(spark, monkeypatch):
    """Leaves of two and hardly an audit: the planned number of trees has to show every pair."""
    for name, value in (("LEAF", 2), ("TREES", 1), ("ROUNDS", 0), ("AUDIT", 1)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base + 0.3 * rng.standard_normal(base.shape)])
    got, want = split_groups(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    assert got == want


def test_embedding_dedup_recall_on_many_clusters(spark, monkeypatch):
    """Several leaves, clusters of many sizes and spreads: every link is found, and printed as the recall."""
    monkeypatch.setattr(neighbours, "LEAF", 64)
    rng = np.random.default_rng(12)
    rows = [c + rng.standard_normal(24) * spread for c in rng.standard_normal((80, 24)) for spread in [rng.choice([0.1, 0.2, 0.3])] for _ in range(rng.integers(1, 30))]
    x = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    got, want = split_groups(spark, x)
    recall = sum(n for _, n in got) / sum(n for _, n in want)
    print("recall of links:", recall)
    assert recall >= 0.995 and all(g[1] <= w[1] for g, w in zip(got, want))


def test_embedding_dedup_of_repeated_rows_and_ties(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in neighbours.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def stages(spark, folder, rows, labels):
    """What each stage of the pipeline gets and returns over these documents."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        yield name, docs.collect(), after.collect()
        docs = after


def test_each_stage_matches_plain_python(spark, tmp_path):
    rng = random.Random(15)
    line = lambda: " ".join("w%d" % rng.randrange(2000) for _ in range(12))
    shared = line()
    texts = {i: "\n".join([line() for _ in range(5)] + [shared] * (i % 3 == 0)) for i in range(120)}
    for i in range(0, 120, 8):
        texts[i] += " scum idiot moron"
    for k, i in enumerate((3, 5, 9)):
        copy = texts[i].split("\n")
        texts[200 + k] = "\n".join(" ".join([*own.split()[:-1], f"z{k}"]) if n == 0 else own.replace(" ", "  ") for n, own in enumerate(copy))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()] + [(400, None, None, None, None), (401, "", "en", "s0", 0), (7, texts[7], "en", "s1", 1), (7, "another text\nof this id", "en", "s1", 1)]
    out = {name: (before, after) for name, before, after in stages(spark, tmp_path, rows, [(i, 1, int(i % 8 == 0)) for i in range(120)])}
    before, after = out["toxicity"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if "scum" not in (r.text or ""))
    before, after = out["line_dedup"]
    want = brute_lines_by_id(before)
    assert sorted((r.doc_id, r.text or "", r.n_chars) for r in after) == want
    before, after = out["minhash_near_dedup"]
    pairs = [(r.doc_id, r.text) for r in before]
    linked = brute_components(pairs, 5, 80)
    kept = {(i, " ".join((t or "").lower().split())) for i, t in pairs if linked[i][1] == i}
    assert {(r.doc_id, " ".join((r.text or "").lower().split())) for r in after} == kept and len(after) == len(kept)
    before, after = out["mixing"]
    sizes, taken = Counter(), Counter()
    for rows_, count in ((before, sizes), (after, taken)):
        for r in rows_:
            count[r.source] += len((r.text or "").split())
    assert set(r.doc_id for r in after) <= set(r.doc_id for r in before) and all(taken[s] <= 2 * sizes[s] for s in sizes)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 70 * len(sizes)
    before, after = out["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    ids = [library.encode(r.text or "") for r in before]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in after) == sorted((r.doc_id, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for r, i in zip(before, ids))


def brute_lines_by_id(rows):
    """Line dedup of rows without near lines: each line stays where it stands first by (id, place); rows of one id are one document."""
    first = {}
    for i, p, own in sorted((r.doc_id, p, own) for r in rows for p, own in enumerate((r.text or "").split("\n")) if own.strip()):
        first.setdefault(own, (i, p))
    out = []
    for r in rows:
        kept = [own for p, own in enumerate((r.text or "").split("\n")) if not own.strip() or first[own] == (r.doc_id, p)]
        out.append((r.doc_id, "\n".join(kept), None if r.text is None else len("\n".join(kept))))
    return sorted(out)


def test_stages_of_nothing(spark, tmp_path):
    for name, before, after in stages(spark, tmp_path, [], []):
        assert not before and not after


def test_stages_do_not_mind_other_columns(spark, tmp_path):
    names = "kept component_id size taken copies source_size target n_lines n_dropped p_toxic toxic __id __gone __source base bound hash __r __n id text_ score".split()
    rows = [(i, f"some words of document {i}\nand a line " + "x y z " * i, "en", "s", 9) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"{k} AS {c}" for k, c in enumerate(names)))
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert {r.doc_id for r in stage(spark, df, str(tmp_path)).collect()} == set(range(6))


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    rng = random.Random(5)
    line = lambda: " ".join("w%d" % rng.randrange(3000) for _ in range(30))
    texts = {i: "\n".join(line() for _ in range(6)) for i in range(200)}
    for i in range(0, 200, 8):
        texts[i] += " scum idiot moron"
    copy = texts[3].split()
    copy[5] = "changed"
    texts[300] = " ".join(copy)
    texts[301] = " ".join(texts[3].split())
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()] + [(400, None, None, None, None), (401, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert set(out.columns) == set(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = {i for i in texts if i % 8 or i >= 300} | {400, 401}
    assert ids["toxicity"] == clean and ids["line_dedup"] == clean
    assert ids["minhash_near_dedup"] == clean - {300, 301}
    assert ids["mixing"] <= clean and ids["sentencepiece"] == ids["mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_different_vectors_under_one_id_have_links_of_their_own(spark):
    def near(axis, other):
        v = [0.0] * 6
        v[axis], v[other] = 1.0, 0.1
        return v

    rows = [(1, near(0, 2)), (1, near(3, 4)), (2, near(0, 1)), (3, near(3, 5)), (4, near(0, 5)), (4, near(3, 1)), (1, near(0, 2))]
    for order in (rows, rows[::-1]):
        got = neighbours.embedding_dedup(spark.createDataFrame(order, "vec_id long, embedding array<double>")).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted(
            [(1, 3, 1, True), (1, 3, 1, True), (1, 2, 1, True), (2, 3, 1, False), (3, 2, 1, False), (4, 3, 1, False), (4, 2, 1, False)]
        )
