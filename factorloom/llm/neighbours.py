"""Embedding near-dedup by NN-descent, with audited recall.

Equal vectors are collapsed. Random-hyperplane trees of bounded leaves give a first neighbour graph; as many trees
grow as a pair right at the threshold needs to share a leaf in one of them, but for MISS. NN-descent then joins
neighbours of neighbours until no list changes. The lists only steer the search: every link that a leaf or a round
verifies goes to a table of its own, from which the components come. A vector has one list for its own component and
one for others, so that a tight group does not hide what lies beside it; only pairs of different components are
compared. A list of others that fills up with links is enlarged, and where it stays full at its largest size, the
search goes on with the components that its links have made, until no such list is left.
Lists only keep what can lead to a link: two neighbours of one vector at cosine t are at 2 * t * t - 1 at least. A
block of query vectors, more of them in larger tables, is compared with all vectors to audit the recall; more trees
follow while it is short, and if the last of them leave it short, all vectors are compared after all.
Links of one component are last counted exactly, in blocks, so that a link is found when its ends share a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, components, release, small, table

LINK = 0.9
#: Trees that are worked on at a time, and vectors of a leaf.
TREES, LEAF = 12, 512
#: Share of the pairs right at the threshold that may be in no leaf together, before the descent.
MISS = 0.005
LIST, LARGEST = 10, 80
ROUNDS, AUDIT, RECALL = 6, 128, 0.995
#: More batches of trees that may follow a short audit.
MORE = 3
#: Vectors that are compared at a time, and that are read at a time.
BLOCK, AT_ONCE = 1024, 2000
#: Vectors of one block, at most, where all vectors are compared, or all of one component.
STRIP = 32768


def vectors(rows: DataFrame) -> DataFrame:
    """(id, vec): unit vectors in double precision as bytes, null where the vector can't have a link."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if y is None else y for y in v], dtype=np.float64) if v else np.zeros(0)
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                if top > 0:
                    x = x / top
                    out.append((x / np.sqrt(x @ x)).tobytes())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])
        release()

    return rows.mapInArrow(apply, "id long, vec binary")


def matrix(column) -> np.ndarray:
    values = list(column)
    return np.frombuffer(b"".join(values), dtype=np.float64).reshape(len(values), -1)


def _top(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k most similar b of each a."""
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k], s[place < k]


def trees_for(n: int, link: float) -> int:
    """The trees in which a pair at cosine link shares a leaf at least once, with a chance of 1 - MISS."""
    together = (1 - np.arccos(min(1.0, link)) / np.pi) ** _depth(n, LEAF)
    return 1 if together >= 1 - MISS else int(np.ceil(np.log(MISS) / np.log1p(-together)))


def _depth(rows: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(max(rows, 1) / leaf))))


def tree_leaves(unit: DataFrame, rows: int, trees: range, leaf: int) -> DataFrame:
    """(tree, leaf, part, id, vec): leaves of about ``leaf`` vectors by the signs of random projections.

    part splits what falls together by chance into pieces of about that size, by another hash in every tree, so that
    a leaf that holds a third of all vectors is worked on in many places.
    """
    depth = _depth(rows, leaf)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            ids = batch.column(0).to_numpy()
            by_size: dict[int, list[int]] = {}
            blobs = batch.column(1).to_pylist()
            for i, v in enumerate(blobs):
                by_size.setdefault(len(v), []).append(i)
            for size, at in by_size.items():
                x = matrix(blobs[i] for i in at)
                own = ids[at]
                for t in trees:
                    planes = np.random.default_rng(1000 + t).standard_normal((x.shape[1], depth))
                    code = (x @ planes > 0) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(at), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t, dtype=np.int32)), pa.array(code * 65536 + x.shape[1]), pa.array(own), pa.array([blobs[i] for i in at], pa.binary())], ["tree", "leaf", "id", "vec"]
                    )
        release()

    found = checkpoint(unit.mapInArrow(apply, "tree int, leaf long, id long, vec binary"))
    sizes = found.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2.0 * leaf)).alias("parts")).where("parts > 1")
    split = found.join(small(checkpoint(sizes)), ["tree", "leaf"], "left")
    part = F.coalesce(F.pmod(F.xxhash64("id", "tree"), F.col("parts")), F.lit(0))
    return split.select("tree", "leaf", part.alias("part"), "id", "vec")


def _join(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """roots, where each place names the smallest place that it is linked with, after the links a - b."""
    while True:
        low, high = np.minimum(roots[a], roots[b]), np.maximum(roots[a], roots[b])
        new = low < high
        if not new.any():
            return roots
        a, b = a[new], b[new]
        np.minimum.at(roots, high[new], low[new])
        while (roots[roots] != roots).any():
            roots = roots[roots]


def _stars(ids: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge from each place to its root: the same components as all the links behind roots."""
    at = np.flatnonzero(roots != np.arange(len(roots)))
    return ids[roots[at]], ids[at]


def leaf_neighbours(leaves: DataFrame, k: int, floor: float, link: float) -> DataFrame:
    """(a, b, s) with s >= floor: the k nearest of each vector in its leaf, among those that the leaf's links join with it
    and among the others; with s null: edges that join what is linked. The edges stand for all links, however many.
    """

    def apply(group: pd.DataFrame) -> pd.DataFrame:
        x, ids = matrix(group["vec"]), group["id"].to_numpy()
        near, roots = [], np.arange(len(ids))
        for i in range(0, len(ids), BLOCK):
            s = x[i : i + BLOCK] @ x.T
            r, c = np.nonzero(s >= floor)
            s, r = s[r, c], r + i
            roots = _join(roots, r[s >= link], c[s >= link])
            near.append((r[r != c], c[r != c], s[r != c]))
        out = []
        for r, c, s in near:
            same = roots[r] == roots[c]
            out += [_top(ids[r[part]], ids[c[part]], s[part], k) for part in (same, ~same)]
        a, b = _stars(ids, roots)
        out.append((a, b, np.full(len(a), np.nan)))
        a, b, s = (np.concatenate([o[j] for o in out]) for j in range(3))
        return pd.DataFrame({"a": a, "b": b, "s": s})

    found = leaves.groupBy("tree", "leaf", "part").applyInPandas(apply, "a long, b long, s double")
    return found.withColumn("s", F.nanvl("s", F.lit(None).cast("double")))


def all_pairs(unit: DataFrame, link: float) -> DataFrame:
    """(a, b): edges with the components of all links of unit (id, vec); every vector meets every other one, in blocks."""
    strip = F.least(F.lit(STRIP), F.greatest(F.lit(BLOCK), F.ceil(F.count("*") / 8.0)))
    parts = checkpoint(unit.groupBy(F.length("vec").alias("bytes")).agg(F.ceil(F.count("*") / strip).cast("int").alias("strips")))
    own = unit.withColumn("bytes", F.length("vec")).join(F.broadcast(parts), "bytes").withColumn("own", F.pmod(F.xxhash64("id"), F.col("strips")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    side = lambda i, j: own.select(*(F.col(k).alias(n) for n, k in zip(("bytes", "i", "j", "id", "vec"), ("bytes", i, j, "id", "vec")))).where("i <= j")

    def apply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64)})
        u, v, ids = matrix(a["vec"]), matrix(b["vec"]), np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])
        roots = np.arange(len(ids))
        for k in range(0, len(u), BLOCK):
            r, c = np.nonzero(u[k : k + BLOCK] @ v.T >= link)
            roots = _join(roots, r + k, c + len(u))
        first, second = _stars(ids, roots)
        return pd.DataFrame({"a": first, "b": second})

    keys = ["bytes", "i", "j"]
    return side("own", "other").groupBy(*keys).cogroup(side("other", "own").groupBy(*keys)).applyInPandas(apply, "a long, b long").where("a <> b")


def shortened(graph: DataFrame, sizes: DataFrame | None, k: int) -> DataFrame:
    """The best entries of each list of graph (a, b, same, s): k of them, or of a list of others as many as sizes (a, k) says."""
    best = Window.partitionBy("a", "same").orderBy(F.desc("s"), "b")
    graph = graph.groupBy("a", "b", "same").agg(F.max("s").alias("s"))
    room = F.lit(k)
    if sizes is not None:
        graph, room = graph.join(sizes, "a", "left"), F.when(F.col("same"), k).otherwise(F.coalesce("k", F.lit(k)))
    return graph.withColumn("r", F.row_number().over(best)).where(F.col("r") <= room).select("a", "b", "same", "s")


def similarities(pairs: DataFrame, unit: DataFrame, floor: float) -> DataFrame:
    """pairs (a, b) with their cosine s >= floor."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            same = np.array([len(x) == len(y) for x, y in zip(left, right)], dtype=bool)
            s = np.array([np.frombuffer(x) @ np.frombuffer(y) if ok else -2.0 for x, y, ok in zip(left, right, same)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["a", "b", "s"])
        release()

    pairs = small(checkpoint(pairs))
    x = unit.join(pairs, F.col("id") == F.col("a")).select("a", "b", F.col("vec").alias("x"))
    y = unit.join(pairs, F.col("id") == F.col("b")).select("a", "b", F.col("vec").alias("y"))
    found = x.join(y, ["a", "b"]).select("a", "b", "x", "y").mapInArrow(apply, "a long, b long, s double")
    return found.where(F.col("s") >= floor)


def told_apart(graph: DataFrame, of: DataFrame) -> DataFrame:
    """graph (a, b, s) with same: whether a and b are in one component of (id, component_id)."""
    for end in ("a", "b"):
        graph = graph.join(of.select(F.col("id").alias(end), F.col("component_id").alias(f"{end}c")), end, "left")
    same = F.coalesce("ac", "a") == F.coalesce("bc", "b")
    return graph.select("a", "b", same.alias("same"), "s")


def descend(graph: DataFrame, unit: DataFrame, links: DataFrame, link: float, floor: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Refine the graph (a, b, s) by neighbours of neighbours in other components until no list changes.

    links (a, b) are those known. Returns the graph, the links and their components (id, component_id).
    """
    of, sizes = checkpoint(components(links)), None
    graph = checkpoint(shortened(told_apart(graph.union(graph.select("b", "a", "s")), of), None, LIST))
    while True:
        before, full = links, None
        for _ in range(ROUNDS):
            two = graph.select("a", F.col("b").alias("m")).join(graph.select(F.col("a").alias("m"), "b"), "m").where("a < b").select("a", "b").distinct()
            two = two.join(graph.select("a", "b"), ["a", "b"], "left_anti")
            new = told_apart(two.withColumn("s", F.lit(0.0)), of).where("NOT same").select("a", "b")
            new = checkpoint(similarities(new, unit, floor).select("a", "b", F.lit(False).alias("same"), "s"))
            if not new.limit(1).count():
                break
            links = links.union(new.where(F.col("s") >= link).select("a", "b"))
            old, graph = graph, checkpoint(shortened(graph.union(new).union(new.select(F.col("b").alias("a"), F.col("a").alias("b"), "same", "s")), sizes, LIST))
            full = saturated(graph, sizes, link)
            if full is not None:
                grown = full.select("a", F.least(2 * F.col("k"), F.lit(LARGEST)).alias("k"))
                sizes = checkpoint(grown if sizes is None else sizes.union(grown).groupBy("a").agg(F.max("k").alias("k")))
            elif not graph.join(old, ["a", "b"], "left_anti").limit(1).count():
                break
        if links is before:
            return graph.select("a", "b", "s"), links, of
        links = checkpoint(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        of = checkpoint(components(links))
        if full is None:
            return graph.select("a", "b", "s"), links, of
        graph, sizes = checkpoint(told_apart(graph.select("a", "b", "s"), of)), None


def saturated(graph: DataFrame, sizes: DataFrame | None, link: float) -> DataFrame | None:
    """(a, k): the lists of others that are full, by their own size k, of nothing but links: they may hide more of them."""
    lists = graph.where("NOT same").groupBy("a").agg(F.count("*").alias("n"), F.min("s").alias("worst")).where((F.col("worst") >= link) & (F.col("n") >= LIST))
    lists = lists.withColumn("k", F.lit(LIST)) if sizes is None else lists.join(sizes, "a", "left").withColumn("k", F.coalesce("k", F.lit(LIST)))
    full = lists.where("n >= k").select("a", "k")
    return full if full.limit(1).count() else None


def audit(unit: DataFrame, near: DataFrame, of: DataFrame, link: float, queries: int = AUDIT) -> tuple[int, int]:
    """(links of the query vectors in truth, those that are found): brute force over all vectors.

    Links inside a component are all counted later, so a link is found when its ends are in one. The queries are at
    most ``queries`` vectors, half of them from near (id), the vectors that have neighbours at all, by a hash of their id.
    """
    pick = lambda frame, k: frame.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(k)
    ids = pick(near.select("id"), queries // 2).union(pick(unit.select("id"), queries - queries // 2)).distinct()
    chosen = unit.join(F.broadcast(ids), "id", "left_semi").select("id", "vec").collect()
    if not chosen:
        return 0, 0
    ids = np.array([r["id"] for r in chosen])
    by_size = {n: [i for i, r in enumerate(chosen) if len(r["vec"]) == n] for n in {len(r["vec"]) for r in chosen}}
    blobs = [bytes(r["vec"]) for r in chosen]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, vecs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for n, at in by_size.items():
                here = [i for i, v in enumerate(vecs) if len(v) == n]
                if here:
                    r, c = np.nonzero(matrix(blobs[i] for i in at) @ matrix(vecs[i] for i in here).T >= link)
                    a, b = ids[np.array(at)[r]], own[np.array(here)[c]]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    truth = unit.select("id", "vec").mapInArrow(apply, "a long, b long")
    pairs = truth.join(of.select(F.col("id").alias("a"), F.col("component_id").alias("x")), "a", "left").join(of.select(F.col("id").alias("b"), F.col("component_id").alias("y")), "b", "left")
    return tuple(pairs.agg(F.count("*"), F.count_if(F.col("x") == F.col("y"))).first())


def counted_links(unit: DataFrame, members: DataFrame, link: float) -> DataFrame:
    """(id, linked): how many other rows each vector is linked with, comparing all vectors of a component in blocks.

    unit: (id, vec, copies); members: (id, component_id). Small components go to a task together; a large one is dealt
    into strips, and each strip meets each other strip once.
    """
    strips = checkpoint(members.groupBy("component_id").agg(F.ceil(F.count("*") / F.lit(float(STRIP // 8))).cast("int").alias("strips")))
    deal = F.when(F.col("strips") > 1, F.col("component_id")).otherwise(-1 - F.pmod(F.xxhash64("component_id"), F.lit(members.count() // BLOCK + 1)))
    own = members.join(small(strips), "component_id").withColumn("deal", deal).join(unit, "id")
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.col("strips")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("strips") - 1))
    names = ["deal", "block", "other", "c", "id", "vec", "copies"]
    left = own.withColumn("to", each).select(*(F.col(k).alias(n) for n, k in zip(names, ["deal", "block", "to", "component_id", "id", "vec", "copies"])))
    right = own.withColumn("to", each).select(*(F.col(k).alias(n) for n, k in zip(names, ["deal", "to", "block", "component_id", "id", "vec", "copies"])))

    def apply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, linked = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        others = dict(list(b.groupby("c")))
        for c, own in a.groupby("c"):
            if (other := others.get(c)) is not None:
                x, y, copies, mine = matrix(own["vec"]), matrix(other["vec"]), other["copies"].to_numpy(), own["id"].to_numpy()
                ids.append(mine)
                linked += [((x[i : i + BLOCK] @ y.T >= link) & (mine[i : i + BLOCK, None] != other["id"].to_numpy())) @ copies for i in range(0, len(mine), BLOCK)]
        return pd.DataFrame({"id": np.concatenate(ids), "linked": np.concatenate(linked).astype(np.int64)})

    keys = ["deal", "block", "other"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(apply, "id long, linked long")
    return found.groupBy("id").agg(F.sum("linked").alias("linked"))


def searched(unit: DataFrame, n: int, link: float) -> DataFrame:
    """(id, component_id) of the linked vectors of unit (id, vec), found by the search or, if the audit stays short, by all pairs."""
    floor, links, graph, start = max(0.0, 2 * link * link - 1), None, None, 0
    planned = trees_for(n, link)
    for end in (planned + TREES * k for k in range(MORE + 1)):
        for at in range(start, end, TREES):
            leaves = tree_leaves(unit, n, range(at, min(at + TREES, end)), LEAF)
            found = checkpoint(leaf_neighbours(leaves, LIST, floor, link))
            stars, more = found.where("s IS NULL").select("a", "b"), found.where("s IS NOT NULL")
            links = stars if links is None else links.union(stars)
            graph = more if graph is None else graph.union(more)
        start = end
        graph, links, of = descend(graph, unit, links, link, floor)
        total, seen = audit(unit, graph.select(F.col("a").alias("id")).distinct(), of, link, max(AUDIT, int(np.ceil(np.sqrt(n)))))
        if seen >= RECALL * total:
            return of
    return components(all_pairs(unit, link))


def embedding_dedup(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", link: float = LINK) -> DataFrame:
    """One row per row of rows: its id, n_links, component_id, kept.

    Vectors are linked when their cosine in double precision is at least ``link``. n_links counts the other rows that
    a vector is linked with. Vectors that are null, empty, zero or hold a null or a value that is not finite link with
    nothing, vectors of different length not with each other. A null id gets component_id null and is kept. Each row is a
    vector of its own: rows that repeat a vector are links of each other, under one id or several, and different vectors
    under one id have links and a component each. Empty tables give no rows.
    """
    read = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    parsed = checkpoint(vectors(read).withColumn("d", F.xxhash64("vec")).withColumn("e", F.hash("vec")))
    valid = parsed.where("vec IS NOT NULL AND id IS NOT NULL")
    classes = checkpoint(valid.groupBy("d", "e").agg(F.min("id").alias("lead"), F.count("*").alias("copies")))
    #: the vertex of a distinct vector: its smallest id, or a hash where this id already stands for another vector
    first = classes.groupBy("lead").agg(F.min(F.struct("d", "e")).alias("first"))
    own = F.when(F.struct("d", "e") == F.col("first"), F.col("lead")).otherwise(F.xxhash64("lead", "d", "e"))
    classes = checkpoint(classes.join(first, "lead").select("d", "e", "lead", "copies", own.alias("vertex")))
    unit = valid.join(classes, ["d", "e"]).where("id = lead").dropDuplicates(["vertex"]).select(F.col("vertex").alias("id"), "vec", "copies")
    unit = checkpoint(unit)
    of = checkpoint(searched(unit.select("id", "vec"), unit.count(), link))
    inner = counted_links(unit, of, link)
    found = classes.join(of.withColumnRenamed("id", "vertex"), "vertex", "left").join(inner.withColumnRenamed("id", "vertex"), "vertex", "left")
    found = checkpoint(found.withColumn("root", F.coalesce("component_id", "vertex")))
    least = found.groupBy("root").agg(F.min("lead").alias("c"))
    known = found.join(least, "root").select("d", "e", "c", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n"))
    bad = F.col("vec").isNull() | F.col("id").isNull()
    out = parsed.withColumn("bad", bad).join(known, ["d", "e"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("bad"), 0).otherwise(F.col("n")).cast("long").alias("n_links"),
        F.when(F.col("bad"), F.col("id")).otherwise(F.col("c")).alias("component_id"),
        (F.col("bad") | (F.col("c") == F.col("id"))).alias("kept"),
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
