"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Documents with one shingle set are collapsed first. The others get BANDS * ROWS minima from a single pass over their
shingle hashes; an empty bin takes the minimum of a full bin that its own fixed random order names. Documents that
agree on a band share a bucket, and buckets with the same members are one. A bucket does not yield its pairs: all
members meet one centre, the member that shares the most buckets, and the links that hold on the full sets make
components. Where a bucket still has more than one component, the members outside the centre's component meet the
members of other components by their sets, block by block inside tasks; only pairs that are near leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHasher, checkpoint, components, portions, release, small, splitmix, table

BANDS, ROWS = 40, 6
#: Bytes of the sets of a bucket's members that meet as many others in one task, about.
BLOCK = 4_000_000
#: A set of which one in HEAVY rows or more are copies is joined by broadcast; there are HEAVY of them at most.
HEAVY = 500
EMPTY = U64(0xFFFFFFFFFFFFFFFF)

_hasher: list[WordHasher] = []


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``words`` words of each text, repeats included, and their number per text.

    A text with fewer words has one run, all of its words; a text without words has none.
    """
    if not _hasher:
        _hasher.append(WordHasher())
    hashes, counts = _hasher[0].words(texts)
    number = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    starts = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(number.sum())
    length = np.repeat(np.minimum(counts, words), number)
    out = length.astype(U64)
    for k in range(words):
        inside = k < length
        out[inside] = splitmix(out[inside] * U64(0x100000001B3) + hashes[starts[inside] + k])
    return out, number


def fill_orders(bins: int) -> np.ndarray:
    """For each bin a fixed random order of all bins, in which it looks for a full one."""
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int, bins: int, orders: np.ndarray) -> np.ndarray:
    """The bins' minima of n sets, densified; rows of sets without members keep EMPTY."""
    table_ = np.full((n, bins), EMPTY, dtype=U64)
    at = ((hashes >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    np.minimum.at(table_.reshape(-1), owner * bins + at, (hashes << U64(32)) | (hashes >> U64(32)))
    full = table_ != EMPTY
    row, col = np.nonzero(~full & full.any(axis=1, keepdims=True))
    out = table_.copy()
    for step in range(bins):
        if not len(row):
            break
        source = orders[col, step]
        hit = full[row, source]
        out[row[hit], col[hit]] = table_[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    return out


def sets_of(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, number = shingles([t.encode(errors="surrogatepass").lower() for t in texts], words)
    return [np.unique(hashes[e - k : e]) for e, k in zip(np.cumsum(number), number)]


def minima(sets: list[np.ndarray], bins: int, orders: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return signatures(np.concatenate(sets) if sets else np.zeros(0, dtype=U64), owner, len(sets), bins, orders)


def sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, d1, d2, keys): d1, d2 tell the shingle set, keys are the hashes of the bands."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = fill_orders(bands * rows)
        for batch in batches:
            for part, texts in portions(batch, 1):
                sets, n = sets_of(texts, words), len(texts)
                d1, d2 = (np.array([splitmix(mix(s)).sum(dtype=U64) for s in sets], dtype=U64) for mix in (lambda s: s ^ U64(0x5555555555555555), lambda s: s + U64(0x1234567)))
                least = minima(sets, bands * rows, orders).reshape(n, bands, rows)
                keys = np.tile(splitmix(np.arange(bands, dtype=U64)), (n, 1))
                for r in range(rows):
                    keys = splitmix(keys * U64(0x100000001B3) + least[:, :, r])
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * bands)
                sizes = pa.array(np.array([len(s) for s in sets], dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), sizes, pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))],
                    ["id", "n_shingles", "d1", "d2", "keys"],
                )

    return docs.mapInArrow(apply, "id long, n_shingles long, d1 long, d2 long, keys array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, set): the sorted distinct shingle hashes as bytes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets_of(texts, words)], pa.binary())], ["id", "set"])

    return docs.mapInArrow(apply, "id long, set binary")


def shortened(sets: DataFrame) -> DataFrame:
    """(id, n, set): the upper halves of the sorted hashes as bytes. They may agree by chance, but none that agrees is lost."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                own = [np.frombuffer(x, dtype=U64) for x in part.column(1).to_pylist()]
                short = [(s >> U64(32)).astype(np.uint32).tobytes() for s in own]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array(short, pa.binary())], ["id", "n", "set"])

    return sets.mapInArrow(apply, "id long, n long, set binary")


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """edges (a, b) with ok: 100 * intersection >= percent * union on the full sets."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])
        release()

    edges = small(edges)
    left = sets.join(edges, F.col("id") == F.col("a")).select("a", "b", F.col("set").alias("x"))
    right = sets.join(edges, F.col("id") == F.col("b")).select("a", "b", F.col("set").alias("y"))
    return left.join(right, ["a", "b"]).select("a", "b", "x", "y").mapInArrow(apply, "a long, b long, ok boolean")


def buckets(sketches: DataFrame) -> DataFrame:
    """(bucket, id, n_shingles, members) of the buckets with several members; of buckets with the same members one."""
    n = sketches.select("id", "n_shingles", F.explode("keys").alias("bucket"))
    alike = [F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("first")]
    shared = n.groupBy("bucket").agg(*alike).where("members > 1")
    one = checkpoint(shared.groupBy("members", "x", "first").agg(F.min("bucket").alias("bucket"), F.count("*").alias("weight")))
    return checkpoint(n.join(small(one.select("bucket", "members", "weight")), "bucket"))


def unmet(members: DataFrame, centres: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of one bucket and different components whose shortened sets are near.

    In buckets with more than one component, the members outside the component of the centre meet all members, in
    blocks of about BLOCK bytes times BLOCK bytes.
    """
    own = members.select("bucket", "id", "n_shingles").join(found, "id", "left").select("bucket", "id", "n_shingles", F.coalesce("component_id", "id").alias("c"))
    main = centres.join(found, F.col("centre") == F.col("id"), "left").select("bucket", F.coalesce("component_id", "centre").alias("main"))
    own = own.join(main, "bucket").withColumn("other", F.col("c") != F.col("main"))
    size = 4 * F.col("n_shingles")
    blocks = lambda n: F.ceil(n / float(BLOCK)).cast("int")
    mixed = own.groupBy("bucket").agg(blocks(F.sum(F.when(F.col("other"), size))).alias("i"), blocks(F.sum(size)).alias("j")).where("i > 0")
    own = checkpoint(own.join(small(checkpoint(mixed)), "bucket").select("bucket", "id", "n_shingles", "c", "other", "i", "j"))
    wanted = shortened(sets.join(small(checkpoint(own.select("id").distinct())), "id", "left_semi"))
    #: so many buckets go to a task together that they have about 4 * BLOCK bytes
    deals = (own.agg(F.sum(size)).first()[0] or 0) // (4 * BLOCK) + 1
    own = own.join(checkpoint(wanted), "id")
    deal = F.pmod(F.xxhash64("bucket", F.lit(5)), F.lit(deals)).cast("int")
    spread = lambda side: F.pmod(F.xxhash64("id", F.lit(side)), F.col(side)).cast("int")
    each = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    keys, values = ["deal", "i", "j"], ["bucket", "id", "c", "n", "set"]
    columns = lambda i, j: [c.alias(k) for k, c in zip([*keys, *values], [deal, i, j, *map(F.col, values)])]
    left = own.where("other").withColumn("at", each("j")).select(*columns(spread("i"), F.col("at")))
    right = own.withColumn("at", each("i")).select(*columns(F.col("at"), spread("j")))

    def by_size(table_: pa.Table) -> pd.DataFrame:
        rows = pd.DataFrame({k: table_.column(k).to_numpy() for k in values[:-1]})
        rows["set"] = [np.frombuffer(x, dtype=np.uint32) for x in table_.column("set").to_pylist()]
        return rows.sort_values(["bucket", "n"], kind="stable")

    def apply(x: pa.Table, y: pa.Table) -> pa.Table:
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        if x.num_rows and y.num_rows:
            theirs = dict(list(by_size(y).groupby("bucket")))
            for bucket, mine in by_size(x).groupby("bucket"):
                if bucket in theirs:
                    pairs += near_pairs(mine, theirs[bucket], percent)
        found = np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(apply, "a long, b long").distinct()


def near_pairs(x: pd.DataFrame, y: pd.DataFrame, percent: int) -> Iterator[np.ndarray]:
    """Pairs of ids of x and y (id, c, n, set; y by rising n) with different c whose sets are near."""
    ids, c, n = (y[k].to_numpy() for k in ("id", "c", "n"))
    known, codes = np.unique(np.concatenate(y["set"].to_list()), return_inverse=True)
    starts = np.cumsum(n) - n
    marked = np.zeros(len(known), dtype=np.int32)
    for id_, own, size, mine in zip(x["id"], x["c"], x["n"], x["set"]):
        #: only sizes that can be near
        low, high = np.searchsorted(n, [-(-percent * size // 100), 100 * size // percent + 1])
        if low == high:
            continue
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        at = at[known[at] == mine]
        marked[at] = 1
        end = starts[high] if high < len(starts) else len(codes)
        both = np.add.reduceat(marked[codes[starts[low] : end]], starts[low:high] - starts[low])
        marked[at] = 0
        near = (c[low:high] != own) & (100 * both >= percent * (n[low:high] + size - both))
        if near.any():
            hit = ids[low:high][near]
            yield np.column_stack([np.minimum(hit, id_), np.maximum(hit, id_)])


def near_components(docs: DataFrame, sketches: DataFrame, same: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component_id) of the rows of sketches that are linked; docs has the texts as (id, text), same further links."""
    members = buckets(sketches)
    degree = members.groupBy("id").agg(F.sum(F.col("members") * F.col("weight")).alias("degree"))
    degree = checkpoint(degree)
    sets = checkpoint(shingle_sets(docs.join(small(degree.select("id")), "id", "left_semi"), words).dropDuplicates(["id", "set"]))
    best = F.max(F.struct("degree", "id", "n_shingles")).alias("best")
    centres = checkpoint(members.join(small(degree), "id").groupBy("bucket").agg(best).select("bucket", F.col("best.id").alias("centre"), F.col("best.n_shingles").alias("size")))
    rays = members.join(small(centres), "bucket").where((F.col("id") != F.col("centre")) & (F.least("n_shingles", "size") * 100 >= percent * F.greatest("n_shingles", "size")))
    pairs = checkpoint(rays.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct())
    links = checkpoint(confirm(pairs, sets, percent).where("ok").select("a", "b").union(same))
    found = checkpoint(components(links))
    more = checkpoint(unmet(members, centres.select("bucket", "centre"), found, sets, percent).join(pairs, ["a", "b"], "left_anti"))
    more = checkpoint(confirm(more, sets, percent).where("ok").select("a", "b"))
    return checkpoint(components(links.union(more))) if more.limit(1).count() else found


def with_leads(rows: DataFrame, classes: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with the lead of their class (keys, lead, copies): the few large classes by broadcast, the others by a shuffle."""
    heavy = classes.where(F.col("copies") * HEAVY >= max(total, HEAVY)).select(*keys, F.col("lead").alias("large"))
    dealt = rows.join(F.broadcast(heavy), keys, "left")
    rest = dealt.where("large IS NULL").drop("large").join(classes.select(*keys, "lead"), keys)
    return dealt.where("large IS NOT NULL").withColumnRenamed("large", "lead").select(*rest.columns).union(rest)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: its id, n_shingles, component_id, kept.

    The set of a document is its distinct runs of ``words`` words (all of its words where there are fewer). Sets whose
    overlap is at least ``percent`` of their union are linked; component_id is the smallest id reachable. A null or
    blank text has an empty set, size 0, and stays alone. A null id is not linked: it gets component_id null and is
    kept. Rows that repeat an id are one vertex with the links of all their texts, n_shingles is each row's own. Other
    columns are not read; empty tables give no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = checkpoint(sketch(texts, words, bands, rows))
    own = ["n_shingles", "d1", "d2"]
    filled = sketches.where("n_shingles > 0 AND id IS NOT NULL")
    classes = checkpoint(filled.groupBy(*own).agg(F.min("id").alias("lead"), F.count("*").alias("copies")))
    total = classes.agg(F.sum("copies")).first()[0] or 0
    led = checkpoint(with_leads(filled.select("id", *own), classes, own, total).select("id", *own, "lead"))
    #: Only an id that is repeated with other texts joins classes.
    several = led.groupBy("id").agg(F.min("lead").alias("a"), F.max("lead").alias("z")).where("a < z").select("id", "a")
    same = led.join(several, "id").select("a", F.col("lead").alias("b")).where("a <> b").distinct()
    ones = filled.join(classes, own).where("id = lead").dropDuplicates(["id", *own]).select("id", "n_shingles", "keys")
    found = near_components(texts, ones, checkpoint(same), words, percent)
    linked = led.join(found.withColumnRenamed("id", "lead"), "lead", "left").select("id", "n_shingles", F.coalesce("component_id", "lead").alias("c"))
    out = linked.union(sketches.where("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("c").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two words, as the query's contract has it; the pipeline takes five."""
    return near_dedup(table(spark, sf_dir, "documents"), words=2)
