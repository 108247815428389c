"""Helpers shared by the text operators: tables, checkpoints, word hashing, components.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, which is exactly what ``bytes.lower().split()`` gives on the
UTF-8 bytes of a text.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
U64 = np.uint64
#: Paths in the shared folder that this process has written to.
_WRITTEN: list[str] = []
#: Tables of keys of up to this many bytes are broadcast, larger ones are joined with a shuffle.
BROADCAST_BYTES = 4_000_000
#: Edges that one task joins at the end of a search for components, at most.
FEW_EDGES = 1000
#: Rows and characters of texts that a task works on at a time, and bytes of which words are hashed at a time.
ROWS_AT_ONCE, CHARS_AT_ONCE, BYTES_AT_ONCE = 500, 250_000, 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names (spark.checkpoint.dir).

    Only a local session without that setting (a test) gets a folder of its own; a cluster without it is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str = "") -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_folder(spark)}/{name}{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def discard_written(spark: SparkSession) -> int:
    """Delete all that this process has put into the shared folder so far; the number of paths.

    To be called once results have been saved: frames that read these tables can't be worked out any more.
    """
    gone = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: df as a table that is written to the shared folder and read again.

    A table is smaller than the rows of df.checkpoint(), its size is known when joins are planned, and the plan after it
    starts without the filters and constraints of the plan before it, which grow in loops. Once it is written, the
    shuffle files behind it are of no more use and go, instead of waiting for the driver's garbage collector.
    """
    spark = df.sparkSession
    path, cleanup = new_path(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The checkpointed df, with a broadcast hint if it is proven small: columns of fixed width, times the counted rows."""
    if not all(isinstance(f.dataType, (NumericType, BooleanType, DateType)) for f in df.schema.fields):
        return df
    rows = limit // (16 + 8 * len(df.columns))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until df has no such column."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in df.columns}:
            name = f"_{name}"
        out.append(name)
    return out


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a key depends on every bit of the input."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHasher:
    """64-bit hashes of the words of many texts at once, with prefix sums over their joined bytes."""

    def __init__(self, spaces: bytes = b" \t\n\x0b\f\r") -> None:
        """spaces: the bytes that stand between words."""
        self._letters = splitmix(np.arange(256, dtype=U64) + U64(1 << 20))
        lower = np.arange(256)
        lower[65:91] += 32
        self._letters = self._letters[lower]
        self._space = np.zeros(256, dtype=bool)
        self._space[np.frombuffer(spaces, dtype=np.uint8)] = True
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        base = 0x5851F42D4C957F2D
        self._up = np.full(n, base, dtype=U64)
        self._down = np.full(n, pow(base, -1, 1 << 64), dtype=U64)
        self._up[0] = self._down[0] = 1
        np.multiply.accumulate(self._up, out=self._up)
        np.multiply.accumulate(self._down, out=self._down)

    def words(self, texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple:
        """The hash of each word of the texts in order, and the number of words of each text.

        With prefixes, also an array per length of the hashes of the words' first bytes and whether more bytes follow.
        Long texts are worked on in parts that end between words.
        """
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        gaps = np.flatnonzero(self._space[data]) if len(data) > BYTES_AT_ONCE else None
        parts, at = [], 0
        while at < len(data):
            end = len(data)
            if end - at > BYTES_AT_ONCE:
                k = np.searchsorted(gaps, at + BYTES_AT_ONCE)
                end = int(gaps[k - 1 if k and gaps[k - 1] > at else k]) + 1
            parts.append(self._part(data[at:end], at, prefixes))
            at = end
        starts, hashes, *cut = (np.concatenate(p) for p in zip(*parts))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
        return (hashes, counts, cut) if prefixes else (hashes, counts)

    def _part(self, data: np.ndarray, offset: int, prefixes: tuple[int, ...]) -> list[np.ndarray]:
        """Places and hashes of the words of data, which ends with a space, and the hashes of their prefixes."""
        if len(data) > len(self._up):
            self._powers(2 * len(data))
        gap = self._space[data]
        before = np.concatenate(([True], gap[:-1]))
        starts = np.flatnonzero(before & ~gap)
        ends = np.flatnonzero(gap & ~before)
        sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(self._letters[data] * self._up[: len(data)], out=sums[1:])
        down = self._down[starts]
        whole = splitmix((sums[ends] - sums[starts]) * down)
        cut = [splitmix((sums[np.minimum(starts + k, ends)] - sums[starts]) * down + (starts + k < ends) + U64(2 * k)) for k in prefixes]
        return [starts + offset, whole, *cut]


def slices(texts: list, limit: int = CHARS_AT_ONCE):
    """(from, to) runs of texts of about limit characters; a longer text is a run of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def release() -> None:
    """Give freed memory back to the system, so that a worker waits for its next task without the buffers of this one."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of ROWS_AT_ONCE rows and about CHARS_AT_ONCE characters, each with the texts of a column (null as empty)."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(at, ROWS_AT_ONCE)
        texts = [t or "" for t in part.column(column).to_pylist()]
        for a, b in slices(texts):
            yield part.slice(a, b - a), texts[a:b]
    release()


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, p): each vertex of a few edges with one vertex of its component."""
    root: dict[int, int] = {}
    for frame in frames:
        for pair in zip(frame["a"].tolist(), frame["b"].tolist()):
            ends = []
            for v in pair:
                while root.setdefault(v, v) != v:
                    root[v] = v = root[root[v]]
                ends.append(v)
            root[max(ends)] = min(ends)
    out = {}
    for v in root:
        p = v
        while root[p] != p:
            p = root[p]
        out[v] = p
    yield pd.DataFrame({"u": list(out), "p": list(out.values())}, dtype=np.int64)


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(id, component_id) for every vertex of edges (a, b): component_id is the smallest id reachable.

    The graph is contracted: in each round every vertex moves to the neighbour, or that neighbour's choice, with the
    smallest hash under a seed of the round, and edges move along. At least half of the vertices are expected to go
    in a round, whatever the graph looks like, so a chain takes a logarithmic number of rounds. Neighbours are
    aggregated before they are shuffled. The last ``few`` edges are joined in one task. Only counts come to the driver;
    each round cuts its lineage.
    """
    left = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while left.limit(few + 1).count() > few:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("v"))
        both = left.select(F.col("a").alias("u"), rank("b").alias("v")).union(left.select(F.col("b"), rank("a")))
        best = both.groupBy("u").agg(F.min("v").alias("v"))
        one = checkpoint(best.select("u", F.least("v", rank("u"))["v"].alias("p")))
        moves.append(checkpoint(one.join(small(one).select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"))))
        to = small(moves[-1])
        for end in ("a", "b"):
            left = left.join(to.withColumnRenamed("u", end), end).withColumn(end, F.col("p")).drop("p")
        left = checkpoint(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves.append(checkpoint(left.coalesce(1).mapInPandas(_joined, "u long, p long")))
    found = moves.pop()
    while moves:
        found = moves.pop().join(small(found).select(F.col("u").alias("p"), F.col("p").alias("q")), "p", "left").select("u", F.coalesce("q", "p").alias("p"))
        found = checkpoint(found)
    least = checkpoint(found.groupBy("p").agg(F.min("u").alias("component_id")))
    return found.join(small(least), "p").select(F.col("u").alias("id"), "component_id")
