"""Sharding by a minimax contiguous partition.

Rows with equal texts are an atomic group. Groups stand in the order of a 64-bit hash of their text, and the order is cut
into shards so that the largest shard is as small as any cutting of this order allows: a binary search over the shard
capacity, checked greedily. As the order is the hash itself, a row's shard follows from its own text and the few cuts,
without a join, however large its group is.

The order is never sorted or collected for the search. It works on sums of sizes over ranges of hashes: with ranges taken as
whole, the search gives a capacity that is surely enough; with ranges taken as divisible, one below which none is enough.
Only ranges in which a cut can fall between the two are divided further, until both agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, small, table

SHARDS = 40
#: Bytes that a row takes besides its text.
OVERHEAD = 16
#: Leading bits of a hash that name a range at first, and more bits for each division.
FIRST_BITS, MORE_BITS = 16, 6
#: A range with more than this part of a mean shard is always divided.
FINE = 64


@dataclass
class Ranges:
    """Consecutive ranges of hashes: leading bits and their number, last hash that occurs, bytes, whether it is one group."""

    bits: np.ndarray
    prefix: np.ndarray
    last: np.ndarray
    size: np.ndarray
    whole: np.ndarray

    @classmethod
    def of(cls, rows: list, bits: int) -> Ranges:
        rows = sorted((r["prefix"], r["last"], r["size"], r["n"]) for r in rows)
        prefix, last, size, n = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
        return cls(np.full(len(rows), bits), prefix, last, size, n == 1)

    def with_parts(self, divided: np.ndarray, parts: Ranges) -> Ranges:
        """The ranges, with parts in place of the divided ones."""
        names = ("bits", "prefix", "last", "size", "whole")
        joined = [np.concatenate((getattr(self, k)[~divided], getattr(parts, k))) for k in names]
        order = np.argsort(joined[2], kind="stable")
        return Ranges(*(x[order] for x in joined))


class Cutting:
    """Greedy checks of a capacity over consecutive sizes; places are bytes from the start."""

    def __init__(self, ranges: Ranges, shards: int) -> None:
        self.ends = np.concatenate(([0], np.cumsum(ranges.size)))
        self.whole, self.shards, self.total = ranges.whole, shards, int(self.ends[-1])

    def reach(self, at: int, capacity: int, divisible: bool) -> int:
        """The farthest place that a shard from at gets to."""
        goal = at + capacity
        if goal >= self.total:
            return self.total
        i = int(np.searchsorted(self.ends, goal, side="right")) - 1
        return goal if divisible and not self.whole[i] else max(at, int(self.ends[i]))

    def places(self, capacity: int, divisible: bool) -> list[int]:
        """Where the shards end one after the other."""
        out, at = [], 0
        for _ in range(self.shards):
            at = self.reach(at, capacity, divisible)
            out.append(at)
        return out

    def capacity(self, divisible: bool) -> int:
        """The smallest one that is enough."""
        low, high = -(-self.total // self.shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.places(middle, divisible)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def even(self, capacity: int) -> list[int]:
        """Ends of shards within capacity, each as near to its even share as the capacity lets it be."""
        ends, first, at = self.ends, [], self.total
        for _ in range(self.shards):
            first.append(at)
            at = int(ends[np.searchsorted(ends, at - capacity)]) if at > capacity else 0
        out, at = [], 0
        for j, least in enumerate(reversed(first), 1):
            share = self.total * j / self.shards
            i = min(int(np.searchsorted(ends, share)), len(ends) - 1)
            near = ends[i - 1] if i and share - ends[i - 1] < ends[i] - share else ends[i]
            at = min(max(int(near), least, at), self.reach(at, capacity, False))
            out.append(at)
        return out


@dataclass
class Plan:
    """Where each hash goes: shard j ends with the hash cuts[j]; groups above an even share have a shard of their own."""

    shards: int
    capacity: int
    cuts: list[int] = field(default_factory=list)
    alone: list[int] = field(default_factory=list)

    def shard(self, key: Column) -> Column:
        """The shard of a hash, a whole number below ``shards``."""
        out = sum((F.when(key > c, 1).otherwise(0) for c in self.cuts), F.lit(0))
        for i, heavy in enumerate(self.alone):
            out = F.when(key == heavy, self.shards - len(self.alone) + i).otherwise(out)
        return out.cast("int")


def group_key(text: Column) -> Column:
    """The hash that orders the groups; null counts as empty. Texts that share a hash by chance are one group."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ranges_of(groups: DataFrame, bits: int, within: list[tuple[int, int]] | None = None) -> Ranges:
    """Sums over the ranges that the leading bits name, of all groups or of those in the given (bits, prefix) ranges."""
    parts = [groups]
    if within is not None:
        parts = []
        for b in sorted({b for b, _ in within}):
            named = groups.sparkSession.createDataFrame([(p,) for n, p in within if n == b], "p long")
            parts.append(groups.join(F.broadcast(named), F.shiftright("key", 64 - b) == F.col("p"), "left_semi"))
    found = []
    for part in parts:
        cell = F.shiftright("key", 64 - bits).alias("prefix")
        found += part.groupBy(cell).agg(F.max("key").alias("last"), F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    return Ranges.of(found, bits)


def plan_shards(groups: DataFrame, shards: int = SHARDS, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> Plan:
    """The cuts for groups (key, size), one row a key.

    A group that is larger than an even share of what is left gets a shard of its own; there are fewer than ``shards`` of
    those, and the smallest capacity is then theirs. The rest is cut into the other shards. The driver sees at most
    2^first_bits sums and, for each division, those of the ranges around ``shards`` cuts.
    """
    largest = [(r["size"], r["key"]) for r in groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect()]
    left, free, alone = groups.agg(F.sum("size")).first()[0] or 0, shards, []
    for size, key in largest:
        if size * free <= left:
            break
        alone.append(key)
        left, free = left - size, free - 1
    capacity = largest[0][0] if alone else 0
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    if not left:
        return Plan(shards, capacity, [], alone)
    ranges, bits = ranges_of(rest, first_bits), first_bits
    while True:
        cutting = Cutting(ranges, free)
        divided = ~ranges.whole & (ranges.size * FINE * free > left)
        if not divided.any():
            enough, least = cutting.capacity(False), cutting.capacity(True)
            if enough == least:
                break
            starts = cutting.ends[:-1]
            for a, b in zip(cutting.places(least, False), cutting.places(enough, True)):
                divided |= ~ranges.whole & (starts <= b) & (cutting.ends[1:] >= a)
            if not divided.any():
                break
        bits = min(64, max(bits, int(ranges.bits[divided].max())) + more_bits)
        within = list(zip(ranges.bits[divided].tolist(), ranges.prefix[divided].tolist()))
        ranges = ranges.with_parts(divided, ranges_of(rest, bits, within))
    places = cutting.even(enough)
    cuts = [int(ranges.last[np.searchsorted(cutting.ends, p) - 1]) if p else np.iinfo(np.int64).min for p in places[:-1]]
    return Plan(shards, max(capacity, enough), [int(c) for c in cuts], alone)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of shards, with the task's number and each row's place among the task's rows of its shard."""
    part = TaskContext.get().partitionId()
    shard, seen = None, 0
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        place = np.arange(len(shards), dtype=np.int64)
        starts = np.flatnonzero(np.diff(shards, prepend=shards[:1] - 1)) if len(shards) else place
        for a, b in zip(starts, [*starts[1:], len(shards)]):
            if shards[a] != shard:
                shard, seen = shards[a], 0
            place[a:b] += seen - a
            seen += b - a
        numbers = [pa.array(np.full(len(shards), part, dtype=np.int64)), pa.array(place)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], names=[*batch.schema.names, "part", "place"])


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, size, text_crc32, law, shard, slot, grown_shard.

    The size is the UTF-8 bytes of the text and ``OVERHEAD``. The law is ``bytes``: sizes of shards are near equal, as far
    as equal texts, which stay together, allow it. Slots number the rows of a shard from 0, by the hash of the text, then by
    id. A null text counts as empty, null ids come first, rows that repeat an id or a whole row count one by one; an empty
    table gives no rows, other columns are not read. With fewer groups than shards, some shards stay empty.
    ``grown_shard`` is null: a further shard would move cuts.

    Rows are numbered after a range sort by shard, hash, id and a row number, so that no group and no shard meets in one
    task; a shard's slots continue from task to task by counts of rows per task and shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpoint(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(OVERHEAD).cast("long")).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            group_key(F.col(text_col)).alias("key"),
        )
    )
    plan = plan_shards(checkpoint(rows.groupBy("key").agg(F.sum("size").alias("size"))), shards)
    placed = rows.withColumn("shard", plan.shard(F.col("key"))).withColumn("row", F.monotonically_increasing_id())
    order = placed.repartitionByRange("shard", "key", "id", "size", "row").sortWithinPartitions("shard", "key", "id").drop("row", "key")
    schema = f"id {dict(rows.dtypes)['id']}, size long, text_crc32 long, shard int, part long, place long"
    numbered = checkpoint(order.mapInArrow(_numbered, schema))
    counts = numbered.groupBy("part", "shard").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpoint(counts.select("part", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")))
    return numbered.join(small(offsets), ["part", "shard"]).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text_col: str = "text") -> Plan:
    """Write docs, whole, to one folder a shard under path; the plan that was followed."""
    sizes = docs.select(group_key(F.col(text_col)).alias("key"), (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(OVERHEAD).cast("long")).alias("size"))
    plan = plan_shards(checkpoint(sizes.groupBy("key").agg(F.sum("size").alias("size"))), shards)
    docs.withColumn("shard", plan.shard(group_key(F.col(text_col)))).write.partitionBy("shard").parquet(path)
    return plan


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
