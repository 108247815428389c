"""Conversation prefix trie in balanced parentheses.

Conversations are sorted by the digests of their turns, so that those with a common beginning stand together, and dealt to
tasks by ranges of this order, whatever prefix or whole conversation is frequent. A task cuts its run into shards of
bounded size. The trie of a shard is one sequence of parentheses in preorder; matching parentheses are found by range
minima of the excess over blocks, and whatever a node sums over its subtree is a difference of two cumulative arrays.

Neighbouring shards share a spine: the nodes on the path that the last conversation of the one and the first of the
other have in common. Of these nodes a shard only has a part. All that is asked of a node adds up over its parts, once it
is known how long the common path is: a child, or a node's own text, counts in the shard that opens it first, a leaf in
the shard where it ends. Spines are merged by their key; all other nodes are complete where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, small, table

#: Turns (and conversations) of a shard, about; bytes of a turn's digest; parentheses of a block.
SHARD_TURNS, DIGEST, BLOCK = 100_000, 16, 64
#: Conversations of a group share the first of them as a base, of which at most BASE_TURNS - 1 turns are taken over.
GROUP, BASE_TURNS = 100, 6
NOTHING = hashlib.sha256(b"").hexdigest()
COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


class Parentheses:
    """A sequence of balanced parentheses (1 opens, 0 closes) with a tree of minima of its excess."""

    def __init__(self, bits: np.ndarray) -> None:
        self.opens = np.flatnonzero(bits)
        self.excess = np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
        blocks = 1 << max(0, (-(-len(bits) // BLOCK) - 1).bit_length())
        self.padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        self.padded[: len(bits)] = self.excess
        self.minima = [self.padded.reshape(-1, BLOCK).min(axis=1)]
        while len(self.minima[-1]) > 1:
            self.minima.append(self.minima[-1].reshape(-1, 2).min(axis=1))
        leaf = np.zeros(len(bits) + 1, dtype=np.int64)
        leaf[1 : len(bits)] = (bits[:-1] == 1) & (bits[1:] == 0)
        #: leaf pairs that open before a place
        self.leaves = np.cumsum(leaf)

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The place where each of the opening parentheses closes: the first later one with a smaller excess.

        The rest of the own block is read; then the tree of minima is climbed to the first block that goes low enough.
        """
        goal, at = self.excess[opens] - 1, opens + 1
        out = np.full(len(opens), -1, dtype=np.int64)
        todo = np.arange(len(opens))
        while len(todo):
            hit = self.padded[at[todo]] == goal[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] % BLOCK != 0]
        todo = np.flatnonzero(out < 0)
        block, level = at[todo] // BLOCK, np.zeros(len(todo), dtype=np.int64)
        climbing = np.arange(len(todo))
        for k, minima in enumerate(self.minima):
            low = minima[block[climbing]] <= goal[todo[climbing]]
            level[climbing[low]] = k
            climbing = climbing[~low]
            block[climbing] = (block[climbing] + 1) // 2 if k + 1 < len(self.minima) else 0
        for k in range(len(self.minima) - 1, 0, -1):
            down = np.flatnonzero(level == k)
            left = 2 * block[down]
            block[down] = left + (self.minima[k - 1][left] > goal[todo[down]])
            level[down] = k - 1
        rows = self.padded.reshape(-1, BLOCK)[block]
        out[todo] = block * BLOCK + (rows == goal[todo][:, None]).argmax(axis=1)
        return out


def _minima(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The smallest of values[start:end], for each of many ranges that are not empty."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    out = np.empty(len(starts), dtype=np.int64)
    power = np.log2(ends - starts).astype(np.int64)
    for k in np.unique(power):
        i = np.flatnonzero(power == k)
        out[i] = np.minimum(levels[k][starts[i]], levels[k][ends[i] - (1 << k)])
    return out


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * DIGEST] == b[: middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def _key(path: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(path, digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


NODE_SCHEMA = (
    "shared boolean, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "parent_conv_id long, key1 long, key2 long, parent1 long, parent2 long, piece_from long, piece string"
)
_ARROW = pa.schema(
    [(name, {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}[kind]) for name, kind in (x.split() for x in NODE_SCHEMA.split(", "))]
)


def shard_nodes(rows: list[tuple[int, bytes, list[int]]], before: int, after: int) -> pa.RecordBatch:
    """The nodes of a shard: complete ones as they are, and the parts of those that neighbours share.

    rows: (conv_id, path, lengths of the turns) in order. before: turns in common with the conversation before the shard,
    after: with the one behind it; -1 if there is none.
    """
    depth, length, parent, spine, bits, end = [0], [0], [-1], [0], bytearray(b"\x01"), []
    last = b""
    for _, path, lengths in rows:
        turns, same = len(path) // DIGEST, common_turns(last, path)
        first, new = len(depth), turns - same
        bits += b"\x00" * (len(spine) - 1 - same) + b"\x01" * new
        depth.extend(range(same + 1, turns + 1))
        length.extend(lengths[same:])
        if new:
            parent.append(spine[same])
            parent.extend(range(first, first + new - 1))
        spine[same + 1 :] = range(first, first + new)
        end.append(spine[turns])
        last = path
    bits += b"\x00" * len(spine)
    tree = Parentheses(np.frombuffer(bytes(bits), dtype=np.uint8))
    n = len(depth)
    depth, length, parent = (np.array(x, dtype=np.int64) for x in (depth, length, parent))
    close = tree.find_close(tree.opens)
    behind = np.searchsorted(tree.opens, close)
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    cumulated = lambda x: np.concatenate(([0], np.cumsum(x)))
    subtree = lambda sums: sums[behind] - sums[:n]
    ends = cumulated(np.bincount(end, minlength=n))
    members = subtree(ends)
    opened = np.ones(n, dtype=np.int64)
    opened[: before + 1] = 0
    children = np.bincount(parent[1:], weights=opened[1:], minlength=n).astype(np.int64)
    leaves = tree.leaves[close + 1] - tree.leaves[tree.opens]
    if after == len(last) // DIGEST:
        leaves[spine] -= 1
    saved = subtree(cumulated(members * length)) - subtree(cumulated(length * opened))
    least = _minima(ids, ends[:n], ends[behind])
    shared = np.zeros(n, dtype=bool)
    shared[: before + 1] = True
    shared[spine[: after + 1]] = True
    hashes, pieces, piece_from, keys = [None] * n, [None] * n, [None] * n, [(None, None)] * n
    for i, text in _joined_ends(ids, ends, n):
        if shared[i]:
            pieces[i], piece_from[i] = text, int(ids[ends[i]]) if text else None
        else:
            hashes[i] = hashlib.sha256(text.encode()).hexdigest() if text else NOTHING
    for path, nodes in ((rows[0][1], range(before + 1)), (last, spine[: after + 1])):
        for d, i in enumerate(nodes):
            keys[i] = _key(path[: d * DIGEST])
    up = [(None, None)] + [keys[p] if shared[p] else (None, None) for p in parent[1:]]
    above = [None] + [None if shared[p] else int(least[p]) for p in parent[1:]]
    columns = [shared, depth, least, members, children, leaves, saved, hashes, above, *zip(*keys), *zip(*up), piece_from, pieces]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _joined_ends(ids: np.ndarray, ends: np.ndarray, n: int) -> Iterator[tuple[int, str]]:
    """(node, decimal ids of the conversations that end there, comma-joined; empty if none)."""
    texts = [str(i) for i in ids.tolist()]
    for i in range(n):
        yield i, ",".join(texts[ends[i] : ends[i + 1]])


def _shards(limit: int):
    """The nodes of all shards of a task, from rows (conv_id, path, lengths, part, before, after) in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, list[int]]] = []
        turns, before, after, part = 0, -1, -1, None
        for batch in batches:
            for c, path, lengths, p, b, a in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "path", "lengths", "part", "before", "after"))):
                if held and (p != part or turns >= limit):
                    same = after if p != part else common_turns(held[-1][1], path)
                    yield shard_nodes(held, before, same)
                    held, turns, before = [], 0, same
                if p != part:
                    part, before, after = p, b, a
                held.append((c, path, lengths))
                turns += 1 + len(lengths)
        if held:
            yield shard_nodes(held, before, after)

    return work


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(part, before, after) of parts in order, from their first and last paths."""
    rows = [r for f in frames for r in zip(f["part"], f["first"], f["last"])]
    if not rows:
        return
    between = [-1, *(common_turns(bytes(a[2]), bytes(b[1])) for a, b in zip(rows, rows[1:])), -1]
    yield pd.DataFrame({"part": [int(r[0]) for r in rows], "before": between[:-1], "after": between[1:]}, dtype=np.int64)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key1, key2, ends_sha256) from pieces in the order of keys and first ids; a node's ids stream through one hash."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"key1": key[0], "key2": key[1], "ends_sha256": state.hexdigest()}], pa.schema([("key1", pa.int64()), ("key2", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        for a, b, piece in zip(*(batch.column(k).to_pylist() for k in ("key1", "key2", "piece"))):
            if (a, b) != key:
                if key:
                    yield row()
                key, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
    if key:
        yield row()


def turn_digest(role: Column, text: Column) -> Column:
    """The first ``DIGEST`` bytes of a turn's SHA-256 in hex."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digest and length; texts are not moved.

    Turns stand by their number, null first, those with the same number by their digest. A null role or text is empty,
    rows without a conv_id are none of any conversation, a repeated row is one more turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct("turn", turn_digest(role, text).alias("digest"), F.length(text).alias("n"))
    found = turns.where("conv_id IS NOT NULL").select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return found.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["n"].alias("n"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the base (conv_id - conv_id % 100), then the own ones after the first h; h = crc32(conv_id) % 6."""
    base, shared = F.col("conv_id") - F.col("conv_id") % GROUP, F.crc32(F.col("conv_id").cast("string").cast("binary")) % BASE_TURNS
    heads = conversations.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.slice("turns", 1, BASE_TURNS - 1).alias("head"))
    both = conversations.withColumn("base", base).join(heads, "base", "left").withColumn("h", shared.cast("int"))
    kept = F.slice(F.coalesce("head", F.array().cast(both.schema["turns"].dataType)), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(kept, own).alias("turns"))


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, turns), each conv_id once.

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. No conversation, no node. One conversation's digests stand in one row (36 bytes a turn); a shard holds
    ``shard_turns`` turns, or one longer conversation. The ids of conversations that are all the same are hashed in one
    stream, as the digest asks for, but joined to one text a shard before.
    """
    digests = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    paths = checkpoint(conversations.select("conv_id", F.unhex(digests).alias("path"), F.transform("turns", lambda t: t["n"]).alias("lengths")))
    order = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    dealt = checkpoint(order.withColumn("part", F.spark_partition_id().cast("long")))
    bounds = dealt.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    ties = checkpoint(bounds.repartition(1).sortWithinPartitions("part").mapInPandas(_neighbours, "part long, before long, after long"))
    again = dealt.join(small(ties), "part").repartitionByRange("part").sortWithinPartitions("part", "path", "conv_id")
    nodes = checkpoint(again.mapInArrow(_shards(shard_turns), NODE_SCHEMA))
    parts, key = nodes.where("shared"), ["key1", "key2"]
    sums = [F.sum(c).alias(c) for c in COUNTS]
    first = [F.first(c).alias(c) for c in ("depth", "parent1", "parent2")]
    spine = checkpoint(parts.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), *first, *sums))
    pieces = parts.where("piece <> ''").select(*key, "piece_from", "piece")
    hashes = pieces.repartition(*key).sortWithinPartitions(*key, "piece_from").mapInArrow(_digests, "key1 long, key2 long, ends_sha256 string")
    spine = spine.join(hashes, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    columns = ["conv_id", "depth", *COUNTS, "ends_sha256"]
    complete = nodes.where("NOT shared").select(*columns, "parent_conv_id", "parent1", "parent2")
    least = small(checkpoint(spine.select(F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("__up"))))
    everything = complete.union(spine.select(*columns, F.lit(None).cast("long").alias("parent_conv_id"), "parent1", "parent2"))
    joined = everything.join(least, ["parent1", "parent2"], "left")
    return joined.select("conv_id", "depth", F.coalesce("parent_conv_id", "__up").alias("parent_conv_id"), *COUNTS, "ends_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(checkpoint(gathered(turns))))


#: CRC-32 of a text of digits, bit by bit: the polynomial, start and final complement are those of the standard.
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda s: ascii(s)::BIGINT)), "
    "lambda a, b: list_reduce(list_concat([xor(a, b)], range(1, 9)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"
)
ORACLE = f"""
WITH d AS (SELECT conv_id, turn, length(coalesce(text, '')) n,
                  left(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 32) dg
           FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) rn FROM d),
c AS (SELECT DISTINCT conv_id c, conv_id - conv_id % 100 b, {_CRC.format("conv_id::VARCHAR")} % 6 h FROM t),
m AS (SELECT c.*, (SELECT count(*) FROM t WHERE t.conv_id = c.b AND rn <= c.h) m FROM c),
r AS (SELECT c, rn d, dg, n FROM m JOIN t ON t.conv_id = b AND rn <= h
      UNION ALL SELECT c, m + rn - h, dg, n FROM m JOIN t ON t.conv_id = c AND rn > h),
p AS (SELECT c, d, n, string_agg(dg, '') OVER (PARTITION BY c ORDER BY d) path FROM r UNION ALL SELECT c, 0, 0, '' FROM c),
e AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) ids FROM (SELECT c, arg_max(path, d) path FROM p GROUP BY c) GROUP BY path),
v AS (SELECT path, d, min(n) n, min(c) conv_id, count(*) k FROM p GROUP BY path, d),
k AS (SELECT left(path, 32 * (d - 1)::INT) path, count(*) n_children FROM v WHERE d > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) n_children, coalesce(ids, '') ids FROM v LEFT JOIN k USING (path) LEFT JOIN e USING (path)),
s AS (SELECT left(path, 32 * a::INT) path, sum((k - 1) * n) saved, count(*) FILTER (n_children = 0) n_leaves
      FROM (SELECT *, unnest(range(0, d + 1)) a FROM w) GROUP BY 1)
SELECT w.conv_id::BIGINT conv_id, w.d::BIGINT depth, u.conv_id::BIGINT parent_conv_id, w.k::BIGINT n_convs, w.n_children::BIGINT n_children,
       n_leaves::BIGINT n_leaves, saved::BIGINT saved_tokens, sha256(w.ids) ends_sha256
FROM w JOIN s USING (path) LEFT JOIN v u ON w.d > 0 AND u.path = left(w.path, 32 * (w.d - 1)::INT) AND u.d = w.d - 1
"""
