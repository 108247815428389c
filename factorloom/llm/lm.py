"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model predicts a text (A-Z lower-cased) byte by byte, then an end mark, from the last ORDER bytes. A trie of contexts counts which bytes followed; a byte that a context has not seen is escaped
to the context one byte shorter, without the bytes that the longer one has seen (symbol exclusion, escape
estimate of method C). The trie is a table of counts over the whole corpus, and every log probability is worked out
once per distinct (context, byte). Documents are dealt into blocks of BLOCK_CHARS characters; a block's distinct
entries are joined with the table and come back to the block, so no task ever holds the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHasher, checkpoint, release, slices, table

ORDER = 5
BLOCK_CHARS = 20_000_000
#: Characters that are worked on at a time.
SLICE = 500_000
#: Keys that a task holds before it joins equal ones: of a block, and for the counts, which are handed on from FULL distinct ones (Spark adds
#: them up before they are shuffled); rows of a batch that is handed on.
HELD, COUNTED, FULL, HANDED = 1_000_000, 1_000_000, 750_000, 250_000
LEAST_BLOCKS = 12
#: UTF-8 has neither of these bytes: what stands before a text, and its end.
START, END = b"\xfe", b"\xff"
#: The key of the end token among the words.
END_WORD = U64(1)
ENTRY, TOKEN = 0, 1

_hasher: list[WordHasher] = []


def entries(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The (context, byte) key of every predicted byte in order, the byte lowest, and their number per text."""
    data = [(t or "").encode().lower() + END for t in texts]
    joined = START * ORDER + (START * ORDER).join(data) + bytes(7)
    n = len(joined) - 7 - ORDER
    last = np.frombuffer(joined, dtype=np.uint8)[ORDER : ORDER + n]
    eight = np.ndarray((n,), dtype=">u8", buffer=joined, strides=(1,))  # the eight bytes from each place on
    keys = eight[last != START[0]].astype(U64) >> U64(8 * (7 - ORDER))
    return keys, np.array([len(d) for d in data])


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The key of every word of each text and of the end after it, and their number per text."""
    if not _hasher:
        _hasher.append(WordHasher())
    hashes, counts = _hasher[0].words([(t or "").encode().lower() for t in texts])
    return np.insert(hashes, np.cumsum(counts), END_WORD), counts + 1


KINDS = ((ENTRY, entries), (TOKEN, tokens))


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order. NumPy sorts integers much faster than its own hash table, which np.unique takes, finds them."""
    ordered = np.sort(keys)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One row per key of several tallies."""
    if len(parts) == 1:
        return parts[0]
    keys, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(n[order], starts)


def handed(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The columns as batches of HANDED rows: the JVM holds a batch outside its heap."""
    for a in range(0, len(next(iter(columns.values()))), HANDED):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + HANDED]) for c in columns.values()], list(columns))


def count(docs: DataFrame) -> DataFrame:
    """(kind, key, n) from (text, held_out): n counts the texts that are not held out; keys of the others are there with 0."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {ENTRY: [], TOKEN: []}

        def rows(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = _tally(kept[kind])
            kept[kind] = []
            return handed({"kind": np.full(len(keys), kind, dtype=np.int32), "key": keys.view(np.int64), "n": n})

        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            held = np.array(batch.column(1).to_pylist(), dtype=bool)
            for learn in (True, False):
                own = [t for t, h in zip(texts, held) if h != learn]
                for a, b in slices(own, SLICE):
                    for kind, keyed in KINDS:
                        keys, n = np.unique(keyed(own[a:b])[0], return_counts=True)
                        kept[kind].append((keys, n if learn else np.zeros(len(n), dtype=np.int64)))
                        if sum(len(k) for k, _ in kept[kind]) > COUNTED:
                            kept[kind] = [_tally(kept[kind])]
                            if len(kept[kind][0][0]) > FULL:
                                yield from rows(kind)
        for kind in kept:
            if kept[kind]:
                yield from rows(kind)
        release()

    found = docs.mapInArrow(apply, "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(key, value): log10 of the probability of each entry (key, n), n = 0 for entries that training has not seen.

    counts is read several times: it should be a checkpoint.
    """
    seen = {ORDER: counts.where("n > 0").select("key", "n")}
    for k in range(ORDER - 1, -1, -1):
        seen[k] = checkpoint(seen[k + 1].groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(F.sum("n").alias("n")))
    stats = {}
    for k in range(ORDER, -1, -1):
        rows = seen[k].withColumn("context", F.shiftright("key", 8))
        if k:
            shorter = seen[k - 1].select(F.col("key").alias("low"), F.col("n").alias("m"))
            rows = rows.join(shorter, rows["key"].bitwiseAND((1 << 8 * k) - 1) == F.col("low"))
        else:
            rows = rows.withColumn("m", F.lit(0).cast("long"))
        #: all counts, distinct bytes, and the counts that those bytes have in the context one shorter
        stats[k] = checkpoint(rows.groupBy("context").agg(F.sum("n").alias(f"n{k}"), F.count("*").alias(f"d{k}"), F.sum("m").alias(f"x{k}")))
    known = seen[ORDER].withColumn("context", F.shiftright("key", 8)).join(stats[ORDER], "context")
    known = known.select("key", F.log10(F.col("n") / (F.col(f"n{ORDER}") + F.col(f"d{ORDER}"))).alias("value"))
    new = counts.where("n = 0").select("key")
    for k in range(ORDER, -1, -1):
        new = new.withColumn("context", F.shiftright(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1), 8)).join(stats[k], "context", "left").drop("context")
        if k < ORDER:
            own = seen[k].select(F.col("key").alias("low"), F.col("n").alias(f"c{k}"))
            new = new.join(own, F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1) == F.col("low"), "left").drop("low")
    return known.union(new.select("key", _backed_off(ORDER).alias("value")))


def _backed_off(k: int) -> Column:
    """log10 of the probability from order k down, after all longer contexts have escaped."""
    if k < 0:
        return -F.log10(256 - F.coalesce(F.col("d0"), F.lit(0)))
    zero = F.lit(0)
    above = (F.coalesce(F.col(f"x{k + 1}"), zero), F.coalesce(F.col(f"d{k + 1}"), zero)) if k < ORDER else (zero, zero)
    n, d = F.col(f"n{k}") - above[0], F.col(f"d{k}") - above[1]
    mine = F.coalesce(F.col(f"c{k}"), zero) if k < ORDER else zero
    step = F.when(F.col(f"n{k}").isNull() | (n + d <= 0), 0.0).when(mine > 0, F.log10(mine / (n + d))).otherwise(F.log10(d / (n + d)))
    return step + F.when(mine > 0, 0.0).otherwise(_backed_off(k - 1))


def _block_keys(docs: DataFrame) -> DataFrame:
    """(block, kind, key): the distinct entries and tokens of each block; docs is dealt by block."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            texts = np.array([t or "" for t in batch.column(1).to_pylist()], dtype=object)
            blocks = batch.column(3).to_numpy()
            for block in np.unique(blocks):
                own = texts[blocks == block].tolist()
                for a, b in slices(own, SLICE):
                    for kind, keyed in KINDS:
                        parts = found.setdefault((int(block), kind), [])
                        parts.append(distinct(keyed(own[a:b])[0]))
                        if sum(map(len, parts)) > max(HELD, 2 * len(parts[0])):
                            parts[:] = [distinct(np.concatenate(parts))]
        while found:
            (block, kind), parts = found.popitem()
            keys = distinct(np.concatenate(parts))
            yield from handed({"block": np.full(len(keys), block, dtype=np.int32), "kind": np.full(len(keys), kind, dtype=np.int32), "key": keys.view(np.int64)})
        release()

    return docs.mapInArrow(apply, "block int, kind int, key long")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out rows (crc32 of the id as text, modulo 5, is 1) are scored like the others but not learned from. score is
    the PPM model's log10 probability of the text, white space and end included; base_score that of its words and end by
    smoothed counts. A
    null or blank text is just its end. A null id counts as an empty id. With nothing to learn from, bytes are
    uniform and the base score is 0. Rows may repeat; other columns are not read.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.col(text_col).cast("string")
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"), (F.crc32(name) % 5 == 1).alias("held_out"))
    size = read.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK_CHARS))
    counts = checkpoint(count(read.select("text", "held_out").coalesce(blocks)))
    words = counts.where(F.col("kind") == TOKEN)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    trie = log_probabilities(counts.where(F.col("kind") == ENTRY).select("key", "n"))
    base = F.log10((F.col("n") + 0.5) / (total + 0.5 * (distinct + 1)))
    model = trie.select(F.lit(ENTRY).alias("kind"), "key", "value", F.lit(True).alias("known"))
    model = model.union(words.select("kind", "key", base, F.col("n") > 0))
    dealt = read.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    values = _block_keys(dealt).join(model, ["kind", "key"]).select("block", "kind", "key", "value", "known")
    kinds = dict(read.dtypes)

    def score(own: pa.Table, model_: pa.Table) -> pa.Table:
        kind = model_.column("kind").to_numpy()
        keys, value, known = model_.column("key").to_numpy().view(U64), model_.column("value").to_numpy(), model_.column("known").to_numpy()
        found = {}
        for which in (ENTRY, TOKEN):
            mine = np.flatnonzero(kind == which)
            mine = mine[np.argsort(keys[mine])]
            found[which] = keys[mine], value[mine], known[mine] if which == TOKEN else None
        del kind, keys, value, known, mine
        texts = own.column("text").to_pylist()
        columns: list[list] = [[], [], [], []]
        for a, b in slices([t or "" for t in texts], SLICE):
            for which, keyed in KINDS:
                seen, number = keyed(texts[a:b])
                codes, distinct_ = pd.factorize(seen)
                at = np.searchsorted(found[which][0], distinct_)
                starts = np.cumsum(number) - number
                sums = np.add.reduceat(found[which][1][at][codes], starts)
                if which == ENTRY:
                    columns[3].append(sums)
                else:
                    columns[0].append(number)
                    columns[1].append(np.add.reduceat(found[which][2][at][codes].astype(np.int64), starts))
                    columns[2].append(sums)
        n, k, base_, ppm = (np.concatenate(c) for c in columns)
        del found
        release()
        return pa.table(
            {"id": own.column("id"), "held_out": own.column("held_out"), "n_tokens": n.astype(np.int64), "n_known": k, "train_tokens": np.full(len(texts), total, dtype=np.int64), "base_score": base_, "score": ppm}
        )

    schema = f"id {kinds['id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(score, schema).withColumnRenamed("id", id_col)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
