"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries of the digests, one per partition and merged by a sum, name the few digests that can be
frequent. Their exact counts and winners (at most ``counters`` rows) are broadcast, so that the rows of large
groups never shuffle. The winners of all other groups are aggregated before they are shuffled and joined to their rows,
so that no group is gathered in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, checkpoint, table

COUNTERS = 1024


def misra_gries(counts: dict, more: dict, counters: int) -> dict:
    """Merge exact counts into a summary of at most ``counters`` entries; each merge lowers all by the first that has to go."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > counters:
        cut = sorted(counts.values(), reverse=True)[counters]
        counts = {key: n - cut for key, n in counts.items() if n > cut}
    return counts


def frequent(digests: DataFrame, rows: int, counters: int = COUNTERS) -> DataFrame:
    """The digests that may stand in more than 2 * rows / counters rows: at most ``counters`` of them.

    A summary counts a digest too low by at most rows / counters over all partitions, so everything with twice
    that count is named; no more than ``counters`` digests can reach the bound.
    """

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict = {}
        for batch in batches:
            counts = misra_gries(counts, batch["digest"].value_counts().to_dict(), counters)
        yield pd.DataFrame({"digest": list(counts), "n": list(counts.values())})

    found = digests.select("digest").mapInPandas(summaries, "digest binary, n long")
    return found.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, rows / counters)).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space (``[\\x20\\x09-\\x0D]``). The row with the most code
    points in the original text, then the smallest id, stays. A null text counts as empty, a null id comes last.
    Rows that repeat an id count one by one in group_size and share ``kept``. Empty tables give no rows; other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = checkpoint(
        docs.select(
            F.col(id_col).alias("id"),
            F.length(text).alias("n"),
            F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("digest"),
        )
    )
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no"), "id")
    candidates = frequent(digests, digests.count(), counters)
    heavy = checkpoint(
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
        .select("digest", F.col("best.id").alias("keep_id"), "group_size")
    )
    large = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    several = rest.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    several = checkpoint(several.select("digest", F.col("best.id").alias("lead"), "group_size"))
    copy = F.col("group_size").isNotNull()
    small = rest.join(several, "digest", "left").select(
        "digest", "id", "n", F.when(copy, F.col("lead")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")
    )
    return large.select("digest", "id", "n", "keep_id", "group_size").union(small).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256 FROM documents),
w AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) keep_id,
             count(*) OVER (PARTITION BY text_sha256) group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
