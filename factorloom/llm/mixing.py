"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a fixed 60-bit hash of its id. Per source, tokens are summed by the leading 12 bits; only the
bucket that holds the budget's boundary is refined by the next 12 bits, until it holds one document. A document
is then taken once more when its hash is under its source's threshold: nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, fresh, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BITS, STEP = 60, 12
#: More sources than this are joined with a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000


def id_hash(column: str | Column) -> Column:
    """The first 60 bits of the md5 of the id as text; a null id counts as empty text."""
    text = F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) plus target: share * all sizes by weight, none above most * its own size.

    Weights repeat along the sources in code-point order, null last. Resharing an excess by weight until no target
    is above its limit has a fixed point: every source gets least(limit, level * weight), and the sources at their
    limit are a prefix in the order of limit / weight. That prefix is found with running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sources.withColumn("weight", weight.cast("double")).withColumn("limit", most * F.col("source_size").cast("double"))
    full = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    run = ranked.withColumns(
        {
            "free": share * F.sum("source_size").over(total) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "rest": F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("level", F.col("free") / F.col("rest"))
    level = F.min(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(total)
    out = run.withColumn("level", level["level"])
    return out.select("source", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), "limit").alias("target"))


def thresholds(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, base, bound): a document is taken base times, once more if its hash < bound.

    sized: (source, size, hash). The document on the boundary is taken when that comes nearer to the target.
    Documents with one id share a hash and so a fate.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = targets(sources, weights, share, most)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = state.withColumn("base", base).withColumn("left", F.col("target") - F.col("base") * F.col("source_size"))
    state = checkpoint(state.withColumn("low", F.lit(0).cast("long")).withColumn("open", F.col("left") > 0))
    few = state.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    shift = BITS
    while shift > 0:
        shift -= STEP
        #: joined by its bucket alone, a whole source would go to one task
        wanted = state.where("open").select(F.col("source").alias("s"), "low")
        inside = sized.alias("d").join(
            F.broadcast(wanted) if few else wanted,
            F.expr(f"source <=> s AND shiftright(hash, {shift + STEP}) = shiftright(low, {shift + STEP})"),
        )
        buckets = inside.groupBy("s", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
        upto = F.sum("size").over(Window.partitionBy("s").orderBy("bucket"))
        edge = (
            buckets.withColumn("upto", upto)
            .join(state.where("open").select(F.col("source").alias("t"), "left"), F.expr("s <=> t AND upto > left"))
            .groupBy("s")
            .agg(F.min_by(F.struct("bucket", "size", "upto", "docs"), "bucket").alias("e"))
        )
        state = state.join(edge, F.expr("source <=> s"), "left")
        here = F.col("left") - (F.col("e.upto") - F.col("e.size"))
        last = (F.col("e.docs") == 1) | F.lit(shift == 0)
        take = F.when(last & (here * 2 >= F.col("e.size")), 1).otherwise(0)
        state = checkpoint(
            state.select(
                "source", "source_size", "target", "base",
                F.when(F.col("e").isNull(), F.col("left")).otherwise(here).alias("left"),
                F.when(F.col("e").isNull(), F.col("low")).otherwise(F.shiftleft(F.col("e.bucket") + take, shift)).alias("low"),
                (F.col("open") & F.col("e").isNotNull() & ~last).alias("open"),
            )
        )
        if not state.where("open").limit(1).count():
            break
    return state.select("source", "source_size", "target", "base", F.col("low").alias("bound"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs with size, source_size, target, copies and taken = copies * size (columns of docs by these names give way).

    Size is the number of words of the text, 0 for null. A null source is a source of its own. Empty tables give no
    rows, and sources without words get a target of 0.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*[c for c in docs.columns if c in added and c not in (id_col, text_col, source_col)])
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = checkpoint(docs.select(F.col(source_col).alias("source"), size.alias("size"), id_hash(id_col).alias("hash")))
    source, base, bound = fresh(docs, "__source", "__base", "__bound")
    plan = thresholds(sized, weights, share, most).select(F.col("source").alias(source), "source_size", "target", F.col("base").alias(base), F.col("bound").alias(bound))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = docs.join(plan, F.col(source_col).eqNullSafe(F.col(source))).withColumn("size", size)
    copies = F.col(base) + F.when(id_hash(id_col) < F.col(bound), 1).otherwise(0)
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop(source, base, bound)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle(documents: str = "documents") -> str:
    """The same mix by sorting, as DuckDB SQL; ends in a CTE mixed (all columns of documents, size, ..., copies, taken)."""
    return rf"""
WITH sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT size,
                      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT hash FROM {documents}),
srcs AS (SELECT source, sum(size)::BIGINT source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] weight,
                  2e0 * source_size lim FROM srcs),
run AS (SELECT *, (1.5e0 * sum(source_size) OVER ()
                   - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(weight) OVER ()
                   - coalesce(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) lev
        FROM ranked),
lvl AS (SELECT arg_min(lev, lim / weight) FILTER (lim > lev * weight) lev FROM run),
tgt AS (SELECT source, source_size, coalesce(least(lim, lvl.lev * weight), lim) target FROM run, lvl),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END base FROM tgt),
cum AS (SELECT s.*, b.source_size, b.target, b.base, b.target - b.base * b.source_size rem,
               sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash, s.doc_id ROWS UNBOUNDED PRECEDING) upto
        FROM sized s JOIN b ON s.source IS NOT DISTINCT FROM b.source),
mixed AS (SELECT * EXCLUDE (upto, rem, base, hash),
                 base + CASE WHEN rem > 0 AND (upto <= rem OR (upto - size <= rem AND (rem - (upto - size)) * 2 >= size)) THEN 1 ELSE 0 END copies
          FROM cum)
"""


ORACLE = oracle() + "SELECT doc_id, size, source_size, target, (copies * size)::BIGINT taken FROM mixed"
