"""A corpus pipeline of five stages, each of which works on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm import lines, minhash, mixing, pieces, toxicity
from factorloom.llm.common import WORD, new_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go; null and empty texts are not, and rows that repeat an id are told by their own text."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), whole=True)
    return scored.where(~F.col("toxic")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, or nearly so, go from the texts; every document keeps its row."""
    return lines.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by runs of five words at a similarity of 0.8, the one with the smallest id stays.

    Of rows that repeat this id with the same words, one stays; texts of one id that differ all stay. A document without
    words, or with a null id, is linked with none and stays, each of its rows. An empty table gives no rows.
    """
    copies = minhash.near_dedup(docs).where(~F.col("kept")).select("doc_id").distinct()
    rest = docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)
    several = rest.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    with_words = rest.join(several, "doc_id", "left_semi").where(F.col("text").rlike(WORD))
    with_words = with_words.withColumn("__words", F.sha2(F.regexp_replace(F.lower(F.trim("text")), r"[\x20\x09-\x0D]+", " "), 256))
    order = Window.partitionBy("doc_id", "__words").orderBy(F.desc(F.length("text")), "text", "lang", "source", "n_chars")
    best = with_words.withColumn("__r", F.row_number().over(order)).where("__r = 1")
    once = rest.join(several, "doc_id", "left_anti").union(rest.join(several, "doc_id", "left_semi").where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))))
    return once.select(*COLUMNS).union(best.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them; those without words are no part of it.

    Rows that repeat an id share a hash and are taken alike; null ids count as an empty one, null sources as a source.
    """
    mixed = mixing.mix(docs).where("taken > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts, as numbers and digests, a row per row; null texts count as empty."""
    return pieces.encode_decode(docs, pieces.model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Classifier and tokenizer are beyond SQL; the tests hold each stage against plain Python over what came into it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_path(spark, "pipeline-")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
