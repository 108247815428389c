"""Reading and writing panels: column-pruned scans, filtered archives, CSV and JSON sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorloom.functions import symbol


#: Paths in the shared folder that this process has written to.
_WRITTEN: list[str] = []
#: Tickers that are named in a scan's filter at most; buckets of a panel table.
PUSHED_TICKERS, BUCKETS = 2_000, 64


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, or KeyError naming the columns it lacks; a check of the schema, not a job."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """A Parquet or CSV table; a CSV has a header and an explicit schema, its types are never inferred."""
    if kind == "csv":
        if schema is None:
            raise ValueError("a CSV needs a schema")
        return spark.read.option("header", True).schema(schema).csv(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_panel(spark: SparkSession, path: str, required: Sequence[str], optional: Sequence[str] = (), kind: str = "parquet", schema=None) -> DataFrame:
    """Only the wanted columns of a panel; optional ones where they exist."""
    df = require(read_table(spark, path, kind, schema), required)
    return df.select(*required, *[c for c in optional if c in df.columns and c not in required])


def filter_archive(df: DataFrame, universe: DataFrame, start: str, end: str, dimension: str | None = None, normalised: bool = False) -> DataFrame:
    """Rows of the universe's tickers between two days (and of one dimension).

    The days and the dimension reach the scan. Where the archive's tickers are ``normalised`` already, as
    ``write_panel_by_ticker`` writes them, so do the tickers: as a list, if a count shows that they are at most
    ``PUSHED_TICKERS``, else as a join on the stored column.
    """
    kept = df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if dimension is not None:
        kept = kept.where(F.col("dimension") == dimension)
    names = universe.select(symbol("ticker").alias("ticker")).where("ticker <> ''").distinct()
    if not normalised:
        return kept.withColumn("ticker", symbol("ticker")).join(names, "ticker", "left_semi")
    few = [r["ticker"] for r in names.limit(PUSHED_TICKERS + 1).collect()]
    return kept.where(F.col("ticker").isin(few)) if len(few) <= PUSHED_TICKERS else kept.join(names, "ticker", "left_semi")


def archive_counts(df: DataFrame, kept: DataFrame) -> DataFrame:
    """(rows_in, rows_out) as a one-row table."""
    return df.agg(F.count("*").alias("rows_in")).crossJoin(kept.agg(F.count("*").alias("rows_out")))


def recent_slice(df: DataFrame, universe: DataFrame, start: str, end: str) -> DataFrame:
    """(rows, tickers, last_date) of the recent part of an archive; one row, also when it is empty."""
    kept = filter_archive(df, universe, start, end)
    return kept.agg(F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("tickers"), F.max("date").alias("last_date"))


def written(df: DataFrame) -> DataFrame:
    """df as a table that is written to the shared folder (spark.checkpoint.dir) and read again: worked out once, its plan cut.

    A local session without that setting gets a folder of its own; a cluster without it is refused.
    """
    return rewritten(df, lambda path: df.write.parquet(path))


def rewritten(df: DataFrame, write: Callable[[str], None], read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """What a sink has written to a new path in the shared folder, read again (as Parquet, with df's schema)."""
    path = new_path(df.sparkSession)
    write(path)
    return read(path) if read else df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def discard_written(spark: SparkSession) -> int:
    """Delete what ``written``, ``rewritten`` and ``new_path`` have put into the shared folder so far; the number of paths.

    To be called once their results have been saved: frames that read them can't be worked out any more.
    """
    gone = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrites the folder; Spark's commit publishes it as a whole."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_panel(df: DataFrame, path: str) -> None:
    """Parquet in folders by year, so that a window of years prunes files."""
    df.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)


def write_panel_by_ticker(df: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """A panel table that is bucketed and sorted by normalised tickers, under a path; the table, read again.

    Windows by ticker and joins on it need no shuffle over it, and files skip tickers that a filter does not name.
    """
    rows = df.withColumn("ticker", symbol("ticker")).repartition(buckets, "ticker")
    rows.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "ticker").sortBy("ticker", "date").saveAsTable(table)
    return df.sparkSession.table(table)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
