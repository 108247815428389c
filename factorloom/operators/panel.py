"""Cleaning and shaping of (ticker, date) panels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import finite, ratio, symbol


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the last in the given ingest order. The order must tell all rows of a key apart."""
    rank = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return df.withColumn("__row", F.row_number().over(rank)).where("__row = 1").drop("__row")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rank = Window.partitionBy(*keys).orderBy(*[F.asc(c) for c in order])
    return df.withColumn("__row", F.row_number().over(rank)).where("__row = 1").drop("__row")


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def finite_frame(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every double column."""
    return df.withColumns({c: finite(c) for c, kind in df.dtypes if kind in ("double", "float")})


def symbols(df: DataFrame, column: str = "ticker") -> DataFrame:
    """Distinct normalised symbols, blanks and NULLs dropped."""
    return df.select(symbol(column).alias(column)).where(F.col(column) != "").distinct()


def within(df: DataFrame, names: DataFrame, column: str = "ticker") -> DataFrame:
    """The rows whose symbol, normalised, is one of names; the symbols stay as they are."""
    known = symbols(names, column).withColumnRenamed(column, "__name")
    return df.join(known, symbol(column) == F.col("__name"), "left_semi")


def outside(df: DataFrame, names: DataFrame, column: str = "ticker") -> DataFrame:
    """The rows whose symbol, normalised, is none of names. A NULL symbol is none of any, also where names hold NULL."""
    known = symbols(names, column).withColumnRenamed(column, "__name")
    return df.join(known, symbol(column) == F.col("__name"), "left_anti")


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames by column name; a column that a frame lacks is NULL in its rows. No frame is an error."""
    if not frames:
        raise ValueError("nothing to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def days_of(frames: Sequence[DataFrame]) -> DataFrame:
    """(date): the distinct days of all frames."""
    return reduce(DataFrame.union, [f.select("date") for f in frames]).distinct()


def newcomers(df: DataFrame, known: DataFrame, column: str = "ticker") -> DataFrame:
    """The distinct symbols of df that known does not have: those whose history has still to be read."""
    return symbols(df, column).exceptAll(symbols(known, column))


def execution_prices(df: DataFrame, mark_falls_back: bool = False) -> DataFrame:
    """execution_open (adjusted) and mark_close; with mark_falls_back the raw close stands in for a missing adjusted one.

    Rows without a price are dropped.
    """
    adjustment = F.coalesce(ratio("adj_close", "close"), F.lit(1.0))
    mark = F.coalesce("adj_close", "close") if mark_falls_back else F.col("adj_close")
    out = df.withColumn("execution_open", F.col("open") * adjustment).withColumn("mark_close", mark)
    return drop_missing(out, ["date", "ticker", "execution_open", "mark_close", "close"])


def sessions(df: DataFrame, every: int = 1) -> DataFrame:
    """(date, session): the distinct days numbered from 0; with every = k only each k-th of them.

    A few thousand days whatever the panel's size: one window task is enough.
    """
    if every < 1:
        raise ValueError("holding_days must be at least 1")
    numbered = df.select("date").distinct().withColumn("session", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)
    return numbered.where(F.col("session") % every == 0)


def trailing_years(df: DataFrame, years: int) -> DataFrame:
    """The rows of the last years before the panel's last day."""
    last = df.agg(F.max("date").alias("__last"))
    return df.crossJoin(F.broadcast(last)).where(F.col("date") >= F.add_months("__last", -12 * years)).drop("__last")


def last_seen(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.max("date").alias("last_date"))


def audit(df: DataFrame, member: str = "is_member") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("tickers"), F.count_if(member).alias("member_rows"))


def quality_gates(df: DataFrame, universe: DataFrame, smallest: int, largest: int, priced: int, as_of: str, stale_days: int) -> DataFrame:
    """One row of checks before a panel is used: universe size, members with a price on the last day, staleness."""
    last = df.agg(F.max("date").alias("last_date"))
    priced_rows = df.join(F.broadcast(last), F.col("date") == F.col("last_date")).join(universe, "ticker", "left_semi").agg(F.countDistinct("ticker").alias("priced_members"))
    size = universe.agg(F.countDistinct("ticker").alias("universe_size"))
    day = F.lit(as_of).cast("date")
    business = F.date_sub(day, F.when(F.dayofweek(day) == 1, 2).when(F.dayofweek(day) == 7, 1).otherwise(0))
    row = size.crossJoin(priced_rows).crossJoin(last)
    return row.select(
        "universe_size", "priced_members", "last_date",
        F.col("universe_size").between(smallest, largest).alias("size_ok"),
        (F.col("priced_members") >= priced).alias("priced_ok"),
        (F.datediff(business, "last_date") <= stale_days).alias("fresh_ok"),
    )
