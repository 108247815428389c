"""A stored panel that is refreshed by new bars at the cost of new bars.

The bars lie in folders by year. Beside them lies the tail: each ticker's last rows, enough for every trailing window, with
the number of rows that came before. New bars are merged into the folders of their own years, and features of new days are
worked out from the tail alone. Only tickers whose new bars reach back beyond their tail are read from their whole
history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.operators.features import market_cap_rank
from factorloom.operators.panel import keep_last, quality_gates
from factorloom.plans.selectors import prepare_features
from factorloom.sources import written

#: Rows of a ticker before a day that its features and their lagged twins look at, and rows more that new bars may replace.
LOOK_BACK, SLACK = 253, 47


class PanelStore:
    """Bars (ticker, date, close, dollar_volume, ...), one row per ticker and day, under a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.bars_path, self.tail_path = spark, f"{path}/bars", f"{path}/tail"

    def bars(self) -> DataFrame:
        return self.spark.read.parquet(self.bars_path).drop("year")

    def tail(self) -> DataFrame:
        """The last rows of each ticker, with __place: the row's number in the ticker's history."""
        return self.spark.read.parquet(self.tail_path)

    def build(self, bars: DataFrame) -> None:
        """Write a whole panel and its tail."""
        self._write_years(market_cap_rank(bars))
        by = Window.partitionBy("ticker")
        numbered = self.bars().withColumns({"__place": F.row_number().over(by.orderBy("date")), "__n": F.count("*").over(by)})
        numbered.where(F.col("__place") > F.col("__n") - LOOK_BACK - SLACK).drop("__n").write.mode("overwrite").parquet(self.tail_path)

    def _write_years(self, bars: DataFrame) -> None:
        """The years of bars, each folder as a whole; other years' folders stay as they are."""
        rows = bars.withColumn("year", F.year("date")).repartitionByRange("year", "ticker").sortWithinPartitions("year", "ticker", "date")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(self.bars_path)

    def refresh(self, fresh: DataFrame, members: DataFrame | None = None, gates: dict | None = None, keep: Sequence[str] | None = None) -> DataFrame:
        """Merge new bars, one row per (ticker, date), which win over stored ones; features of the days they change.

        Returns the rows of the refreshed tickers from their first new bar on. With members, is_sp500 is true for those on
        the last day only. gates are arguments of ``quality_gates`` (without df and universe): ValueError names those that
        the members fail, before anything is written. Bars that are equal to stored ones change nothing. With ``keep`` the
        result has date, ticker and these columns, and nothing else is worked out for it; the store holds everything.
        """
        fresh = written(fresh)
        if gates is not None:
            row = quality_gates(fresh, members, **gates).first()
            if failed := [name for name in ("size_ok", "priced_ok", "fresh_ok") if not row[name]]:
                raise ValueError(f"the new bars fail: {', '.join(failed)}")
        years = sorted(r["year"] for r in fresh.select(F.year("date").alias("year")).distinct().collect())
        if not years:
            return prepare_features(self.tail().limit(0).drop("__place"), keep=keep)
        stored = self.spark.read.parquet(self.bars_path)
        since = stored.where(F.col("year") >= years[0]).drop("year", "market_cap_rank")
        both = since.withColumn("__source", F.lit(0)).unionByName(fresh.withColumn("__source", F.lit(1)), allowMissingColumns=True)
        merged = written(market_cap_rank(keep_last(both, ["ticker", "date"], ["__source"]).drop("__source")))
        first = written(fresh.groupBy("ticker").agg(F.min("date").alias("__first")))
        tail = self.tail()
        known = tail.join(first, "ticker").groupBy("ticker").agg(F.count_if(F.col("date") < F.col("__first")).alias("before"), F.min("__place").alias("place"))
        deep = written(known.where((F.col("before") < LOOK_BACK) & (F.col("place") > 1)).select("ticker"))
        self._write_years(merged.where(F.year("date").isin(years)))
        #: what stands before the first new bar comes from the tail, or for deep tickers from all that is stored
        before = tail.join(first, "ticker").where(F.col("date") < F.col("__first")).join(deep, "ticker", "left_anti")
        if deep.limit(1).count():
            history = self.spark.read.parquet(self.bars_path).drop("year").join(deep, "ticker", "left_semi").join(first, "ticker").where(F.col("date") < F.col("__first"))
            order = Window.partitionBy("ticker").orderBy("date")
            before = before.unionByName(history.withColumn("__place", F.row_number().over(order)), allowMissingColumns=True)
        after = merged.join(first, "ticker").where(F.col("date") >= F.col("__first"))
        state = before.unionByName(after, allowMissingColumns=True)
        own = Window.partitionBy("ticker")
        place = F.row_number().over(own.orderBy("date")) + F.coalesce(F.min("__place").over(own) - 1, F.lit(0))
        state = written(state.withColumn("__place", place))
        rest = tail.join(first, "ticker", "left_anti")
        count = F.max("__place").over(own)
        kept = state.withColumn("__n", count).where(F.col("__place") > F.col("__n") - LOOK_BACK - SLACK).drop("__n", "__first")
        written(rest.unionByName(kept, allowMissingColumns=True)).write.mode("overwrite").parquet(self.tail_path)
        counted = ("history_days", "decision_history_days", "__first", "__place")
        features = prepare_features(state, keep=None if keep is None else [*keep, *counted], only=F.col("date") >= F.col("__first"))
        features = features.withColumns({"history_days": F.col("__place"), "decision_history_days": F.when(F.col("decision_history_days").isNotNull(), F.col("__place") - 1)})
        out = features.drop("__first", "__place") if keep is None else features.select("date", "ticker", *keep)
        if members is None:
            return out
        last = merged.agg(F.max("date").alias("__last"))
        flags = members.select("ticker").distinct().withColumn("__member", F.lit(True))
        out = out.drop("is_sp500").crossJoin(F.broadcast(last)).join(flags, "ticker", "left")
        return out.withColumn("is_sp500", F.coalesce(F.col("__member") & (F.col("date") == F.col("__last")), F.lit(False))).drop("__member", "__last")
