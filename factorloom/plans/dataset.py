"""The point-in-time panel: prices, membership, valuations and filings; its refresh, benchmark and sizing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factorloom.functions import lenient_date, lenient_double, symbol
from factorloom.operators.features import market_cap_rank
from factorloom.operators.joins import asof_backward, membership_flags, point_in_time_fundamentals, valuation_join
from factorloom.operators.panel import drop_missing, finite_frame, keep_last

#: Source names of valuations and filings, and the panel's names.
VALUATION_NAMES = {"marketcap": "market_cap", "evebitda": "ev_ebitda"}
FILING_NAMES = {"divyield": "dividend_yield", "de": "debt_equity", "currentratio": "current_ratio", "grossmargin": "gross_margin", "netmargin": "net_margin", "ebitdamargin": "ebitda_margin", "assetturnover": "asset_turnover"}


def rename_valuations(valuations: DataFrame) -> DataFrame:
    """Panel names; market capitalisation comes in millions."""
    return valuations.withColumnsRenamed(VALUATION_NAMES).withColumn("market_cap", F.col("market_cap") * 1e6)


def build_panel(prices: DataFrame, valuations: DataFrame, filings: DataFrame, events: DataFrame) -> DataFrame:
    """One row per priced ticker and day with what was known then; no day sees a later filing."""
    prices = prices.withColumn("dollar_volume", F.col("close") * F.col("volume"))
    panel = membership_flags(valuation_join(prices, rename_valuations(valuations)), events)
    panel = point_in_time_fundamentals(panel, filings.withColumnsRenamed(FILING_NAMES))
    return finite_frame(market_cap_rank(panel))


def priced_members(prices: DataFrame, events: DataFrame) -> DataFrame:
    """(ticker, date, close, dollar_volume, is_sp500) of every priced row: what features and gates need of ``build_panel``."""
    prices = prices.select("ticker", "date", "close", (F.col("close") * F.col("volume")).alias("dollar_volume"))
    return drop_missing(finite_frame(membership_flags(prices, events)), ["date", "ticker", "close"])


def known_facts(rows: DataFrame, valuations: DataFrame, filings: DataFrame, on: str = "decision_day") -> DataFrame:
    """rows with the valuations of the day ``on`` and the latest filing on or before it, as decision_<name>.

    These are the lagged columns of ``build_panel`` for rows that carry the session before theirs: only they are joined.
    """
    values = finite_frame(rename_valuations(valuations)).withColumnRenamed("date", on)
    facts = finite_frame(filings.withColumnsRenamed(FILING_NAMES)).withColumnRenamed("date", "fundamental_date")
    decided = lambda df, keys: df.withColumnsRenamed({c: f"decision_{c}" for c in df.columns if c not in keys})
    rows = rows.join(decided(values, ("ticker", on)), ["ticker", on], "left")
    return asof_backward(rows, decided(facts, ("ticker",)), ["ticker"], on, "decision_fundamental_date")


def refresh(local: DataFrame, fresh: DataFrame, members: DataFrame) -> DataFrame:
    """local united with new bars: per (ticker, date) the newer source wins; members are flagged on the last day only."""
    both = local.withColumn("__source", F.lit(0)).unionByName(fresh.withColumn("__source", F.lit(1)), allowMissingColumns=True)
    merged = keep_last(both, ["ticker", "date"], ["__source"]).drop("__source", "is_sp500", "market_cap_rank")
    last = merged.agg(F.max("date").alias("__last"))
    flagged = merged.crossJoin(F.broadcast(last)).join(members.select("ticker").distinct().withColumn("__member", F.lit(True)), "ticker", "left")
    flagged = flagged.withColumn("is_sp500", F.coalesce(F.col("__member") & (F.col("date") == F.col("__last")), F.lit(False)))
    return market_cap_rank(flagged.drop("__last", "__member"))


def build_benchmark(rows: DataFrame, ticker: str, order: Sequence[str] = ()) -> DataFrame:
    """(date, close, ticker, data_source) of one series, the last row of a day; ValueError when nothing is left."""
    clean = drop_missing(rows.select(lenient_date("date").alias("date"), lenient_double("close").alias("close"), *order), ["date", "close"])
    clean = keep_last(clean, ["date"], order).drop(*[c for c in order if c not in ("date", "close")]) if order else clean
    if not clean.limit(1).count():
        raise ValueError("the benchmark is empty")
    return clean.select("date", "close", F.lit(ticker).alias("ticker"), F.lit("adjusted_close").alias("data_source"))


def equal_notional(chosen: DataFrame, budget: float, fraction: float, fx: float, places: int = 4) -> DataFrame:
    """Quantities per cohort: the same amount for every name of a date, floored; prices or quantities that can't be are flagged."""
    n = F.count("*").over(Window.partitionBy("date"))
    scale = 10.0**places
    out = chosen.withColumn("target_value", F.lit(budget * fraction) / n)
    priced = F.when(F.col("close") > 0, F.col("close"))
    out = out.withColumn("quantity", F.coalesce(F.floor(F.try_divide(F.col("target_value") / fx, priced) * scale) / scale, F.lit(0.0)))
    return out.withColumn("estimated_spend", F.col("quantity") * F.coalesce("close", F.lit(0.0)) * fx).withColumn("valid", F.col("quantity") > 0)


def clean_prices(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """Typed and unique prices of a raw text table."""
    numbers = [c for c in raw.columns if c not in ("ticker", "date", *order)]
    typed = raw.withColumns({"ticker": symbol("ticker"), "date": lenient_date("date"), **{c: lenient_double(c) for c in numbers}})
    return keep_last(drop_missing(typed, ["ticker", "date", "close"]), ["ticker", "date"], order)
