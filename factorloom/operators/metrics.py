"""Equity-curve metrics, market regimes and strategy switching."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import clip, ratio
from factorloom.operators.joins import align_to_calendar, series_asof
from factorloom.operators.rolling import Rolling, rolling

YEAR = 252


def curve(df: DataFrame, key: str = "strategy", value: str = "equity") -> DataFrame:
    """df with daily_return (first 0), peak and drawdown per key."""
    order = Window.partitionBy(key).orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("daily_return", F.coalesce(ratio(F.col(value), F.lag(value).over(order)) - 1, F.lit(0.0)))
    return df.withColumn("peak", F.max(value).over(upto)).withColumn("drawdown", ratio(value, "peak") - 1)


def annualised(growth: Column, days: Column) -> Column:
    """Yearly growth of a factor reached after ``days`` sessions; -1 when nothing is left."""
    years = F.greatest((days - 1) / F.lit(float(YEAR)), F.lit(1.0 / YEAR))
    return F.when(growth > 0, F.pow(growth, 1 / years) - 1).otherwise(-1.0)


def sharpe(mean: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, mean / deviation * math.sqrt(YEAR)).otherwise(0.0)


def equity_metrics(df: DataFrame, initial: float, key: str = "strategy", value: str = "equity") -> DataFrame:
    """Final value, total return against the initial capital, yearly growth, volatility (population), Sharpe, drawdown."""
    agg = curve(df, key, value).groupBy(key).agg(
        F.count("*").alias("days"), F.max_by(value, "date").alias("final_equity"), F.stddev_pop("daily_return").alias("dev"), F.avg("daily_return").alias("mean"), F.min("drawdown").alias("low")
    )
    growth = F.col("final_equity") / initial
    return agg.select(
        key, "final_equity",
        ((growth - 1) * 100).alias("total_return_pct"),
        (annualised(growth, F.col("days")) * 100).alias("cagr_pct"),
        (F.col("dev") * math.sqrt(YEAR) * 100).alias("annual_volatility_pct"),
        sharpe(F.col("mean"), F.col("dev")).alias("sharpe_ratio"),
        (F.abs("low") * 100).alias("max_drawdown_pct"),
    )


def benchmark_growth(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(benchmark_cagr_pct, benchmark_days) of the benchmark on df's days, carried forward; a one-row table."""
    aligned = align_to_calendar(df.select("date").distinct(), benchmark.select("date", F.col("close").alias("__close")), ["__close"]).where("__close IS NOT NULL")
    agg = aligned.agg(F.count("*").alias("n"), F.min_by("__close", "date").alias("first"), F.max_by("__close", "date").alias("last"))
    grown = F.when(F.col("n") > 1, annualised(ratio("last", "first"), F.col("n")) * 100)
    return agg.select(grown.alias("benchmark_cagr_pct"))


def metrics_against(df: DataFrame, benchmark: DataFrame, initial: float) -> DataFrame:
    """equity_metrics plus the benchmark's growth on the same days and the excess; all curves share their days."""
    out = equity_metrics(df, initial).crossJoin(F.broadcast(benchmark_growth(df, benchmark)))
    zero = F.coalesce("benchmark_cagr_pct", F.lit(0.0))
    return out.withColumn("benchmark_cagr_pct", zero).withColumn("excess_cagr_pct", F.col("cagr_pct") - zero)


def conditional_metrics(df: DataFrame, regime: DataFrame) -> DataFrame:
    """(strategy, risk_on, cagr_pct, sharpe_ratio) over the days of each state; zeros for a state without days."""
    flagged = curve(df).join(regime.select("date", "risk_on"), "date", "left").withColumn("risk_on", F.coalesce("risk_on", F.lit(False)))
    r = F.col("daily_return")
    agg = flagged.groupBy("strategy", "risk_on").agg(
        F.count("*").alias("n"), F.min(r).alias("worst"), F.sum(F.when(r > -1, F.log1p(r))).alias("logs"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("dev")
    )
    total = F.when(F.col("worst") <= -1, 0.0).otherwise(F.exp("logs"))
    agg = agg.withColumn("cagr_pct", (F.pow(total, YEAR / F.col("n")) - 1) * 100).withColumn("sharpe_ratio", sharpe(F.col("mean"), F.col("dev")))
    states = df.select("strategy").distinct().withColumn("risk_on", F.explode(F.array(F.lit(True), F.lit(False))))
    return states.join(agg, ["strategy", "risk_on"], "left").select("strategy", "risk_on", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("cagr_pct", "sharpe_ratio")])


def benchmark_curve(sessions: DataFrame, benchmark: DataFrame, initial: float) -> DataFrame:
    """(strategy 'benchmark', date, close, equity): the benchmark as of each session, rebased to the initial capital."""
    aligned = series_asof(sessions.select("date"), benchmark.select("date", "close")).withColumn("strategy", F.lit("benchmark"))
    whole = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return aligned.withColumn("equity", ratio("close", F.first("close", ignorenulls=True).over(whole)) * initial)


def curve_gap(daily: DataFrame, initial: float) -> DataFrame:
    """Mean, relative and worst gap of equity over benchmark_equity, days ahead, final relative wealth."""
    valid = daily.where("equity IS NOT NULL AND benchmark_equity IS NOT NULL").withColumn("gap", F.col("equity") - F.col("benchmark_equity"))
    return valid.groupBy("strategy").agg(
        F.avg("gap").alias("mean_equity_gap"),
        (F.avg("gap") / initial * 100).alias("mean_equity_gap_pct_of_initial"),
        (F.count_if(F.col("gap") > 0) / F.count("*") * 100).alias("days_ahead_pct"),
        F.min("gap").alias("worst_equity_gap"),
        ((F.max_by(ratio("equity", "benchmark_equity"), "date") - 1) * 100).alias("final_relative_wealth_pct"),
    )


def market_regime(benchmark: DataFrame) -> DataFrame:
    """SMA200, 63-session return and volatility of a series, its trailing limit, risk_on and the flag known at the open."""
    order = Window.partitionBy("series_id").orderBy("date")

    def over(aggregate, value, n):
        frame = order.rowsBetween(1 - n, 0)
        return F.when(F.count(value).over(frame) == n, aggregate(value).over(frame))

    close = F.col("close")
    df = benchmark.withColumn("__return", ratio(close, F.lag(close).over(order)) - 1)
    df = df.withColumns(
        {"sma200": over(F.avg, close, 200), "return_63d": ratio(close, F.lag(close, 63).over(order)) - 1, "volatility_63d": over(F.stddev_samp, F.col("__return"), 63) * math.sqrt(YEAR)}
    )
    limit = Rolling("__limit", "volatility_63d", "quantile", 756, least=252, at=0.75)
    df = rolling(df, [limit], by="series_id", lag=1, lagged="__known").withColumnRenamed("__known__limit", "volatility_limit")
    calm = (close > F.col("sma200")) & (F.col("return_63d") > 0) & (F.col("volatility_63d") <= F.col("volatility_limit"))
    df = df.withColumn("risk_on", F.coalesce(calm, F.lit(False)))
    df = df.withColumn("risk_on_for_open", F.coalesce(F.lag("risk_on").over(order), F.lit(False)))
    return df.withColumn("regime_for_open", F.when(F.col("risk_on_for_open"), "risk_on").otherwise("risk_off")).drop("__return", "__limit")


def strategy_choices(df: DataFrame, declared: list[str], lookback: int = 252, least: int = 63) -> DataFrame:
    """(date, selected_strategy, selection_sharpe): the best trailing Sharpe before each day; ties and no history go by declared order.

    The first day's return is unknown and never counts. All strategies share their days.
    """
    order = Window.partitionBy("strategy").orderBy("date")
    place = F.array_position(F.lit(declared), F.col("strategy"))
    df = curve(df.where(F.col("strategy").isin(declared))).withColumn("__day", F.row_number().over(order) - 1)
    df = df.withColumn("__r", F.when(F.col("__day") > 0, F.col("daily_return")))
    frame = order.rowsBetween(-lookback, -1)
    mean, dev, n = F.avg("__r").over(frame), F.stddev_pop("__r").over(frame), F.count("__r").over(frame)
    df = df.withColumns({"__mean": mean, "__dev": dev, "__n": n, "__place": place})
    score = F.when(F.col("__n") >= least, F.when(F.col("__dev") > 0, F.col("__mean") / F.col("__dev") * math.sqrt(YEAR)).otherwise(F.lit(float("-inf"))))
    best = Window.partitionBy("date").orderBy(F.col("__score").desc_nulls_last(), "__place")
    ranked = df.withColumn("__score", score).withColumn("__rank", F.row_number().over(best)).where("__rank = 1")
    return ranked.select("date", F.col("strategy").alias("selected_strategy"), F.col("__score").alias("selection_sharpe"))


def trade_summary(trades: DataFrame) -> DataFrame:
    """Orders by action, fees, completed trades, win rate and open positions per strategy."""
    sold = F.col("action").isin("SELL", "FORCED_EXIT")
    n = lambda a: F.count_if(F.col("action") == a)
    agg = trades.groupBy("strategy").agg(
        n("BUY").alias("buy_orders"), n("SELL").alias("sell_orders"), n("FORCED_EXIT").alias("forced_exits"), F.sum("fee").alias("fees"),
        F.count_if(sold).alias("completed"), F.count_if(sold & (F.col("trade_return") > 0)).alias("wins"),
    )
    return agg.withColumn("win_rate_pct", F.coalesce(F.try_divide(F.col("wins") * 100.0, F.col("completed")), F.lit(0.0))).withColumn("open_positions", F.col("buy_orders") - F.col("completed")).drop("wins")


def active_log_return(r: Column, b: Column) -> Column:
    """Log growth over the benchmark's; losses beyond 99.9 % count as that."""
    return F.log1p(clip(r, low=-0.999)) - F.log1p(b)
