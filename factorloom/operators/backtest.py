"""Cohort hold backtests: every rebalance liquidates fully, so cohorts chain by their growth factors.

Fractional shares and proportional commission: whole shares or a minimum fee would make cash depend on the path. A
held name without a bar on the rebalance day leaves at its last mark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.joins import asof_backward
from factorloom.operators.panel import sessions
from factorloom.sources import written


def cohorts(prices: DataFrame, holding_days: int) -> DataFrame:
    """(cohort, start, stop): stop is the next rebalance day, NULL for the last cohort."""
    dates = sessions(prices, holding_days).withColumn("cohort", F.col("session") / holding_days)
    return dates.select(F.col("cohort").cast("int").alias("cohort"), F.col("date").alias("start"), F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("stop"))


def picks(ranked: DataFrame, plan: DataFrame, top_n: int) -> DataFrame:
    """(strategy, cohort, start, stop, ticker, targets): the best of each start day; ranked may carry a strategy."""
    if "strategy" not in ranked.columns:
        ranked = ranked.withColumn("strategy", F.lit("hold"))
    if "exposure" not in ranked.columns:
        ranked = ranked.withColumn("exposure", F.lit(1.0))
    top = ranked.where(F.col("selection_rank") <= top_n).select("strategy", F.col("date").alias("start"), "ticker", "selection_rank", "exposure")
    targets = F.count("*").over(Window.partitionBy("strategy", "start"))
    return top.withColumn("targets", targets).join(F.broadcast(plan), "start")


def of_names(prices: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of prices whose tickers are among those of names, written: however many names are priced, few are held."""
    return written(prices.join(names.select("ticker").distinct(), "ticker", "left_semi"))


def positions(chosen: DataFrame, prices: DataFrame, slippage: float, drop_then_weigh: bool = True) -> DataFrame:
    """One row per held name: entry, exit price, day and action, weight of the cohort.

    Names without a bar on the start day are not bought. Weights share equally what is bought (drop_then_weigh) or what
    was aimed at, times the exposure. What is chosen is written once: it is little next to the prices, of which only the
    chosen tickers' are joined.
    """
    chosen = written(chosen)
    px = of_names(prices.select("ticker", "date", "execution_open", "mark_close"), chosen)
    bought = chosen.join(px.select("ticker", F.col("date").alias("start"), F.col("execution_open").alias("__open")), ["ticker", "start"])
    bought = bought.withColumn("entry", F.col("__open") * (1 + slippage)).drop("__open")
    held = F.count("*").over(Window.partitionBy("strategy", "cohort")) if drop_then_weigh else F.col("targets")
    bought = bought.withColumn("weight", F.col("exposure") / held)
    ends = px.select("ticker", F.col("date").alias("stop"), F.col("execution_open").alias("__exit"))
    bought = bought.join(ends, ["ticker", "stop"], "left")
    #: the last mark before the stop; the bar of the start day is one at least
    bought = bought.withColumn("__until", F.coalesce(F.date_sub("stop", 1), F.lit("9999-12-31").cast("date")))
    marks = px.select("ticker", F.col("date").alias("last_mark_date"), F.col("mark_close").alias("last_mark"))
    bought = asof_backward(bought, marks, ["ticker"], "__until", "last_mark_date")
    keys = ["strategy", "cohort", "ticker"]
    sold = F.col("__exit").isNotNull()
    gone = F.col("stop").isNotNull() & ~sold
    return bought.select(
        *keys, "start", "stop", "entry", "weight", "selection_rank",
        F.when(sold, F.col("__exit") * (1 - slippage)).when(gone, F.col("last_mark") * (1 - slippage)).alias("exit"),
        F.when(sold, F.col("stop")).when(gone, F.col("last_mark_date")).alias("exit_date"),
        F.when(sold, "SELL").when(gone, "FORCED_EXIT").alias("action"),
        "last_mark",
    )


def gain(weight: Column, price: Column, entry: Column, commission: float) -> Column:
    """What a position adds to its cohort's growth at a price, both commissions paid where it is net of its own."""
    return weight * (price / entry * (1 - commission) - 1)


def _gains(commission: float) -> Column:
    """The sum of what a cohort's positions added in the end."""
    return F.sum(gain(F.col("weight"), F.coalesce(F.col("exit") * (1 - commission), F.col("last_mark")), F.col("entry"), commission))


def cohort_growth(held: DataFrame, commission: float) -> DataFrame:
    """(strategy, cohort, factor, start_growth): growth of each cohort and the running product before it."""
    factors = held.groupBy("strategy", "cohort").agg((1 + _gains(commission)).alias("factor"))
    before = Window.partitionBy("strategy").orderBy("cohort").rowsBetween(Window.unboundedPreceding, -1)
    return factors.withColumn("start_growth", F.exp(F.coalesce(F.sum(F.log("factor")).over(before), F.lit(0.0))))


def calendar(prices: DataFrame, spans: DataFrame) -> DataFrame:
    """(date, cohort): the cohort of each session; a day lies in one of spans (cohort, start, stop) at most."""
    inside = (F.col("date") >= F.col("start")) & (F.col("stop").isNull() | (F.col("date") < F.col("stop")))
    return prices.select("date").distinct().join(F.broadcast(spans), inside).select("date", "cohort")


def daily_equity(held: DataFrame, prices: DataFrame, plan: DataFrame, commission: float, initial: float, names: Sequence[str] = (), days: DataFrame | None = None) -> DataFrame:
    """(strategy, date, equity): marks carried forward inside a cohort; what is sold early stays as cash until the next rebalance.

    held is read twice, for its tickers, of which alone prices are joined, and for the curve: each cohort's factor travels with its days, and the
    running product adds it on first days. It should be a table. With names, these strategies have a row for every session; where they hold
    nothing, all is cash. ``days`` are the sessions (date) where they are known.
    """
    days = prices if days is None else days
    marks = prices.select("ticker", "date", "mark_close").join(held.select("ticker").distinct(), "ticker", "left_semi")
    held = held.withColumn("__factor", 1 + _gains(commission).over(Window.partitionBy("strategy", "cohort")))
    rows = held.join(F.broadcast(calendar(days, plan)), "cohort").join(marks, ["ticker", "date"], "left")
    upto = Window.partitionBy("strategy", "cohort", "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last("mark_close", ignorenulls=True).over(upto)
    #: sold at the open, or by force at the last close
    cash = (F.col("date") > F.col("exit_date")) | ((F.col("action") == "SELL") & (F.col("date") == F.col("exit_date")))
    rows = rows.withColumn("__mark", mark)
    value = F.when(cash, F.col("exit") * (1 - commission)).otherwise(F.col("__mark"))
    rows = rows.withColumn("__gain", gain(F.col("weight"), value, F.col("entry"), commission))
    daily = rows.groupBy("strategy", "cohort", "start", "date", "__factor").agg((1 + F.sum("__gain")).alias("growth"), F.sum("weight").alias("invested"))
    if names:
        every = calendar(days, plan).join(F.broadcast(plan.select("cohort", "start")), "cohort").withColumn("strategy", F.explode(F.array(*map(F.lit, names))))
        daily = every.join(daily.drop("start"), ["strategy", "cohort", "date"], "left").na.fill({"__factor": 1.0, "growth": 1.0, "invested": 0.0})
    first = F.when(F.col("date") == F.col("start"), F.log("__factor")).otherwise(0.0)
    before = F.sum(first).over(Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - F.log("__factor")
    daily = daily.withColumn("__before", F.exp(before))
    return daily.select("strategy", "date", (initial * F.col("__before") * F.col("growth")).alias("equity"), (100 * (1 - F.col("invested"))).alias("cash_pct"))


def ledger(held: DataFrame, commission: float) -> DataFrame:
    """Trades: a BUY per position and its SELL or FORCED_EXIT, with fee and return per unit of the position."""
    buys = held.select("strategy", "cohort", "ticker", F.col("start").alias("date"), F.lit("BUY").alias("action"), F.col("entry").alias("price"), (F.col("weight") * commission).alias("fee"), F.lit(None).cast("double").alias("trade_return"))
    sells = held.where("action IS NOT NULL").select(
        "strategy", "cohort", "ticker", F.col("exit_date").alias("date"), "action", F.col("exit").alias("price"),
        (F.col("weight") * F.col("exit") / F.col("entry") * commission).alias("fee"), (F.col("exit") / F.col("entry") - 1).alias("trade_return"),
    )
    return buys.unionByName(sells)


def rebalances(held: DataFrame) -> DataFrame:
    """(strategy, cohort, start, names, tickers): what each rebalance bought, best rank first."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("selection_rank", "ticker"))), lambda x: x["ticker"]), ", ")
    return held.groupBy("strategy", "cohort", "start").agg(F.count("*").alias("names"), names.alias("tickers"))


def hold_backtest(
    ranked: DataFrame | Callable[[DataFrame], DataFrame], prices: DataFrame, holding_days: int, top_n: int, slippage: float, commission: float, initial: float, drop_then_weigh: bool = True
) -> dict[str, DataFrame]:
    """Equity, trades and rebalances of holding the top names from one rebalance to the next.

    ranked is a ranking, or a function that makes one for the rebalance days (date), so that no other day is ranked.
    """
    days = written(prices.select("date").distinct())
    plan = cohorts(days, holding_days)
    if callable(ranked):
        ranked = ranked(plan.select(F.col("start").alias("date")))
    held = written(positions(picks(ranked, plan, top_n), prices, slippage, drop_then_weigh))
    return {"positions": held, "equity": daily_equity(held, prices, plan, commission, initial, days=days), "trades": ledger(held, commission), "rebalances": rebalances(held)}


def trailing_stops(held: DataFrame, prices: DataFrame, stop: float | str) -> DataFrame:
    """held with stop_date: the first session of a position whose previous close was at most (1 - stop) of the peak close since entry.

    stop is a number, or the column of held that has it; NULL there is no stop.
    """
    share = F.col(stop) if isinstance(stop, str) else F.lit(stop)
    spans = held.select("cohort", "start", "stop").distinct()
    own = prices.join(held.where(share.isNotNull()).select("ticker").distinct(), "ticker", "left_semi")
    px = own.join(F.broadcast(calendar(prices, spans)), "date").select("ticker", "date", "close", "cohort")
    keys = ["strategy", "cohort", "ticker"]
    order = Window.partitionBy(*keys).orderBy("date")
    peak = F.max("close").over(order.rowsBetween(Window.unboundedPreceding, -1))
    days = held.where(share.isNotNull()).select(*keys, share.alias("__share")).join(px, ["cohort", "ticker"])
    broken = F.lag("close").over(order) <= peak * (1 - F.col("__share"))
    hits = days.withColumn("__broken", broken).where("__broken").groupBy(*keys).agg(F.min("date").alias("stop_date"))
    return held.join(hits, keys, "left")


def sold_at_stops(held: DataFrame, prices: DataFrame, slippage: float) -> DataFrame:
    """held (with stop_date) as it is when stopped positions are sold at the open of that session; the money waits for the next rebalance."""
    opens = prices.select("ticker", F.col("date").alias("stop_date"), F.col("execution_open").alias("__at_stop"))
    rows = held.join(opens, ["ticker", "stop_date"], "left")
    stopped = F.col("stop_date").isNotNull()
    return rows.withColumns(
        {
            "exit": F.when(stopped, F.col("__at_stop") * (1 - slippage)).otherwise(F.col("exit")),
            "exit_date": F.when(stopped, F.col("stop_date")).otherwise(F.col("exit_date")),
            "action": F.when(stopped, "SELL").otherwise(F.col("action")),
        }
    ).select(*held.columns)


def rank_hysteresis(ranked: DataFrame, enter: int, stay: int) -> DataFrame:
    """(date, ticker, held): in at rank <= enter, out beyond stay, unchanged between; uncapped, per ticker."""
    r = F.col("selection_rank")
    signal = F.when(r <= enter, 1).when(r > stay, 0)
    upto = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("__signal", signal).select("date", "ticker", (F.coalesce(F.last("__signal", ignorenulls=True).over(upto), F.lit(0)) == 1).alias("held"))
