"""Strategies on one ranking: each is an ordering of the same rows, so all run as one backtest by strategy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.backtest import cohorts, daily_equity, of_names, picks, positions, rank_hysteresis, sold_at_stops, trailing_stops
from factorloom.operators.joins import align_to_calendar
from factorloom.operators.metrics import conditional_metrics, metrics_against, strategy_choices
from factorloom.operators.panel import sessions
from factorloom.sources import written

#: What the orders are made of.
NEEDED = ("date", "ticker", "selection_rank", "selection_score", "decision_momentum_12m_ex_1m", "decision_price_vs_200d_ma", "rsi14_decision", "adaptive_risk_on_score", "adaptive_risk_off_score")
#: Days of the lookback of the switch, and from one entry of its log to the next.
LOOKBACK, LOG_DAYS = 252, 21


@dataclass(frozen=True)
class Strategy:
    """What is special about a strategy: SQL over the columns of the ranking and __on, whether the day is risk-on.

    order and keep say which rows it wants and how it sorts them (best first), share how much of the money it puts in.
    ``stay`` keeps a name up to that rank once it is in; ``stop`` is the fall from a peak that sells a position;
    ``among`` are the strategies that it chooses from by their last Sharpe ratios, the first for want of any.
    """

    name: str
    every: int
    order: str = "selection_score"
    keep: str = "true"
    share: str = "1e0"
    stay: int | None = None
    stop: float | None = None
    among: tuple[str, ...] = ()


def oversold(name: str, threshold: float) -> Strategy:
    return Strategy(name, 21, keep=f"rsi14_decision <= {threshold}")


def by_regime(name: str, share_when_off: float) -> Strategy:
    return Strategy(name, 21, order="IF(__on, adaptive_risk_on_score, adaptive_risk_off_score)", share=f"IF(__on, 1e0, {share_when_off}e0)")


#: The strategies that are compared.
STRATEGIES = (
    Strategy("baseline_6m", 126),
    Strategy("monthly_composite", 21),
    Strategy("momentum_12_1", 21, order="decision_momentum_12m_ex_1m"),
    Strategy("trend_filter", 21, keep="__on AND decision_price_vs_200d_ma > 0"),
    oversold("mean_reversion_rsi30", 30.0),
    oversold("mean_reversion_rsi35", 35.0),
    oversold("mean_reversion_rsi40", 40.0),
    Strategy("rank_persistence_30", 21, stay=30),
    Strategy("rank_persistence_50", 21, stay=50),
    Strategy("rank_persistence_75", 21, stay=75),
    Strategy("risk_overlay_15pct", 126, stop=0.15),
    Strategy("risk_overlay_20pct", 126, stop=0.20),
    Strategy("risk_overlay_25pct", 126, stop=0.25),
    by_regime("regime_adaptive_40pct", 0.40),
    by_regime("regime_adaptive_65pct", 0.65),
    by_regime("regime_adaptive_100pct", 1.00),
    Strategy("performance_adaptive_252d", 21, among=("baseline_6m", "monthly_composite", "momentum_12_1", "trend_filter", "mean_reversion_rsi35")),
)


def orderings(ranked: DataFrame, regime: DataFrame, strategies: tuple[Strategy, ...], top_n: int = 25) -> DataFrame:
    """(strategy, date, ticker, selection_rank, exposure): every strategy's own order of each date.

    ranked needs selection_score, decision_momentum_12m_ex_1m, decision_price_vs_200d_ma, rsi14_decision and the two
    adaptive scores. Ties go by score, then ticker. Names that a strategy keeps by their rank come first, and the dates
    of ranked are then its decisions; ``top_n`` is the rank by which a name gets in. Raises on a strategy that chooses among others: it has no order of its own.
    """
    if choosing := [s.name for s in strategies if s.among]:
        raise ValueError(f"no order of their own: {', '.join(choosing)}")
    flags = regime.select("date", F.coalesce("risk_on_for_open", F.lit(False)).alias("__flag"))
    rows = ranked.join(F.broadcast(flags), "date", "left").withColumn("__on", F.coalesce("__flag", F.lit(False)))
    own = [s for s in strategies if s.stay is None]
    wanted = [(s.name, s.stay) for s in strategies if s.stay is not None]
    parts = [own_orders(rows, own)] if own else []
    for name, stay in wanted:
        parts.append(persistent(ranked, stay, top_n).select(F.lit(name).alias("strategy"), "date", "ticker", "selection_rank", F.lit(1.0).alias("exposure")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def own_orders(rows: DataFrame, strategies: Sequence[Strategy]) -> DataFrame:
    """``orderings`` of strategies that keep no names by their rank; rows tell whether their day is risk-on (__on).

    Rows are dealt by date once and sorted once for each order that differs; a rank is the number of rows that a strategy
    keeps up to a row. So they are multiplied by the strategies only after that, and not shuffled or sorted any more.
    """
    ranks: dict[str, Column] = {}
    keys = {order: f"__key_{i}" for i, order in enumerate(dict.fromkeys(s.order for s in strategies))}
    rows = rows.withColumns({key: F.expr(order).cast("double") for order, key in keys.items()})
    for s in strategies:
        #: the order of the ranking itself, which rows that come from it have already
        first = [] if s.order == "selection_score" else [F.col(keys[s.order]).desc_nulls_last()]
        upto = Window.partitionBy("date").orderBy(*first, F.col("selection_score").desc_nulls_last(), F.asc("ticker")).rowsBetween(Window.unboundedPreceding, 0)
        ranks[s.name] = F.count_if(F.expr(s.keep)).over(upto).cast("int")
    rows = rows.withColumns({f"__rank_{i}": rank for i, rank in enumerate(ranks.values())})
    each = [F.struct(F.lit(s.name).alias("strategy"), F.expr(s.keep).alias("keep"), F.col(f"__rank_{i}").alias("selection_rank"), F.expr(s.share).alias("exposure")) for i, s in enumerate(strategies)]
    return rows.select("date", "ticker", F.explode(F.array(*each)).alias("s")).where("s.keep").select("s.strategy", "date", "ticker", "s.selection_rank", "s.exposure")


def persistent(ranked: DataFrame, stay: int, enter: int) -> DataFrame:
    """(date, ticker, selection_rank): names in by rank ``enter`` that stay up to rank ``stay``; those that were in before come first."""
    held = rank_hysteresis(ranked, enter, stay).join(ranked.select("date", "ticker", F.col("selection_rank").alias("__rank")), ["date", "ticker"])
    numbered = sessions(ranked).withColumnRenamed("session", "__day")
    held = held.join(F.broadcast(numbered), "date")
    own = Window.partitionBy("ticker").orderBy("date")
    before = F.lag("held").over(own) & (F.lag("__day").over(own) == F.col("__day") - 1)
    held = held.withColumn("__new", (~F.coalesce(before, F.lit(False))).cast("int")).where("held")
    order = Window.partitionBy("date").orderBy("__new", "__rank", "ticker")
    return held.select("date", "ticker", F.row_number().over(order).alias("selection_rank"))


def held_names(ranked: DataFrame, regime: DataFrame, prices: DataFrame, days: DataFrame, strategies: tuple[Strategy, ...], top_n: int, slippage: float) -> DataFrame:
    """Positions of strategies of one rebalance period, stops carried out; targets weigh before names without a bar are dropped."""
    plan = cohorts(days, strategies[0].every)
    chosen = ranked.join(F.broadcast(plan.select(F.col("start").alias("date"))), "date", "left_semi")
    chosen = written(picks(orderings(chosen, regime, strategies, top_n), plan, top_n))
    own = of_names(prices, chosen)
    held = positions(chosen, own, slippage, drop_then_weigh=False)
    return stopped(written(held), own, strategies, slippage)


def stopped(held: DataFrame, prices: DataFrame, strategies: tuple[Strategy, ...], slippage: float) -> DataFrame:
    stops = {s.name: s.stop for s in strategies if s.stop is not None}
    if not stops:
        return held
    share: Column = F.lit(None).cast("double")
    for name, stop in stops.items():
        share = F.when(F.col("strategy") == name, stop).otherwise(share)
    return sold_at_stops(trailing_stops(held.withColumn("__stop", share), prices, "__stop").drop("__stop"), prices, slippage)


def chosen_orders(orders: DataFrame, choices: DataFrame, strategy: Strategy, same: dict[str, str]) -> DataFrame:
    """The orders of a strategy that takes over, on each date, those of the strategy that choices (date, selected_strategy) names.

    same tells which strategy has the orders of another one, on the dates of this one's calendar.
    """
    source = F.col("selected_strategy")
    for name, other in same.items():
        source = F.when(F.col("selected_strategy") == name, other).otherwise(source)
    picked = choices.select("date", source.alias("strategy"))
    return orders.join(F.broadcast(picked), ["date", "strategy"]).withColumn("strategy", F.lit(strategy.name))


def choice_log(choices: DataFrame, sessions: DataFrame, lookback: int = LOOKBACK, every: int = LOG_DAYS) -> DataFrame:
    """(date, selected_strategy, lookback_days, selection_sharpe) of every ``every``-th session (date, session)."""
    days = sessions.where(F.col("session") % every == 0).select("date")
    return choices.join(F.broadcast(days), "date").select("date", "selected_strategy", F.lit(lookback).alias("lookback_days"), "selection_sharpe")


def decision_days(prices: DataFrame, strategies: tuple[Strategy, ...]) -> DataFrame:
    """(date): the rebalance days of all strategies; no other day has to be ranked."""
    prices = written(prices.select("date").distinct())
    starts = [cohorts(prices, every).select(F.col("start").alias("date")) for every in sorted({s.every for s in strategies})]
    return reduce(DataFrame.union, starts).distinct()


def compare(ranked: DataFrame, regime: DataFrame, benchmark: DataFrame, prices: DataFrame, strategies: tuple[Strategy, ...], top_n: int, slippage: float, commission: float, initial: float, recent_years: int = 2) -> dict[str, DataFrame]:
    """Daily equity of all strategies, their comparison, and the choices of those that choose.

    Everything that several parts read is written once: the rebalance days of ranked (see ``decision_days``), the sessions, and the curves, one
    row per strategy and session, on which the curves of those that choose rest. Of all prices only those of held names are read more than once.
    """
    regime, benchmark = written(regime.select("date", "risk_on_for_open")), written(benchmark.select("date", "close"))
    ranked, days = decided(ranked, prices, strategies)
    equity, choices = own_curves(ranked, regime, prices, days, strategies, top_n, slippage, commission, initial), None
    for s in (s for s in strategies if s.among):
        known = {other.name: other for other in strategies}
        choices = choices_of(equity, s)
        #: a strategy of another period has the orders of one of this period that differs in nothing else
        same = {n: m for n in s.among for m in s.among if known[n].every != s.every and replace(known[n], name=m, every=s.every) == known[m]}
        plan = cohorts(days, s.every)
        asked = ranked.join(F.broadcast(plan.select(F.col("start").alias("date"))), "date", "left_semi")
        orders = orderings(asked, regime, tuple(known[n] for n in s.among if n not in same))
        held = written(positions(picks(chosen_orders(orders, choices, s, same), plan, top_n), prices, slippage, drop_then_weigh=False))
        equity = written(equity.unionByName(daily_equity(held, prices, plan, commission, initial, [s.name], days)))
    table = comparison(equity, benchmark, regime, initial, recent_years)
    return {"equity": equity, "comparison": table, "choices": choices}


def decided(ranked: DataFrame, prices: DataFrame, strategies: tuple[Strategy, ...]) -> tuple[DataFrame, DataFrame]:
    """The rebalance days of ranked, and (date) of all sessions, both written."""
    days = written(prices.select("date").distinct())
    return written(ranked.join(F.broadcast(decision_days(days, strategies)), "date", "left_semi").select(*NEEDED)), days


def own_curves(ranked: DataFrame, regime: DataFrame, prices: DataFrame, days: DataFrame, strategies: tuple[Strategy, ...], top_n: int, slippage: float, commission: float, initial: float) -> DataFrame:
    """Daily equity of the strategies that don't choose among others, written; days are all sessions of prices."""
    equity = None
    for every in sorted({s.every for s in strategies}):
        own = tuple(s for s in strategies if s.every == every and not s.among)
        if own:
            held = written(held_names(ranked, regime, prices, days, own, top_n, slippage))
            curves = daily_equity(held, prices, cohorts(days, every), commission, initial, [s.name for s in own], days)
            equity = curves if equity is None else equity.unionByName(curves)
    return written(equity)


def choices_of(equity: DataFrame, strategy: Strategy) -> DataFrame:
    """What a strategy that chooses among others chooses on each day, from their curves; written."""
    return written(strategy_choices(equity.where(F.col("strategy").isin(*strategy.among)), list(strategy.among), LOOKBACK))


def switches(ranked: DataFrame, regime: DataFrame, prices: DataFrame, strategies: tuple[Strategy, ...], top_n: int, slippage: float, commission: float, initial: float) -> DataFrame:
    """The choices of ``compare`` alone: only the strategies that the last one that chooses looks at get curves, itself it needs none."""
    s = [s for s in strategies if s.among][-1]
    among = tuple(other for other in strategies if other.name in s.among)
    ranked, days = decided(ranked, prices, among)
    return choices_of(own_curves(ranked, written(regime.select("date", "risk_on_for_open")), prices, days, among, top_n, slippage, commission, initial), s)


def comparison(equity: DataFrame, benchmark: DataFrame, regime: DataFrame, initial: float, recent_years: int = 2) -> DataFrame:
    """One row per curve (strategy, date, equity), the best recent Sharpe ratio first, the smaller recent drawdown of equal ones.

    Metrics of the whole time and, as recent_<metric>, of the last years before the last day, where a curve starts at its
    first value; growth of the benchmark (date, close), carried forward over the days of all curves, and the excess over it;
    growth and Sharpe ratio of days that are risk-on and risk-off at the open.
    """
    days = equity.select("date").distinct()
    series = written(align_to_calendar(days, benchmark.select("date", "close"), ["close"]))
    edge = F.broadcast(days.agg(F.add_months(F.max("date"), -12 * recent_years).alias("__edge")))
    since = lambda df: df.crossJoin(edge).where("date >= __edge").drop("__edge")
    start = F.first("equity").over(Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rebased = since(equity).select("strategy", "date", (F.col("equity") / start).alias("equity"))
    recent = metrics_against(rebased, since(series), 1.0)
    recent = recent.select("strategy", *[F.col(c).alias(f"recent_{c}") for c in recent.columns if c != "strategy"])
    states = conditional_metrics(equity, regime.select("date", F.col("risk_on_for_open").alias("risk_on")))
    when = lambda on, c: F.max(F.when(F.col("risk_on") == on, F.col(c)))
    by_state = states.groupBy("strategy").agg(
        when(True, "sharpe_ratio").alias("risk_on_sharpe"), when(False, "sharpe_ratio").alias("risk_off_sharpe"), when(True, "cagr_pct").alias("risk_on_cagr_pct"), when(False, "cagr_pct").alias("risk_off_cagr_pct")
    )
    table = metrics_against(equity, series, initial).join(recent, "strategy").join(by_state, "strategy")
    return table.orderBy(F.desc("recent_sharpe_ratio"), "recent_max_drawdown_pct", "strategy")


def stopped_positions(ranked: DataFrame, prices: DataFrame, holding_days: int, top_n: int, slippage: float, stop: float) -> DataFrame:
    """Positions of the risk overlay with their stop days."""
    plan = cohorts(prices, holding_days)
    return trailing_stops(positions(picks(ranked, plan, top_n), prices, slippage), prices, stop)
