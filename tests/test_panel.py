"""Scenarios of the panel operators on small frames, and registered queries against their DuckDB twins."""

import datetime as dt
import glob
import json
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from factorloom import sources
from factorloom.functions import average_percent_rank, clip, lenient_date, lenient_double, mean_of_present, symbol, symbol_key
from factorloom.operators import backtest, features, joins, metrics, panel, tuning
from factorloom.plans import dataset, selectors, strategies
from factorloom.plans.store import PanelStore

DAYS = pd.bdate_range("2023-01-02", periods=320)


def frame(spark, data):
    pdf = pd.DataFrame(data)
    for c in pdf.columns:
        if str(pdf[c].dtype).startswith("datetime"):
            pdf[c] = pdf[c].dt.date
    return spark.createDataFrame(pdf)


def price_panel(spark, **last_close):
    rows = []
    for k, (name, volume, cap) in enumerate((("BIG", 5e6, 9e9), ("MID", 5e6, 5e9), ("LOWVOL", 1e5, 1e9), ("OUT", 5e6, 2e9))):
        for i, day in enumerate(DAYS):
            rows.append((day.date(), name, 10 + 4 * i / 319 + k * 0.001 * (i % 7), volume, cap))
    for name, close in last_close.items():
        rows = [(d, t, close if (t, d) == (name, DAYS[-1].date()) else c, v, m) for d, t, c, v, m in rows]
    return spark.createDataFrame(rows, "date date, ticker string, close double, dollar_volume double, market_cap double")


def names(spark, *tickers):
    return spark.createDataFrame([(t,) for t in tickers], "ticker string")


def test_configs_refuse_what_cannot_be():
    for bad in (dict(weights={"size_rank": 0.5}), dict(decision_lag_days=-1)):
        with pytest.raises(ValueError):
            selectors.PriceConfig(**bad)
    for bad in (dict(weights={}), dict(weights={"a": math.nan}), dict(weights={"a": 1.0, "b": -1.0}), dict(rsi_threshold=101.0)):
        with pytest.raises(ValueError):
            selectors.CompositeConfig(**bad)
    double = selectors.CompositeConfig(weights={k: 2 * v for k, v in selectors.COMPOSITE_WEIGHTS.items()})
    assert selectors.shares(double.weights) == pytest.approx(selectors.shares(selectors.CompositeConfig().weights))


def test_members_and_liquidity_decide_who_is_ranked(spark):
    got = selectors.rank_stocks(price_panel(spark), names(spark, "big.AX", " mid ", "LOWVOL"))
    rows = features.latest_shortlist(got, 5).collect()
    assert {r.ticker for r in rows} == {"BIG", "MID"} and {r.membership_source for r in rows} == {"constituent_file"}
    with pytest.raises(ValueError):
        selectors.rank_stocks(price_panel(spark))
    proxy = features.latest_ranking(selectors.rank_stocks(price_panel(spark), allow_market_cap_proxy=True, config=selectors.PriceConfig(market_cap_proxy_count=2, max_volatility_percentile=1.0)))
    assert {r.ticker for r in proxy.collect()} == {"BIG", "MID"}
    with pytest.raises(KeyError):
        selectors.rank_stocks(price_panel(spark).drop("close"), names(spark, "BIG"))


def test_equal_names_tie_and_go_by_ticker(spark):
    flat = price_panel(spark).withColumn("close", F.lit(10.0)).where("ticker <> 'LOWVOL'").withColumn("dollar_volume", F.lit(5e6))
    rows = features.latest_ranking(selectors.rank_stocks(flat, names(spark, "BIG", "MID", "OUT"), config=selectors.PriceConfig(max_volatility_percentile=1.0))).collect()
    assert len({r.selection_score for r in rows}) == 1 and [r.ticker for r in sorted(rows, key=lambda r: r.selection_rank)] == ["BIG", "MID", "OUT"]


def test_decisions_know_the_session_before(spark):
    last = features.latest_ranking(selectors.rank_stocks(price_panel(spark, BIG=999.0), names(spark, "BIG", "MID"), config=selectors.PriceConfig(max_volatility_percentile=1.0))).where("ticker = 'BIG'").first()
    assert last.close == 999.0 and last.decision_close < 15


def test_an_empty_ranking_keeps_its_columns(spark):
    got = selectors.rank_stocks(price_panel(spark), names(spark, "BIG"), config=selectors.PriceConfig(min_price=1e9))
    assert got.count() == 0 and dict(got.dtypes)["selection_rank"] == "int" and features.latest_shortlist(got).count() == 0


def test_windows_match_pandas(spark):
    pdf = price_panel(spark).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    got = selectors.prepare_features(price_panel(spark)).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    by = pdf.groupby("ticker")["close"]
    ret = by.pct_change(fill_method=None)
    want = {
        "momentum_12m_ex_1m": by.shift(21) / by.shift(252) - 1,
        "momentum_6m": by.pct_change(126, fill_method=None),
        "ma_200d": by.transform(lambda v: v.rolling(200).mean()),
        "volatility_30d": ret.groupby(pdf["ticker"]).transform(lambda v: v.rolling(30).std()),
        "downside_volatility_90d": ret.where(ret < 0, 0.0).groupby(pdf["ticker"]).transform(lambda v: v.rolling(90).std()),
        "drawdown_252d": pdf["close"] / by.transform(lambda v: v.rolling(252).max()) - 1,
        "median_dollar_volume_60d": pdf.groupby("ticker")["dollar_volume"].transform(lambda v: v.rolling(60).median()),
    }
    for name, series in want.items():
        assert got[name].isna().equals(series.isna()) and (got[name] - series).abs().max() < 1e-9, name


def test_percent_rank_averages_ties_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, x) for x in (3.0, 1.0, 3.0, None, 2.0)], "date int, x double").withColumn("r", average_percent_rank("x", "date")).withColumn("d", average_percent_rank("x", "date", False))
    pdf = df.toPandas()
    assert pdf["r"].equals(pdf["x"].rank(pct=True)) and pdf["d"].equals(pdf["x"].rank(pct=True, ascending=False))


def test_scalar_functions(spark):
    df = spark.createDataFrame([(" brk.b ", "2024-02-30", "nan", None), ("BRKb_US_EQ", "2024-02-28 10:00:00", "1.5", 7.0), ("x.ax", "?", "inf", 0.1)], "s string, d string, n string, v double")
    rows = df.select(symbol_key("s").alias("k"), symbol("s").alias("t"), lenient_date("d").alias("d"), lenient_double("n").alias("n"), clip(F.col("v"), 1.0, 2.0).alias("c"), mean_of_present([F.col("v"), F.lit(None).cast("double")]).alias("m")).collect()
    assert [r.k for r in rows] == ["BRKB", "BRKB", "XAX"] and rows[2].t == "X"
    assert [r.d for r in rows] == [None, dt.date(2024, 2, 28), None] and [r.n for r in rows] == [None, 1.5, None]
    assert [r.c for r in rows] == [None, 2.0, 1.0] and [r.m for r in rows] == [None, 7.0, 0.1]


def test_rsi_warms_up_at_zero(spark):
    up = frame(spark, {"date": DAYS[:30], "ticker": "A", "close": [float(i + 1) for i in range(30)]})
    rows = features.rsi(up).orderBy("date").collect()
    assert rows[0].decision_rsi14 is None and rows[5].decision_rsi14 == 0.0 and rows[29].decision_rsi14 == 100.0


def test_membership_follows_snapshots_and_changes(spark):
    day = lambda d: dt.date(2024, 1, d)
    events = spark.createDataFrame([(day(1), "AAA", "historical"), (day(1), "BBB", "current"), (day(8), "AAA", "removed"), (day(8), "CCC", "added"), (day(1), "DDD", "added")], "date date, ticker string, action string")
    sessions = spark.createDataFrame([(day(d),) for d in (2, 5, 8, 9)], "date date")
    got = {(r.date.day, r.ticker) for r in joins.membership_panel(sessions, events).collect()}
    assert got == {(d, t) for d in (2, 5) for t in ("AAA", "BBB")} | {(d, t) for d in (8, 9) for t in ("BBB", "CCC")}
    with pytest.raises(ValueError):
        joins.membership_panel(sessions, events.where("action = 'added'"))


def test_filings_are_seen_from_their_day_on(spark):
    day = lambda d: dt.date(2024, 2, d)
    prices = spark.createDataFrame([("A", day(1), 1.0), ("A", day(2), 1.0), ("A", day(5), 1.0), ("B", day(5), 1.0)], "ticker string, date date, close double")
    filings = spark.createDataFrame([("A", day(2), 0.1, 1), ("A", day(2), 0.2, 2), ("A", day(4), None, 3)], "ticker string, date date, roe double, n int")
    got = {(r.ticker, r.date.day): (r.roe, r.fundamental_date and r.fundamental_date.day) for r in joins.point_in_time_fundamentals(prices, filings, ["n"]).collect()}
    assert got == {("A", 1): (None, None), ("A", 2): (0.2, 2), ("A", 5): (None, 4), ("B", 5): (None, None)}
    old = joins.series_asof(prices.select("date").distinct(), filings.where("n = 2").select("date", "roe"), tolerance_days=2)
    assert {r.date.day: r.roe for r in old.collect()} == {1: None, 2: 0.2, 5: None}


def test_execution_prices_scale_by_the_adjustment(spark):
    row = panel.execution_prices(spark.createDataFrame([("A", dt.date(2024, 1, 1), 9.0, 10.0, 10.5)], "ticker string, date date, open double, close double, adj_close double")).first()
    assert row.execution_open == pytest.approx(9.45) and row.mark_close == 10.5
    with pytest.raises(ValueError):
        panel.sessions(spark.createDataFrame([(dt.date(2024, 1, 1),)], "date date"), 0)


def test_a_delisted_name_is_sold_at_its_last_mark(spark):
    days = [d.date() for d in DAYS[:6]]
    rows = [(d, t, 10.0, 10.0, 10.0) for t, n in (("AAA", 3), ("BBB", 6)) for d in days[:n]]
    prices = panel.execution_prices(spark.createDataFrame(rows, "date date, ticker string, open double, close double, adj_close double"))
    ranked = prices.select("date", "ticker", F.when(F.col("ticker") == "AAA", 1).otherwise(2).alias("selection_rank"))
    out = backtest.hold_backtest(ranked, prices, 5, 2, 0.01, 0.001, 1000.0)
    trades = {(r.ticker, r.action, r.date) for r in out["trades"].collect()}
    assert ("AAA", "FORCED_EXIT", days[2]) in trades and ("BBB", "SELL", days[5]) in trades and len(trades) == 5
    equity = [r.equity for r in out["equity"].orderBy("date").collect()]
    assert len(equity) == 6 and equity[0] < 1000 and equity[3] < equity[2]
    summary = metrics.trade_summary(out["trades"]).first()
    assert (summary.buy_orders, summary.forced_exits, summary.open_positions) == (3, 1, 1)
    growth = {r.cohort: (r.factor, r.start_growth) for r in backtest.cohort_growth(out["positions"], 0.001).collect()}
    assert growth[1][1] == pytest.approx(growth[0][0]) and equity[5] == pytest.approx(1000 * growth[0][0] * growth[1][0])


def test_composite_uses_fundamentals_of_members_only(spark):
    rows = []
    for name, member, roe in (("GOOD", True, 0.4), ("WEAK", True, 0.1), ("OUT", False, 0.9)):
        for i, day in enumerate(DAYS):
            rows.append((day.date(), name, 20 + i * 0.01, 1e7, 1e9, member, roe, 10.0))
    df = spark.createDataFrame(rows, "date date, ticker string, close double, dollar_volume double, market_cap double, is_sp500 boolean, roe double, pe double")
    got = features.latest_ranking(selectors.rank_composite(df, selectors.CompositeConfig(max_volatility_percentile=1.0))).orderBy("selection_rank").collect()
    assert [r.ticker for r in got] == ["GOOD", "WEAK"] and got[0].quality_rank > got[1].quality_rank
    assert {r.shareholder_yield_rank for r in got} == {0.5} and {r.financial_strength_rank for r in got} == {0.5}
    with pytest.raises(KeyError):
        selectors.rank_composite(df.drop("is_sp500"))


def test_metrics_of_a_flat_and_a_lost_curve(spark):
    rows = [(s, d.date(), v if i else 100.0) for s, v in (("flat", 100.0), ("lost", 0.0)) for i, d in enumerate(DAYS[:10])]
    got = {r.strategy: r for r in metrics.equity_metrics(spark.createDataFrame(rows, "strategy string, date date, equity double"), 100.0).collect()}
    assert got["flat"].sharpe_ratio == 0 and got["flat"].cagr_pct == 0 and got["lost"].cagr_pct == -100 and got["lost"].max_drawdown_pct == 100


def test_weights_and_splits(spark):
    long = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (1, "zzz", 9.0), (2, "a", -1.0)], "candidate_id int, feature string, weight double")
    assert [(r.candidate_id, list(r.weights)) for r in tuning.normalised_candidates(long, ["a", "b", "c"]).collect()] == [(1, [0.5, 0.5, 0.0])]
    spans = spark.createDataFrame([(i, dt.date(2020 + i, 1, 1), dt.date(2020 + i, 7, 1), 0.1) for i in range(5)], "period int, start date, stop date, benchmark_return double")
    row = tuning.split_is_usable(tuning.split_periods(spans, 2)).first()
    assert (row.development, row.audit, row.purged, row.usable) == (2, 2, 1, False)


def test_refresh_prefers_new_bars_and_flags_the_last_day(spark):
    day = lambda d: dt.date(2024, 1, d)
    old = spark.createDataFrame([("A", day(1), 1.0, 5.0), ("A", day(2), 2.0, 5.0)], "ticker string, date date, close double, market_cap double")
    new = spark.createDataFrame([("A", day(2), 9.0), ("A", day(3), 3.0)], "ticker string, date date, close double")
    got = {r.date.day: (r.close, r.is_sp500) for r in dataset.refresh(old, new, names(spark, "A")).collect()}
    assert got == {1: (1.0, False), 2: (9.0, False), 3: (3.0, True)}
    with pytest.raises(ValueError):
        dataset.build_benchmark(new.where("false"), "B")


def test_sources_round_trip(spark, tmp_path):
    df = price_panel(spark).limit(50)
    sources.write_csv(df, f"{tmp_path}/csv")
    back = sources.read_panel(spark, f"{tmp_path}/csv", ["date", "ticker"], ["close", "absent"], "csv", df.schema)
    assert back.columns == ["date", "ticker", "close"] and back.count() == 50
    sources.write_panel(df, f"{tmp_path}/panel")
    assert sources.read_table(spark, f"{tmp_path}/panel").where("year = 2023").count() == df.where("year(date) = 2023").count()
    sources.write_summary(df.agg(F.count("*").alias("n")), f"{tmp_path}/summary")
    files = [f for f in os.listdir(f"{tmp_path}/summary") if f.endswith(".json")]
    assert len(files) == 1 and json.loads(open(f"{tmp_path}/summary/{files[0]}").read()) == {"n": 50}
    with pytest.raises(KeyError):
        sources.require(df, ["nothing"])
    with pytest.raises(ValueError):
        sources.read_table(spark, f"{tmp_path}/csv", "csv")


TWINS = "n8_keep_last j3_asof_filings j7_membership_panel j10_unambiguous_map a6_metrics_against_benchmark w14_rsi w17_market_regime w18_strategy_switch p2_rank_stocks p5_point_in_time_panel p6_hold_equity p8_periods p9_evaluate p16_candidate_table j8_rsi_join p7_compare s7_csv_sink s7_panel_sink s8_summary_sink w21_trailing_stop".split()


@pytest.mark.parametrize("name", TWINS)
def test_query_matches_its_twin(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, folder).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)

    def rows(df):
        return sorted((tuple("" if pd.isna(v) else str(v)[:10] if hasattr(v, "year") else round(v, 5) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False)), key=str)

    assert rows(got) == rows(want)


def test_the_flagship_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def prices_of(spark, closes):
    """Prices of each ticker on the first days, opens like closes."""
    rows = [(DAYS[i].date(), t, c, c, c) for t, line in closes.items() for i, c in enumerate(line)]
    return panel.execution_prices(spark.createDataFrame(rows, "date date, ticker string, open double, close double, adj_close double"))


def test_a_stop_sells_at_the_next_open_and_waits_in_cash(spark):
    prices = prices_of(spark, {"A": [10.0, 12.0, 10.0, 5.0, 9.0, 9.0, 9.0], "B": [10.0] * 7})
    ranked = prices.select("date", "ticker", F.lit(1).alias("selection_rank"))
    plan = backtest.cohorts(prices, 5)
    held = backtest.positions(backtest.picks(ranked, plan, 2), prices, 0.0)
    stopped = backtest.sold_at_stops(backtest.trailing_stops(held, prices, 0.15), prices, 0.0)
    got = {(r.cohort, r.ticker): (r.exit, r.exit_date, r.action) for r in stopped.collect()}
    assert got[0, "A"] == (5.0, DAYS[3].date(), "SELL") and got[0, "B"] == (10.0, DAYS[5].date(), "SELL")
    equity = [r.equity for r in backtest.daily_equity(stopped, prices, plan, 0.0, 100.0).orderBy("date").collect()]
    assert equity == pytest.approx([100, 110, 100, 75, 75, 75, 75])


def test_sessions_without_positions_are_cash(spark):
    prices = prices_of(spark, {"A": [10.0, 10.0, 20.0, 20.0, 30.0, 30.0]})
    ranked = prices.where(F.col("date") == DAYS[2].date()).select("date", "ticker", F.lit(1).alias("selection_rank"))
    plan = backtest.cohorts(prices, 2)
    held = backtest.positions(backtest.picks(ranked, plan, 1), prices, 0.0)
    equity = backtest.daily_equity(held, prices, plan, 0.0, 100.0, ["hold", "none"]).orderBy("strategy", "date").collect()
    assert [r.equity for r in equity] == pytest.approx([100, 100, 100, 100, 150, 150] + [100] * 6)
    assert [r.cash_pct for r in equity] == pytest.approx([100, 100, 0, 0, 100, 100] + [100] * 6)


def test_a_ranking_may_be_a_function_of_the_rebalance_days(spark):
    prices = prices_of(spark, {"A": [10.0, 11.0, 12.0, 13.0], "B": [10.0, 9.0, 8.0, 7.0]})
    rank = lambda days: days.select("date", F.lit("B").alias("ticker"), F.lit(1).alias("selection_rank"))
    out = backtest.hold_backtest(rank, prices, 2, 1, 0.0, 0.0, 100.0)
    assert [r.tickers for r in out["rebalances"].orderBy("cohort").collect()] == ["B", "B"]
    assert [r.equity for r in out["equity"].orderBy("date").collect()] == pytest.approx([100, 90, 80, 70])


def test_persistent_names_stay_before_new_ones(spark):
    order = [["A", "B", "C", "D"], ["B", "C", "A", "D"], ["C", "D", "B", "A"]]
    rows = [(DAYS[i].date(), t, k + 1) for i, names_ in enumerate(order) for k, t in enumerate(names_)]
    ranked = spark.createDataFrame(rows, "date date, ticker string, selection_rank int")
    got = {}
    for r in strategies.persistent(ranked, 3, 2).orderBy("date", "selection_rank").collect():
        got.setdefault(r.date, []).append(r.ticker)
    #: A stays at rank 3 and goes at 4; C comes in on the second day, after those that were in before
    assert list(got.values()) == [["A", "B"], ["B", "A", "C"], ["C", "B", "D"]]


def test_orderings_refuse_strategies_that_choose_among_others(spark):
    columns = "date date, ticker string, selection_score double, decision_momentum_12m_ex_1m double, decision_price_vs_200d_ma double, rsi14_decision double, adaptive_risk_on_score double, adaptive_risk_off_score double"
    own = tuple(s for s in strategies.STRATEGIES if s.among)
    with pytest.raises(ValueError, match=own[0].name):
        strategies.orderings(spark.createDataFrame([], columns), spark.createDataFrame([], "date date, risk_on_for_open boolean"), own)


def test_scoring_candidates_shuffles_no_triples(spark, tmp_path):
    periods = spark.createDataFrame([(p, f"T{k}", [k / 9.0, p / 3.0], float(k)) for p in range(3) for k in range(9)], "period int, ticker string, features array<double>, forward_return double")
    candidates = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])], "candidate_id int, weights array<double>")
    out = tuning.evaluate(periods, candidates, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.replace("SortAggregate", "") and "Cartesian" not in plan
    spans = periods.select("period").distinct()
    got = {(r.candidate_id, r.period): r.strategy_return for r in tuning.by_period(out, spans).collect()}
    assert got == {(c, p): v for p in range(3) for c, v in ((1, 7.5), (2, 0.5), (3, 0.5))}


def test_top_means_take_the_first_of_equal_scores_at_the_cut():
    rng = np.random.default_rng(4)
    returns = rng.standard_normal(30)
    scores = rng.integers(0, 6, (200, 30)) / 2.0
    for n in (1, 4, 30, 40):
        want = [returns[np.argsort(-row, kind="stable")[:n]].mean() for row in scores]
        assert np.allclose(tuning.top_means(scores, returns, n), want)


def test_candidate_metrics_of_arrays_match_numpy(spark):
    rng = np.random.default_rng(9)
    start = dt.date(2020, 1, 1)
    parts = ["development"] * 14 + ["purged"] * 2 + ["audit"] * 5
    spans = spark.createDataFrame([(i, start + dt.timedelta(days=i), start, float(b), p) for i, (p, b) in enumerate(zip(parts, rng.normal(0, 0.1, 21)))], "period long, start date, stop date, benchmark_return double, part string")
    bench = np.array([r.benchmark_return for r in spans.orderBy("period").collect()])
    values = {c: rng.normal(0.05, 0.2, 21) for c in range(6)}
    values[5][3] = -1.5
    returns = spark.createDataFrame([(c, v.tolist()) for c, v in values.items()], "candidate_id int, returns array<double>")
    got = {r.candidate_id: r for r in tuning.candidate_metrics(returns, spans).collect()}
    for c, v in values.items():
        active = np.log1p(np.maximum(v, -0.999)) - np.log1p(bench)
        dev, audit = active[:14], active[16:]
        spread = np.std([f.mean() for f in np.array_split(dev, 4)])
        robust = dev.mean() + 0.35 * np.quantile(dev, 0.25) + 0.01 * ((dev > 0).mean() - 0.5) - 0.35 * spread
        want = (dev.mean(), np.quantile(dev, 0.25), (dev > 0).mean(), v[:14].mean(), spread, robust, audit.mean(), np.quantile(audit, 0.25), (audit > 0).mean(), v[16:].mean())
        names = "development_mean_active development_active_q25 development_outperformance_rate development_strategy_mean fold_std robust_score audit_mean_active audit_active_q25 audit_outperformance_rate audit_strategy_mean"
        assert np.allclose([got[c][n] for n in names.split()], want)
    few = tuning.candidate_metrics(returns.withColumn("returns", F.slice("returns", 1, 2)), spans.where("period < 2")).first()
    assert few.fold_std is not None and few.audit_mean_active is None and few.audit_active_q25 is None


def bars_of(spark, tickers, days, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(t, d.date(), float(c), float(c * 10), float(m)) for t in tickers for d, c, m in zip(days, rng.uniform(5, 50, len(days)), rng.uniform(1, 9, len(days)))]
    return spark.createDataFrame(rows, "ticker string, date date, close double, dollar_volume double, market_cap double")


def same_features(got, want):
    columns = sorted(set(want.columns))
    assert sorted(got.columns) == columns
    round_ = lambda df: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect())
    assert round_(got) == round_(want)


def test_a_refreshed_store_equals_a_rebuilt_panel_and_rewrites_only_the_new_year(spark, tmp_path):
    days = pd.bdate_range("2021-06-01", periods=440)
    bars = bars_of(spark, ["A", "B", "C"], days)
    cut = days[420].date()
    store = PanelStore(spark, str(tmp_path / "store"))
    store.build(bars.where(F.col("date") <= days[425].date()).withColumn("close", F.when(F.col("date") >= cut, 99.0).otherwise(F.col("close"))))
    files = {y: sorted(glob.glob(f"{tmp_path}/store/bars/year={y}/*.parquet")) for y in (2021, 2022, 2023)}
    assert store.tail().count() == 3 * 300
    late = bars_of(spark, ["D"], days[430:], seed=2)
    got = store.refresh(bars.where(F.col("date") >= cut).unionByName(late), spark.createDataFrame([("A",), ("D",)], "ticker string"))
    want = selectors.prepare_features(bars.unionByName(late)).where(F.col("date") >= cut)
    want = want.withColumn("is_sp500", F.col("ticker").isin("A", "D") & (F.col("date") == days[-1].date()))
    same_features(got, want)
    assert {y: sorted(glob.glob(f"{tmp_path}/store/bars/year={y}/*.parquet")) for y in (2021, 2022)} == {y: files[y] for y in (2021, 2022)}
    assert sorted(store.bars().drop("market_cap_rank").collect()) == sorted(bars.unionByName(late).collect())
    more = bars_of(spark, ["A", "B", "C", "D"], pd.bdate_range(days[-1] + pd.Timedelta(days=1), periods=3), seed=3)
    same_features(store.refresh(more), selectors.prepare_features(bars.unionByName(late).unionByName(more)).where(F.col("date") > days[-1].date()))


def test_a_store_reads_the_history_of_tickers_whose_new_bars_reach_behind_the_tail(spark, tmp_path):
    days = pd.bdate_range("2020-01-01", periods=700)
    bars = bars_of(spark, ["A", "B"], days)
    store = PanelStore(spark, str(tmp_path / "store"))
    store.build(bars.where("date <> DATE '2021-03-01'"))
    got = store.refresh(bars.where("date = DATE '2021-03-01' AND ticker = 'A'"))
    want = selectors.prepare_features(bars.where("ticker = 'A' OR date <> DATE '2021-03-01'")).where("ticker = 'A' AND date >= DATE '2021-03-01'")
    same_features(got, want)
    assert store.refresh(bars.limit(0)).count() == 0
    with pytest.raises(ValueError, match="priced_ok"):
        gates = {"smallest": 1, "largest": 5, "priced": 2, "as_of": "2022-09-01", "stale_days": 3}
        store.refresh(bars.where("date = DATE '2022-09-06' AND ticker = 'A'"), spark.createDataFrame([("A",), ("B",)], "ticker string"), gates)


def test_a_ticker_that_a_later_snapshot_lacks_leaves_without_meeting_it(spark):
    sessions = spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2023-01-02", periods=8)], "date date")
    log = [("2022-12-30", "A", "historical"), ("2022-12-30", "B", "current"), ("2023-01-04", "B", "historical"), ("2023-01-04", "C", "added"), ("2023-01-04", "D", "removed"),
           ("2023-01-05", "C", "removed"), ("2023-01-05", "A", "added"), ("2023-01-07", "D", "added"), ("2023-01-11", "E", "historical"), ("2030-01-01", "Z", "added")]
    events = spark.createDataFrame(log, "date string, ticker string, action string").withColumn("date", F.to_date("date"))
    out = joins.membership_panel(sessions, events)
    got = {}
    for r in out.collect():
        got.setdefault(r.ticker, []).append(r.date.day)
    assert {t: sorted(d) for t, d in got.items()} == {"A": [2, 3, 5, 6, 9, 10], "B": [2, 3, 4, 5, 6, 9, 10], "C": [4], "D": [9, 10], "E": [11]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="no membership snapshot"):
        joins.membership_panel(sessions, events.where("date > DATE '2023-01-02'"))


def test_asof_join_of_a_hot_key_by_buckets_equals_the_plain_one_and_spreads(spark):
    rng = np.random.default_rng(8)
    day = lambda n: (dt.date(2020, 1, 1) + dt.timedelta(days=int(n)))
    left = [("HOT" if rng.random() < 0.5 else f"T{rng.integers(40)}", day(rng.integers(0, 1500)), i) for i in range(4000)] + [(None, day(3), -1), ("HOT", None, -2)]
    right = {(t, day(rng.integers(0, 1500))): i for i, t in enumerate(["HOT"] * 30 + ["T1"] * 5 + ["T2"])}
    left = spark.createDataFrame(left, "ticker string, date date, row int")
    right = spark.createDataFrame([(t, d, float(i) if i % 3 else None) for (t, d), i in right.items()], "ticker string, filed date, value double")
    plain = joins.asof_backward(left, right, ["ticker"], "date", "filed")
    split = joins.asof_backward_split(left, right, ["ticker"], "date", "filed", bucket_days=30)
    order = lambda df: sorted(map(str, df.select("ticker", "date", "row", "filed", "value").collect()))
    assert order(split) == order(plain)
    near = joins.asof_backward_split(left, right, ["ticker"], "date", "filed", 30, tolerance_days=40)
    assert order(near) == order(joins.asof_backward(left, right, ["ticker"], "date", "filed", 40))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [r["count"] for r in split.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(tasks) < 2 * sorted(tasks)[len(tasks) // 2]


def test_features_of_a_bucketed_panel_are_not_shuffled_and_tickers_reach_its_scan(spark, tmp_path):
    bars = features.market_cap_rank(bars_of(spark, ["a ", "B.AX", "c"], pd.bdate_range("2022-01-03", periods=280)))
    stored = sources.write_panel_by_ticker(bars, "bucketed_panel", str(tmp_path / "panel"), buckets=4)
    got = selectors.prepare_features(stored, clean_already=True)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    same_features(got, selectors.prepare_features(bars))
    universe = spark.createDataFrame([(" a",), ("",), ("b",)], "ticker string")
    kept = sources.filter_archive(stored, universe, "2022-02-01", "2022-12-31", normalised=True)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan and " IN (" in plan.split("PartitionFilters")[0] and "DataFilters: [isnotnull(date" in plan
    assert {r.ticker for r in kept.collect()} == {"A", "B"} == {r.ticker for r in sources.filter_archive(bars, universe, "2022-02-01", "2022-12-31").collect()}
    spark.sql("DROP TABLE bucketed_panel")


def test_sets_of_rows_and_symbols(spark):
    bars = spark.createDataFrame([(" a", 1), ("B.AX", 2), ("c", 3), (None, 4)], "ticker string, n int")
    names = spark.createDataFrame([("A",), ("b",), (None,)], "ticker string")
    assert sorted(r.n for r in panel.within(bars, names).collect()) == [1, 2]
    assert sorted(r.n for r in panel.outside(bars, names).collect()) == [3, 4]
    assert [r.ticker for r in panel.newcomers(bars, names).collect()] == ["C"]
    both = panel.stacked([bars, names.withColumn("extra", F.lit("x"))]).collect()
    assert len(both) == 7 and {(r.n, r.extra) for r in both if r.extra} == {(None, "x")}
    with pytest.raises(ValueError):
        panel.stacked([])
    prices = spark.createDataFrame([("A", 1, 5.0), ("B", 1, 6.0)], "ticker string, date int, close double")
    values = spark.createDataFrame([("A", 1, 9.0, 0.5), ("A", 1, 9.0, 0.7)], "ticker string, date int, close double, pe double")
    assert sorted((r.ticker, r.close, r.pe or 0.0) for r in joins.valuation_join(prices, values).collect()) == [("A", 5.0, 0.5), ("A", 5.0, 0.7), ("B", 6.0, 0.0)]


def test_written_tables_go_when_they_are_discarded(spark):
    df = sources.written(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    assert sources.discard_written(spark) > 0 and not os.path.exists(path)
    assert sources.discard_written(spark) == 0
