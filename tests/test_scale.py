"""Shapes that grow with the tables: what is scored, ranked and carried along."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import backtest, features, joins, rolling, tuning
from factorloom.plans import queries, selectors, strategies
from factorloom.plans.fixtures import Tables
from factorloom.plans.store import PanelStore
from tests.test_panel import bars_of


def scored_by_hand(names, weights, n):
    """Mean return of the n best names, equal ones by ticker."""
    score = np.zeros(len(names))
    for i, w in enumerate(weights):
        score += w * np.array([f[i] for _, f, _ in names])
    order = sorted(range(len(names)), key=lambda k: (-score[k], names[k][0]))
    return np.mean([names[k][2] for k in order[:n]])


@pytest.mark.parametrize("at_once", [50_000, 40])
def test_candidates_meet_only_names_that_may_be_chosen(spark, monkeypatch, at_once):
    monkeypatch.setattr(tuning, "NAMES_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    #: many equal features, so that places at the cut are decided by tickers
    periods = {p: [(f"T{k:03d}", (rng.integers(0, 12, 3) / 11).tolist(), float(rng.normal())) for k in range(150)] for p in range(3)}
    rows = spark.createDataFrame([(p, *n) for p, own in periods.items() for n in own], "period int, ticker string, features array<double>, forward_return double")
    weights = {c: (rng.integers(-3, 9, 3) / 8).tolist() for c in range(90)}
    candidates = spark.createDataFrame(list(weights.items()), "candidate_id int, weights array<double>")
    got = {r.candidate_id: r.returns for r in tuning.evaluate(rows, candidates, 4).collect()}
    assert got.keys() == weights.keys()
    for c, w in weights.items():
        assert np.allclose(got[c], [scored_by_hand(own, w, 4) for _, own in sorted(periods.items())])
    found = {r.candidate_id: r for r in tuning.score_summary(rows, candidates).collect()}
    for c, w in weights.items():
        scores = [np.dot(w, f) for own in periods.values() for _, f, _ in own]
        assert np.allclose((found[c].mean_score, found[c].best_score), (np.mean(scores), np.max(scores)))


def test_a_name_that_may_be_chosen_under_some_weights_stays():
    rng = np.random.default_rng(5)
    for _ in range(40):
        names, d, n = rng.integers(5, 300), rng.integers(1, 5), rng.integers(1, 6)
        f = rng.integers(0, 30, (names, d)) / 29
        w = rng.normal(size=d) + rng.normal(size=(20, d)) * rng.choice([0.01, 0.3])
        kept = set(tuning.can_be_chosen(f, w.min(axis=0), w.max(axis=0), n).tolist())
        for row in tuning.scores_of(f, w):
            assert set(np.argsort(-row, kind="stable")[:n].tolist()) <= kept
    near = tuning.can_be_chosen(rng.random((4000, 3)), np.array([0.3, 0.3, 0.3]), np.array([0.31, 0.31, 0.31]), 5)
    assert len(near) < 100


def test_candidates_of_equal_weights_are_scored_once(spark):
    candidates = spark.range(2000).select(F.col("id").alias("candidate_id"), F.array(*[((F.col("id") + k) % 3).cast("double") for k in range(3)]).alias("weights"))
    blocks = tuning.packed_weights(tuning.distinct_weights(candidates)).collect()
    assert sum(len(b.weights) for b in blocks) == 9


def test_kept_columns_equal_those_of_all(spark):
    import pandas as pd

    days = pd.bdate_range("2020-01-01", periods=320)
    bars = bars_of(spark, [f"T{k}" for k in range(6)], days).withColumns({"is_sp500": F.lit(True), "pe": F.col("close") - 20, "fcf": F.col("close") * 3, "roe": F.col("dollar_volume")})
    gates = dict(min_price=0.0, min_median_dollar_volume_60d=0.0, min_price_vs_200d_ma=-1.0, max_volatility_percentile=1.0)
    names = spark.createDataFrame([(f"T{k}",) for k in range(6)], "ticker string")
    exact = lambda df, c: sorted(map(str, df.select(*c).collect()))
    some = ["date", "ticker", "momentum_6m_rank", "selection_score", "selection_rank"]
    config = selectors.PriceConfig(**gates)
    whole = selectors.rank_stocks(bars, names, config=config)
    got = selectors.rank_stocks(bars, names, config=config, keep=["momentum_6m_rank"])
    assert sorted(got.columns) == sorted(some) and exact(got, some) == exact(whole, some)
    last = whole.agg(F.max("date").alias("date"))
    assert exact(selectors.rank_stocks(bars, names, config=config, keep=["momentum_6m_rank"], ranking_dates=last), some) == exact(features.latest_ranking(whole), some)
    some = ["date", "ticker", "quality_rank", "value_rank", "fcf_yield_rank", "shareholder_yield_rank", "selection_score", "selection_rank"]
    config = selectors.CompositeConfig(**gates, rsi_threshold=60.0)
    whole = selectors.rank_composite(bars, config)
    got = selectors.rank_composite(bars, config, keep=some[2:6], clean_already=True)
    assert exact(got, some) == exact(whole, some) and len(got.columns) == 9
    sized = selectors.prepare_features(bars, keep=["decision_market_cap_rank"])
    assert sized.columns == ["date", "ticker", "decision_market_cap_rank"] and "MapInArrow" not in sized._jdf.queryExecution().executedPlan().toString()


def test_only_kept_columns_go_through_the_rolling_kernel(spark):
    df = spark.createDataFrame([("A", k, float(k), "x") for k in range(5)], "ticker string, date int, x double, other string")
    out = rolling.rolling(df, [rolling.Rolling("m", "x", "mean", 2)], lag=1, lagged="old_", keep=["ticker", "date"], current=False)
    assert out.columns == ["ticker", "date", "old_m"]
    assert [r.old_m for r in out.orderBy("date").collect()] == [None, None, 0.5, 1.5, 2.5]


def test_rows_of_an_asof_join_are_dealt_by_its_keys(spark):
    left = spark.createDataFrame([("A", 3, 1.0), ("A", 1, 2.0), ("B", 2, 3.0)], "ticker string, date int, x double")
    right = spark.createDataFrame([("A", 2, 7.0)], "ticker string, day int, y double")
    out = joins.asof_backward(left, right, ["ticker"], "date", "day")
    assert out.columns == ["ticker", "date", "x", "day", "y"]
    assert sorted(map(tuple, out.collect())) == [("A", 1, 2.0, None, None), ("A", 3, 1.0, 2, 7.0), ("B", 2, 3.0, None, None)]
    plan = features.history_days(out)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_flags_from_spells_equal_the_whole_membership_panel(spark):
    day = lambda k: f"2020-01-{k:02d}"
    rng = np.random.default_rng(8)
    prices = spark.createDataFrame([(t, day(k)) for t in "ABCDE" for k in range(2, 29, 3) if rng.random() < 0.7], "ticker string, date string").select("ticker", F.to_date("date").alias("date"))
    log = [(t, day(1), "historical") for t in "ABC"] + [(t, day(16), "historical") for t in "BD"]
    log += [("A", day(6), "removed"), ("A", day(7), "added"), ("E", day(9), "added"), ("C", day(4), "removed"), ("B", day(22), "removed"), ("B", day(24), "added")]
    events = spark.createDataFrame(log, "ticker string, date string, action string").select("ticker", F.to_date("date").alias("date"), "action")
    panel = joins.membership_panel(prices.select("date").distinct(), events).withColumn("is_sp500", F.lit(True))
    want = sorted(map(tuple, joins.membership_join(prices, panel).select("ticker", "date", "is_sp500").collect()))
    got = joins.membership_flags(prices, events)
    assert sorted(map(tuple, got.select("ticker", "date", "is_sp500").collect())) == want
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_periods_look_at_the_last_bars_before_stops_only(spark):
    rng = np.random.default_rng(4)
    day = lambda k: f"2020-01-{k:02d}"
    bars = spark.createDataFrame([(t, day(k), float(k)) for t in "ABCDE" for k in range(1, 29) if rng.random() < 0.3], "ticker string, date string, close double").withColumn("date", F.to_date("date"))
    days = spark.createDataFrame([(day(k),) for k in range(1, 29)], "date string").select(F.to_date("date").alias("date"))
    stops = days.where("day(date) IN (5, 12, 13, 25)")
    last = tuning.last_before(bars, days, stops)
    names = bars.select("ticker").distinct().crossJoin(stops.withColumnRenamed("date", "stop"))
    joined = lambda right: sorted(map(str, joins.asof_backward(names, right.withColumnRenamed("date", "last"), ["ticker"], "stop", "last").select("ticker", "stop", "last", "close").collect()))
    assert joined(last) == joined(bars)
    assert last.count() <= 5 * 4 and last.count() < bars.count()


def test_features_of_asked_days_see_all_rows_but_only_these_are_ranked(spark):
    bars = bars_of(spark, ["A", "B"], pd.bdate_range("2020-01-01", periods=300))
    asked = bars.select("date").distinct().orderBy(F.desc("date")).limit(3)
    keep = ["decision_close", "decision_history_days", "decision_drawdown_252d", "decision_median_dollar_volume_60d"]
    found = selectors.prepare_features(bars, keep=keep, dates=asked)
    want = selectors.prepare_features(bars, keep=keep).join(asked, "date", "left_semi")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))


def test_tasks_that_add_up_bars_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(queries, "LINES_A_TASK", 500)
    t = Tables(spark, "/root/testdata/sf0.01")
    own = queries.with_bars(t)
    assert len(own.bars.inputFiles()) > 3 * spark.sparkContext.defaultParallelism
    assert own.bars.exceptAll(t.bars).count() == t.bars.exceptAll(own.bars).count() == 0


def test_last_bars_before_stops_are_found_without_a_sort(spark):
    bars = bars_of(spark, ["A", "B"], pd.bdate_range("2022-01-03", periods=30)).select("date", "ticker", "close")
    days = bars.select("date").distinct()
    last = tuning.last_before(bars, days, days.where("dayofmonth(date) % 10 = 0"))
    assert last.columns == bars.columns
    assert "SortAggregate" not in last._jdf.queryExecution().executedPlan().toString()


def test_fundamentals_that_come_late_are_those_of_the_whole_panel(spark):
    t = queries.with_bars(Tables(spark, "/root/testdata/sf0.01"))
    keep = ["size_rank", "quality_rank", "value_rank", "shareholder_yield_rank", "fcf_yield_rank", "decision_rsi14"]
    got = queries.composite(t, keep)
    rows = queries.panel.drop_missing(queries.full_panel(t), ["date", "ticker", "close"])
    whole = selectors.rank_composite(rows, queries.COMPOSITE, None, keep, clean_already=True)
    assert got.columns == whole.columns and got.count() > 0
    assert got.exceptAll(whole).count() == whole.exceptAll(got).count() == 0


def test_a_panel_without_sizes_is_not_sorted_for_their_ranks(spark):
    bars = bars_of(spark, ["A"], pd.bdate_range("2022-01-03", periods=3)).select("ticker", "date", "close")
    got = features.market_cap_rank(bars)
    assert got.where("market_cap_rank IS NULL").count() == 3
    assert dict(got.dtypes)["market_cap_rank"] == "int"
    assert "Window" not in got._jdf.queryExecution().analyzed().toString()


def test_a_refresh_works_out_kept_columns_only(spark, tmp_path):
    bars = bars_of(spark, ["A", "B"], pd.bdate_range("2021-06-01", periods=320))
    keep = ["close", "history_days", "ma_200d", "decision_history_days", "decision_momentum_6m"]
    found = []
    for own in (None, keep):
        store = PanelStore(spark, str(tmp_path / f"store{own is None}"))
        store.build(bars.where("date < DATE '2022-06-01'"))
        found.append(store.refresh(bars.where("date >= DATE '2022-05-20'"), **({"keep": own} if own else {})))
    assert found[1].columns == ["date", "ticker", *keep]
    whole = found[0].select(*found[1].columns)
    assert found[1].count() > 0 and whole.exceptAll(found[1]).count() == found[1].exceptAll(whole).count() == 0


def test_candidates_are_dealt_by_the_results_they_get(spark, monkeypatch):
    monkeypatch.setattr(tuning, "TASK_BYTES", 1000)
    candidates = spark.range(300).coalesce(1).select(F.col("id").alias("candidate_id"), F.array((F.col("id") % 3).cast("double")).alias("weights"))
    results = spark.createDataFrame([([float(k)], [1.0 * k, 2.0]) for k in range(3)], "weights array<double>, returns array<double>")
    with_adaption = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = tuning.for_all(results, candidates)
        assert dealt.rdd.getNumPartitions() >= 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_adaption)
    assert sorted(tuple(r.returns) for r in dealt.collect()) == sorted((float(k % 3), 2.0) for k in range(300))


def test_rows_are_not_multiplied_by_strategies_before_they_are_dealt(spark):
    rng = np.random.default_rng(11)
    rows = [(pd.Timestamp("2024-01-01") + pd.Timedelta(days=int(d)), f"T{k:02d}", float(rng.integers(0, 5)), None if k == 3 else float(rng.integers(0, 4)), float(rng.normal()), float(rng.integers(20, 50)), float(rng.random()), float(rng.random())) for d in range(4) for k in range(20)]
    names = ["date", "ticker", "selection_score", "decision_momentum_12m_ex_1m", "decision_price_vs_200d_ma", "rsi14_decision", "adaptive_risk_on_score", "adaptive_risk_off_score"]
    ranked = spark.createDataFrame(pd.DataFrame(rows, columns=names)).withColumn("date", F.to_date("date")).withColumn("selection_rank", F.lit(0)).withColumn("decision_momentum_12m_ex_1m", F.nullif(F.col("decision_momentum_12m_ex_1m"), F.lit(float("nan"))))
    regime = spark.createDataFrame([("2024-01-02", True), ("2024-01-03", False)], "date string, risk_on_for_open boolean").withColumn("date", F.to_date("date"))
    own = tuple(s for s in strategies.STRATEGIES if s.stay is None and not s.among)
    out = strategies.orderings(ranked, regime, own)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" in plan.split("Exchange hashpartitioning")[0]
    got = {s: [] for s in {x.name for x in own}}
    for r in out.orderBy("strategy", "date", "selection_rank").collect():
        got[r.strategy].append((str(r.date), r.ticker, r.selection_rank, r.exposure))
    for s in own:
        want = []
        for day in sorted({str(r[0].date()) for r in rows}):
            on = day == "2024-01-02"
            kept = []
            for r in (dict(zip(names, r)) for r in rows if str(r[0].date()) == day):
                if s.name == "trend_filter" and not (on and r["decision_price_vs_200d_ma"] > 0) or s.name.startswith("mean_reversion") and not r["rsi14_decision"] <= float(s.name[-2:]):
                    continue
                key = r["decision_momentum_12m_ex_1m"] if s.name == "momentum_12_1" else r["adaptive_risk_on_score" if on else "adaptive_risk_off_score"] if s.name.startswith("regime") else r["selection_score"]
                kept.append((key is None or pd.isna(key), 0 if key is None or pd.isna(key) else -key, -r["selection_score"], r["ticker"]))
            share = float(s.name[16:-3].strip("_")) / 100 if s.name.startswith("regime") and not on else 1.0
            want += [(day, k[3], i + 1, share) for i, k in enumerate(sorted(kept))]
        assert got[s.name] == want, s.name


def test_only_the_last_days_are_ranked_unless_none_has_a_row(spark):
    days = spark.sql("SELECT date_add(DATE '2024-01-01', CAST(id AS INT)) AS date FROM range(60)")
    asked = []

    def rank(last):
        """Rows up to a day, of the asked days."""

        def own(dates):
            asked.append(None if dates is None else dates.count())
            rows = days.where(F.col("date") <= last).withColumn("ticker", F.lit("A"))
            return rows if dates is None else rows.join(dates, "date", "left_semi")

        return own

    assert [str(r.date) for r in features.latest_of(rank("2024-02-25"), days).collect()] == ["2024-02-25"] and asked == [21]
    assert [str(r.date) for r in features.latest_of(rank("2024-01-05"), days).collect()] == ["2024-01-05"] and asked == [21, 21, None]


def test_a_backtest_joins_prices_of_held_names_only(spark):
    days = spark.sql("SELECT date_add(DATE '2024-01-01', CAST(d.id AS INT)) AS date, concat('T', t.id) AS ticker, 10e0 + d.id * (t.id + 1) AS close FROM range(8) d CROSS JOIN range(50) t")
    prices = days.withColumns({"execution_open": F.col("close"), "mark_close": F.col("close")})
    ranked = prices.where("ticker IN ('T1', 'T2')").select("date", "ticker", (F.ascii(F.substring("ticker", 2, 1)) - 48).alias("selection_rank"))
    chosen = backtest.picks(ranked, backtest.cohorts(prices, 4), 1)
    assert {r.ticker for r in backtest.of_names(prices, chosen).collect()} == {"T1"}
    read = []
    original, backtest.written = backtest.written, lambda df: read.append(original(df)) or read[-1]
    try:
        backtest.hold_backtest(ranked, prices, 4, 1, 0.0, 0.0, 100.0)["equity"].collect()
    finally:
        backtest.written = original
    assert all(x.select("ticker").distinct().count() == 1 for x in read if "ticker" in x.columns) and any("execution_open" in x.columns for x in read)
