"""Rolling frames against pandas, whatever the batches and the keys are."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import features
from factorloom.operators import rolling as R


def series(n, seed, missing=0.1):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(100, 30, n), 2)
    v[rng.random(n) < missing] = np.nan
    v[n // 3 : n // 3 + n // 5] = 7.0
    return v


@pytest.mark.parametrize("n,least", [(1, None), (5, None), (5, 2), (50, 20), (400, 3)])
def test_kernels_match_pandas(n, least):
    v = series(300, n)
    least = n if least is None else least
    window = pd.Series(v).rolling(n, min_periods=least)
    assert np.allclose(R.means(v, n, least), window.mean(), equal_nan=True)
    assert np.allclose(R.maxima(v, n, least), window.max(), equal_nan=True)
    assert np.allclose(R.quantiles(v, n, least, 0.75), window.quantile(0.75), equal_nan=True)
    got, want = R.deviations(v, n, least), window.std().to_numpy()
    assert np.allclose(got, want, atol=1e-6, equal_nan=True)
    assert (got[n // 3 : n // 3 + 60][np.isfinite(got[n // 3 : n // 3 + 60])] >= 0).all()


def test_deviations_of_large_values_keep_small_differences():
    v = 1e9 + np.tile([0.0, 0.01, 0.02], 100)
    assert np.allclose(R.deviations(v, 30, 30)[29:], pd.Series(v - 1e9).rolling(30).std()[29:], rtol=1e-5)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_rolling_carries_frames_over_batches_but_not_over_keys(spark, batch):
    rows = [(k, d, float(x)) for k, n in (("A", 90), ("B", 3), ("C", 41), (None, 5)) for d, x in enumerate(series(n, n))]
    df = spark.createDataFrame(rows, "ticker string, date int, x double").selectExpr("ticker", "date", "CASE WHEN isnan(x) THEN NULL ELSE x END AS x", "'kept' AS other").repartition(3)
    specs = [R.Rolling("m", "x", "mean", 10, least=4), R.Rolling("h", "x", "maximum", 6), R.Rolling("q", "x", "quantile", 9, least=1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = R.rolling(df, specs, lag=2, lagged="old_").toPandas().sort_values(["ticker", "date"], na_position="last")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert list(got.columns) == ["ticker", "date", "x", "other", "m", "h", "q", "old_m", "old_h", "old_q"] and len(got) == len(rows)
    for _, own in got.groupby("ticker", dropna=False):
        x = own["x"].astype(float).reset_index(drop=True)
        for name, want in (("m", x.rolling(10, min_periods=4).mean()), ("h", x.rolling(6).max()), ("q", x.rolling(9, min_periods=1).median())):
            assert np.allclose(own[name].astype(float), want, equal_nan=True)
            assert np.allclose(own[f"old_{name}"].astype(float), want.shift(2), equal_nan=True)
    assert R.rolling(df.limit(0), specs).count() == 0


def test_the_cost_of_a_row_does_not_grow_with_the_frame():
    v = series(200_000, 1, missing=0.0)
    took = {}
    for n in (50, 500):
        began = time.process_time()
        for kernel in (R.means, R.maxima, R.deviations):
            kernel(v, n, n)
        R.quantiles(v[:50_000], n, n, 0.5)
        took[n] = time.process_time() - began
    assert took[500] < 2.5 * took[50]


@pytest.mark.parametrize("batch", [5, 10_000])
def test_ranks_of_all_columns_in_one_pass_equal_windows(spark, batch):
    rng = np.random.default_rng(batch)
    rows = [(d, f"T{k}", float(rng.integers(0, 5)), float(rng.normal()) if rng.random() < 0.8 else None, None) for d in range(9) for k in range(int(rng.integers(1, 25)))]
    df = spark.createDataFrame(rows, "day int, ticker string, x double, y double, z double").selectExpr("date_add(DATE '2020-01-01', day) AS date", "ticker", "x", "y", "z")
    ranks = {"x_up": ("x", True), "x_down": ("x", False), "y_up": ("y", True), "z_up": ("z", True)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = features.percent_ranks(df, ranks)
        assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
        got = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(tuple, features.percent_ranks(df, ranks, largest=3).collect()))
    assert features.percent_ranks(df.limit(0), ranks).count() == 0


def test_only_wanted_rows_leave_the_kernel_though_frames_see_all(spark):
    rows = [(t, d, None if (d + len(t)) % 7 == 0 else float((d * 37 + len(t)) % 11), d % 5 == 0 if d % 3 else None) for t in ("A", "BB", "CCC") for d in range(150)]
    df = spark.createDataFrame(rows, "ticker string, date int, x double, wanted boolean")
    specs = [R.Rolling("mean", "x", "mean", 20, 5), R.Rolling("middle", "x", "quantile", 60, 1), R.Rolling("top", "x", "maximum", 30, 1)]
    whole = R.rolling(df, specs, lag=1, lagged="old_").where("wanted")
    few = R.rolling(df, specs, lag=1, lagged="old_", only=F.col("wanted"))
    assert sorted(map(str, few.collect())) == sorted(map(str, whole.collect())) and few.count() == 60


def test_short_frames_give_the_quantiles_of_the_sorted_run():
    rng = np.random.default_rng(3)
    for n, least, at, gaps in ((60, 60, 0.5, 0.0), (60, 3, 0.25, 0.4), (1, 1, 0.5, 0.2), (64, 0, 0.9, 0.95), (7, 7, 1.0, 0.1)):
        values = np.round(rng.random(500) * 1e4, 2)
        values[rng.random(500) < gaps] = np.nan
        found = R.short_quantiles(values, n, least, at)
        frames = [values[max(0, i + 1 - n) : i + 1] for i in range(500)]
        known = [f[~np.isnan(f)] for f in frames]
        want = [np.quantile(k, at) if len(k) >= max(least, 1) else np.nan for k in known]
        assert np.allclose(found, want, rtol=1e-12, equal_nan=True)


def test_equal_keys_stay_equal_wherever_batches_end(spark):
    rng = np.random.default_rng(11)
    close = np.exp(np.cumsum(rng.normal(0, 0.02, 250))).tolist()
    rows = spark.createDataFrame([(f"T{k:02d}", d, c) for k in range(12) for d, c in enumerate(close)], "ticker string, date int, close double")
    rows = rows.withColumn("r", F.col("close") * 1.7 - 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = R.rolling(rows, [R.Rolling("m", "close", "mean", 50), R.Rolling("s", "r", "deviation", 30)])
        assert got.count() == rows.count()
        assert got.groupBy("date").agg(F.countDistinct("m", "s").alias("n")).where("n > 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
