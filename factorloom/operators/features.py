"""Trailing-window features per ticker, their lag to the decision, and cross-sectional ranks per date."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from factorloom.functions import average_percent_rank, clip, ratio
from factorloom.operators.rolling import Rolling, rolling
from factorloom.sources import written

#: Rows of a date that a task ranks at once, at most.
LARGEST_DATE = 500_000


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def trailing(aggregate, value: Column, n: int) -> Column:
    """The aggregate over the last n rows; NULL until there are n values."""
    frame = by_ticker().rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(frame) == n, aggregate(value).over(frame))


def change(column: str, n: int, skip: int = 0) -> Column:
    """Relative change over n rows, ending ``skip`` rows ago."""
    now = F.lag(column, skip).over(by_ticker()) if skip else F.col(column)
    return ratio(now, F.lag(column, n).over(by_ticker())) - 1


def history_days(df: DataFrame) -> DataFrame:
    return df.withColumn("history_days", F.row_number().over(by_ticker()))


def momentum(df: DataFrame) -> DataFrame:
    return df.withColumns({"momentum_12m_ex_1m": change("close", 252, 21), "momentum_6m": change("close", 126), "momentum_3m": change("close", 63)})


#: What is worked out over long frames (see ``rolling``); ``__return`` and ``__loss`` come from ``returns``.
TREND = (Rolling("ma_50d", "close", "mean", 50), Rolling("ma_200d", "close", "mean", 200))
RISK = (Rolling("volatility_30d", "__return", "deviation", 30), Rolling("downside_volatility_90d", "__loss", "deviation", 90), Rolling("__high_252d", "close", "maximum", 252))
LIQUIDITY = (Rolling("median_dollar_volume_60d", "dollar_volume", "quantile", 60),)


def returns(df: DataFrame) -> DataFrame:
    """Daily returns and losses. A ticker's first return is unknown, but counts as no loss."""
    df = df.withColumn("__return", change("close", 1))
    return df.withColumn("__loss", F.when(F.col("__return") < 0, F.col("__return")).otherwise(0.0))


def trend_of(df: DataFrame, prefix: str = "") -> DataFrame:
    """Distances from the moving averages, from columns by this prefix."""
    price, middle = ratio(f"{prefix}close", f"{prefix}ma_200d") - 1, ratio(f"{prefix}ma_50d", f"{prefix}ma_200d") - 1
    df = df.withColumns({f"{prefix}price_vs_200d_ma": price, f"{prefix}ma_50d_vs_200d": middle})
    quality = clip(F.col(f"{prefix}price_vs_200d_ma"), -0.25, 0.25) + clip(F.col(f"{prefix}ma_50d_vs_200d"), -0.15, 0.15)
    return df.withColumn(f"{prefix}trend_quality", quality)


def drawdown_of(df: DataFrame, prefix: str = "") -> DataFrame:
    return df.withColumn(f"{prefix}drawdown_252d", ratio(f"{prefix}close", f"{prefix}__high_252d") - 1).drop(f"{prefix}__high_252d")


def trend(df: DataFrame) -> DataFrame:
    return trend_of(rolling(df, TREND))


def risk(df: DataFrame) -> DataFrame:
    """Sample volatilities of daily returns and of losses, and the distance from the highest close of 252 days."""
    return drawdown_of(rolling(returns(df), RISK)).drop("__return", "__loss")


def liquidity(df: DataFrame) -> DataFrame:
    """The exact rolling median of 60 days of traded value."""
    return rolling(df, LIQUIDITY)


#: The features that come from each group of long frames.
FROM_FRAMES = (
    (TREND, ("ma_50d", "ma_200d", "price_vs_200d_ma", "ma_50d_vs_200d", "trend_quality")), (RISK[:1], ("volatility_30d",)),
    (RISK[1:2], ("downside_volatility_90d",)), (RISK[2:], ("drawdown_252d",)), (LIQUIDITY, ("median_dollar_volume_60d",)),
)


def price_features(df: DataFrame, lag_days: int, more: Sequence[str] = (), keep: Sequence[str] | None = None, only: Column | None = None) -> DataFrame:
    """All features and their decision_ twins, and those of ``more`` columns: windows and rolling frames in one pass by ticker.

    With ``keep`` only the columns that these need are worked out and handed through the kernel of the rolling frames, and
    with ``only`` no more than the rows for which it is true come out of it, though all of them are seen.
    """
    wanted = lambda prefix, names: keep is None or any(f"{prefix}{n}" in keep for n in names)
    early = [c for c in ("close", "history_days", "momentum_12m_ex_1m", "momentum_6m", "momentum_3m", "market_cap", "market_cap_rank", *more) if c == "close" or wanted("decision_", [c])]
    df = decision_lag(momentum(history_days(df)), early, lag_days)
    specs = [s for own, names in FROM_FRAMES if wanted("", names) or wanted("decision_", names) for s in own]
    current = any(wanted("", names) for _, names in FROM_FRAMES)
    if specs:
        passed = None if keep is None else ["ticker", "date", "close", "decision_close", *keep]
        df = rolling(returns(df), specs, lag=lag_days, lagged="decision_", keep=passed, current=current, only=only)
    elif only is not None:
        df = df.where(only)
    for prefix in ("", "decision_") if current else ("decision_",):
        df = trend_of(df, prefix) if f"{prefix}ma_200d" in df.columns else df
        df = drawdown_of(df, prefix) if f"{prefix}__high_252d" in df.columns else df
    return df.drop("__return", "__loss", "decision_ma_50d", "decision_ma_200d", "decision_ma_50d_vs_200d")


def market_cap_rank(df: DataFrame) -> DataFrame:
    """Dense rank per date, largest first; NULL for a NULL size; kept where the panel has one."""
    if "market_cap" not in df.columns:
        #: no size, no rank: rows need not meet
        df = df.withColumns({c: F.lit(None).cast(kind) for c, kind in (("market_cap", "double"), ("market_cap_rank", "int")) if c not in df.columns})
    if "market_cap_rank" in df.columns:
        return df
    order = Window.partitionBy("date").orderBy(F.col("market_cap").desc_nulls_last())
    return df.withColumn("market_cap_rank", F.when(F.col("market_cap").isNotNull(), F.dense_rank().over(order)))


def decision_lag(df: DataFrame, columns: list[str], days: int) -> DataFrame:
    """decision_<column>: the value known ``days`` sessions of the ticker before."""
    if days < 0:
        raise ValueError("a decision can't look ahead: the lag must be 0 or more sessions")
    return df.withColumns({f"decision_{c}": F.lag(c, days).over(by_ticker()) if days else F.col(c) for c in columns})


def rsi(df: DataFrame, lag_days: int = 1, period: int = 14, name: str = "decision_rsi14") -> DataFrame:
    """RSI by simple averages. 100 where no loss is known, then 0 where no gain is known: so 0 while warming up."""
    df = df.withColumn("__delta", F.col("close") - F.lag("close", 1).over(by_ticker()))
    gain = trailing(F.avg, clip(F.col("__delta"), low=0.0), period)
    loss = trailing(F.avg, -clip(F.col("__delta"), high=0.0), period)
    df = df.withColumns({"__gain": gain, "__loss": loss})
    value = 100 - 100 / (1 + F.try_divide("__gain", "__loss"))
    value = F.when(F.coalesce(F.col("__loss") > 0, F.lit(False)), value).otherwise(100.0)
    df = df.withColumn("__rsi", F.when(F.coalesce(F.col("__gain") > 0, F.lit(False)), value).otherwise(0.0))
    lagged = F.lag("__rsi", lag_days).over(by_ticker()) if lag_days else F.col("__rsi")
    return df.withColumn(name, lagged).drop("__delta", "__gain", "__loss", "__rsi")


def averaged_ranks(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Average rank over the number of values within runs of equal group numbers (0, 1, ...); NaN for NaN."""
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    starts = np.flatnonzero(new)
    tie = np.cumsum(new) - 1
    base = np.searchsorted(group, g)
    count = np.bincount(group, weights=~np.isnan(values))[g]
    first, last = starts[tie] - base + 1, np.append(starts[1:], len(v))[tie] - base
    out = np.empty(len(v))
    out[order] = np.where(np.isnan(v), np.nan, (first + last) / 2 / np.maximum(count, 1))
    return out


def percent_ranks(df: DataFrame, ranks: dict[str, tuple[str, bool]], largest: int = LARGEST_DATE) -> DataFrame:
    """name -> (column, higher is better): averaged percent ranks per date.

    All columns are ranked in one pass over rows that are dealt and sorted by date once; a task holds one date and a batch.
    Where a date has more than ``largest`` rows, each rank is a window instead, which can spill. df is read twice, once
    to count: it should be a table.
    """
    most = df.groupBy("date").count().agg(F.max("count")).first()[0] or 0
    if most > largest:
        return df.withColumns({name: average_percent_rank(column, "date", up) for name, (column, up) in ranks.items()})
    names = df.columns
    read = df.withColumns({f"__rank_{i}": (F.col(c) if up else -F.col(c)).cast("double") for i, (c, up) in enumerate(ranks.values())})
    schema = StructType([StructField(f.name, f.dataType, True) for f in df.schema.fields] + [StructField(n, DoubleType()) for n in ranks])

    def ranked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        days = rows.column("date").cast(pa.int32()).to_numpy()
        group = np.cumsum(np.concatenate(([0], days[1:] != days[:-1])))
        found = [averaged_ranks(rows.column(f"__rank_{i}").to_numpy(), group) for i in range(len(ranks))]
        columns = [rows.column(n) for n in names] + [pa.chunked_array([pa.array(x, mask=np.isnan(x))]) for x in found]
        yield from pa.table(columns, names=[*names, *ranks]).to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            days = batch.column("date").cast(pa.int32()).to_numpy()
            before = held[-1].column("date").cast(pa.int32())[-1].as_py() if held else days[0]
            changes = np.flatnonzero(np.concatenate(([days[0] != before], days[1:] != days[:-1])))
            if len(changes):
                done = [*held, batch.slice(0, changes[-1])]
                yield from ranked(pa.Table.from_batches([b for b in done if b.num_rows]))
                held = [batch.slice(changes[-1])]
            else:
                held.append(batch)
        if held:
            yield from ranked(pa.Table.from_batches(held))

    return read.repartition("date").sortWithinPartitions("date").mapInArrow(work, schema)


def selection_rank(df: DataFrame, score: str = "selection_score", ties: str = "ticker") -> DataFrame:
    order = Window.partitionBy("date").orderBy(F.col(score).desc_nulls_last(), F.asc(ties))
    return df.withColumn("selection_rank", F.row_number().over(order))


def output_order(df: DataFrame) -> DataFrame:
    """The order in which rankings are saved: by date, rank, ticker."""
    return df.orderBy("date", "selection_rank", "ticker")


def top_per_date(df: DataFrame, n: int, rank: str = "selection_rank") -> DataFrame:
    return df.where(F.col(rank) <= n)


def latest_shortlist(ranked: DataFrame, limit: int = 25) -> DataFrame:
    """The best of the last ranked date; an empty ranking gives an empty list."""
    last = ranked.agg(F.max("date").alias("__last"))
    rows = ranked.join(F.broadcast(last), F.col("date") == F.col("__last")).drop("__last")
    return rows.orderBy("selection_rank").limit(limit)


def latest_of(rank: Callable[[DataFrame | None], DataFrame], days: DataFrame, recent: int = 21) -> DataFrame:
    """``latest_ranking`` of a function that ranks given days (date), or all for None: only the last days are ranked, all of them where none of these has a row."""
    found = written(rank(days.select("date").distinct().orderBy(F.desc("date")).limit(recent)))
    return latest_ranking(found if found.limit(1).count() else written(rank(None)))


def latest_ranking(ranked: DataFrame) -> DataFrame:
    last = ranked.agg(F.max("date").alias("__last"))
    return ranked.join(F.broadcast(last), F.col("date") == F.col("__last")).drop("__last")
