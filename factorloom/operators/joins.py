"""Point-in-time joins: as-of, membership intervals, calendar alignment, symbol maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import symbol_key
from factorloom.operators.panel import keep_first, keep_last
from factorloom.sources import written


def membership_join(prices: DataFrame, members: DataFrame, flag: str = "is_sp500") -> DataFrame:
    """prices with the membership flag, false where the panel of members has no row."""
    return prices.join(members, ["date", "ticker"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def valuation_join(prices: DataFrame, valuations: DataFrame) -> DataFrame:
    """prices with the valuations of the same ticker and day; NULL where there are none, and a row for each where there are several.

    Columns that prices have already keep their values.
    """
    keys = ["ticker", "date"]
    return prices.join(valuations.drop(*[c for c in valuations.columns if c in prices.columns and c not in keys]), keys, "left")


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, right_on: str, tolerance_days: int | None = None) -> DataFrame:
    """left with the columns of the latest right row on or before its day, per key: one shuffle, one sort.

    Both sides are united and the last right row is carried forward as a whole, NULLs included; so no left row meets
    more than one. right must have one row per key and day. Beyond the tolerance the columns are NULL.
    """
    carried = [c for c in right.columns if c not in by]
    kinds = dict(right.dtypes)
    facts = right.select(*by, F.col(right_on).alias("__on"), F.struct(*carried).alias("__right"), F.lit(0).alias("__side"))
    events = left.select(*by, F.col(on).alias("__on"), F.lit(None).cast(facts.schema["__right"].dataType).alias("__right"), F.lit(1).alias("__side"), F.struct(*[c for c in left.columns if c not in by], F.lit(1).alias("__row")).alias("__left"))
    facts = facts.withColumn("__left", F.lit(None).cast(events.schema["__left"].dataType))
    upto = Window.partitionBy(*by).orderBy("__on", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = facts.unionByName(events).withColumn("__last", F.last("__right", ignorenulls=True).over(upto)).where("__side = 1")
    match = F.col("__last")
    if tolerance_days is not None:
        match = F.when(F.datediff(F.col("__on"), F.col(f"__last.{right_on}")) <= tolerance_days, match)
    rows = both.withColumn("__last", match)
    #: the keys stay columns of their own, so that rows are still known to be dealt by them
    own = [F.col(c) if c in by else F.col(f"__left.{c}") for c in left.columns]
    return rows.select(*own, *[F.col(f"__last.{c}").cast(kinds[c]).alias(c) for c in carried if c not in left.columns])


def asof_backward_split(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, right_on: str, bucket_days: int = 64, tolerance_days: int | None = None) -> DataFrame:
    """``asof_backward`` for keys that may hold most rows: a key is dealt by buckets of days, so that no key is one task.

    First each (key, bucket) gives its last right row, aggregated before it is shuffled; over these few rows, the last one of
    all earlier buckets is carried into each bucket that has left rows. There it stands before all other rows, and the
    join is local to the bucket. Days have to be dates.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / bucket_days)
    carried = [c for c in right.columns if c not in by]
    keyed = right.withColumn("__bucket", bucket(right_on))
    ends = keyed.groupBy(*by, "__bucket").agg(F.max_by(F.struct(*carried), F.col(right_on)).alias("__fact"))
    wanted = left.select(*by, bucket(on).alias("__bucket")).distinct().withColumn("__wanted", F.lit(True))
    both = ends.join(wanted, [*by, "__bucket"], "full")
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    brought = both.withColumn("__brought", F.last("__fact", ignorenulls=True).over(earlier)).where("__wanted AND __brought IS NOT NULL")
    #: a fact of an earlier bucket keeps its own day, which sorts it before all of the bucket
    facts = keyed.unionByName(brought.select(*by, "__bucket", "__brought.*"))
    out = asof_backward(left.withColumn("__bucket", bucket(on)), facts, [*by, "__bucket"], on, right_on, tolerance_days)
    return out.drop("__bucket")


def point_in_time_fundamentals(prices: DataFrame, filings: DataFrame, order: Sequence[str] = (), bucket_days: int | None = None) -> DataFrame:
    """The latest filing on or before each price day; of one ticker's filings of a day, the last by ``order``.

    With ``bucket_days`` a ticker is dealt by buckets of days (see ``asof_backward_split``), for tables in which few tickers
    hold most rows.
    """
    facts = filings.withColumnRenamed("date", "fundamental_date")
    if order:
        facts = keep_last(facts, ["ticker", "fundamental_date"], order)
    if bucket_days is not None:
        return asof_backward_split(prices, facts, ["ticker"], "date", "fundamental_date", bucket_days)
    return asof_backward(prices, facts, ["ticker"], "date", "fundamental_date")


def series_asof(sessions: DataFrame, series: DataFrame, tolerance_days: int = 4) -> DataFrame:
    """sessions (date) with the value of one series, at most some days old. A constant key gives the window a partition."""
    left = sessions.withColumn("series_id", F.lit("series"))
    right = series.withColumn("series_id", F.lit("series")).withColumnRenamed("date", "source_date")
    return asof_backward(left, right, ["series_id"], "date", "source_date", tolerance_days).drop("series_id")


def align_to_calendar(sessions: DataFrame, series: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact days first, then carried forward without limit: rows of the series off the calendar are lost."""
    upto = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return sessions.join(series, "date", "left").withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})


def membership_panel(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """(date, ticker) of every member on every session, from an event log (date, ticker, action).

    The latest snapshot (historical or current) on or before the first session seeds the set; a later snapshot replaces
    it; on one day the snapshot comes first, then removals, then additions; other events of the seed's day are ignored.

    A ticker's own events tell its state up to its next event, but no longer than to the next snapshot: had it been in
    that, this would be an event of its own. So a spell ends at the earlier of the two, and no snapshot has to meet
    the tickers that are missing from it. A calendar of the days of sessions and events (thousands, whatever the log's
    size) turns days into session numbers; a spell is a run of these, and each number finds its day by an equal join.
    """
    spells, calendar = membership_spells(sessions, events)
    numbers = F.explode(F.sequence("from_session", F.col("to_session") - 1)).alias("session")
    numbered = calendar.where("session IS NOT NULL").select("date", "session")
    return spells.select("ticker", numbers).join(F.broadcast(numbered), "session").select("date", "ticker")


def membership_flags(prices: DataFrame, events: DataFrame, flag: str = "is_sp500") -> DataFrame:
    """prices with whether the ticker is a member on the day, as ``membership_join`` with the whole ``membership_panel`` of their days.

    Each row meets its ticker's spells, of which there are as many as changes, in one row: no member has to have a row on a
    day without a price, and prices are not united with anything.
    """
    spells, calendar = membership_spells(prices.select("date").distinct(), events)
    day = lambda name, number: F.broadcast(calendar.where("session IS NOT NULL").select(F.col("date").alias(name), F.col("session").alias(number)))
    spells = spells.withColumn("__end", F.col("to_session") - 1).join(day("__first_day", "from_session"), "from_session").join(day("__last_day", "__end"), "__end")
    own = spells.groupBy("ticker").agg(F.collect_list(F.struct("__first_day", "__last_day")).alias("__spells"))
    out = prices.join(own, "ticker", "left").select(*prices.columns, "__spells")
    inside = F.exists("__spells", lambda s: F.col("date").between(s["__first_day"], s["__last_day"]))
    return out.withColumn(flag, F.coalesce(inside, F.lit(False))).drop("__spells")


def membership_spells(sessions: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticker, from_session, to_session) of every spell, the last session excluded, and the calendar (see ``membership_panel``)."""
    events = events.withColumn("action", F.when(F.col("action") == "current", "historical").otherwise(F.col("action")))
    calendar = membership_calendar(sessions, events)
    seed = calendar.where("seeds").agg(F.max("date").alias("seed")).first()["seed"]
    if seed is None:
        raise ValueError("no membership snapshot on or before the first session")
    live = events.where((F.col("date") > seed) | ((F.col("date") == seed) & (F.col("action") == "historical")))
    has = lambda a: F.max(F.col("action") == a)
    status = live.groupBy("ticker", "date").agg((has("added") | (~has("removed") & has("historical"))).alias("member"))
    status = status.join(F.broadcast(calendar.select("date", "from_session", "replaced_at")), "date")
    own = Window.partitionBy("ticker").orderBy("date")
    spells = status.withColumn("to_session", F.least(F.lead("from_session").over(own), "replaced_at")).where("member AND from_session < to_session")
    return spells.select("ticker", "from_session", "to_session"), calendar


def membership_calendar(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """One row per day of sessions or events: its session number, the first one on or after it (their number if there is
    none), that of the next snapshot after it, and whether it is a snapshot on or before the first session."""
    days = sessions.select("date", F.lit(True).alias("open"), F.lit(False).alias("snapshot"))
    days = days.union(events.select("date", F.lit(False), F.col("action") == "historical")).where("date IS NOT NULL")
    days = days.groupBy("date").agg(F.max("open").alias("open"), F.max("snapshot").alias("snapshot"))
    whole, later = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("date")
    count = F.count_if("open").over(whole)
    number = F.count_if("open").over(earlier)
    days = days.withColumns({"session": F.when(F.col("open"), number - 1), "from_session": F.when(F.col("open"), number - 1).otherwise(number), "__n": count})
    replaced = F.max(F.when(F.col("snapshot"), F.struct(-F.unix_date("date"), F.col("from_session").alias("s")))).over(later.rowsBetween(Window.unboundedPreceding, -1))
    seeds = F.col("snapshot") & ((F.col("from_session") == 0) & (F.col("__n") > 0))
    return written(days.select("date", "session", "from_session", F.coalesce(replaced["s"], F.col("__n")).alias("replaced_at"), seeds.alias("seeds")))


def held_quantities(positions: DataFrame) -> DataFrame:
    """(key, quantity): positions (broker_ticker, quantity) added up by symbol key."""
    return positions.groupBy(symbol_key("broker_ticker").alias("key")).agg(F.sum("quantity").alias("quantity"))


def annotate_instruments(ranking: DataFrame, instruments: DataFrame, positions: DataFrame) -> DataFrame:
    """ranking with the broker's ticker (dollar stocks, first per key) and held quantity per symbol key."""
    tradable = instruments.where("type = 'STOCK' AND currency_code = 'USD'").withColumn("key", symbol_key("short_name"))
    tradable = keep_first(tradable, ["key"], ["broker_ticker"]).select("key", "broker_ticker")
    held = held_quantities(positions).withColumnRenamed("quantity", "held_quantity")
    out = ranking.withColumn("key", symbol_key("ticker")).join(tradable, "key", "left").join(held, "key", "left")
    return out.withColumns({"held_quantity": F.coalesce("held_quantity", F.lit(0.0)), "tradable": F.col("broker_ticker").isNotNull()}).withColumn("held", F.col("held_quantity") > 0)


def unambiguous_instruments(instruments: DataFrame) -> DataFrame:
    """(key, broker_ticker, isin): the symbol keys, of ticker or short name, that name exactly one instrument."""
    keys = F.array_distinct(F.array(symbol_key("broker_ticker"), symbol_key("short_name")))
    rows = instruments.select("broker_ticker", "isin", F.explode(keys).alias("key")).where("key <> ''").distinct()
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n = 1").drop("n")


def map_instruments(tickers: DataFrame, instruments: DataFrame) -> DataFrame:
    """tickers (ticker[, expected_isin]) with broker_ticker; an ISIN that differs from the expected one gives NULL."""
    out = tickers.withColumn("key", symbol_key("ticker")).join(unambiguous_instruments(instruments), "key", "left")
    if "expected_isin" in tickers.columns:
        fits = F.col("expected_isin").isNull() | (F.col("expected_isin") == F.col("isin"))
        out = out.withColumn("broker_ticker", F.when(fits, F.col("broker_ticker")))
    return out.drop("key", "isin")


def wide_by_date(long: DataFrame, names: Sequence[str], key: str = "strategy", value: str = "equity") -> DataFrame:
    """One column per named series, aligned by date."""
    return long.groupBy("date").pivot(key, list(names)).agg(F.first(value))
