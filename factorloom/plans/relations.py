"""SQL of the twins: features, ranks, membership, backtests, in DuckDB's dialect and written apart from the operators."""

from __future__ import annotations

from factorloom.plans.catalog import RELATIONS

TICKER = "PARTITION BY ticker ORDER BY date"
FRAMES = ", ".join(f"w{n} AS ({TICKER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (14, 30, 50, 60, 90, 200, 252))
DECISIONS = (
    "close history_days momentum_12m_ex_1m momentum_6m momentum_3m trend_quality price_vs_200d_ma volatility_30d "
    "downside_volatility_90d drawdown_252d median_dollar_volume_60d market_cap market_cap_rank"
).split()


def percent_rank(column: str, ascending: bool = True, by: str = "date") -> str:
    """Average rank over the count of values."""
    order = f"PARTITION BY {by} ORDER BY {column} {'ASC' if ascending else 'DESC'} NULLS LAST"
    return f"CASE WHEN {column} IS NOT NULL THEN (rank() OVER ({order}) + count({column}) OVER ({order} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2e0 / count({column}) OVER (PARTITION BY {by}) END"


def features(name: str, source: str, more: tuple[str, ...] = ()) -> None:
    """Relations <name>_r, <name>_g, <name>: source with features and decision_ columns; source has market_cap."""
    RELATIONS[f"{name}_r"] = f"SELECT *, close / lag(close) OVER w - 1 AS ret, close - lag(close) OVER w AS delta FROM {source} WINDOW w AS ({TICKER})"
    RELATIONS[f"{name}_g"] = f"""SELECT *, row_number() OVER w AS history_days,
        lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS momentum_12m_ex_1m, close / lag(close, 126) OVER w - 1 AS momentum_6m, close / lag(close, 63) OVER w - 1 AS momentum_3m,
        CASE WHEN count(*) OVER w50 = 50 THEN avg(close) OVER w50 END AS ma_50d, CASE WHEN count(*) OVER w200 = 200 THEN avg(close) OVER w200 END AS ma_200d,
        CASE WHEN count(ret) OVER w30 = 30 THEN stddev_samp(ret) OVER w30 END AS volatility_30d,
        CASE WHEN count(*) OVER w90 = 90 THEN stddev_samp(CASE WHEN ret < 0 THEN ret ELSE 0 END) OVER w90 END AS downside_volatility_90d,
        CASE WHEN count(*) OVER w252 = 252 THEN close / max(close) OVER w252 - 1 END AS drawdown_252d,
        CASE WHEN count(*) OVER w60 = 60 THEN quantile_cont(dollar_volume, 0.5) OVER w60 END AS median_dollar_volume_60d,
        CASE WHEN market_cap IS NOT NULL THEN dense_rank() OVER (PARTITION BY date ORDER BY market_cap DESC NULLS LAST) END AS market_cap_rank,
        CASE WHEN count(delta) OVER w14 = 14 THEN avg(greatest(delta, 0)) OVER w14 END AS avg_gain, CASE WHEN count(delta) OVER w14 = 14 THEN avg(-least(delta, 0)) OVER w14 END AS avg_loss
        FROM {name}_r WINDOW w AS ({TICKER}), {FRAMES}"""
    RELATIONS[f"{name}_h"] = f"""SELECT *, close / ma_200d - 1 AS price_vs_200d_ma, ma_50d / ma_200d - 1 AS ma_50d_vs_200d,
        CASE WHEN ma_200d IS NOT NULL THEN greatest(-0.25, least(0.25, close / ma_200d - 1)) + greatest(-0.15, least(0.15, ma_50d / ma_200d - 1)) END AS trend_quality,
        CASE WHEN coalesce(avg_gain > 0, false) THEN CASE WHEN coalesce(avg_loss > 0, false) THEN 100 - 100 / (1 + avg_gain / avg_loss) ELSE 100e0 END ELSE 0e0 END AS rsi14
        FROM {name}_g"""
    lags = ", ".join(f"lag({c}) OVER w AS decision_{c}" for c in (*DECISIONS, *more))
    RELATIONS[name] = f"SELECT *, {lags}, lag(rsi14) OVER w AS decision_rsi14 FROM {name}_h WINDOW w AS ({TICKER})"


RELATIONS["sized_bars"] = "SELECT *, CAST(NULL AS DOUBLE) AS market_cap FROM bars"
features("feat", "sized_bars")

MIN_PRICE, MIN_VOLUME = 1000, 100000
GATES = f"decision_history_days >= 252 AND decision_close >= {MIN_PRICE} AND decision_median_dollar_volume_60d >= {MIN_VOLUME} AND decision_price_vs_200d_ma >= -0.25 AND volatility_percentile <= 0.9"
PRICE_RANKS = {
    "momentum_12m_ex_1m_rank": ("decision_momentum_12m_ex_1m", True), "momentum_6m_rank": ("decision_momentum_6m", True), "momentum_3m_rank": ("decision_momentum_3m", True),
    "trend_quality_rank": ("decision_trend_quality", True), "downside_risk_rank": ("decision_downside_volatility_90d", False), "drawdown_rank": ("decision_drawdown_252d", True),
    "liquidity_rank": ("decision_median_dollar_volume_60d", True), "size_rank": ("decision_market_cap", True),
}
PRICE_SCORE = (
    "coalesce(momentum_12m_ex_1m_rank, 0) * 0.32e0 + coalesce(momentum_6m_rank, 0) * 0.26e0 + coalesce(momentum_3m_rank, 0) * 0.14e0 + coalesce(trend_quality_rank, 0) * 0.2e0 "
    "+ coalesce(downside_risk_rank, 0) * 0.03e0 + coalesce(drawdown_rank, 0) * 0.02e0 + coalesce(liquidity_rank, 0) * 0.03e0 + coalesce(size_rank, 0) * 0e0"
)
RELATIONS["seeded"] = "SELECT DISTINCT ticker FROM index_events WHERE date = DATE '1995-01-01'"
RELATIONS["vol_ranked"] = f"SELECT *, {percent_rank('decision_volatility_30d')} AS volatility_percentile FROM feat WHERE ticker IN (SELECT ticker FROM seeded)"
RELATIONS["price_eligible"] = f"SELECT * FROM vol_ranked WHERE {GATES}"
RELATIONS["price_ranks"] = f"SELECT *, {', '.join(f'{percent_rank(c, up)} AS {n}' for n, (c, up) in PRICE_RANKS.items())} FROM price_eligible"
RELATIONS["price_scored"] = f"SELECT *, 100 * ({PRICE_SCORE}) AS selection_score FROM price_ranks"
RELATIONS["price_ranked"] = "SELECT *, row_number() OVER (PARTITION BY date ORDER BY selection_score DESC, ticker) AS selection_rank FROM price_scored"

# Membership by intervals.
RELATIONS["days"] = "SELECT DISTINCT date FROM bars"
RELATIONS["seed_day"] = "SELECT max(date) AS d FROM index_events WHERE action = 'historical' AND date <= (SELECT min(date) FROM days)"
RELATIONS["live_events"] = "SELECT * FROM index_events WHERE date > (SELECT d FROM seed_day) OR (date = (SELECT d FROM seed_day) AND action = 'historical')"
RELATIONS["stated"] = """SELECT date, ticker, CASE WHEN max(CASE WHEN action = 'added' THEN 1 ELSE 0 END) = 1 THEN 1 WHEN max(CASE WHEN action = 'removed' THEN 1 ELSE 0 END) = 1 THEN 0
    WHEN max(CASE WHEN action = 'historical' THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS m
    FROM (SELECT date, ticker, action FROM live_events UNION ALL
          SELECT x.date, y.ticker, 'absent' FROM (SELECT DISTINCT date FROM live_events WHERE action = 'historical') AS x CROSS JOIN (SELECT DISTINCT ticker FROM index_events) AS y) AS u GROUP BY date, ticker"""
RELATIONS["spans"] = "SELECT ticker, m, date AS f, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS u FROM stated"
RELATIONS["members"] = "SELECT s.date, i.ticker FROM days AS s JOIN spans AS i ON s.date >= i.f AND (i.u IS NULL OR s.date < i.u) WHERE i.m = 1"

# The point-in-time panel.
RELATIONS["filings_once"] = "SELECT ticker, date AS fundamental_date, roe, divyield, de, currentratio, fcf FROM filings QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY fcf DESC, roe DESC, divyield DESC, de DESC, currentratio DESC) = 1"
RELATIONS["panel"] = """SELECT b.ticker, b.date, b.open, b.close, b.adj_close, b.volume, b.close * b.volume AS dollar_volume, m.ticker IS NOT NULL AS is_sp500,
    v.marketcap * 1e6 AS market_cap, v.pe, v.pb, v.ps, v.evebitda AS ev_ebitda, f.fundamental_date, f.roe, f.divyield AS dividend_yield, f.de AS debt_equity, f.currentratio AS current_ratio, f.fcf
    FROM bars AS b LEFT JOIN members AS m ON b.ticker = m.ticker AND b.date = m.date LEFT JOIN valuations AS v ON b.ticker = v.ticker AND b.date = v.date
    ASOF LEFT JOIN filings_once AS f ON b.ticker = f.ticker AND b.date >= f.fundamental_date"""
features("pfeat", "panel", ("pe", "pb", "ps", "ev_ebitda", "roe", "current_ratio", "fcf", "debt_equity", "dividend_yield"))
RELATIONS["p_vol"] = f"SELECT *, {percent_rank('decision_volatility_30d')} AS volatility_percentile FROM pfeat WHERE is_sp500"
RELATIONS["p_eligible"] = f"""SELECT *, CASE WHEN decision_volatility_30d > 0 THEN decision_momentum_6m / (decision_volatility_30d * sqrt(126)) END AS ram,
    CASE WHEN decision_pe > 0 THEN decision_pe END AS x_pe, CASE WHEN decision_pb > 0 THEN decision_pb END AS x_pb, CASE WHEN decision_ps > 0 THEN decision_ps END AS x_ps, CASE WHEN decision_ev_ebitda > 0 THEN decision_ev_ebitda END AS x_ev,
    CASE WHEN decision_pe > 0 THEN 1 / decision_pe END AS x_ey, CASE WHEN decision_market_cap > 0 THEN decision_fcf / decision_market_cap END AS x_fy FROM p_vol WHERE {GATES}"""
COMPOSITE_PARTS = {**PRICE_RANKS, "risk_adjusted_momentum_6m_rank": ("ram", True), "r_roe": ("decision_roe", True), "r_pe": ("x_pe", False), "r_pb": ("x_pb", False), "r_ps": ("x_ps", False), "r_ev": ("x_ev", False),
    "earnings_yield_rank": ("x_ey", True), "fcf_yield_rank": ("x_fy", True), "r_cr": ("decision_current_ratio", True), "r_de": ("decision_debt_equity", False), "shareholder_yield_rank": ("decision_dividend_yield", True)}
RELATIONS["p_ranks"] = f"SELECT *, {', '.join(f'{percent_rank(c, up)} AS {n}' for n, (c, up) in COMPOSITE_PARTS.items())} FROM p_eligible"


def mean_of(*names: str) -> str:
    return f"(0e0 + {' + '.join(f'coalesce({n}, 0)' for n in names)}) / nullif({' + '.join(f'CASE WHEN {n} IS NULL THEN 0 ELSE 1 END' for n in names)}, 0)"


RELATIONS["p_blends"] = f"SELECT *, r_roe AS quality_rank, {mean_of('r_pe', 'r_pb', 'r_ps', 'r_ev', 'fcf_yield_rank')} AS value_rank, {mean_of('r_cr', 'r_de')} AS financial_strength_rank FROM p_ranks"
COMPOSITE = {"momentum_12m_ex_1m_rank": 25, "momentum_6m_rank": 55, "momentum_3m_rank": 25, "drawdown_rank": -10, "liquidity_rank": 10, "quality_rank": 5, "value_rank": 25, "financial_strength_rank": 10}
RELATIONS["p_scored"] = f"SELECT *, 100 * ({' + '.join(f'coalesce({n}, 0.5) * ({w}e0 / 145)' for n, w in COMPOSITE.items())}) AS selection_score FROM p_blends"
RELATIONS["p_ranked"] = "SELECT *, row_number() OVER (PARTITION BY date ORDER BY selection_score DESC, ticker) AS selection_rank FROM p_scored"

# Execution prices, benchmark, cohorts.
RELATIONS["px"] = "SELECT ticker, date, close, open * (adj_close / close) AS execution_open, adj_close AS mark_close FROM bars"
RELATIONS["numbered"] = "SELECT date, row_number() OVER (ORDER BY date) - 1 AS session FROM days"
RELATIONS["bench_asof"] = "SELECT s.date, CASE WHEN date_diff('day', b.date, s.date) <= 4 THEN b.close END AS bench FROM days AS s ASOF LEFT JOIN bench_px AS b ON s.date >= b.date"
HOLD, TOP, SLIP, FEE, CAPITAL = 126, 5, 0.001, 0.0005, 20000
RELATIONS["plan"] = f"SELECT session // {HOLD} AS cohort, date AS start, lead(date) OVER (ORDER BY date) AS stop FROM numbered WHERE session % {HOLD} = 0"
RELATIONS["bought"] = f"""SELECT p.cohort, p.start, p.stop, r.ticker, r.selection_rank, x.execution_open * (1 + {SLIP}e0) AS entry, 1e0 / count(*) OVER (PARTITION BY p.cohort) AS weight
    FROM price_ranked AS r JOIN plan AS p ON r.date = p.start JOIN px AS x ON x.ticker = r.ticker AND x.date = p.start WHERE r.selection_rank <= {TOP}"""
RELATIONS["marks"] = "SELECT b.cohort, b.ticker, arg_max(x.mark_close, x.date) AS last_mark, max(x.date) AS last_mark_date FROM bought AS b JOIN px AS x ON x.ticker = b.ticker AND x.date >= b.start AND (b.stop IS NULL OR x.date < b.stop) GROUP BY b.cohort, b.ticker"
RELATIONS["held"] = f"""SELECT 'hold' AS strategy, b.*, m.last_mark, CASE WHEN e.ticker IS NOT NULL THEN 'SELL' WHEN b.stop IS NOT NULL THEN 'FORCED_EXIT' END AS action,
    CASE WHEN e.ticker IS NOT NULL THEN e.execution_open * (1 - {SLIP}e0) WHEN b.stop IS NOT NULL THEN m.last_mark * (1 - {SLIP}e0) END AS exit,
    CASE WHEN e.ticker IS NOT NULL THEN b.stop WHEN b.stop IS NOT NULL THEN m.last_mark_date END AS exit_date
    FROM bought AS b JOIN marks AS m ON b.cohort = m.cohort AND b.ticker = m.ticker LEFT JOIN px AS e ON e.ticker = b.ticker AND e.date = b.stop"""
RELATIONS["factors"] = f"SELECT cohort, 1 + sum(weight * (coalesce(exit * (1 - {FEE}e0), last_mark) / entry * (1 - {FEE}e0) - 1)) AS factor FROM held GROUP BY cohort"
RELATIONS["chain"] = "SELECT *, exp(coalesce(sum(ln(factor)) OVER (ORDER BY cohort ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS start_growth FROM factors"
RELATIONS["grid"] = "SELECT d.date, p.cohort FROM days AS d JOIN plan AS p ON d.date >= p.start AND (p.stop IS NULL OR d.date < p.stop)"
RELATIONS["daily_marks"] = "SELECT g.date, h.*, last_value(x.mark_close IGNORE NULLS) OVER (PARTITION BY h.cohort, h.ticker ORDER BY g.date) AS mark FROM held AS h JOIN grid AS g ON g.cohort = h.cohort LEFT JOIN px AS x ON x.ticker = h.ticker AND x.date = g.date"
RELATIONS["hold_equity"] = f"""SELECT 'hold' AS strategy, m.date, {CAPITAL} * c.start_growth * (1 + sum(m.weight * (CASE WHEN m.action = 'FORCED_EXIT' AND m.date > m.exit_date THEN m.exit * (1 - {FEE}e0) ELSE m.mark END / m.entry * (1 - {FEE}e0) - 1))) AS equity,
    100 * (1 - sum(m.weight)) AS cash_pct FROM daily_marks AS m JOIN chain AS c ON c.cohort = m.cohort GROUP BY m.date, m.cohort, c.start_growth"""
RELATIONS["hold_trades"] = f"""SELECT strategy, cohort, ticker, start AS date, 'BUY' AS action, entry AS price, weight * {FEE}e0 AS fee, CAST(NULL AS DOUBLE) AS trade_return FROM held
    UNION ALL SELECT strategy, cohort, ticker, exit_date, action, exit, weight * exit / entry * {FEE}e0, exit / entry - 1 FROM held WHERE action IS NOT NULL"""


def curve_of(relation: str) -> str:
    return f"""SELECT *, equity / peak - 1 AS drawdown FROM (SELECT *, coalesce(equity / lag(equity) OVER w - 1, 0) AS daily_return, max(equity) OVER w AS peak FROM {relation} WINDOW w AS (PARTITION BY strategy ORDER BY date)) AS c"""


def metrics_of(relation: str, capital: float = CAPITAL) -> str:
    return f"""SELECT strategy, final_equity, (g - 1) * 100 AS total_return_pct, CASE WHEN g > 0 THEN pow(g, 1 / greatest((n - 1) / 252e0, 1 / 252e0)) - 1 ELSE -1 END * 100 AS cagr_pct, dev * sqrt(252) * 100 AS annual_volatility_pct,
        CASE WHEN dev > 0 THEN mean / dev * sqrt(252) ELSE 0 END AS sharpe_ratio, abs(low) * 100 AS max_drawdown_pct
        FROM (SELECT strategy, count(*) AS n, arg_max(equity, date) AS final_equity, arg_max(equity, date) / {capital}e0 AS g, stddev_pop(daily_return) AS dev, avg(daily_return) AS mean, min(drawdown) AS low FROM {relation} GROUP BY strategy) AS a"""


RELATIONS["curves"] = curve_of("equity")
RELATIONS["hold_curve"] = curve_of("hold_equity")
RELATIONS["all_metrics"] = metrics_of("curves")
RELATIONS["hold_metrics"] = metrics_of("hold_curve")
BENCH = "PARTITION BY series_id ORDER BY date"
RELATIONS["bench_steps"] = f"""SELECT *, CASE WHEN count(*) OVER w200 = 200 THEN avg(close) OVER w200 END AS sma200, close / lag(close, 63) OVER w - 1 AS return_63d,
    CASE WHEN count(ret) OVER w63 = 63 THEN stddev_samp(ret) OVER w63 END * sqrt(252) AS volatility_63d FROM (SELECT *, close / lag(close) OVER ({BENCH}) - 1 AS ret FROM bench_px) AS b
    WINDOW w AS ({BENCH}), w63 AS ({BENCH} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), w200 AS ({BENCH} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)"""
RELATIONS["bench_limits"] = f"""SELECT *, CASE WHEN count(volatility_63d) OVER w >= 252 THEN quantile_cont(volatility_63d, 0.75) OVER w END AS lim FROM bench_steps WINDOW w AS ({BENCH} ROWS BETWEEN 755 PRECEDING AND CURRENT ROW)"""
RELATIONS["bench_flags"] = f"""SELECT *, coalesce(close > sma200 AND return_63d > 0 AND volatility_63d <= volatility_limit, false) AS risk_on FROM (SELECT *, lag(lim) OVER ({BENCH}) AS volatility_limit FROM bench_limits) AS b"""
RELATIONS["regimes"] = f"""SELECT *, coalesce(lag(risk_on) OVER ({BENCH}), false) AS risk_on_for_open, CASE WHEN coalesce(lag(risk_on) OVER ({BENCH}), false) THEN 'risk_on' ELSE 'risk_off' END AS regime_for_open FROM bench_flags"""

# Tuning.
ANCHOR, TUNE_HOLD, TUNE_TOP = 21, 126, 5
TUNED = ("momentum_12m_ex_1m_rank", "momentum_6m_rank", "liquidity_rank")
RELATIONS["period_spans"] = f"""SELECT a.session AS period, a.date AS start, z.date AS stop, zb.bench / ab.bench - 1 AS benchmark_return FROM numbered AS a JOIN numbered AS z ON z.session = a.session + {TUNE_HOLD}
    JOIN bench_asof AS ab ON ab.date = a.date JOIN bench_asof AS zb ON zb.date = z.date WHERE a.session % {ANCHOR} = 0 AND ab.bench > 0 AND zb.bench IS NOT NULL"""
RELATIONS["period_entries"] = f"""SELECT s.*, r.ticker, {', '.join(f'coalesce(r.{c}, 0.5) AS f{i}' for i, c in enumerate(TUNED))}, x.execution_open AS entry FROM price_ranked AS r JOIN period_spans AS s ON r.date = s.start JOIN px AS x ON x.ticker = r.ticker AND x.date = s.start WHERE x.execution_open > 0"""
RELATIONS["period_exits"] = "SELECT e.*, CASE WHEN x.date = e.stop THEN x.execution_open ELSE x.mark_close END AS exit FROM period_entries AS e ASOF JOIN px AS x ON e.ticker = x.ticker AND e.stop >= x.date"
RELATIONS["period_rows"] = "SELECT *, exit / entry - 1 AS forward_return FROM period_exits QUALIFY count(*) OVER (PARTITION BY period) >= 5"
RELATIONS["period_scores"] = "SELECT c.candidate_id, p.period, p.ticker, p.forward_return, p.f0 * c.w1 + p.f1 * c.w2 + p.f2 * c.w3 AS score FROM period_rows AS p CROSS JOIN candidates AS c"
RELATIONS["period_returns"] = f"""SELECT candidate_id, period, avg(forward_return) AS strategy_return FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, period ORDER BY score DESC, ticker) AS place FROM period_scores) AS s WHERE place <= {TUNE_TOP} GROUP BY candidate_id, period"""
RELATIONS["parts"] = """SELECT period, start, stop, benchmark_return, CASE WHEN stop < edge THEN 'development' WHEN start >= edge THEN 'audit' ELSE 'purged' END AS part
    FROM (SELECT DISTINCT period, start, stop, benchmark_return FROM period_rows) AS p CROSS JOIN (SELECT CAST(max(stop) - INTERVAL 2 YEAR AS DATE) AS edge FROM period_rows) AS e"""
RELATIONS["active_returns"] = """SELECT r.candidate_id, r.strategy_return, p.start, p.part, ln(1 + greatest(r.strategy_return, -0.999e0)) - ln(1 + p.benchmark_return) AS active,
    ntile(4) OVER (PARTITION BY r.candidate_id, p.part ORDER BY p.start) AS fold FROM period_returns AS r JOIN parts AS p ON p.period = r.period WHERE p.part <> 'purged'"""
RELATIONS["fold_spread"] = "SELECT candidate_id, stddev_pop(m) AS fold_std FROM (SELECT candidate_id, fold, avg(active) AS m FROM active_returns WHERE part = 'development' GROUP BY candidate_id, fold) AS f GROUP BY candidate_id"


def part_of(name: str) -> str:
    return f"""SELECT candidate_id, avg(active) AS {name}_mean_active, quantile_cont(active, 0.25) AS {name}_active_q25, count(*) FILTER (active > 0) / count(*)::DOUBLE AS {name}_outperformance_rate, avg(strategy_return) AS {name}_strategy_mean
        FROM active_returns WHERE part = '{name}' GROUP BY candidate_id"""


RELATIONS["development_part"], RELATIONS["audit_part"] = part_of("development"), part_of("audit")
RELATIONS["candidate_scores"] = """SELECT d.*, f.fold_std, a.* EXCLUDE (candidate_id), d.development_mean_active + 0.35 * d.development_active_q25 + 0.01 * (d.development_outperformance_rate - 0.5) - 0.35 * f.fold_std AS robust_score
    FROM development_part AS d JOIN fold_spread AS f ON f.candidate_id = d.candidate_id LEFT JOIN audit_part AS a ON a.candidate_id = d.candidate_id"""
