"""Queries for trade outcomes, portfolios and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions.nulls import ladder, tags
from tidebar.operators import features as ft, metrics as mt, trades as tr
from tidebar.operators.layout import blocked, lag, lead, own_rows, rolling
from tidebar.plans.features_q import CROSS_SQL, DAY_SQL, day_col
from tidebar.plans.registry import query, rounded, sql_rounded
from tidebar.plans.tables import bars_cte, lagged, led, numbered, roll
from tidebar.sources.bars import common_dates, date_ranges

# --- a plain momentum rule stands in for the scoring rules (which have queries of their own) ---


def rule_signals(bars):
    """Decision, regime and reasons per bar from the distance to the five-bar mean."""
    df = own_rows(
        blocked(bars, back=10).withColumns({"_m": rolling(F.avg, "close", 5), "_c5": lag("close", 5)})
    )
    m = F.col("close") / F.col("_m") - 1.0
    decision = ladder([(m > 0.25, "STRONG_BUY"), (m > 0.12, "WEAK_BUY"), (m > 0.05, "PROBING_BUY")], "NO_TRADE")
    up = F.coalesce(F.col("close") > F.col("_c5"), F.lit(False))
    return df.withColumns(
        {
            "decision": decision,
            "market_regime": F.when(up, "TRENDING").otherwise("RANGING"),
            "reasons": tags([(m <= -0.3, "Volatility shock"), (m <= 0.0, "Confidence below floor"), (~up, "Trend not aligned")]),
        }
    ).drop("_m", "_c5")


RULE_SQL = f"""s0 AS (SELECT *, close / {roll('avg', 'close', 5)} - 1 AS m, coalesce(close > {lagged('close', 5)}, false) AS up FROM bars),
sig AS (SELECT *, CASE WHEN m > 0.25 THEN 'STRONG_BUY' WHEN m > 0.12 THEN 'WEAK_BUY' WHEN m > 0.05 THEN 'PROBING_BUY' ELSE 'NO_TRADE' END AS decision,
  CASE WHEN up THEN 'TRENDING' ELSE 'RANGING' END AS market_regime FROM s0),
prof AS (SELECT *, CASE decision WHEN 'STRONG_BUY' THEN 0.02 ELSE 0.015 END AS sl, CASE decision WHEN 'STRONG_BUY' THEN 0.03 ELSE 0.02 END AS tp,
  CASE decision WHEN 'STRONG_BUY' THEN 3 ELSE 1 END AS hold FROM sig WHERE decision <> 'NO_TRADE'),
ent AS (SELECT p.*, b.open AS entry FROM prof p LEFT JOIN bars b ON b.symbol = p.symbol AND b.n = p.n + 1),
path AS (SELECT e.symbol, e.n, b.n - e.n AS j, e.entry, CASE WHEN b.open <= entry*(1-sl) THEN 'SL' WHEN b.open >= entry*(1+tp) THEN 'TP'
  WHEN b.low <= entry*(1-sl) THEN 'SL' WHEN b.high >= entry*(1+tp) THEN 'TP' WHEN b.n - e.n = hold THEN 'TIME' END AS why,
  CASE WHEN b.open <= entry*(1-sl) THEN b.open WHEN b.open >= entry*(1+tp) THEN b.open WHEN b.low <= entry*(1-sl) THEN entry*(1-sl)
  WHEN b.high >= entry*(1+tp) THEN entry*(1+tp) ELSE b.close END AS px
  FROM ent e JOIN bars b ON b.symbol = e.symbol AND b.n BETWEEN e.n + 1 AND e.n + e.hold),
hit AS (SELECT symbol, n, min(j) AS j FROM path WHERE why IS NOT NULL GROUP BY ALL),
trd AS (SELECT e.symbol, e.n, e.bar_ts, e.decision, e.market_regime, e.entry AS entry_price, p.px AS exit_price, coalesce(p.why, 'INVALID') AS exit_reason,
  p.j::INT AS holding_days, e.n + p.j AS exit_no, p.px / e.entry - 1 AS return_pct
  FROM ent e LEFT JOIN hit h USING (symbol, n) LEFT JOIN path p ON p.symbol = h.symbol AND p.n = h.n AND p.j = h.j)"""

TAKEN_SQL = f"""rel AS (SELECT t.*, greatest(t.exit_no, t.n + (SELECT count(*) FROM bars b WHERE b.symbol = t.symbol
  AND b.bar_ts BETWEEN t.bar_ts AND t.bar_ts + INTERVAL 3 DAY)) AS release_no FROM trd t WHERE exit_reason <> 'INVALID' AND n >= 80),
succ AS (SELECT r.symbol, r.n, (SELECT min(u.n) FROM rel u WHERE u.symbol = r.symbol AND u.n >= r.release_no) AS nx FROM rel r),
pos(symbol, n) AS (SELECT symbol, min(n) FROM succ GROUP BY 1 UNION ALL
  SELECT p.symbol, s.nx FROM pos p JOIN succ s ON s.symbol = p.symbol AND s.n = p.n WHERE s.nx IS NOT NULL),
taken AS (SELECT t.* FROM rel t JOIN pos p ON p.symbol = t.symbol AND p.n = t.n)"""

COOLDOWN = 3
MIN_HISTORY = 80  # bars before the first evaluated one


def rule_trades(bars):
    return tr.first_touch_exits(tr.with_profile(rule_signals(bars)))


def rule_positions(bars):
    t = rule_trades(bars)
    t = t.where(F.col("exit_reason") != "INVALID")
    return tr.non_overlapping(tr.with_release(t, bars, COOLDOWN), min_history=MIN_HISTORY)


@query(
    "first_touch_exits", "N1 N3 E7",
    f"WITH {bars_cte()}, {RULE_SQL} SELECT symbol, {DAY_SQL}, decision, exit_reason, holding_days, {sql_rounded(['entry_price', 'exit_price', 'return_pct'])} FROM trd",
)
def first_touch_exits(spark, sf):
    t = rule_trades(numbered(spark, sf))
    return t.select("symbol", day_col(), "decision", "exit_reason", "holding_days", *rounded(t, ["entry_price", "exit_price", "return_pct"]))


@query(
    "non_overlapping_positions", "N4",
    f"WITH RECURSIVE {bars_cte()}, {RULE_SQL}, {TAKEN_SQL} SELECT symbol, n AS bar_no, decision, exit_no, release_no, round(return_pct, 6) AS return_pct FROM taken",
)
def non_overlapping_positions(spark, sf):
    p = rule_positions(numbered(spark, sf))
    return p.select("symbol", "bar_no", "decision", "exit_no", "release_no", *rounded(p, ["return_pct"]))


EQUITY_SQL = """gain AS (SELECT symbol, exit_no AS n, ln(1 + return_pct) AS g FROM taken),
held AS (SELECT b.symbol, b.n, t.entry_price, b.n = t.exit_no AS leaving FROM taken t JOIN bars b ON b.symbol = t.symbol AND b.n BETWEEN t.n + 1 AND t.exit_no),
cash AS (SELECT b.symbol, b.n, b.bar_ts, b.close, round(sum(coalesce(g, 0)) OVER (PARTITION BY b.symbol ORDER BY b.n), 12) AS c FROM bars b LEFT JOIN gain g ON g.symbol = b.symbol AND g.n = b.n),
eq AS (SELECT c.symbol, c.n, c.bar_ts, exp(c) * CASE WHEN entry_price IS NOT NULL AND NOT leaving THEN c.close / entry_price ELSE 1 END AS equity,
  (entry_price IS NOT NULL)::INT AS in_position FROM cash c LEFT JOIN held h ON h.symbol = c.symbol AND h.n = c.n WHERE c.n >= 80),
curve AS (SELECT *, equity / greatest(1, max(equity) OVER (PARTITION BY symbol ORDER BY n)) - 1 AS drawdown FROM eq)"""


@query(
    "equity_curve", "N5 B4 G7",
    f"WITH RECURSIVE {bars_cte()}, {RULE_SQL}, {TAKEN_SQL}, {EQUITY_SQL} SELECT symbol, {DAY_SQL}, in_position, round(equity + 1e-9, 6) AS equity, round(drawdown + 1e-9, 6) AS drawdown FROM curve",
)
def equity_curve(spark, sf):
    bars = numbered(spark, sf)
    e = tr.equity_curve(bars, rule_positions(bars))
    # stop and target levels multiply to exact halves of a millionth: nudge both sides off the tie
    nudged = [F.round(F.col(x) + 1e-9, 6).alias(x) for x in ("equity", "drawdown")]
    return e.select("symbol", day_col(), "in_position", *nudged)


@query(
    "equity_ratios", "F5 F6 F11",
    f"""WITH RECURSIVE {bars_cte()}, {RULE_SQL}, {TAKEN_SQL}, {EQUITY_SQL},
st AS (SELECT *, lag(equity) OVER (PARTITION BY symbol ORDER BY n) AS p FROM curve), st2 AS (SELECT *, (equity - p) / greatest(p, 1e-12) AS r FROM st)
SELECT symbol, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe_ratio,
  round(avg(r) / stddev_samp(r) FILTER (WHERE r < 0) * sqrt(252), 6) AS sortino_ratio, round(min(drawdown), 6) AS max_drawdown,
  round(avg(in_position), 6) AS exposure_ratio FROM st2 GROUP BY 1""",
)
def equity_ratios(spark, sf):
    bars = numbered(spark, sf)
    e = mt.with_step_return(tr.equity_curve(bars, rule_positions(bars)))
    m = mt.equity_ratios(e, ["symbol"])
    return m.select("symbol", *rounded(m, ["sharpe_ratio", "sortino_ratio", "max_drawdown", "exposure_ratio"]))


STATS = ["win_rate", "avg_return_per_trade", "median_return_per_trade", "total_return", "compounded_return", "best_trade", "worst_trade", "average_holding_days", "profit_factor", "expectancy"]


@query(
    "trade_statistics", "F3 F11",
    f"""WITH RECURSIVE {bars_cte()}, {RULE_SQL}, {TAKEN_SQL},
g AS (SELECT symbol, count(*)::BIGINT AS total_trades, avg((return_pct > 0)::INT) AS win_rate, avg(return_pct) AS avg_return_per_trade,
  median(return_pct) AS median_return_per_trade, sum(return_pct) AS total_return, product(1 + return_pct) - 1 AS compounded_return, max(return_pct) AS best_trade,
  min(return_pct) AS worst_trade, avg(holding_days) AS average_holding_days,
  sum(CASE WHEN return_pct > 0 THEN return_pct ELSE 0 END) / nullif(abs(sum(CASE WHEN return_pct < 0 THEN return_pct ELSE 0 END)), 0) AS profit_factor,
  avg(return_pct) AS expectancy FROM taken GROUP BY 1)
SELECT symbol, total_trades, {sql_rounded(STATS)} FROM g""",
)
def trade_statistics(spark, sf):
    m = mt.trade_statistics(rule_positions(numbered(spark, sf)), ["symbol"])
    return m.select("symbol", "total_trades", *rounded(m, STATS))


@query(
    "regime_performance", "F7 F8",
    f"""WITH RECURSIVE {bars_cte()}, {RULE_SQL}, {TAKEN_SQL},
p AS (SELECT symbol, market_regime, count(*)::BIGINT AS trades, avg((return_pct > 0)::INT) AS win_rate, avg(return_pct) AS avg_return, sum(return_pct) AS total_return FROM taken GROUP BY ALL)
SELECT symbol, market_regime, trades, {sql_rounded(['win_rate', 'avg_return', 'total_return'])},
  first_value(market_regime) OVER (PARTITION BY symbol ORDER BY total_return DESC) AS best_regime FROM p""",
)
def regime_performance(spark, sf):
    p = mt.regime_performance(rule_positions(numbered(spark, sf)), ["symbol"])
    j = p.join(mt.best_regime(p, ["symbol"]), "symbol")
    return j.select("symbol", "market_regime", "trades", *rounded(j, ["win_rate", "avg_return", "total_return"]), "best_regime")


@query(
    "strategy_health", "F9",
    f"""WITH RECURSIVE {bars_cte()}, {RULE_SQL}, {TAKEN_SQL}, a AS (SELECT *, CASE WHEN decision <> 'NO_TRADE' THEN n END AS hit_n FROM sig WHERE n >= 80),
cool AS (SELECT DISTINCT t.symbol, b.n FROM taken t JOIN bars b ON b.symbol = t.symbol AND b.n > t.n AND b.n < t.release_no),
b AS (SELECT symbol, n, hit_n - lag(hit_n IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY n) AS gap FROM a)
SELECT symbol, count(*)::BIGINT AS days_evaluated, round(avg((hit_n IS NOT NULL)::INT), 6) AS signal_frequency, round(avg((decision = 'STRONG_BUY')::INT), 6) AS strong_signal_frequency,
  round(avg((decision = 'WEAK_BUY')::INT), 6) AS weak_signal_frequency, round(avg((decision = 'PROBING_BUY')::INT), 6) AS probing_signal_frequency,
  round(avg(b.gap), 6) AS average_time_between_signals, round(avg((cool.n IS NOT NULL)::INT), 6) AS percentage_days_blocked_by_cooldown, round(avg((hit_n IS NULL)::INT), 6) AS percentage_no_trade
FROM a JOIN b USING (symbol, n) LEFT JOIN cool USING (symbol, n) GROUP BY 1""",
)
def strategy_health(spark, sf):
    bars = numbered(spark, sf)
    s = tr.cooldown_active(rule_signals(bars).where(F.col("bar_no") >= MIN_HISTORY), rule_positions(bars))
    h = mt.strategy_health(s, ["symbol"])
    return h.select("symbol", "days_evaluated", *rounded(h, [c for c in h.columns if c not in ("symbol", "days_evaluated")]))


@query(
    "rejection_buckets", "F10 F9",
    f"""WITH {bars_cte()}, {RULE_SQL}, b AS (SELECT *, CASE WHEN decision = 'NO_TRADE' THEN CASE WHEN m <= -0.3 THEN 'volatility_shock' WHEN m <= 0 THEN 'low_confidence'
  WHEN NOT up THEN 'trend_filter' ELSE 'other' END END AS bucket FROM sig), c AS (SELECT symbol, bucket, count(*)::BIGINT AS n FROM b GROUP BY ALL),
d AS (SELECT *, round(n / sum(n) OVER (PARTITION BY symbol), 6) AS share FROM c) SELECT * FROM d WHERE bucket IS NOT NULL""",
)
def rejection_buckets(spark, sf):
    r = mt.rejection_shares(rule_signals(numbered(spark, sf)), ["symbol"])
    return r.select("symbol", "bucket", "n", *rounded(r, ["share"]))


@query(
    "slipped_exits_always_buy", "N2 N7 F20",
    f"""WITH {bars_cte()}, e AS (SELECT *, {led('open', 1)} * 1.001 AS entry, {led('n', 8)} AS enough FROM bars),
p AS (SELECT e.symbol, e.n, e.entry, b.n - e.n AS j, CASE WHEN b.low <= entry * 0.98 THEN entry * 0.98 WHEN b.high >= entry * 1.03 THEN entry * 1.03 WHEN b.n = e.n + 7 THEN b.close END AS px
  FROM e JOIN bars b ON b.symbol = e.symbol AND b.n BETWEEN e.n + 1 AND e.n + 7 WHERE e.enough IS NOT NULL AND e.n > 200),
x AS (SELECT symbol, n, any_value(entry) AS entry, arg_min(px, j) * 0.999 AS px FROM p WHERE px IS NOT NULL GROUP BY ALL),
r AS (SELECT symbol, (px - entry) / entry AS ret FROM x)
SELECT symbol, count(*)::BIGINT AS trade_count, round(avg((ret > 0)::INT), 6) AS win_rate, round(sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / abs(sum(CASE WHEN ret <= 0 THEN ret ELSE 0 END)), 6) AS profit_factor,
  round(sum(ln(1 + ret)), 4) AS log_growth FROM r GROUP BY 1""",
)
def slipped_exits_always_buy(spark, sf):
    t = tr.slipped_exits(numbered(spark, sf), horizon=7, min_history=200)
    m = mt.simple_summary(t, ["symbol"], extra=[F.round(F.sum(F.log1p("trade_return")), 4).alias("log_growth")])
    return m.select("symbol", "trade_count", *rounded(m, ["win_rate", "profit_factor"]), "log_growth")


# --- portfolios over the weekly panel ------------------------------------------------------------


def weekly_scored(spark, sf):
    """Weekly bars with features; the score is the four-bar momentum."""
    bars = numbered(spark, sf, "week")
    f = ft.cross_features(bars).dropna(subset=ft.CROSS)
    return bars, f.withColumn("score", F.col("return_5d"))


def portfolio_of(scored, bars, n=2):
    dates = scored.select("bar_ts").distinct()
    return tr.portfolio_returns(tr.top_n_per_date(scored, n), bars, dates)


WEEKLY = f"""{bars_cte('week')}, {CROSS_SQL}, sc AS (SELECT *, return_5d AS score FROM cross_f WHERE {' AND '.join(c + ' IS NOT NULL' for c in ft.CROSS)})"""


def PORT_SQL(n=2, rank="score DESC, symbol"):
    return f"""dts AS (SELECT bar_ts, lead(bar_ts) OVER (ORDER BY bar_ts) AS next_ts, k FROM (SELECT bar_ts, count(*) AS k FROM sc GROUP BY 1)),
pk AS (SELECT s.*, row_number() OVER (PARTITION BY bar_ts ORDER BY {rank}) AS rk FROM sc s),
pr AS (SELECT p.bar_ts, p.symbol, p.rk, (b.close * 0.999 - b.open * 1.001) / (b.open * 1.001) AS r FROM pk p JOIN dts d ON d.bar_ts = p.bar_ts AND d.k >= 2 AND d.next_ts IS NOT NULL
  JOIN bars b ON b.symbol = p.symbol AND b.bar_ts = d.next_ts WHERE p.rk <= {n}),
port AS (SELECT bar_ts, avg(r) AS ret, list(symbol ORDER BY rk) AS symbols FROM pr GROUP BY 1)"""


@query(
    "top_n_portfolio_returns", "N6 H1 E6",
    f"WITH {WEEKLY}, {PORT_SQL()} SELECT {DAY_SQL}, round(ret, 6) AS ret, array_to_string(symbols, ',') AS symbols FROM port",
)
def top_n_portfolio_returns(spark, sf):
    bars, scored = weekly_scored(spark, sf)
    p = portfolio_of(scored, bars)
    return p.select(day_col(), *rounded(p, ["ret"]), F.concat_ws(",", "symbols").alias("symbols"))


PORT_METRICS = """cu AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY bar_ts)) AS eqv FROM port),
dd AS (SELECT *, (eqv - max(eqv) OVER (ORDER BY bar_ts)) / max(eqv) OVER (ORDER BY bar_ts) AS ddn FROM cu)
SELECT {label} AS strategy, count(*)::BIGINT AS trade_count, round(sum(ln(1 + ret)), 6) AS log_growth, round(avg((ret > 0)::INT), 6) AS win_rate,
  round(sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / abs(sum(CASE WHEN ret <= 0 THEN ret ELSE 0 END)), 6) AS profit_factor,
  round(avg(ret) / stddev_pop(ret) * sqrt(252), 6) AS sharpe_ratio, round(min(ddn), 6) AS max_drawdown FROM dd"""

# the compounded return of this synthetic panel is astronomically large: compare its logarithm
METRIC_COLS = ["log_growth", "win_rate", "profit_factor", "sharpe_ratio", "max_drawdown"]


def with_log_growth(m):
    return m.withColumn("log_growth", F.log1p("compounded_return"))


@query(
    "weekly_momentum_portfolio", "F4 F6 A1 A7 A13 C6 C17 H1 N6",
    f"WITH {WEEKLY}, {PORT_SQL()}, {PORT_METRICS.format(label=repr('momentum'))}",
)
def weekly_momentum_portfolio(spark, sf):
    bars, scored = weekly_scored(spark, sf)
    p = portfolio_of(scored, bars).withColumn("strategy", F.lit("momentum"))
    m = with_log_growth(mt.portfolio_metrics(p, ["strategy"]))
    return m.select("strategy", "trade_count", *rounded(m, METRIC_COLS))


@query("pseudo_random_portfolio", "N7")
def pseudo_random_portfolio(spark, sf):
    bars, scored = weekly_scored(spark, sf)
    p = portfolio_of(scored.withColumn("score", tr.pseudo_random_score(42)), bars)
    m = with_log_growth(mt.portfolio_metrics(p.withColumn("strategy", F.lit("random")), ["strategy"]))
    return m.select("strategy", "trade_count", *rounded(m, METRIC_COLS))


@query(
    "common_dates", "E4",
    f"WITH {bars_cte('week')}, k AS (SELECT bar_ts FROM bars GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)) SELECT symbol, {DAY_SQL}, round(close, 6) AS close FROM bars WHERE bar_ts IN (SELECT bar_ts FROM k)",
)
def common_dates_q(spark, sf):
    from tidebar.plans.tables import weekly

    return common_dates(weekly(spark, sf)).select("symbol", day_col(), F.round("close", 6).alias("close"))


@query(
    "fast_signal_gate", "N8 G6 M1",
    f"""WITH {bars_cte()}, {CROSS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n) AS k, 1 / (1 + exp(-3 * return_5d)) AS prob FROM cross_f WHERE {' AND '.join(c + ' IS NOT NULL' for c in ft.CROSS)}),
g AS (SELECT *, CASE WHEN count(*) OVER w >= 50 THEN quantile_cont(prob, 0.8) OVER w END AS cutoff FROM f WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT symbol, {DAY_SQL}, round(cutoff, 6) AS cutoff, coalesce(prob >= 0.6 AND prob >= cutoff AND realized_vol_5d > 0.005 AND realized_vol_5d < 0.08 AND ret_lag_3 > 0, false) AS signal FROM g""",
)
def fast_signal_gate(spark, sf):
    f = ft.cross_features(numbered(spark, sf)).dropna(subset=ft.CROSS)
    f = f.withColumn("prob", F.lit(1.0) / (F.exp(F.col("return_5d") * -3.0) + 1.0))
    g = tr.fast_gate(f)
    return g.select("symbol", day_col(), *rounded(g, ["cutoff"]), "signal")


@query(
    "buy_gate", "M1",
    f"""WITH {bars_cte()}, {CROSS_SQL}, f AS (SELECT *, 1 / (1 + exp(-3 * return_5d)) AS p, realized_vol_5d / 10 AS v, n % 5 = 0 AS cool FROM cross_f WHERE realized_vol_5d IS NOT NULL AND return_5d IS NOT NULL),
g AS (SELECT *, concat_ws(',', CASE WHEN p < 0.58 THEN 'probability_below_threshold' END, CASE WHEN NOT (v > 0.005 AND v < 0.08) THEN 'volatility_out_of_range' END, CASE WHEN cool THEN 'cooldown_active' END) AS rs FROM f)
SELECT symbol, {DAY_SQL}, CASE WHEN rs = '' THEN 'BUY' ELSE 'NO_TRADE' END AS signal, rs AS reasons FROM g""",
)
def buy_gate(spark, sf):
    f = ft.cross_features(numbered(spark, sf)).dropna(subset=["realized_vol_5d", "return_5d"])
    p = F.lit(1.0) / (F.exp(F.col("return_5d") * -3.0) + 1.0)
    signal, reasons = tr.gate(p, F.col("realized_vol_5d") / 10.0, F.col("bar_no") % 5 == 0)
    return f.select("symbol", day_col(), signal.alias("signal"), F.concat_ws(",", reasons).alias("reasons"))
