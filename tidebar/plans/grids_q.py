"""Queries for grids, ablations and per-fold metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import features as ft, grids as gr, metrics as mt, models as ml
from tidebar.plans.features_q import CROSS_SQL
from tidebar.plans.paths_q import PRED_SQL, member_predictions
from tidebar.plans.registry import query, rounded, sql_rounded
from tidebar.plans.signals_q import DECISION_SQL, SIGNALS_SQL, TIER_SQL, signals_table
from tidebar.plans.tables import bars_cte, led, numbered
from tidebar.session import cut_lineage

OK = " AND ".join(c + " IS NOT NULL" for c in ft.CROSS)
GRID = ["win_rate", "profit_factor", "pf_vs_baseline"]


@query(
    "experiment_grid", "F18 H6 F20 N7 N8",
    f"""WITH {bars_cte()}, {CROSS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n) AS k, 1 / (1 + exp(-3 * return_5d)) AS prob, realized_vol_5d / 10 AS v5 FROM cross_f WHERE {OK}),
g AS (SELECT *, CASE WHEN count(*) OVER w >= 50 THEN quantile_cont(prob, 0.8) OVER w END AS cutoff FROM f WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
e AS (SELECT g.*, h.h, lead(open, 1) OVER (PARTITION BY symbol, h.h ORDER BY n) * 1.001 AS entry, lead(n, h.h + 1) OVER (PARTITION BY symbol, h.h ORDER BY n) AS enough FROM g, (VALUES (3), (5), (7)) h(h)),
p AS (SELECT e.symbol, e.n, e.h, e.entry, b.n - e.n AS j, CASE WHEN b.low <= entry * 0.98 THEN entry * 0.98 WHEN b.high >= entry * 1.03 THEN entry * 1.03 WHEN b.n = e.n + h THEN b.close END AS px FROM e JOIN bars b ON b.symbol = e.symbol AND b.n BETWEEN e.n + 1 AND e.n + h WHERE enough IS NOT NULL AND e.n > 200),
x AS (SELECT symbol, n, h, any_value(entry) AS entry, arg_min(px, j) * 0.999 AS px FROM p WHERE px IS NOT NULL GROUP BY ALL),
t AS (SELECT x.h, (x.px - x.entry) / x.entry AS ret, g.prob, coalesce(g.prob >= g.cutoff AND g.v5 > 0.005 AND g.v5 < 0.08 AND g.ret_lag_3 > 0, false) AS ok FROM x JOIN g USING (symbol, n)),
r AS (SELECT t.*, q.th FROM t, (VALUES (-1.0), (0.55), (0.60), (0.65)) q(th) WHERE q.th < 0 OR (ok AND prob >= q.th)),
m AS (SELECT h AS horizon, th::DOUBLE AS threshold, count(*)::BIGINT AS trade_count, avg((ret > 0)::INT) AS win_rate, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / abs(sum(CASE WHEN ret <= 0 THEN ret ELSE 0 END)) AS profit_factor, sum(ln(1 + ret)) AS log_growth FROM r GROUP BY ALL)
SELECT m.horizon, m.threshold, m.trade_count, round(m.win_rate, 6) AS win_rate, round(m.profit_factor, 6) AS profit_factor, round(m.log_growth, 4) AS log_growth, round(m.profit_factor / b.profit_factor, 6) AS pf_vs_baseline
FROM m JOIN m b ON b.horizon = m.horizon AND b.threshold < 0 WHERE m.threshold >= 0""",
)
def experiment_grid(spark, sf):
    bars = numbered(spark, sf)
    f = ft.cross_features(bars).dropna(subset=ft.CROSS).withColumns(
        {"prob": F.lit(1.0) / (F.exp(F.col("return_5d") * -3.0) + 1.0), "realized_vol_5d": F.col("realized_vol_5d") / 10.0}
    )
    f = f.select("symbol", "bar_no", "prob", "realized_vol_5d", "ret_lag_3").join(bars, ["symbol", "bar_no"])
    g = gr.leaderboard(gr.experiment_grid(f, [3, 5, 7], [0.55, 0.60, 0.65]))
    return g.select("horizon", "threshold", "trade_count", *rounded(g, GRID), F.round("log_growth", 4).alias("log_growth"))


ABL = ["win_rate", "total_return", "profit_factor"]


def _ablation_sql():
    base = SIGNALS_SQL.replace("\nsg AS (", "\nsg0 AS (").replace("i0 AS (SELECT symbol, bar_ts, n, close,", "i0 AS (SELECT symbol, bar_ts, n, open, high, low, close,")
    sg = """, sgx AS (SELECT s.* REPLACE (CASE WHEN v.reg THEN market_regime ELSE 'RANGING' END AS market_regime, CASE WHEN v.snt THEN twitter_sentiment ELSE 0 END AS twitter_sentiment, least(1, signal_strength_score + CASE WHEN v.snt AND twitter_volume >= 5 THEN least(0.07, least(1, abs(twitter_sentiment)) * least(1, twitter_volume / 120.0) * 0.055) ELSE 0 END) AS signal_strength_score,
    CASE WHEN v.snt AND twitter_sentiment > 0.5 THEN least(1, confidence_score * (1 + least(0.045, least(1, twitter_volume / 120.0) * least(1, abs(twitter_sentiment)) * 0.03))) ELSE confidence_score END AS confidence_score, false AS cooldown_active), v.name AS vname, v.cd, v.strict
  FROM sg0 s, (VALUES ('A_full', true, true, true, true), ('B_no_twitter', false, true, true, true), ('C_no_regime_filter', true, false, true, true), ('D_no_cooldown', true, true, false, true), ('E_weaker_thresholds', true, true, true, true), ('F_decision_layer_only', true, true, true, false)) v(name, snt, reg, cd, strict)), sg AS (SELECT * FROM sgx)"""
    tail = """, picked AS (SELECT t.symbol, t.vname, t.cd, t.n, t.bar_ts, CASE WHEN t.strict THEN t.td WHEN d.tsig = 'BUY' THEN CASE WHEN d.hc THEN 'STRONG_BUY' ELSE 'WEAK_BUY' END ELSE 'NO_TRADE' END AS decision FROM tier t JOIN dec d ON d.symbol = t.symbol AND d.n = t.n AND d.vname = t.vname),
prof AS (SELECT *, CASE decision WHEN 'STRONG_BUY' THEN 0.02 ELSE 0.015 END AS sl, CASE decision WHEN 'STRONG_BUY' THEN 0.03 ELSE 0.02 END AS tp, CASE decision WHEN 'STRONG_BUY' THEN 3 ELSE 1 END AS hold FROM picked WHERE decision <> 'NO_TRADE'),
ent AS (SELECT p.*, b.open AS entry FROM prof p LEFT JOIN bars b ON b.symbol = p.symbol AND b.n = p.n + 1),
pth AS (SELECT e.symbol, e.vname, e.n, b.n - e.n AS j, CASE WHEN b.open <= entry*(1-sl) THEN 1 WHEN b.open >= entry*(1+tp) THEN 1 WHEN b.low <= entry*(1-sl) THEN 1 WHEN b.high >= entry*(1+tp) THEN 1 WHEN b.n - e.n = hold THEN 1 END AS why,
  CASE WHEN b.open <= entry*(1-sl) THEN b.open WHEN b.open >= entry*(1+tp) THEN b.open WHEN b.low <= entry*(1-sl) THEN entry*(1-sl) WHEN b.high >= entry*(1+tp) THEN entry*(1+tp) ELSE b.close END AS px FROM ent e JOIN bars b ON b.symbol = e.symbol AND b.n BETWEEN e.n + 1 AND e.n + e.hold),
hit AS (SELECT symbol, vname, n, min(j) AS j FROM pth WHERE why IS NOT NULL GROUP BY ALL),
rel AS (SELECT e.symbol, e.vname, e.n, p.px / e.entry - 1 AS r, greatest(e.n + p.j, e.n + CASE WHEN e.cd THEN (SELECT count(*) FROM bars b WHERE b.symbol = e.symbol AND b.bar_ts BETWEEN e.bar_ts AND e.bar_ts + INTERVAL 3 DAY) ELSE 1 END) AS release_no
  FROM ent e JOIN hit h USING (symbol, vname, n) JOIN pth p ON p.symbol = h.symbol AND p.vname = h.vname AND p.n = h.n AND p.j = h.j),
succ AS (SELECT r.symbol, r.vname, r.n, (SELECT min(u.n) FROM rel u WHERE u.symbol = r.symbol AND u.vname = r.vname AND u.n >= r.release_no) AS nx FROM rel r),
pos(symbol, vname, n) AS (SELECT symbol, vname, min(n) FROM succ GROUP BY 1, 2 UNION ALL SELECT p.symbol, p.vname, s.nx FROM pos p JOIN succ s ON s.symbol = p.symbol AND s.vname = p.vname AND s.n = p.n WHERE s.nx IS NOT NULL)
SELECT symbol AS base_symbol, vname AS variant, count(*)::BIGINT AS total_trades, round(avg((r > 0)::INT), 6) AS win_rate, round(sum(r), 6) AS total_return, round(sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(abs(sum(CASE WHEN r < 0 THEN r ELSE 0 END)), 0), 6) AS profit_factor
FROM rel JOIN pos USING (symbol, vname, n) GROUP BY ALL"""
    return (base + sg + DECISION_SQL + TIER_SQL + tail).replace("WITH ", "WITH RECURSIVE ", 1)


@query("ablation_variants", "N9 M23 F18 H6", _ablation_sql())
def ablation_variants(spark, sf):
    s = gr.ablation(signals_table(spark, sf), cooldown_days=3)
    return s.select("base_symbol", "variant", "total_trades", *rounded(s, ABL))


@query(
    "rolling_origin_metrics", "K2 F12 F13",
    f"""WITH {bars_cte()}, {PRED_SQL}, c AS (SELECT symbol, count(*) AS tot FROM (SELECT DISTINCT symbol, n FROM pr) GROUP BY 1),
q AS (SELECT p.*, dense_rank() OVER (PARTITION BY p.symbol ORDER BY n) AS pos, tot, floor(tot * 0.6) AS h FROM pr p JOIN c USING (symbol)),
f AS (SELECT *, floor((pos - 1 - h) / 30) AS fold FROM q WHERE pos > h AND h >= 50 AND h + (floor((pos - 1 - h) / 30) + 1) * 30 <= tot),
m AS (SELECT symbol, model, fold, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, coalesce(avg(CASE WHEN y <> 0 THEN (sign(y) = sign(p))::INT END), 0.5) AS directional_accuracy FROM f GROUP BY ALL)
SELECT symbol, model, count(*)::BIGINT AS folds, round(avg(mae), 6) AS mae_mean, round(avg(rmse), 6) AS rmse_mean, round(avg(directional_accuracy), 6) AS directional_accuracy_mean, round(stddev_pop(mae), 6) AS mae_std, round(stddev_pop(rmse), 6) AS rmse_std, round(stddev_pop(directional_accuracy), 6) AS directional_accuracy_std FROM m GROUP BY ALL""",
)
def rolling_origin_metrics(spark, sf):
    p = cut_lineage(member_predictions(numbered(spark, sf)))
    span = p.groupBy("symbol").agg(F.min("bar_no").alias("_lo"), F.max("bar_no").alias("_hi"))
    p = p.join(span, "symbol")
    pos, n = F.col("bar_no") - F.col("_lo") + 1, F.col("_hi") - F.col("_lo") + 1
    p = p.withColumn("fold", ml.rolling_origin_fold(pos, n)).where(F.col("fold").isNotNull())
    names = ["mae", "rmse", "directional_accuracy"]
    m = mt.over_folds(mt.regression_metrics(p, ["symbol", "model", "fold"]), ["symbol", "model"], names)
    return m.select("symbol", "model", "folds", *rounded(m, [f"{x}_{k}" for k in ("mean", "std") for x in names]))
