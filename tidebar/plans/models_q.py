"""Queries for splits, scaling, training and scoring.

Fitted models have no SQL counterpart: the tests check their operators on small frames.  The
queries train members of the operators' full sizes on the pooled daily bars of all symbols.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions.nulls import drop_incomplete
from tidebar.operators import features as ft, fold as fd, labels as lb, metrics as mt, models as ml, paths as ph, signals as sg, trades as tr
from tidebar.operators.layout import blocked, lead, own_rows, rolling
from tidebar.plans.features_q import CROSS_SQL, DAY_SQL, day_col, full_sql
from tidebar.plans.paths_q import SCALE, WEIGHTS
from tidebar.plans.registry import query, rounded, sql_rounded
from tidebar.plans.tables import bars_cte, led, numbered
from tidebar.plans.trades_q import METRIC_COLS, portfolio_of, with_log_growth
from tidebar.session import cut_lineage
from tidebar.sources.bars import latest_rows

OK = " AND ".join(c + " IS NOT NULL" for c in ft.CROSS)


def labelled(spark, sf, freq="day", horizon=5):
    """Cross features with the cross-sectional label, complete rows only."""
    bars = numbered(spark, sf, freq)
    y = lb.cross_sectional_label(bars, horizon).select("symbol", "bar_no", "label")
    x = drop_incomplete(ft.cross_features(bars), ft.CROSS)
    return bars, cut_lineage(x.join(y, ["symbol", "bar_no"]))


@query(
    "chronological_splits", "K1 K2 K3",
    f"""WITH {bars_cte()}, {CROSS_SQL}, x AS (SELECT * FROM cross_f WHERE {OK}), d AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) AS no, count(*) OVER () AS tot FROM (SELECT DISTINCT bar_ts FROM x)),
f AS (SELECT *, floor(tot * 0.5) AS h1, floor((tot - floor(tot * 0.5)) / 5) AS s1, floor(tot * 0.6) AS h2 FROM d)
SELECT symbol, {DAY_SQL}, no AS date_no, (CASE WHEN no > h1 THEN least(floor((no - 1 - h1) / s1), 4) END)::INT AS walk_forward_fold, (CASE WHEN no > h2 AND h2 + (floor((no - 1 - h2) / 30) + 1) * 30 <= tot AND h2 >= 50 THEN floor((no - 1 - h2) / 30) END)::INT AS rolling_fold,
  CASE WHEN no <= floor(tot * 0.7::DOUBLE) THEN 'train' WHEN no <= floor(tot * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'cal' ELSE 'test' END AS split FROM x JOIN f USING (bar_ts)""",
)
def chronological_splits(spark, sf):
    x = drop_incomplete(ft.cross_features(numbered(spark, sf)), ft.CROSS).select("symbol", "bar_ts")
    df = ml.with_date_no(x)
    no, n = F.col("date_no"), F.col("n_dates")
    return df.select(
        "symbol", day_col(), "date_no", ml.walk_forward_fold(no, n).alias("walk_forward_fold"), ml.rolling_origin_fold(no, n).alias("rolling_fold"), ml.chronological_split(no, n).alias("split")
    )


@query(
    "robust_scaling", "K4",
    f"""WITH {bars_cte()}, {CROSS_SQL}, x AS (SELECT * FROM cross_f WHERE {OK}),
l AS (UNPIVOT (SELECT symbol, bar_ts, {', '.join(ft.CROSS)} FROM x) ON {', '.join(ft.CROSS)} INTO NAME feature VALUE v),
q AS (SELECT feature, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM l WHERE extract(year FROM bar_ts) < 1999 GROUP BY 1)
SELECT symbol, {DAY_SQL}, feature, round((v - q50) / CASE WHEN q75 = q25 THEN 1 ELSE q75 - q25 END, 5) AS scaled FROM l JOIN q USING (feature)""",
)
def robust_scaling(spark, sf):
    x = cut_lineage(drop_incomplete(ft.cross_features(numbered(spark, sf)), ft.CROSS))
    stats = ml.robust_stats(x.where(F.year("bar_ts") < 1999), ft.CROSS)
    s = ml.robust_scale(x, ft.CROSS, stats)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f, 5).alias("scaled")) for f in ft.CROSS]))
    return s.select("symbol", day_col(), cells.alias("c")).select("symbol", "bar_day", "c.*")


def folded(spark, sf):
    _, x = labelled(spark, sf)
    x = ml.with_date_no(x.where(F.col("label").isNotNull()))
    return x.withColumn("fold", ml.walk_forward_fold(F.col("date_no"), F.col("n_dates")))


@query("walk_forward_classifier", "K1 K5 K6 F14 F13")
def walk_forward_classifier(spark, sf):
    preds = cut_lineage(ml.walk_forward(folded(spark, sf), ft.CROSS, "label"))
    m = mt.classification_metrics(preds.withColumn("y_true", F.col("label")), ["fold"])
    m = cut_lineage(m.withColumn("model", F.lit("classifier")))
    return m.join(mt.over_folds(m, ["model"], ["accuracy", "brier_score", "roc_auc"]), "model")


@query(
    "classification_metrics", "F14 F13",
    f"""WITH {bars_cte()}, {CROSS_SQL}, x AS (SELECT *, (returns > 0)::INT AS y, 1 / (1 + exp(-close_open * 2)) AS p, n % 4 AS fold FROM cross_f WHERE returns IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rk FROM x)
SELECT fold, count(*)::BIGINT AS n, round(avg((y = (p >= 0.5)::INT)::INT), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier_score,
  round(((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * sum(1 - y)))::DOUBLE, 6) AS roc_auc FROM r GROUP BY 1""",
)
def classification_metrics(spark, sf):
    x = ft.cross_features(numbered(spark, sf)).where(F.col("returns").isNotNull())
    p = F.lit(1.0) / (F.exp(F.col("close_open") * -2.0) + 1.0)
    x = x.select((F.col("bar_no") % 4).alias("fold"), (F.col("returns") > 0).cast("int").alias("y_true"), p.alias("y_prob"))
    m = mt.classification_metrics(x.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int")), ["fold"])
    return m.select("fold", "n", *rounded(m, ["accuracy", "brier_score", "roc_auc"]))


@query("cross_sectional_ranker", "K3 K6 K11 N6 F4")
def cross_sectional_ranker(spark, sf):
    bars, x = labelled(spark, sf)
    x = ml.with_date_no(x).withColumn("split", ml.chronological_split(F.col("date_no"), F.col("n_dates")))
    x = cut_lineage(x)
    known = x.where(F.col("label").isNotNull())
    model = ml.fit_classifier(known.where(F.col("split") == "train"), ft.CROSS, "label")
    cal = ml.fit_calibrator(ml.score(model, known.where(F.col("split") == "cal")), "label")
    test = ml.calibrated(cal, ml.score(model, x.where(F.col("split") == "test"))).withColumn("score", F.col("y_prob"))
    p = portfolio_of(cut_lineage(test.select("symbol", "bar_ts", "score")), bars).withColumn("strategy", F.lit("ranker"))
    m = with_log_growth(mt.portfolio_metrics(p, ["strategy"]))
    return m.select("strategy", "trade_count", *rounded(m, METRIC_COLS))


@query("latest_prediction", "K12 H7")
def latest_prediction(spark, sf):
    _, x = labelled(spark, sf)
    x = ml.with_date_no(x)
    x = cut_lineage(x)
    no, n = F.col("date_no"), F.col("n_dates")
    known = x.where(F.col("label").isNotNull() & (no < n))
    model = ml.fit_classifier(known, ft.CROSS, "label")
    cal = ml.fit_calibrator(ml.score(model, known.where(no >= n - F.greatest(F.lit(1), F.floor(n * 0.1)))), "label")
    now = ml.calibrated(cal, ml.score(model, latest_rows(x)))
    signal, reasons = tr.gate(F.col("y_prob"), F.col("realized_vol_5d"), F.lit(False))
    return now.select("symbol", day_col(), F.col("y_prob").alias("probability"), signal.alias("signal"), F.concat_ws(",", reasons).alias("reasons"))


def with_targets(spark, sf):
    """Daily core features with the next return and the five-bar direction."""
    bars = numbered(spark, sf)
    y = lb.directional_forward_label(lb.next_log_return(bars)).select("symbol", "bar_no", "close", "target_log_return_1d", "direction")
    x = drop_incomplete(ft.core_features(bars), ft.CORE).join(y, ["symbol", "bar_no"])
    return cut_lineage(ml.with_date_no(x))


def train_part(x, share=0.7):
    return x.where((F.col("date_no") <= F.floor(F.col("n_dates") * share)) & F.col("target_log_return_1d").isNotNull())


@query("ensemble_regressors", "K4 K7 K13 F12")
def ensemble_regressors(spark, sf):
    x = with_targets(spark, sf)
    x = cut_lineage(ml.robust_scale(x, ft.CORE, ml.robust_stats(train_part(x), ft.CORE)))
    models = ml.fit_members(train_part(x), ft.CORE, "target_log_return_1d", F.col("date_no"), F.col("n_dates"))
    test = x.where((F.col("date_no") > F.floor(F.col("n_dates") * 0.7)) & F.col("target_log_return_1d").isNotNull())
    p = ml.predict_members(models, test)
    long = p.select("symbol", F.col("target_log_return_1d").alias("y"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("y_pred")) for m in models])).alias("c")).select("symbol", "y", "c.*")
    return mt.regression_metrics(long, ["symbol", "model"])


@query("direction_heads", "K8 K9 K10 K15")
def direction_heads(spark, sf):
    x = with_targets(spark, sf)
    heads = ml.fit_direction_heads(train_part(x).where(F.col("direction").isNotNull()), ft.CORE, "direction")
    now = ml.score_direction(heads, latest_rows(x))
    m = sg.merged_probs("head_linear", "head_trees")
    now = now.withColumns({**m, "directional_model_agreement": sg.distribution_agreement("head_linear", "head_trees")})
    return now.select("symbol", "p_down", "p_neutral", "p_up", "directional_model_agreement", sg.max_prob().alias("directional_confidence"))


@query("one_step_forecast", "K14 L8")
def one_step_forecast(spark, sf):
    x = with_targets(spark, sf)
    models = ml.fit_members(train_part(x), ft.CORE, "target_log_return_1d", F.col("date_no"), F.col("n_dates"))
    now = ml.predict_members(models, latest_rows(x)).withColumns({"vol": F.col("realized_vol_20d") / SCALE, "p99_daily": F.lit(None).cast("double")})
    f = ml.one_step_forecast(now, list(models), [0.5, 0.3, 0.2])
    return f.select("symbol", "ensemble_log_return", "direction", "confidence", "predicted_price", "lower_bound", "upper_bound")


def _recursive_sql():
    """The same path as a recursion over (last seven returns, smoothed moments)."""
    a = 2 / 15
    q = 1 - a
    std = f"sqrt(greatest(eq - em * em, 0) / (1 - (pow({q * q!r}, k - 2) + {a * a / (1 - q * q)!r} * (1 - pow({q * q!r}, k - 2)))))"
    return f"""WITH RECURSIVE {bars_cte()}, mx AS (SELECT symbol, max(n) AS last FROM bars GROUP BY 1),
tl AS (SELECT b.symbol, b.close, b.n - greatest(last - 1000, 0) AS k, last - greatest(last - 1000, 0) AS top, ln(b.close / lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.n)) / 50 AS x FROM bars b JOIN mx ON mx.symbol = b.symbol WHERE b.n > last - 1000),
sm AS (SELECT *, pow({q!r}, k - 2) * sum(CASE WHEN k = 2 THEN x WHEN k > 2 THEN {a!r} * x END * pow({q!r}, 2 - k)) OVER w AS em, pow({q!r}, k - 2) * sum(CASE WHEN k = 2 THEN x * x WHEN k > 2 THEN {a!r} * x * x END * pow({q!r}, 2 - k)) OVER w AS eq,
  list(x) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS xs FROM (SELECT symbol, close, k, top, CASE WHEN k > 1 THEN x END AS x FROM tl) WINDOW w AS (PARTITION BY symbol ORDER BY k)),
rec(symbol, step, k, close, xs, em, eq, ens, vol, agree) AS (SELECT symbol, 0, k, close, xs, em, eq, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM sm WHERE k = top UNION ALL
  SELECT symbol, step + 1, k + 1, close * exp(e), list_append(xs[2:7], e / 50), {q!r} * em + {a!r} * e / 50, {q!r} * eq + {a!r} * (e / 50) * (e / 50), e, v,
    CASE WHEN mx - mn < 1e-6 THEN 0.22 WHEN (abs(r1) + abs(r2) + abs(r3) + abs(r4)) / 4 < 1e-10 THEN 0.25 ELSE greatest(0, 1 - sqrt((pow(r1 - mu, 2) + pow(r2 - mu, 2) + pow(r3 - mu, 2) + pow(r4 - mu, 2)) / 4) / ((abs(r1) + abs(r2) + abs(r3) + abs(r4)) / 4)) END
  FROM (SELECT *, (r1 + r2 + r3 + r4) / 4 AS mu, greatest(r1, r2, r3, r4) AS mx, least(r1, r2, r3, r4) AS mn, greatest(-cap, least(cap, 0.4 * r1 + 0.3 * r2 + 0.2 * r3 + 0.1 * r4)) AS e
    FROM (SELECT *, greatest(-cap, least(cap, xs[7])) AS r1, greatest(-cap, least(cap, (xs[5] + xs[6] + xs[7]) / 3)) AS r2, greatest(-cap, least(cap, (xs[1] + xs[2] + xs[3] + xs[4] + xs[5] + xs[6] + xs[7]) / 7)) AS r3, greatest(-cap, least(cap, -0.5 * xs[7])) AS r4
      FROM (SELECT *, greatest(least(least(0.055, 3 * greatest(v, 0.004)), 1.15 * 0.04), 0.002) AS cap FROM (SELECT *, greatest({std}, 0.005) AS v FROM rec WHERE step < 14)))))
SELECT symbol, step::INT AS step, round(ens, 8) AS ens, round(close, 4) AS price, round(vol, 8) AS vol, round(agree, 6) AS agree FROM rec WHERE step > 0"""


@query("recursive_forecast", "L1 L2 L3 L4 L7", _recursive_sql())
def recursive_forecast(spark, sf):
    path = fd.fold_steps(fd.recursive_fold(numbered(spark, sf), fd.ReturnState, None, WEIGHTS, p99=0.04, scale=SCALE, guard=False))
    return path.select("symbol", "step", F.round("ens", 8).alias("ens"), F.round("price", 4).alias("price"), F.round("vol", 8).alias("vol"), F.round("agree", 6).alias("agree"))


@query("recursive_model_forecast", "L1 L6 K7 K13")
def recursive_model_forecast(spark, sf):
    bars = numbered(spark, sf)
    x = with_targets(spark, sf)
    models = ml.fit_members(train_part(x), ft.CORE, "target_log_return_1d", F.col("date_no"), F.col("n_dates"))
    path = fd.recursive_fold(bars, fd.CoreState, fd.flat_members(models, ft.CORE), [0.5, 0.3, 0.2], scale=SCALE)
    names = list(models)
    steps = fd.fold_steps(path, "clip_saturation", "missing_fill_ratio", "guardrail")
    return steps.select("symbol", "step", "ens", "price", "lower", "upper", "agree", *[F.col("member_prices")[i].alias(f"price_{m}") for i, m in enumerate(names)], "clip_saturation", "missing_fill_ratio", "guardrail")
