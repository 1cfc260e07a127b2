"""Queries for forecast paths and their quality.

Four plain members (last return, three-bar mean, weekly momentum, reversal) stand in for trained
models, so every path rule has an exact DuckDB counterpart.  The test ticks move far more than
real prices, so members and volatility are scaled down by 50.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions.arrays import amean, column_of
from tidebar.functions.nulls import fill_defaults
from tidebar.operators import metrics as mt, paths as ph
from tidebar.operators.features import change
from tidebar.operators.ewm import WARMUP, Ewm, ewm_std, span, with_ewm
from tidebar.operators.layout import blocked, lag, lead, own_rows, rolling
from tidebar.plans.registry import query, rounded, sql_rounded
from tidebar.plans.tables import bars_cte, ew, lagged, led, numbered, roll

MODELS = ["last_return", "mean_return", "weekly_momentum", "reversal"]
WEIGHTS = [0.4, 0.3, 0.2, 0.1]
DECAY = [0.90, 0.95, 1.0, 0.80]
SCALE = 50.0


def member_frame(bars):
    """Bars with the four members' next-step log returns, a volatility and a regime code."""
    lr = F.log(F.col("close") / lag("close"))
    df = blocked(bars, back=WARMUP + 16).withColumn("lr", lr / SCALE).withColumn("_lr2", F.col("lr") * F.col("lr"))
    df = with_ewm(df, {"_m": Ewm("lr", span(14), 2), "_q": Ewm("_lr2", span(14), 2)})
    df = df.withColumns(
        {
            "vol": ewm_std(F.col("_m"), F.col("_q"), span(14), 2),
            "p_last_return": F.col("lr"),
            "p_mean_return": rolling(F.avg, "lr", 3),
            "p_weekly_momentum": rolling(F.sum, "lr", 7) / 7.0,
            "p_reversal": F.col("lr") * -0.5,
        }
    )
    df = own_rows(df).where(F.col("bar_no") >= 9)
    code = F.when(F.col("vol") < 0.012, 0.0).when(F.col("vol") < 0.030, 1.0).otherwise(2.0)
    return df.drop("_m", "_q", "_lr2").withColumn("vol_regime_encoded", code)


MEMBER_SQL = f"""m0 AS (SELECT *, ln(close / {lagged('close', 1)}) / 50 AS lr FROM bars),
m1 AS (SELECT *, {ew('lr', 2 / 15, 2)} AS em, {ew('lr*lr', 2 / 15, 2)} AS eq, {roll('avg', 'lr', 3)} AS mean3, {roll('sum', 'lr', 7)} / 7 AS mom7 FROM m0),
mem AS (SELECT *, sqrt(greatest(eq - em*em, 0) / (1 - (pow({(13 / 15) ** 2!r}, n - 2) + {(2 / 15) ** 2 / (1 - (13 / 15) ** 2)!r} * (1 - pow({(13 / 15) ** 2!r}, n - 2))))) AS vol0 FROM m1 WHERE n >= 9)"""


def path_frame(bars):
    """Fourteen-step paths of every bar."""
    df = member_frame(bars)
    row = lambda s: F.array(*[F.col(f"p_{m}") * F.pow(F.lit(d), s.cast("double") - 1.0) for m, d in zip(MODELS, DECAY)])
    df = df.withColumns(
        {
            "raw": F.transform(F.sequence(F.lit(1), F.lit(ph.HORIZON)), row),
            "weights": F.array(*map(F.lit, WEIGHTS)),
            "p99_daily": F.lit(0.04),
            "p99_cum": F.lit(0.12),
        }
    )
    return ph.with_ensemble(df)


# long form: one row per (symbol, n, step, model)
PATH_SQL = f"""{MEMBER_SQL},
pm AS (SELECT symbol, n, bar_ts, close, greatest(vol0, 0.005) AS vol, CASE WHEN vol0 < 0.012 THEN 0 WHEN vol0 < 0.030 THEN 1 ELSE 2 END AS code, lr, mean3, mom7 FROM mem),
raw AS (SELECT p.*, s.step, x.k, x.model, x.w, CASE x.k WHEN 1 THEN lr WHEN 2 THEN mean3 WHEN 3 THEN mom7 ELSE -0.5 * lr END * pow(x.d, s.step - 1) AS r0
  FROM pm p, (SELECT unnest(range(1, 15)) AS step) s, (VALUES {', '.join(f"({i + 1}, '{m}', {w}, {d})" for i, (m, w, d) in enumerate(zip(MODELS, WEIGHTS, DECAY)))}) x(k, model, w, d)),
cap AS (SELECT *, greatest(least(least(0.055, 3 * greatest(vol, 0.004)), 1.15 * 0.04), 0.002) AS cap FROM raw),
cl AS (SELECT *, greatest(-cap, least(cap, greatest(-0.12, least(0.12, r0)))) AS r FROM cap),
st AS (SELECT symbol, n, any_value(bar_ts) AS bar_ts, step, any_value(close) AS close, any_value(vol) AS vol, any_value(code) AS code, any_value(cap) AS cap,
  greatest(-any_value(cap), least(any_value(cap), sum(w * r) / sum(w))) AS ens, avg(abs(r)) AS mabs, stddev_pop(r) AS sd, max(r) AS mx, min(r) AS mn,
  bool_and(abs(r) >= cap - 1e-6) AS sat FROM cl GROUP BY symbol, n, step),
ag AS (SELECT *, sum(ens) OVER (PARTITION BY symbol, n ORDER BY step) AS cum, CASE WHEN mx - mn < 1e-6 THEN 0.22 WHEN mn >= 0.12 - 1e-4 OR mx <= -0.12 + 1e-4 THEN 0.28 WHEN mabs < 1e-10 THEN 0.25
  ELSE greatest(0, least(1, 1 - sd / mabs)) END AS agree FROM st),
pth AS (SELECT *, close * exp(cum) AS price, close * exp(cum) * exp(-2 * vol * sqrt(step) * (0.88 + 0.12 * code)) AS lower, close * exp(cum) * exp(2 * vol * sqrt(step) * (0.88 + 0.12 * code)) AS upper FROM ag)"""


def _explode(df, cols):
    """One row per step of parallel arrays."""
    zipped = F.arrays_zip(*[F.col(a).alias(b) for a, b in cols.items()])
    return df.select("symbol", "bar_no", F.posexplode(zipped).alias("s", "x")).select(
        "symbol", "bar_no", (F.col("s") + 1).alias("step"), "x.*"
    )


@query(
    "forecast_paths", "L2 L3 L4 L5 L7",
    f"WITH {bars_cte()}, {PATH_SQL} SELECT symbol, n AS bar_no, step::INT AS step, round(ens, 8) AS ens, round(price / close, 6) AS rel_price, round(lower / close, 6) AS rel_lower, round(upper / close, 6) AS rel_upper, round(agree, 6) AS agree FROM pth",
)
def forecast_paths(spark, sf):
    df = path_frame(numbered(spark, sf))
    rel = lambda a: F.transform(a, lambda p: F.round(p / F.col("close"), 6))
    df = df.withColumns({"rp": rel("prices"), "rl": rel("lower"), "ru": rel("upper")})
    out = _explode(df, {"ens": "ens", "rp": "rel_price", "rl": "rel_lower", "ru": "rel_upper", "agree": "agree"})
    return out.withColumns({"ens": F.round("ens", 8), "agree": F.round("agree", 6)})


@query(
    "long_model_paths", "L4 E8",
    f"WITH {bars_cte('week')}, {PATH_SQL} SELECT symbol, n AS bar_no, step::INT AS step, model, round(r, 8) AS log_return FROM cl",
)
def long_model_paths(spark, sf):
    df = path_frame(numbered(spark, sf, "week"))
    long = ph.long_paths(df, MODELS)
    back = ph.long_paths(ph.nest_paths(long, MODELS), MODELS)
    return back.withColumn("log_return", F.round("log_return", 8))


@query(
    "cumulative_guardrail", "L6",
    f"""WITH {bars_cte()}, {PATH_SQL},
g AS (SELECT *, sum(ens) OVER (PARTITION BY symbol, n) AS tot, least(3.5 * vol * sqrt(14), 1.2 * 0.12) AS lim FROM pth),
f AS (SELECT *, CASE WHEN abs(tot) > lim THEN lim / abs(tot) ELSE 1 END AS fac FROM g),
p AS (SELECT *, exp(cum * fac) AS rp, CASE WHEN fac < 1 THEN 1 ELSE 0.88 + 0.12 * code END AS bs FROM f)
SELECT symbol, n AS bar_no, step::INT AS step, fac < 1 AS guardrail, round(ens * fac, 8) AS ens, round(rp, 6) AS rel_price, round(rp * exp(-2 * vol * sqrt(step) * bs), 6) AS rel_lower FROM p""",
)
def cumulative_guardrail(spark, sf):
    df = ph.with_cumulative_guardrail(path_frame(numbered(spark, sf)))
    rel = lambda a: F.transform(a, lambda p: F.round(p / F.col("close"), 6))
    df = df.withColumns({"rp": rel("prices"), "rl": rel("lower"), "g": F.transform("prices", lambda p: F.col("guardrail"))})
    out = _explode(df, {"g": "guardrail", "ens": "ens", "rp": "rel_price", "rl": "rel_lower"})
    return out.withColumn("ens", F.round("ens", 8))


AGREE_SQL = f"""mid AS (SELECT c.*, median(r) OVER w AS ctr, avg(abs(r)) OVER w AS ma FROM cl c WINDOW w AS (PARTITION BY symbol, n, step)),
dv AS (SELECT *, abs(r - ctr) / greatest(abs(ctr), ma, 0.0025) AS dev, CASE WHEN r > 1e-6 THEN 1 WHEN r < -1e-6 THEN -1 ELSE 0 END AS sg FROM mid),
sp AS (SELECT symbol, n, step, avg(dev) AS mdev, max(dev) AS xdev, avg((dev <= 0.85)::INT) AS near, avg((sg = 1)::INT) AS pos, avg((sg = -1)::INT) AS neg FROM dv GROUP BY ALL),
sc AS (SELECT *, 1 / (1 + mdev / 0.85) AS mag, greatest(pos, neg, 0.8 * greatest(0, 1 - pos - neg)) AS sgn, (pos > 0 AND neg > 0) AS mixed,
  CASE WHEN pos > neg AND pos >= 0.5 THEN 1 WHEN neg > pos AND neg >= 0.5 THEN -1 ELSE 0 END AS maj FROM sp),
sc2 AS (SELECT *, (0.45 * sgn + 0.55 * mag) * CASE WHEN mixed THEN 0.74 ELSE 1 END AS b0 FROM sc),
sc3 AS (SELECT *, greatest(0, least(1, CASE WHEN xdev >= 1.35 AND near >= 0.34 THEN least(1, b0 * 1.06) ELSE b0 END)) AS score FROM sc2),
reg AS (SELECT symbol, n, round(avg(score), 4) AS regression_agreement, round(avg((NOT mixed)::INT), 4) AS same_sign_fraction, round(avg(sgn), 4) AS sign_consensus_mean, round(avg(mag), 4) AS magnitude_consensus_mean FROM sc3 GROUP BY ALL),
pmd AS (SELECT d.symbol, d.n, d.k, any_value(d.model) AS model, round(greatest(0, least(1, 0.62 * least(1, avg(d.dev) / 1.25) + 0.24 * avg((s.maj <> 0 AND d.sg <> 0 AND d.sg <> s.maj)::INT)
  + 0.14 * avg((d.dev >= greatest(1.15, 0.88 * s.xdev))::INT))), 4) AS dvg FROM dv d JOIN sc3 s USING (symbol, n, step) GROUP BY d.symbol, d.n, d.k),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, n ORDER BY dvg DESC, k) AS q FROM pmd),
dg AS (SELECT symbol, n, max(CASE WHEN q = 1 AND dvg >= 0.26 THEN model END) AS diverging_model, coalesce(max(CASE WHEN q = 1 AND dvg >= 0.26 THEN dvg END), 0) AS diverging_model_score, max(CASE WHEN q = 2 THEN dvg END) AS second FROM rk GROUP BY ALL)"""


@query(
    "regression_agreement", "L11",
    f"WITH {bars_cte()}, {PATH_SQL}, {AGREE_SQL} SELECT symbol, n AS bar_no, regression_agreement, same_sign_fraction, sign_consensus_mean, magnitude_consensus_mean, diverging_model, diverging_model_score FROM reg JOIN dg USING (symbol, n)",
)
def regression_agreement(spark, sf):
    df = ph.with_regression_agreement(path_frame(numbered(spark, sf)), MODELS)
    return df.select("symbol", "bar_no", "regression_agreement", "same_sign_fraction", "sign_consensus_mean", "magnitude_consensus_mean", "diverging_model", "diverging_model_score")


@query(
    "filtered_ensemble", "L12",
    f"""WITH {bars_cte()}, {PATH_SQL}, {AGREE_SQL},
ex AS (SELECT *, CASE WHEN diverging_model_score >= 0.56 AND (diverging_model_score - second >= 0.05 OR diverging_model_score >= 0.66) THEN diverging_model END AS excluded_model FROM dg),
kp AS (SELECT c.symbol, c.n, c.step, sum(w * r) / sum(w) AS r FROM cl c JOIN ex USING (symbol, n) WHERE excluded_model IS NOT NULL AND c.model <> excluded_model GROUP BY ALL),
fin AS (SELECT symbol, n, exp(sum(r)) AS g FROM kp GROUP BY ALL)
SELECT ex.symbol, ex.n AS bar_no, excluded_model, round(g, 6) AS rel_filtered FROM ex LEFT JOIN fin ON fin.symbol = ex.symbol AND fin.n = ex.n""",
)
def filtered_ensemble(spark, sf):
    df = ph.with_filtered_ensemble(ph.with_regression_agreement(path_frame(numbered(spark, sf)), MODELS), MODELS)
    return df.select("symbol", "bar_no", "excluded_model", F.round(F.col("filtered_final") / F.col("close"), 6).alias("rel_filtered"))


@query(
    "agreement_trend", "L13 L14",
    f"""WITH {bars_cte()}, {PATH_SQL}, {AGREE_SQL},
a AS (SELECT symbol, n, last(agree ORDER BY step) AS fin, first(agree ORDER BY step) AS fst, stddev_pop(agree) AS sd, avg(agree) AS lvl FROM pth GROUP BY ALL),
b AS (SELECT *, fin - fst AS slope, greatest(0, least(1, 1 - least(1, sd / 0.18))) AS stab FROM a),
d AS (SELECT *, round(greatest(0, least(1, 0.5 * stab + 0.3 * (0.5 + 0.5 * greatest(-1, least(1, slope / 0.18))) + 0.2 * lvl)), 4) AS agreement_trend_score,
  CASE WHEN slope <= -0.10 OR (fin < lvl - 0.08 AND sd > 0.06) THEN 'collapsing' WHEN slope >= 0.08 THEN 'improving' WHEN stab >= 0.72 THEN 'stable' ELSE 'mixed' END AS agreement_trend_label FROM b),
e AS (SELECT d.*, regression_agreement AS ra, 0.5 + 0.5 * lvl AS da, 0.67 * regression_agreement + 0.33 * (0.5 + 0.5 * lvl) AS mix FROM d JOIN reg USING (symbol, n))
SELECT symbol, n AS bar_no, agreement_trend_score, agreement_trend_label, round(slope, 4) AS agreement_slope, round(stab, 4) AS agreement_stability,
  round(greatest(0, least(1, CASE WHEN ra >= 0.6 AND da >= 0.6 THEN least(1, mix + 0.05 * least(ra, da)) WHEN ra < 0.35 AND da < 0.55 THEN mix * 0.92 ELSE mix END)), 6) AS combined_agreement FROM e""",
)
def agreement_trend(spark, sf):
    df = ph.with_regression_agreement(path_frame(numbered(spark, sf)), MODELS)
    t = ph.agreement_trend(F.col("agree"))
    df = df.withColumns(t).withColumn("combined_agreement", ph.combined_agreement(F.col("regression_agreement"), amean(F.col("agree")) * 0.5 + 0.5))
    return df.select("symbol", "bar_no", *t, F.round("combined_agreement", 6).alias("combined_agreement"))


@query(
    "path_stability_and_chaos", "L15 L16 L17",
    f"""WITH {bars_cte()}, {PATH_SQL},
fl AS (SELECT *, sign(ens) * sign(lag(ens) OVER (PARTITION BY symbol, n ORDER BY step)) AS prod FROM pth),
s AS (SELECT symbol, n, round(greatest(0, least(1, 0.52 * greatest(0, least(1, 1 - least(1, var_pop(ens) / 2.5e-4))) + 0.48 * greatest(0, least(1, 1 - 0.55 * count(*) FILTER (WHERE prod < 0) / 13)))), 4) AS stability_score FROM fl GROUP BY ALL),
q AS (SELECT symbol, n, step, avg((r > 0)::INT) AS p, avg((r < 0)::INT) AS m, var_pop(r) AS v FROM cl GROUP BY ALL),
ch AS (SELECT symbol, n, round(avg((p >= 0.34 AND m >= 0.34)::INT), 4) AS chaos, avg((p >= 0.34 AND m >= 0.34)::INT) >= 0.28 AS chaotic, avg(v * CASE WHEN p > 0 AND m > 0 THEN 1 ELSE 0.28 END) AS eff, avg(v) AS rawv FROM q GROUP BY ALL)
SELECT symbol, n AS bar_no, stability_score, chaotic, chaos, round(eff * 1e6, 5) AS eff_var_ppm, round(rawv * 1e6, 5) AS raw_var_ppm FROM s JOIN ch USING (symbol, n)""",
)
def path_stability_and_chaos(spark, sf):
    df = path_frame(numbered(spark, sf))
    chaotic, share = ph.chaotic_disagreement(F.col("matrix"))
    eff, raw = ph.effective_variance(F.col("matrix"))
    return df.select(
        "symbol", "bar_no", ph.path_stability(F.col("ens")).alias("stability_score"), chaotic.alias("chaotic"), share.alias("chaos"),
        F.round(eff * 1e6, 5).alias("eff_var_ppm"), F.round(raw * 1e6, 5).alias("raw_var_ppm"),
    )


@query(
    "multi_day_consensus", "L18",
    f"""WITH {bars_cte()}, {MEMBER_SQL}, o AS (SELECT *, (0.4*lr + 0.3*mean3 + 0.2*mom7 - 0.05*lr) AS e, least(1, abs(lr) * 10) AS conf FROM mem),
d AS (SELECT symbol, n, CASE WHEN e > 1e-3 THEN 1 WHEN e < -1e-3 THEN -1 ELSE 0 END AS dir, conf FROM o),
j AS (SELECT a.symbol, a.n, count(b.n) AS k, count(*) FILTER (WHERE b.dir > 0) AS pos, count(*) FILTER (WHERE b.dir < 0) AS neg, count(*) FILTER (WHERE b.dir = 0) AS flat, avg(b.conf) AS c
  FROM d a LEFT JOIN d b ON b.symbol = a.symbol AND b.n BETWEEN a.n - 3 AND a.n - 1 GROUP BY ALL)
SELECT symbol, n AS bar_no, CASE WHEN k = 0 THEN 0.45 ELSE round(CASE WHEN pos = k THEN 0.92 WHEN neg = k THEN 0.28 WHEN pos >= greatest(neg, flat) AND pos >= k - 1 THEN 0.72 WHEN flat = k THEN 0.38 ELSE 0.32 END * (0.55 + 0.45 * c), 4) END AS consensus_score FROM j""",
)
def multi_day_consensus(spark, sf):
    df = one_step(member_frame(numbered(spark, sf)))
    return ph.with_consensus(df).select("symbol", "bar_no", "consensus_score")


def one_step(df, eps: float = 1e-3):
    """Weighted one-step forecast with direction and a confidence."""
    e = sum((F.col(f"p_{m}") * w for m, w in list(zip(MODELS, WEIGHTS))[1:]), F.col(f"p_{MODELS[0]}") * WEIGHTS[0])
    return df.withColumn("ens1", e).withColumns(
        {
            "direction": F.when(F.col("ens1") > eps, 1).when(F.col("ens1") < -eps, -1).otherwise(0),
            "confidence": F.least(F.lit(1.0), F.abs("lr") * 10.0),
        }
    )


TREND_CASE = lambda z: f"CASE WHEN {z} >= 2 THEN 'STRONG UP' WHEN {z} >= 0.5 THEN 'UP' WHEN {z} <= -2 THEN 'STRONG DOWN' WHEN {z} <= -0.5 THEN 'DOWN' ELSE 'NEUTRAL' END"


@query(
    "path_trend_labels", "L19 L20 L9",
    f"""WITH {bars_cte()}, {PATH_SQL}, e AS (SELECT symbol, n, vol, cum, exp(cum) AS g FROM pth WHERE step = 14),
m AS (SELECT symbol, n, close / {lagged('close', 7)} - 1 AS r7 FROM bars),
z AS (SELECT e.*, greatest(-3.5, least(3.5, 0.58 * cum / (vol * sqrt(14)) + 0.42 * cum / 14 / vol)) AS z1, greatest(-3, least(3, (g - 1) / vol * 0.65 + coalesce(r7 / 50 / vol * 0.45, 0))) AS z2 FROM e LEFT JOIN m USING (symbol, n)),
y AS (SELECT *, lag(z2) OVER (PARTITION BY symbol ORDER BY n) AS pz FROM z), x AS (SELECT *, CASE WHEN pz IS NULL THEN z2 ELSE 0.52 * pz + 0.48 * z2 END AS z3 FROM y)
SELECT symbol, n AS bar_no, round(z1, 6) AS trend_z, {TREND_CASE('z1')} AS trend_label, round(z3, 6) AS blended_z, {TREND_CASE('z3')} AS blended_label, round(abs(cum) / 0.12, 6) AS sanity_ratio, abs(cum) / 0.12 > 1.35 AS sanity_extreme FROM x""",
)
def path_trend_labels(spark, sf):
    bars = own_rows(blocked(numbered(spark, sf), back=8).withColumn("return_7d", change("close", 7)))
    df = path_frame(bars)
    z1 = ph.path_trend_score(F.col("prices"), F.col("close"), F.col("vol"))
    z2 = ph.trend_score(F.col("close"), F.element_at("prices", -1), F.col("vol"), F.col("return_7d") / SCALE)
    ratio, extreme = ph.path_sanity(F.col("prices"), F.col("close"), F.col("p99_cum"))
    df = df.select("symbol", "bar_no", z1.alias("z1"), z2.alias("z2"), ratio.alias("sanity_ratio"), extreme.alias("sanity_extreme"))
    df = own_rows(blocked(df, back=1).withColumn("z3", ph.blend_trend(F.col("z2"), lag("z2"))))
    return df.select(
        "symbol", "bar_no", F.round("z1", 6).alias("trend_z"), ph.trend_label(F.col("z1")).alias("trend_label"),
        F.round("z3", 6).alias("blended_z"), ph.trend_label(F.col("z3")).alias("blended_label"), F.round("sanity_ratio", 6).alias("sanity_ratio"), "sanity_extreme",
    )


@query(
    "horizon_snapshots", "L21",
    f"""WITH {bars_cte()}, {PATH_SQL} SELECT symbol, n AS bar_no, step::INT AS day_index, step || 'd' AS horizon, round(price / close - 1, 6) AS implied_return_vs_spot, round(agree, 6) AS agreement_score FROM pth WHERE step IN (1, 3, 7, 14)""",
)
def horizon_snapshots(spark, sf):
    s = ph.snapshots(path_frame(numbered(spark, sf)))
    return s.select("symbol", "bar_no", "day_index", "horizon", "implied_return_vs_spot", F.round("agreement_score", 6).alias("agreement_score"))


@query(
    "path_summary", "F17 L10 B9 L25",
    f"""WITH {bars_cte()}, {PATH_SQL},
mv AS (SELECT symbol, n, bool_and(v < 1e-16) AS dead FROM (SELECT symbol, n, k, var_pop(r0) AS v FROM cl GROUP BY ALL) GROUP BY ALL),
a AS (SELECT symbol, n, last(price / close ORDER BY step) AS fin, min(price / close) AS mnp, max(price / close) AS mxp, avg(price / close) AS avp, var_pop(ens) AS ve, var_pop(price / close) / (avg(price / close) * avg(price / close)) AS vp,
  max(ens) - min(ens) AS sp, avg(sat::INT) AS satf FROM pth GROUP BY ALL),
b AS (SELECT a.*, (ve < 1e-14 AND vp < 1e-16) OR dead AS const FROM a JOIN mv USING (symbol, n)),
c AS (SELECT *, NOT const AND (ve < 1e-10 OR vp < 1e-12 OR sp < 1e-9) AS quiet, (n % 40) / 100.0 > 0.32 OR (n % 3 = 0 AND (n % 40) / 100.0 > 0.12) AS degr FROM b),
d AS (SELECT *, greatest(0, least(1, CASE n % 7 WHEN 0 THEN 0.22 WHEN 1 THEN 0.48 ELSE 0.82 END - 0.12 * quiet::INT - 0.14 * degr::INT - 0.1 * (abs(ln(fin)) / 0.12 > 1.35)::INT - 0.1 * (satf > 0.35)::INT)) AS q FROM c)
SELECT symbol, n AS bar_no, round(fin, 6) AS final_price, round(mnp, 6) AS min_price, round(mxp, 6) AS max_price, round(avp, 6) AS mean_price, CASE WHEN fin > 1 THEN 'up' WHEN fin < 1 THEN 'down' ELSE 'flat' END AS outlook,
  const AS is_constant_prediction, quiet AS low_variance_warning, degr AS degraded_input, CASE WHEN const OR q < 0.25 THEN 'invalid' WHEN q < 0.55 OR quiet OR degr THEN 'questionable' ELSE 'valid' END AS forecast_validity, (CASE WHEN const THEN 0.08 ELSE round(q, 4) END)::DOUBLE AS forecast_quality_score FROM d""",
)
def path_summary(spark, sf):
    df = path_frame(numbered(spark, sf))
    rel = F.transform("prices", lambda p: p / F.col("close"))
    df = df.withColumn("rel", rel)
    summary = ph.path_summary(F.col("rel"), F.lit(1.0))
    missing, aligned = (F.col("bar_no") % 40) / 100.0, F.col("bar_no") % 3 == 0
    quality = ph.quality_signals(F.col("ens"), F.col("rel"), F.col("raw"), len(MODELS), missing, aligned)
    _, extreme = ph.path_sanity(F.col("rel"), F.lit(1.0), F.col("p99_cum"))
    df = df.withColumns({**summary, **quality, "sanity_extreme": extreme})
    k = F.col("bar_no") % 7
    df = df.withColumn("artifact_mode", F.when(k == 0, "legacy").when(k == 1, "degraded"))
    df = fill_defaults(df, {"artifact_mode": "production", "guardrail": False})
    label, q = ph.forecast_validity({c: F.col(c) for c in ("is_constant_prediction", "low_variance_warning", "degraded_input", "artifact_mode", "guardrail", "sanity_extreme", "clip_saturation")})
    return df.select(
        "symbol", "bar_no", *rounded(df, ["final_price", "min_price", "max_price", "mean_price"]), "outlook",
        "is_constant_prediction", "low_variance_warning", "degraded_input", label.alias("forecast_validity"), q.alias("forecast_quality_score"),
    )


@query(
    "smoothed_paths", "L22 L23",
    f"""WITH RECURSIVE {bars_cte('week')}, {PATH_SQL},
cp(symbol, n, step, p) AS (SELECT symbol, n, step, greatest(0.92, least(1.08, price / close)) FROM pth WHERE step = 1 UNION ALL
  SELECT c.symbol, c.n, q.step, greatest(c.p * 0.92, least(c.p * 1.08, q.price / q.close)) FROM cp c JOIN pth q ON q.symbol = c.symbol AND q.n = c.n AND q.step = c.step + 1),
sm AS (SELECT symbol, n, step, avg(p) OVER (PARTITION BY symbol, n ORDER BY step ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mid FROM cp),
h AS (SELECT s.*, q.vol, avg(q.agree) OVER (PARTITION BY s.symbol, s.n) AS ma, greatest((q.upper - q.lower) / 2 / q.close, mid * 0.004, greatest(q.vol, 1e-6) * sqrt(s.step) * (1 + least(2, q.vol / 0.02) * 0.35) * 1.25,
  1.5 * 0.01 * sqrt(s.step) * (1 + least(2, q.vol / 0.02) * 0.35), 0.005) AS hw FROM sm s JOIN pth q ON q.symbol = s.symbol AND q.n = s.n AND q.step = s.step),
k AS (SELECT *, greatest(hw * CASE WHEN ma < 0.45 THEN 1.35 WHEN ma < 0.55 THEN 1.15 ELSE 1 END, mid * 0.005) AS hh FROM h)
SELECT symbol, n AS bar_no, step::INT AS step, round(mid, 6) AS mid, round(mid - hh, 6) AS lower, round(mid + hh, 6) AS upper FROM k""",
)
def smoothed_paths(spark, sf):
    df = path_frame(numbered(spark, sf, "week"))
    rel = lambda a: F.transform(a, lambda p: p / F.col("close"))
    df = df.withColumns({"rp": rel("prices"), "rl": rel("lower"), "ru": rel("upper")})
    df = df.withColumn("mid", ph.smooth_prices(F.col("rp"), F.lit(1.0)))
    b = ph.recentred_bounds(F.col("mid"), F.col("rl"), F.col("ru"), F.lit(1.0), F.lit(0.01), F.col("vol"), amean(F.col("agree")))
    df = df.withColumn("b", b)
    out = df.select("symbol", "bar_no", F.posexplode("b").alias("s", "x")).select("symbol", "bar_no", (F.col("s") + 1).alias("step"), "x.*")
    return out.select("symbol", "bar_no", "step", *rounded(out, ["mid", "lower", "upper"]))


@query(
    "member_spreads", "L23 L8",
    f"""WITH {bars_cte('week')}, {PATH_SQL}, mp AS (SELECT symbol, n, k, step, exp(sum(r) OVER (PARTITION BY symbol, n, k ORDER BY step)) AS p FROM cl),
s AS (SELECT symbol, n, step, (max(p) - min(p)) / avg(abs(p)) AS sp FROM mp GROUP BY ALL),
a AS (SELECT symbol, n, avg(sp) AS ms, last(sp ORDER BY step) AS fs FROM s GROUP BY ALL),
b AS (SELECT symbol, n, avg(r) AS mr, stddev_pop(r) AS sd FROM cl WHERE step = 1 GROUP BY ALL)
SELECT symbol, n AS bar_no, round(ms, 6) AS mean_spread, round(fs, 6) AS final_spread, round(greatest(0, least(1, 1 - sd / abs(mr))), 6) AS model_agreement FROM a JOIN b USING (symbol, n)""",
)
def member_spreads(spark, sf):
    df = path_frame(numbered(spark, sf, "week")).withColumn("mp", ph.member_prices(F.col("matrix"), F.lit(1.0), len(MODELS)))
    return df.select(
        "symbol", "bar_no", F.round(ph.mean_relative_spread(F.col("mp")), 6).alias("mean_spread"), F.round(ph.final_relative_spread(F.col("mp")), 6).alias("final_spread"),
        F.round(ph.model_agreement(F.col("matrix")[0]), 6).alias("model_agreement"),
    )


@query(
    "blended_paths", "L24 P3",
    f"""WITH {bars_cte('week')}, {PATH_SQL}, b AS (SELECT symbol, n, step, price, lag(price) OVER (PARTITION BY symbol, step ORDER BY n) AS old, close FROM pth)
SELECT symbol, n AS bar_no, step::INT AS step, round(CASE WHEN old IS NULL THEN price ELSE 0.58 * price + 0.42 * old END / close, 6) AS rel_price FROM b""",
)
def blended_paths(spark, sf):
    df = path_frame(numbered(spark, sf, "week")).select("symbol", "bar_no", "close", "prices")
    df = own_rows(blocked(df, back=1).withColumn("b", F.coalesce(ph.blend_paths(F.col("prices"), lag("prices")), F.col("prices"))))
    out = df.withColumn("rel", F.transform("b", lambda p: F.round(p / F.col("close"), 6)))
    return _explode(out, {"rel": "rel_price"})


# --- members as predictions ------------------------------------------------------------------------


def member_predictions(bars):
    """Long (symbol, bar_no, model, y, y_pred): each member against the next log return."""
    df = own_rows(blocked(member_frame(bars), ahead=1).withColumn("y", lead("lr")))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("y_pred")) for m in MODELS]))
    return df.where(F.col("y").isNotNull()).select("symbol", "bar_no", "y", pairs.alias("p")).select("symbol", "bar_no", "y", "p.*")


PRED_SQL = f"""{MEMBER_SQL}, nx AS (SELECT *, {led('lr', 1)} AS y FROM mem),
pr AS (SELECT symbol, n, y, m.model, CASE m.k WHEN 1 THEN lr WHEN 2 THEN mean3 WHEN 3 THEN mom7 ELSE -0.5 * lr END AS p FROM nx, (VALUES (1, 'last_return'), (2, 'mean_return'), (3, 'weekly_momentum'), (4, 'reversal')) m(k, model) WHERE y IS NOT NULL),
met AS (SELECT symbol, model, count(*)::BIGINT AS n_, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2,
  coalesce(avg(CASE WHEN abs(y) > 1e-10 THEN abs((y - p) / y) END), 0) AS mape, coalesce(avg(CASE WHEN y <> 0 THEN (sign(y) = sign(p))::INT END), 0.5) AS directional_accuracy FROM pr GROUP BY ALL)"""


@query(
    "regression_metrics", "F12",
    f"WITH {bars_cte()}, {PRED_SQL} SELECT symbol, model, n_ AS n, {sql_rounded(['mae', 'rmse', 'r2', 'directional_accuracy'])}, round(mape, 4) AS mape FROM met",
)
def regression_metrics(spark, sf):
    m = mt.regression_metrics(member_predictions(numbered(spark, sf)), ["symbol", "model"])
    return m.select("symbol", "model", "n", *rounded(m, ["mae", "rmse", "r2", "directional_accuracy"]), F.round("mape", 4).alias("mape"))


@query(
    "ensemble_weights", "F15 F16",
    f"""WITH {bars_cte()}, {PRED_SQL} SELECT symbol, model, round((1 / mae) / sum(1 / mae) OVER (PARTITION BY symbol), 6) AS weight,
  round(avg(directional_accuracy) OVER (PARTITION BY symbol), 6) AS mean_directional_accuracy FROM met""",
)
def ensemble_weights(spark, sf):
    m = mt.regression_metrics(member_predictions(numbered(spark, sf)), ["symbol", "model"])
    w = mt.model_weights(m, ["symbol"]).join(mt.mean_directional_accuracy(m, ["symbol"]), "symbol")
    return w.select("symbol", "model", *rounded(w, ["weight", "mean_directional_accuracy"]))


@query(
    "weighted_predictions", "E8 K14",
    f"""WITH {bars_cte()}, {PRED_SQL}, w AS (SELECT symbol, model, (1 / mae) / sum(1 / mae) OVER (PARTITION BY symbol) AS wt FROM met)
SELECT p.symbol, p.n AS bar_no, round(sum(greatest(-0.15, least(0.15, p.p)) * wt) / sum(wt), 8) AS ensemble_log_return FROM pr p JOIN w USING (symbol, model) GROUP BY ALL""",
)
def weighted_predictions(spark, sf):
    preds = member_predictions(numbered(spark, sf))
    w = mt.model_weights(mt.regression_metrics(preds, ["symbol", "model"]), ["symbol"]).select("symbol", "model", "weight")
    r = F.greatest(F.lit(-0.15), F.least(F.lit(0.15), F.col("y_pred")))
    out = preds.join(w, ["symbol", "model"]).groupBy("symbol", "bar_no").agg((F.sum(r * F.col("weight")) / F.sum("weight")).alias("e"))
    return out.select("symbol", "bar_no", F.round("e", 8).alias("ensemble_log_return"))
