"""Queries for market context, scores, decisions, tiers, rankings and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions.arrays import amean
from tidebar.functions.prices import model_feature_view, price_decimals, round_price
from tidebar.operators import features as ft, metrics as mt, paths as ph, regimes as rg, reports as rp, signals as sg
from tidebar.operators.layout import blocked, own_rows
from tidebar.plans.features_q import DAY_SQL, day_col, full_sql
from tidebar.plans.paths_q import MODELS, PRED_SQL, member_predictions
from tidebar.plans.registry import query, rounded, sql_rounded
from tidebar.plans.tables import bars_cte, hourly, lagged, numbered, prev, roll, weekly
from tidebar.session import cut_lineage
from tidebar.sources import bars as src

# --- market context on the full features -------------------------------------------------------------


def context(spark, sf, freq="day"):
    bars = numbered(spark, sf, freq)
    return ft.full_features(bars).join(bars.select("symbol", "bar_no", "close"), ["symbol", "bar_no"])


@query(
    "market_regime", "M2 M3 M4 M5",
    full_sql()
    + f""", c0 AS (SELECT *, CASE WHEN ewma_vol_logret_14 > 0 THEN ewma_vol_logret_14 END AS posv FROM full_f),
c1 AS (SELECT *, {roll('count', 'ewma_vol_logret_14', 24, 0)} AS seen, {prev('avg', 'posv', 23, 1)} AS m23, {prev('avg', 'posv', 30, 8)} AS base30,
  {roll('count', 'adx_14', 5, 1)} AS adx_n, {roll('avg', 'adx_14', 5, 1)} AS am, {roll('stddev_pop', 'adx_14', 5, 1)} AS asd FROM c0),
c2 AS (SELECT *, CASE WHEN seen >= 8 THEN ewma_vol_logret_14 / m23 END AS vr, coalesce(trend_consistency_score, 0.5) AS tc FROM c1),
c3 AS (SELECT *, coalesce(vr >= 1.75, false) AS vo, adx_14 > 25 AND tc >= 0.48 AS tg, (adx_14 < 22 AND range_position_14d_window BETWEEN 0.25 AND 0.75) OR adx_14 < 20 AS mid_rng FROM c2)
SELECT symbol, {DAY_SQL}, CASE WHEN vo THEN 'VOLATILE' WHEN tg THEN 'TRENDING' ELSE 'RANGING' END AS market_regime,
  round((CASE WHEN vo THEN greatest(0.55, least(1, (vr - 1) / 1.2)) WHEN tg THEN greatest(0, least(1, 0.42 + 0.28 * least(1, (adx_14 - 25) / 30) + 0.3 * least(1, tc))) WHEN mid_rng THEN greatest(0, least(1, 0.85 - 0.02 * greatest(0, adx_14))) ELSE 0.52 END)::DOUBLE, 4) AS market_regime_confidence,
  CASE vol_regime_encoded WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS volatility_regime, coalesce(ewma_vol_logret_14 / base30 > 1.8, false) AS volatility_shock,
  round(CASE WHEN base30 IS NULL THEN 1 ELSE coalesce(ewma_vol_logret_14, 0) / base30 END, 4) AS volatility_shock_ratio,
  round((CASE WHEN ema_20 <= 0 OR ema_50 <= 0 THEN 0.45 ELSE 0.55 * CASE WHEN ema_20 > ema_50 THEN 1 WHEN ema_20 < ema_50 THEN 0.35 ELSE 0.55 END * CASE WHEN coalesce(return_7d > 0, false) THEN 1 ELSE 0.82 END
    + 0.45 * CASE WHEN adx_n < 3 THEN 0.5 ELSE greatest(0, least(1, 1 - least(1, asd / greatest(am, 8)))) END END)::DOUBLE, 4) AS trend_confirmation_score FROM c3""",
)
def market_regime(spark, sf):
    df = rg.with_volatility_shock(rg.with_market_regime(context(spark, sf)))
    df = rg.with_trend_confirmation(df, F.coalesce(F.col("return_7d") > 0, F.lit(False)))
    return df.withColumn("volatility_regime", rg.volatility_regime()).select(
        "symbol", day_col(), "market_regime", "market_regime_confidence", "volatility_regime", "volatility_shock", "volatility_shock_ratio", "trend_confirmation_score"
    )


# --- a signals table with every scoring input ----------------------------------------------------------
# Each input is a plain integer hash of the hourly bars, spread over its legal range, so that every
# branch of the rules below is taken and DuckDB can rebuild the table.
PRIME = 10007

INPUTS = {
    # name: (Spark, DuckDB) over u(k) = fraction in [0, 1) that depends on the bar and k
    "p_up": (lambda u: u(1) * 0.6 + 0.3, "0.3 + u1 * 0.6"),
    "p_down": (lambda u: (F.lit(0.7) - u(1) * 0.6) * u(2), "(0.7 - u1 * 0.6) * u2"),
    "p_neutral": (lambda u: (F.lit(0.7) - u(1) * 0.6) * (F.lit(1.0) - u(2)), "(0.7 - u1 * 0.6) * (1 - u2)"),
    "mean_agreement": (lambda u: u(3) * 0.65 + 0.35, "0.35 + 0.65 * u3"),
    "signal_strength_score": (lambda u: u(4) * 0.75 + 0.25, "0.25 + 0.75 * u4"),
    "move": (lambda u: u(5) * 0.16 - 0.05, "u5 * 0.16 - 0.05"),
    "band": (lambda u: u(6) * 0.08 + 0.01, "0.01 + u6 * 0.08"),
    "base_confidence": (lambda u: u(7) * 0.6 + 0.35, "0.35 + u7 * 0.6"),
    "combined_agreement": (lambda u: u(8) * 0.6 + 0.38, "0.38 + u8 * 0.6"),
    "stability_score": (lambda u: u(9) * 0.6 + 0.38, "0.38 + 0.6 * u9"),
    "consensus_score": (lambda u: u(10) * 0.6 + 0.37, "0.37 + 0.6 * u10"),
    "trend_confirmation_score": (lambda u: u(11) * 0.5 + 0.48, "0.48 + 0.5 * u11"),
    "adx_14": (lambda u: u(12) * 50.0, "u12 * 50"),
    "return_7d": (lambda u: u(13) * 0.2 - 0.08, "u13 * 0.2 - 0.08"),
    "trend_consistency_score": (lambda u: u(14), "u14"),
    "vol_expansion_score": (lambda u: u(15), "u15"),
    "ewma_vol_logret_14": (lambda u: u(16) * 0.05 + 0.002, "0.002 + u16 * 0.05"),
    "risk_reward_ratio": (lambda u: u(17) * 1.8 + 0.9, "0.9 + u17 * 1.8"),
    "agreement_trend_score": (lambda u: u(18), "u18"),
    "twitter_sentiment": (lambda u: u(19) * 2.0 - 1.0, "u19 * 2 - 1"),
    "twitter_volume": (lambda u: u(20) * 200.0, "u20 * 200"),
    "eff_var": (lambda u: u(21) * 0.001, "u21 * 0.001"),
    "raw_var": (lambda u: u(22) * 0.001, "u22 * 0.001"),
    "mean_error": (lambda u: u(23) * 0.1, "u23 * 0.1"),
    "implied_log_return": (lambda u: u(24) * 0.02 - 0.01, "u24 * 0.02 - 0.01"),
    "clip_saturation": (lambda u: u(25) * 0.7, "u25 * 0.7"),
    "recent_no_trade_fraction": (lambda u: u(26), "u26"),
    "rsi_14": (lambda u: u(27) * 100.0, "u27 * 100"),
    "macd_histogram": (lambda u: u(28) * 2.0 - 1.0, "u28 * 2 - 1"),
    "confidence_score": (lambda u: u(29) * 0.8 + 0.19, "0.19 + 0.8 * u29"),
}
PICKS = {
    "volatility_regime": (30, ["LOW", "MEDIUM", "HIGH", "MEDIUM", "LOW"]),
    "market_regime": (31, ["TRENDING", "RANGING", "VOLATILE", "TRENDING", "RANGING"]),
    "trend_label": (32, ["STRONG UP", "UP", "NEUTRAL", "DOWN", "STRONG DOWN", "UP", "STRONG UP"]),
    "agreement_trend_label": (33, ["stable", "improving", "collapsing", "mixed", "stable"]),
    "artifact_mode": (34, ["production", "degraded", "legacy", "production", "production"]),
}
FLAGS = {
    "is_constant_prediction": 41, "degraded_input": 43, "low_variance_warning": 47, "sanity_extreme": 53, "chaotic": 7, "volatility_shock": 11,
    "guardrail": 13, "cooldown_active": 17, "feature_sanity_failed": 37, "inexact": 19,
}


def signals_table(spark, sf):
    """Hourly bars with every scoring input (written once: several rules read it)."""
    bars = numbered(spark, sf, "hour")
    cents, n = F.round(F.col("close") * 100, 0).cast("bigint"), F.col("bar_no")
    bars = bars.withColumns({"_a": cents * 31 + n * 17, "_b": cents * n, "_c": (cents % 97) * (n % 89) * 13 + cents, "_d": cents * cents + n * n * 7})
    mix = lambda k: F.col("_a") + F.col("_b") * k + F.col("_c") * (k * k) + F.col("_d") % PRIME * (k * k * k)
    u = lambda k: (mix(k) % PRIME) / F.lit(float(PRIME))
    cols = {name: f(u) for name, (f, _) in INPUTS.items()}
    cols |= {name: F.element_at(F.array(*map(F.lit, v)), (F.floor(u(k) * len(v)) + 1).cast("int")) for name, (k, v) in PICKS.items()}
    cols |= {name: F.col("bar_no") % k == 0 for name, k in FLAGS.items()}
    df = bars.withColumns(cols)
    spot = F.col("close")
    df = df.withColumns(
        {
            "final_prediction": spot * (F.col("move") + 1.0),
            "lower_bound": spot * (F.col("move") + 1.0 - F.col("band")),
            "upper_bound": spot * (F.col("move") + 1.0 + F.col("band")),
            "exact_feature_match": ~F.col("inexact"),
            "vol0": F.col("ewma_vol_logret_14"), "n_steps": F.lit(14),
            "vol_regime_encoded": F.when(F.col("volatility_regime") == "LOW", 0.0).when(F.col("volatility_regime") == "MEDIUM", 1.0).otherwise(2.0),
            "trend_strength_adx": F.col("adx_14") / 100.0,
            "breakout_above_20d_high": F.when(F.col("bar_no") % 5 == 0, 1.0).otherwise(0.0), "breakout_below_20d_low": F.lit(0.0),
            "directional_confidence": sg.max_prob(), "forecast_bullish": F.col("move") > 0, "expected_move_pct": F.abs("move"),
            "risk_adjusted_confidence": F.col("base_confidence") * 0.9,
            "sentiment_alignment": F.when(F.col("twitter_sentiment") > 0.5, 1.0).otherwise(0.0),
        }
    )
    return cut_lineage(df)


def _signals_sql():
    us = ", ".join(f"(a_ + b_ * {k} + c_ * {k * k} + d_ % {PRIME} * {k**3}) % {PRIME} / {PRIME}::DOUBLE AS u{k}" for k in range(1, 35))
    seed = "SELECT *, x * 31 + n * 17 AS a_, x * n AS b_, (x % 97) * (n % 89) * 13 + x AS c_, x * x + n * n * 7 AS d_ FROM (SELECT *, round(close * 100)::BIGINT AS x FROM bars)"
    ins = ", ".join(f"({sql})::DOUBLE AS {name}" for name, (_, sql) in INPUTS.items())
    pk = ", ".join(f"([{', '.join(repr(x) for x in v)}])[(floor(u{k} * {len(v)}) + 1)::INT] AS {name}" for name, (k, v) in PICKS.items())
    fl = ", ".join(f"n % {k} = 0 AS {name}" for name, k in FLAGS.items())
    return f"""WITH {bars_cte('hour')}, us AS (SELECT *, {us} FROM ({seed})), i0 AS (SELECT symbol, bar_ts, n, close, {ins}, {pk}, {fl} FROM us),
sg AS (SELECT *, close * (1 + move) AS final_prediction, greatest(p_up, p_down, p_neutral) AS pm, least(1, greatest(0, 1 - greatest(p_up, p_down, p_neutral) + 0.35 * p_neutral)) AS unc,
  CASE volatility_regime WHEN 'LOW' THEN 0.0 WHEN 'MEDIUM' THEN 1.0 ELSE 2.0 END AS code, CASE WHEN n % 5 = 0 THEN 1.0 ELSE 0.0 END AS brk FROM i0)"""


SIGNALS_SQL = _signals_sql()
B01 = lambda x: f"greatest(0, least(1, {x}))"


@query(
    "signal_strength", "M6 M7 M24 J9",
    SIGNALS_SQL
    + f""", s AS (SELECT *, {B01(f"0.4 * least(1, abs(move) / (ewma_vol_logret_14 * sqrt(14)) / 2.2) + 0.3 * least(1, pow(adx_14 / 45, 0.9)) + 0.22 * least(1, abs(return_7d) / 0.06) + 0.05 * trend_consistency_score + 0.03 * 0.5 * brk")} AS st FROM sg)
SELECT symbol, n AS bar_no, round(st, 6) AS strength, round({B01("st + CASE WHEN twitter_volume >= 5 THEN least(0.07, 0.055 * least(1, abs(twitter_sentiment)) * least(1, twitter_volume / 120)) ELSE 0 END")}, 6) AS bumped,
  round(unc, 6) AS uncertainty, round((0.35 * (confidence_score + 1.3e-6) + 0.3 * combined_agreement + 0.2 * least(1, abs(move) / 0.08) + 0.15 * signal_strength_score)::DOUBLE, 4) AS market_score FROM s""",
)
def signal_strength(spark, sf):
    df = signals_table(spark, sf)
    st = sg.signal_strength(F.col("close"), F.col("final_prediction"))
    df = df.withColumn("st", st)
    return df.select(
        "symbol", "bar_no", F.round("st", 6).alias("strength"),
        F.round(sg.with_sentiment_bump(F.col("st"), F.col("twitter_sentiment"), F.col("twitter_volume")), 6).alias("bumped"),
        F.round(sg.classifier_uncertainty(), 6).alias("uncertainty"),
        # inputs have three decimals: shift them off the exact rounding ties
        sg.market_score(F.col("confidence_score") + 1.3e-6, F.col("combined_agreement"), F.col("expected_move_pct"), F.col("signal_strength_score")).alias("market_score"),
    )


@query(
    "financial_confidence", "M8",
    SIGNALS_SQL
    + f""", a AS (SELECT *, CASE WHEN raw_var >= 1e-9 THEN 0.22 ELSE 0.18 END AS w, mean_agreement AS ag, signal_strength_score AS ss, implied_log_return AS r, trend_consistency_score AS tc FROM sg),
b AS (SELECT *, ((CASE WHEN raw_var < 1e-8 THEN 0.35 ELSE 1 / (1 + eff_var / 0.00025) END + 1 / (1 + mean_error / 0.05) + 1 / (1 + ewma_vol_logret_14 / 0.04)) * 0.26 + w * ag) / (0.78 + w)
  * CASE WHEN ag < 0.5 THEN 0.58 + 0.42 * ag / 0.5 ELSE 1 END * CASE WHEN unc >= 0.55 THEN 0.88 + 0.12 * greatest(0, (1 - unc) / 0.45) ELSE 1 END AS c FROM a),
c1 AS (SELECT *, CASE WHEN ss >= 0.5 AND ag >= 0.68 AND unc <= 0.48 THEN least(1, c * (1 + 0.04 * (ss - 0.5) / 0.5)) ELSE c END AS c1 FROM b),
c2 AS (SELECT *, CASE WHEN ss >= 0.55 AND ag >= 0.74 AND unc <= 0.42 AND code <= 1.25 THEN least(1, c1 * 1.025) ELSE c1 END AS c2 FROM c1),
c3 AS (SELECT *, CASE WHEN (r > 0.0018 AND p_up >= 0.4 AND p_up >= p_down AND ag >= 0.58) OR (r < -0.0018 AND p_down >= 0.4 AND p_down >= p_up AND ag >= 0.58) THEN least(1, c2 * 1.022)
  WHEN p_neutral > 0.52 OR pm < 0.36 THEN c2 * 0.9 WHEN (r > 0.0025 AND p_down > p_up + 0.1) OR (r < -0.0025 AND p_up > p_down + 0.1) THEN c2 * 0.88 ELSE c2 END * CASE WHEN code >= 1.85 THEN 0.86 ELSE 1 END AS c3 FROM c2),
c4 AS (SELECT *, CASE WHEN tc >= 0.6 THEN least(1, c3 * (1 + 0.072 * (tc - 0.6) / 0.4)) WHEN tc < 0.36 THEN c3 * 0.91 ELSE c3 END * CASE WHEN chaotic THEN 0.88 ELSE 1 END AS c4,
  twitter_volume >= 5 AND abs(r) >= 0.0015 AND abs(twitter_sentiment) >= 0.06 AS op FROM c3),
c5 AS (SELECT *, CASE WHEN op AND ((r > 0 AND twitter_sentiment > 0.04) OR (r < 0 AND twitter_sentiment < -0.04)) THEN 1.0 WHEN op AND ((r > 0 AND twitter_sentiment < -0.07) OR (r < 0 AND twitter_sentiment > 0.07)) THEN -1.0 ELSE 0.0 END AS al FROM c4),
c6 AS (SELECT *, CASE WHEN al > 0 THEN least(1, c4 * (1 + least(0.045, 0.03 * least(1, twitter_volume / 120) * abs(twitter_sentiment)))) WHEN al < 0 THEN c4 * (1 - least(0.055, 0.042 * least(1, twitter_volume / 120) * abs(twitter_sentiment))) ELSE c4 END AS c6 FROM c5)
SELECT symbol, n AS bar_no, al::DOUBLE AS sentiment_alignment, twitter_volume >= 5 AS sentiment_used, round(c6 * CASE artifact_mode WHEN 'legacy' THEN 0.52 * 0.48 * 0.68 WHEN 'degraded' THEN 0.52 * 0.88 * 0.68 ELSE 1 END
  * CASE WHEN inexact THEN 0.72 ELSE 1 END * CASE WHEN guardrail THEN 0.78 ELSE 1 END * CASE WHEN clip_saturation > 0.35 THEN 0.62 ELSE 1 END, 6) AS financial_confidence FROM c6""",
)
def financial_confidence(spark, sf):
    df = sg.with_financial_confidence(signals_table(spark, sf).drop("sentiment_alignment"))
    return df.select("symbol", "bar_no", "sentiment_alignment", "sentiment_used", F.round("financial_confidence", 6).alias("financial_confidence"))


@query(
    "confidence_stack", "M9 M10 M11 M12 M13 M14",
    SIGNALS_SQL
    + f""", a AS (SELECT *, 0.4 * pm + 0.3 * combined_agreement + 0.3 * signal_strength_score AS hy FROM sg),
b AS (SELECT *, least(hy, CASE WHEN sanity_extreme THEN 0.35 ELSE 1 END, CASE WHEN is_constant_prediction THEN 0.12 WHEN low_variance_warning THEN 0.32 ELSE 1 END, CASE WHEN degraded_input THEN 0.38 ELSE 1 END) AS cp FROM a),
c AS (SELECT *, cp * CASE volatility_regime WHEN 'HIGH' THEN 0.94 ELSE 1 END AS base, cp * CASE WHEN mean_agreement < 0.5 THEN 0.62 + 0.38 * mean_agreement / 0.5 ELSE 1 END AS f0 FROM b),
d AS (SELECT *, CASE WHEN mean_agreement < 0.42 AND unc >= 0.48 THEN least(f0, 0.49) WHEN mean_agreement < 0.5 AND unc >= 0.55 THEN least(f0, 0.52) ELSE f0 END * CASE volatility_regime WHEN 'HIGH' THEN 0.9 ELSE 1 END AS full_,
  CASE WHEN chaotic THEN 0.5 ELSE 1 END AS k1, CASE WHEN volatility_regime = 'HIGH' OR volatility_shock THEN 0.6 ELSE 1 END AS k2, CASE WHEN chaotic THEN 0.58 ELSE 1 END AS k3, CASE WHEN volatility_regime = 'HIGH' OR volatility_shock THEN 0.72 ELSE 1 END AS k4 FROM c),
e AS (SELECT *, round(least({B01("base * (0.48 + 0.52 * mean_agreement) * stability_score * consensus_score * trend_confirmation_score * CASE market_regime WHEN 'VOLATILE' THEN 0.75 WHEN 'TRENDING' THEN 1.05 ELSE 0.96 END")}, k1, k2), 4) AS ra,
  round(least({B01("base * CASE market_regime WHEN 'VOLATILE' THEN 0.94 WHEN 'TRENDING' THEN 1.02 ELSE 0.98 END")}, k3, k4), 4) AS li FROM d)
SELECT symbol, n AS bar_no, round(base, 6) AS base, round(full_, 6) AS finalized, ra::DOUBLE AS risk_adjusted, li::DOUBLE AS light_adjusted, round(0.6 * base + 0.4 * li, 6) AS decision_confidence,
  round(0.2 + 0.65 * {B01("0.42 * mean_agreement + 0.28 * greatest(0, 1 - least(1, ewma_vol_logret_14 / 0.035)) + 0.2 * greatest(0, 1 - least(1, band / 0.14)) + 0.1 * greatest(0.35, least(0.75, u_acc))")}, 6) AS realistic FROM (SELECT *, base_confidence AS u_acc FROM e)""",
)
def confidence_stack(spark, sf):
    df = signals_table(spark, sf)
    hybrid = sg.hybrid_confidence(F.col("directional_confidence"), F.col("combined_agreement"), F.col("signal_strength_score"))
    df = df.withColumn("cap", sg.capped(hybrid))
    df = df.withColumns(
        {"base": sg.finalized_hybrid(F.col("cap"), F.col("volatility_regime")), "finalized": sg.finalized(F.col("cap"), F.col("mean_agreement"), F.col("volatility_regime"))}
    )
    df = df.withColumns({"risk_adjusted": sg.risk_adjusted(F.col("base")), "light_adjusted": sg.light_risk_adjusted(F.col("base"))})
    df = df.withColumns(
        {
            "decision_confidence": sg.decision_confidence(F.col("base"), F.col("light_adjusted")),
            "realistic": sg.realistic_confidence(F.col("mean_agreement"), F.col("band"), F.col("ewma_vol_logret_14"), F.col("base_confidence")),
        }
    )
    return df.select("symbol", "bar_no", *rounded(df, ["base", "finalized"]), "risk_adjusted", "light_adjusted", *rounded(df, ["decision_confidence", "realistic"]))


DECISION_SQL = f""", e0 AS (SELECT *, abs(final_prediction - close) / close AS em, least(1, abs(final_prediction - close) / close / 0.08) AS emp, pm * CASE WHEN pm < 0.38 THEN 0.84 ELSE 1 END AS clf, {B01("pow(adx_14 / 55, 0.88)")} AS ax,
  least(1, abs(return_7d) / 0.06) AS ms, trend_consistency_score AS tc, signal_strength_score AS ss, volatility_regime AS v, recent_no_trade_fraction AS nt FROM sg),
e1 AS (SELECT *, {B01("0.26 * emp + 0.24 * ss + 0.2 * clf + 0.14 * ax + 0.1 * tc + 0.06 * ms")} * CASE WHEN emp > 0.55 AND vol_expansion_score > 0.62 AND tc < 0.4 AND ss < 0.38 THEN 0.86 ELSE 1 END AS x FROM e0),
e2 AS (SELECT *, least(1, x * (0.76 + 0.24 * (0.52 * tc + 0.48 * greatest(ss, ms)))) AS x2, (final_prediction - close) / close AS mv FROM e1),
e3 AS (SELECT *, CASE WHEN abs(mv) > 2e-5 AND abs(return_7d) > 2e-5 THEN CASE WHEN (mv > 0) = (return_7d > 0) THEN least(1, x2 * 1.05) ELSE x2 * 0.9 END ELSE x2 END AS edge, abs(final_prediction - close) / greatest(2 * close * band, close * 1e-8) AS rr,
  greatest(0.86, least(1.12, CASE v WHEN 'HIGH' THEN 1.05 WHEN 'LOW' THEN 0.94 ELSE 1 END * CASE WHEN tc >= 0.66 THEN 0.93 WHEN tc >= 0.52 THEN 0.97 ELSE 1 END * CASE WHEN nt > 0.82 AND tc >= 0.58 THEN 0.97 ELSE 1 END)) AS sc,
  CASE WHEN mv > 0.00015 THEN 1 WHEN mv < -0.00015 THEN -1 ELSE 0 END AS ps, CASE WHEN trend_label LIKE '%UP' THEN 1 WHEN trend_label LIKE '%DOWN' THEN -1 ELSE 0 END AS ts FROM e2),
e4 AS (SELECT *, (ps > 0 AND p_up >= p_down + 0.06) OR (ps < 0 AND p_down >= p_up + 0.06) AS ca, sc * CASE v WHEN 'HIGH' THEN 0.38 ELSE 0.28 END AS rrn, sc * CASE v WHEN 'HIGH' THEN 0.45 + 0.07 ELSE 0.45 END AS edn FROM e3),
e5 AS (SELECT *, ps <> 0 AND ps = ts AND ca AS al FROM e4),
e6 AS (SELECT *, concat_ws('|', CASE WHEN is_constant_prediction THEN 'flat ensemble path' END, CASE WHEN degraded_input THEN 'incomplete features' END, CASE WHEN low_variance_warning THEN 'path varies too little' END,
  CASE WHEN em < 0.02 THEN 'expected move too small for an edge' END, CASE WHEN base_confidence < 0.46 * sc THEN 'confidence below floor' END, CASE WHEN mean_agreement < 0.58 * sc THEN 'model agreement below floor' END,
  CASE WHEN ss < 0.36 * sc THEN 'signal strength below floor' END, CASE WHEN edge < edn THEN 'edge score below floor' END, CASE WHEN rr * CASE v WHEN 'HIGH' THEN 0.82 ELSE 1 END < rrn THEN 'reward too low for the risk' END,
  CASE WHEN ps = 0 THEN 'forecast flat against spot' END, CASE WHEN ts = 0 THEN 'trend is neutral' END, CASE WHEN NOT al THEN 'trend, path and classifier not aligned' END) AS why FROM e5),
e7 AS (SELECT *, CASE WHEN why = '' AND ps > 0 THEN 'BUY' WHEN why = '' AND ps < 0 THEN 'SELL' ELSE 'NO_TRADE' END AS tsig FROM e6),
e8 AS (SELECT *, base_confidence * (0.8 + 0.2 * greatest(0.38, least(1, 0.18 * edge + 0.18 * mean_agreement + 0.16 * {B01("rr / greatest(rrn * 2.2, 0.12)")} + 0.13 * CASE v WHEN 'HIGH' THEN 0.72 WHEN 'MEDIUM' THEN 0.88 ELSE 1 END + 0.13 * CASE WHEN al THEN 1 ELSE 0.62 END
  + 0.09 * CASE WHEN tsig <> 'NO_TRADE' THEN 1 ELSE 0.68 END + 0.04 * CASE WHEN em < 0.02 THEN 0.55 WHEN em < 0.05 THEN 0.82 ELSE 1 END + 0.09 * tc))) AS conf FROM e7),
dec AS (SELECT *, v IN ('LOW', 'MEDIUM') AND conf >= 0.56 AND mean_agreement >= 0.72 AND ss >= 0.46 AND al AND ca AS hc FROM e8)"""


@query(
    "decision_bundle", "M15 M16 M17 M18 M19 M20 M21 J6 J7 J8",
    SIGNALS_SQL + DECISION_SQL
    + """ SELECT symbol, n AS bar_no, tsig AS trade_signal, round(edge, 6) AS edge_score, round(em, 6) AS expected_move_pct, CASE WHEN em < 0.02 THEN 'WEAK' WHEN em < 0.05 THEN 'MODERATE' ELSE 'STRONG' END AS expected_move_strength,
  round(rr, 6) AS risk_reward_ratio, round(sc, 6)::DOUBLE AS decision_threshold_scale, al AS directional_alignment, why AS reasons, round(conf, 6) AS confidence_after_decision, hc AS high_conviction,
  trend_label <> 'NEUTRAL' AND adx_14 >= 28 AND abs(return_7d) >= 0.018 AND mean_agreement >= 0.7 AND ss >= 0.4 AND ((mv > 0.004 AND return_7d > 0.006 AND p_up >= p_down + 0.04) OR (mv < -0.004 AND return_7d < -0.006 AND p_down >= p_up + 0.04)) AS high_conviction_setup FROM dec""",
)
def decision_bundle(spark, sf):
    df = sg.with_decision(signals_table(spark, sf))
    setup = sg.high_conviction_setup((F.col("final_prediction") - F.col("close")) / F.col("close"), F.col("trend_label"))
    return df.select(
        "symbol", "bar_no", "trade_signal", *rounded(df, ["edge_score", "expected_move_pct"]), "expected_move_strength", *rounded(df, ["risk_reward_ratio", "decision_threshold_scale"]),
        "directional_alignment", F.concat_ws("|", "rejection_reasons").alias("reasons"), F.round("confidence_after_decision", 6).alias("confidence_after_decision"), "high_conviction", setup.alias("high_conviction_setup"),
    )


@query(
    "no_trade_share", "P2 M15",
    SIGNALS_SQL + DECISION_SQL + f""", q AS (SELECT *, (tsig = 'NO_TRADE')::INT::DOUBLE AS idle FROM dec)
SELECT symbol, n AS bar_no, round(coalesce({prev('avg', 'idle', 96, 10)}, 0), 6) AS recent_no_trade_fraction FROM q""",
)
def no_trade_share(spark, sf):
    df = sg.with_decision(signals_table(spark, sf)).drop("recent_no_trade_fraction")
    return sg.with_idle_share(df).select("symbol", "bar_no", F.round("recent_no_trade_fraction", 6).alias("recent_no_trade_fraction"))


TIER_SQL = f""", t0 AS (SELECT *, confidence_score AS cf, combined_agreement AS ag, pm AS dc, signal_strength_score AS s, abs(move) AS em, risk_reward_ratio AS rw, market_regime AS rg, volatility_regime AS v, agreement_trend_label AS lb, agreement_trend_score AS ats,
  move > 0 AND trend_label NOT LIKE '%DOWN' AS bull, twitter_sentiment > 0.5 AS sal FROM sg),
t1 AS (SELECT *, CASE v WHEN 'LOW' THEN 0.42 WHEN 'HIGH' THEN 0.58 ELSE 0.48 END AS th0, ag > 0.6 AND cf > 0.4 AS rel, lb IN ('stable', 'improving') AND ats >= 0.55 AS held, round(cf * ag * s, 6) AS b FROM t0),
t2 AS (SELECT *, CASE WHEN rel THEN greatest(0.36, th0 - 0.05) ELSE th0 END AS th FROM t1),
t3 AS (SELECT *, CASE WHEN cooldown_active THEN 1 WHEN feature_sanity_failed THEN 2 WHEN cf < 0.22 THEN 3 WHEN ag < 0.4 THEN 4 WHEN dc <= th THEN 5 WHEN em <= 0.015 THEN 6 ELSE 0 END AS g,
  b * CASE rg WHEN 'VOLATILE' THEN 0.7 ELSE 1 END * CASE v WHEN 'HIGH' THEN 0.88 ELSE 1 END * CASE WHEN pm < 0.42 OR abs(p_up - p_down) < 0.06 THEN 0.9 ELSE 1 END AS b1 FROM t2),
t4 AS (SELECT *, CASE WHEN held THEN least(1, b1 * 1.05) WHEN lb = 'collapsing' THEN b1 * 0.9 ELSE b1 END AS b2 FROM t3),
t5 AS (SELECT *, CASE WHEN sal AND move > 0 AND p_up >= 0.45 THEN least(1, b2 * 1.06) ELSE b2 END AS b3 FROM t4), t6 AS (SELECT *, CASE WHEN adx_14 > 25 THEN least(1, b3 * 1.04) ELSE b3 END AS b4 FROM t5),
t7 AS (SELECT *, round(CASE WHEN g = 2 THEN b * 0.85 WHEN g > 0 THEN b ELSE b4 END, 6) AS score, cf >= 0.72 AND ag >= 0.78 AND s >= 0.58 AND p_up >= 0.62 AND stability_score >= 0.55 AND consensus_score >= 0.55 AS ext,
  cf >= 0.55 AND ag >= CASE rg WHEN 'TRENDING' THEN 0.58 ELSE 0.62 END AND s >= 0.5 AND p_up >= 0.6 AND em >= 0.03 AND rw >= 1.5 AND bull AS num,
  consensus_score >= CASE rg WHEN 'TRENDING' THEN 0.64 ELSE 0.70 END AND stability_score >= CASE rg WHEN 'TRENDING' THEN 0.54 ELSE 0.58 END AND trend_confirmation_score >= CASE rg WHEN 'TRENDING' THEN 0.52 ELSE 0.56 END AND NOT volatility_shock AND lb <> 'collapsing' AS lay,
  cf >= 0.45 AND ag >= 0.5 AND em >= 0.015 AND bull AND p_up >= p_down AND stability_score >= 0.4 AND consensus_score >= 0.38 AND lb <> 'collapsing' AND CASE rg WHEN 'RANGING' THEN cf >= 0.48 AND ag >= 0.55 AND stability_score >= 0.48 AND consensus_score >= 0.45 AND em >= 0.018
    WHEN 'VOLATILE' THEN em >= 0.025 AND rw >= 1.25 AND stability_score >= 0.5 ELSE true END AS wk,
  cf > 0.3 AND ag > 0.45 AND em > 0.025 AND NOT volatility_shock AND bull AND dc > th AND p_up >= p_down AND s >= 0.3 AND rw >= CASE v WHEN 'HIGH' THEN 1.15 ELSE 1.05 END AND lb <> 'collapsing' AS pb FROM t6),
tier AS (SELECT *, CASE WHEN g > 0 OR (rg = 'VOLATILE' AND NOT ext) THEN 'NO_TRADE' WHEN rg = 'TRENDING' AND num AND lay THEN 'STRONG_BUY' WHEN wk THEN 'WEAK_BUY' WHEN pb THEN 'PROBING_BUY' ELSE 'NO_TRADE' END AS td FROM t7)"""


@query(
    "trade_tiers", "M22",
    SIGNALS_SQL + TIER_SQL
    + """ SELECT symbol, n AS bar_no, td AS trade_decision, round(score + 3.5e-6, 4)::DOUBLE AS score, dc <= th AS b_directional, cf <= 0.3 AS b_confidence, ag <= 0.45 AS b_agreement, em <= 0.025 OR rw < 1.05 AS b_risk_reward,
  CASE g WHEN 1 THEN 'Signal cooldown running' WHEN 2 THEN 'Feature sanity failed' WHEN 3 THEN 'Hard floor: confidence' WHEN 4 THEN 'Hard floor: agreement' WHEN 5 THEN 'Direction gate: confidence below threshold' WHEN 6 THEN 'Move gate: horizon move too small'
    ELSE concat_ws('|', CASE td WHEN 'STRONG_BUY' THEN 'Strong long' WHEN 'WEAK_BUY' THEN 'Weak long: quality bars met' WHEN 'PROBING_BUY' THEN 'Probing long: small entry' END,
      CASE WHEN rg = 'VOLATILE' THEN 'Regime volatile: edge scaled' END, CASE WHEN v = 'HIGH' THEN 'High volatility regime' END, CASE WHEN pm < 0.42 OR abs(p_up - p_down) < 0.06 THEN 'Classifier uncertain' END, CASE WHEN held THEN 'Agreement held along the path' END,
      CASE WHEN NOT held AND lb = 'collapsing' THEN 'Agreement fell along the path' END, CASE WHEN sal AND move > 0 AND p_up >= 0.45 THEN 'Sentiment supports a long' END, CASE WHEN adx_14 > 25 THEN 'Strong trend by ADX' END,
      CASE WHEN rg = 'VOLATILE' AND NOT ext THEN 'Regime volatile: needs extreme confidence' ELSE nullif(concat_ws('|', CASE WHEN rg = 'RANGING' AND num AND lay THEN 'Regime ranging blocks a strong long' END,
        CASE WHEN num AND NOT lay THEN CASE WHEN volatility_shock THEN 'Not strong: volatility shock' WHEN consensus_score < CASE rg WHEN 'TRENDING' THEN 0.64 ELSE 0.70 END THEN 'Not strong: consensus'
          WHEN stability_score < CASE rg WHEN 'TRENDING' THEN 0.54 ELSE 0.58 END THEN 'Not strong: path stability' WHEN trend_confirmation_score < CASE rg WHEN 'TRENDING' THEN 0.52 ELSE 0.56 END THEN 'Not strong: trend confirmation' END END,
        CASE WHEN td = 'STRONG_BUY' THEN 'Regime trending: bars relaxed' WHEN td = 'WEAK_BUY' AND rg = 'RANGING' THEN 'Regime ranging: tight bars' WHEN td = 'WEAK_BUY' AND rg = 'VOLATILE' THEN 'Regime volatile: extreme confidence' WHEN td = 'NO_TRADE' THEN 'No tier reached' END), '') END) END AS reasons,
  concat_ws('|', CASE WHEN ag > 0.65 THEN 'members side together' END, CASE WHEN held THEN 'agreement holds over the path' END, CASE WHEN lb = 'collapsing' THEN 'agreement falls apart' END, CASE WHEN dc > th THEN 'one direction stands out' ELSE 'no direction stands out' END,
    CASE WHEN volatility_shock OR v = 'HIGH' THEN 'large swings' END, CASE WHEN em >= 0.025 THEN 'move actionable' END, CASE WHEN base_confidence > base_confidence * 0.9 + 0.06 AND ((ag > 0.65)::INT + held::INT + (lb = 'collapsing')::INT + 1 + (volatility_shock OR v = 'HIGH')::INT + (em >= 0.025)::INT) < 6 THEN 'risk lowers confidence' END) AS drivers FROM tier""",
)
def trade_tiers(spark, sf):
    df = sg.with_trade_tier(signals_table(spark, sf))
    b = F.col("decision_blockers")
    return df.select(
        # a six-decimal score times 0.7 is often an exact tie of the next rounding: compare four places, off the tie
        "symbol", "bar_no", "trade_decision", F.round(F.col("score") + 3.5e-6, 4).alias("score"), *[b[k].alias(f"b_{k}") for k in ("directional", "confidence", "agreement", "risk_reward")],
        F.concat_ws("|", "trade_reasons").alias("reasons"), F.concat_ws("|", "key_drivers").alias("drivers"),
    )


@query(
    "explanations", "M25",
    SIGNALS_SQL
    + """, o AS (SELECT *, list_filter([CASE WHEN rsi_14 < 30 THEN 'RSI is oversold' END, CASE WHEN rsi_14 > 70 THEN 'RSI is stretched' END, CASE WHEN return_7d > 0.02 THEN 'weekly momentum is positive' END, CASE WHEN return_7d < -0.02 THEN 'weekly momentum is negative' END,
  CASE WHEN macd_histogram > 0 THEN 'MACD is building' END, CASE WHEN macd_histogram < 0 THEN 'MACD is fading' END], lambda x: x IS NOT NULL) AS ob FROM sg),
p AS (SELECT *, CASE WHEN len(ob) = 0 THEN ['indicators are mixed'] ELSE ob END || list_filter(['weights lean on gradient trees 50%, forest 30%', CASE WHEN mean_agreement < 0.55 THEN 'models disagree' WHEN mean_agreement > 0.8 THEN 'models agree' END,
  'classifier leans ' || CASE WHEN p_up >= greatest(p_down, p_neutral) THEN 'up' WHEN p_down = pm THEN 'down' ELSE 'neutral' END, CASE WHEN ln(final_prediction / close) > 0.002 AND p_down - p_up > 0.08 THEN 'classifier contradicts the rising path' WHEN ln(final_prediction / close) < -0.002 AND p_up - p_down > 0.08 THEN 'classifier contradicts the falling path' END,
  CASE WHEN confidence_score >= 0.58 THEN 'confidence is fairly strong' WHEN confidence_score <= 0.32 THEN 'confidence is limited' END], lambda x: x IS NOT NULL) AS parts FROM o)
SELECT symbol, n AS bar_no, 'Trend: ' || CASE trend_label WHEN 'STRONG UP' THEN 'strongly upward' WHEN 'UP' THEN 'mildly upward' WHEN 'SIDEWAYS' THEN 'range-bound' WHEN 'NEUTRAL' THEN 'range-bound' WHEN 'DOWN' THEN 'mildly downward' WHEN 'STRONG DOWN' THEN 'strongly downward' ELSE 'neutral' END || '. ' || array_to_string(parts[1:5], '; ') || '.' AS explanation FROM p""",
)
def explanations(spark, sf):
    w = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(x).alias("weight")) for m, x in (("forest", 0.3), ("gradient_trees", 0.5), ("linear", 0.2))])
    df = signals_table(spark, sf)
    return df.select("symbol", "bar_no", sg.explanation(w, F.col("mean_agreement"), F.col("confidence_score"), F.col("trend_label"), F.log(F.col("final_prediction") / F.col("close"))).alias("explanation"))


@query(
    "head_merging", "K9 K10 K15",
    SIGNALS_SQL
    + """ SELECT symbol, n AS bar_no, round(CASE WHEN n % 4 = 0 THEN CASE WHEN n % 8 = 0 THEN 0.33 ELSE p_up END ELSE (p_up + 1.0 / 3) / 2 END, 6) AS up, round(CASE WHEN n % 4 = 0 THEN CASE WHEN n % 8 = 0 THEN 0.34 ELSE p_down END ELSE (p_down + 1.0 / 3) / 2 END, 6) AS down,
  round(CASE WHEN n % 4 = 0 THEN 1 ELSE greatest(0, least(1, 1 - 0.5 * (abs(p_up - 1.0/3) + abs(p_down - 1.0/3) + abs(p_neutral - 1.0/3)))) END, 6)::DOUBLE AS agreement FROM sg""",
)
def head_merging(spark, sf):
    third = F.lit(1.0 / 3)
    df = signals_table(spark, sf)
    a = F.when(F.col("bar_no") % 8 != 0, F.struct(F.col("p_down").alias("down"), F.col("p_neutral").alias("neutral"), F.col("p_up").alias("up")))
    b = F.when(F.col("bar_no") % 4 != 0, F.struct(third.alias("down"), third.alias("neutral"), third.alias("up")))
    df = df.select("symbol", "bar_no", a.alias("a"), b.alias("b"))
    m = sg.merged_probs("a", "b")
    return df.select("symbol", "bar_no", F.round(m["p_up"], 6).alias("up"), F.round(m["p_down"], 6).alias("down"), F.round(sg.distribution_agreement("a", "b"), 6).alias("agreement"))


# --- rankings ------------------------------------------------------------------------------------------


def scanner_input(spark, sf):
    df = sg.with_trade_tier(signals_table(spark, sf))
    ms = sg.market_score(F.col("confidence_score"), F.col("combined_agreement"), F.col("expected_move_pct"), F.col("signal_strength_score"))
    return src.latest_rows(df.select("symbol", "bar_ts", ms.alias("market_score"), "confidence_score", "expected_move_pct", "trade_decision", "p_up", "p_down", "p_neutral"))


LATEST_SQL = SIGNALS_SQL + TIER_SQL + """, lt AS (SELECT *, round((0.35 * cf + 0.3 * ag + 0.2 * least(1, em / 0.08) + 0.15 * s)::DOUBLE, 4) AS ms FROM tier QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC) = 1)"""


@query(
    "market_scanner", "H2 H3 H7",
    LATEST_SQL
    + """, r AS (SELECT *, row_number() OVER (ORDER BY ms DESC, cf DESC, symbol) AS rk FROM lt)
SELECT symbol, ms AS market_score, round(cf, 6) AS confidence_score, CASE WHEN rk <= 3 THEN rk::INT END AS top_opportunity_rank, cf = max(cf) OVER () AS is_max_confidence, em = max(em) OVER () AS is_max_move,
  CASE td WHEN 'STRONG_BUY' THEN 0 WHEN 'WEAK_BUY' THEN 1 ELSE 2 END::INT AS decision_priority,
  CASE WHEN p_up >= p_down AND p_up >= p_neutral THEN 'UP' WHEN p_down >= p_up AND p_down >= p_neutral THEN 'DOWN' ELSE 'NEUTRAL' END AS direction FROM r""",
)
def market_scanner(spark, sf):
    rows = rp.with_leader_flags(rp.scanner_rows(cut_lineage(scanner_input(spark, sf))))
    return rows.orderBy(*rp.display_order()).select(
        "symbol", "market_score", F.round("confidence_score", 6).alias("confidence_score"), "top_opportunity_rank", "is_max_confidence", "is_max_move",
        rp.decision_priority(F.col("trade_decision")).alias("decision_priority"), rp.direction_text(F.col("p_up"), F.col("p_down"), F.col("p_neutral")).alias("direction"),
    )


@query(
    "chart_tail", "H4 J5",
    f"""WITH {bars_cte('hour')}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC) AS k, last_value(close / 1e5) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ref FROM bars)
SELECT symbol, bar_ts, round(close / 1e5, greatest(6, least(14, ceil(-log10(ref))::INT + 5))) AS close, greatest(6, least(14, ceil(-log10(ref))::INT + 5))::INT AS decimals FROM t WHERE k <= 90""",
)
def chart_tail(spark, sf):
    small = hourly(spark, sf).withColumn("close", F.col("close") / 1e5)
    newest = small.groupBy("symbol").agg(F.max_by("close", "bar_ts").alias("ref"))
    return rp.chart(small, 90).join(newest, "symbol").select("symbol", "bar_ts", "close", price_decimals(F.col("ref")).alias("decimals"))


@query(
    "best_model", "H5 K13",
    f"""WITH {bars_cte()}, {PRED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mae, model) AS k FROM met)
SELECT symbol, CASE model WHEN 'last_return' THEN 'Last Return' WHEN 'mean_return' THEN 'Mean Return' WHEN 'weekly_momentum' THEN 'Weekly Momentum' ELSE 'Reversal' END AS best_model, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape * 100, 2) AS mape, round(directional_accuracy * 100, 2) AS directional_accuracy FROM r WHERE k = 1""",
)
def best_model(spark, sf):
    return rp.best_model(mt.regression_metrics(member_predictions(numbered(spark, sf)), ["symbol", "model"]))


@query(
    "default_date_range", "F21",
    f"WITH {bars_cte()} SELECT symbol, min(bar_ts)::DATE AS first_bar, max(bar_ts)::DATE AS last_bar FROM bars GROUP BY 1",
)
def default_date_range(spark, sf):
    from tidebar.plans.tables import daily

    return src.date_ranges(daily(spark, sf)).select("symbol", F.to_date("first_bar").alias("first_bar"), F.to_date("last_bar").alias("last_bar"))


@query(
    "data_freshness", "J11 P4",
    f"""WITH {bars_cte('hour')}, m AS (SELECT symbol, max(bar_ts) AS latest_ts FROM bars GROUP BY 1), t AS (SELECT max(ts) AS nw FROM ticks)
SELECT symbol, latest_ts, (epoch(nw)::BIGINT - epoch(latest_ts)::BIGINT) // 3600 AS age_hours, (epoch(nw)::BIGINT - epoch(latest_ts)::BIGINT) <= 1800 AS is_fresh FROM m, (SELECT date_trunc('second', nw) AS nw FROM t)""",
)
def data_freshness(spark, sf):
    from tidebar.plans.tables import event_ticks

    now = event_ticks(spark, sf).agg(F.max("ts")).scalar()
    return src.freshness(hourly(spark, sf).withColumn("_now", now), F.max("_now"), stale_hours=0.5)


# --- audits ----------------------------------------------------------------------------------------------


@query(
    "feature_row_audit", "B6 B7 B3",
    full_sql()
    + f""" SELECT symbol, {DAY_SQL}, least(12, {' + '.join(f'(({c}) IS NULL OR abs({c}) > 1e5)::INT' for c in ft.FULL)})::INT AS n_issues, round(({' + '.join(f'({c} IS NULL)::INT' for c in ft.FULL)}) / {float(len(ft.FULL))}, 6) AS missing_feature_fill_ratio,
  round(({' + '.join(f'(coalesce({c}, 0) = 0)::INT' for c in ft.FULL)}) / {float(len(ft.FULL))}, 6) AS zero_value_ratio FROM full_f""",
)
def feature_row_audit(spark, sf):
    df = ft.full_features(numbered(spark, sf)).withColumn("issues", rp.audit_issues(ft.FULL, 1e5))
    df = rp.with_filled_features(df, ft.FULL)
    return df.select("symbol", day_col(), F.size("issues").alias("n_issues"), *rounded(df, ["missing_feature_fill_ratio", "zero_value_ratio"]))


@query(
    "model_feature_views", "B8",
    full_sql() + f""" SELECT symbol, {DAY_SQL}, (twitter_volume = 0)::INT + {len(model_feature_view('random_forest', ft.FULL)) - 1} AS rf_width, round({' + '.join(f'coalesce({c}, 0)' for c in model_feature_view('xgboost', ft.FULL) if c not in ('ema_20', 'ema_50', 'sma_20', 'sma_50', 'macd_line', 'macd_signal', 'macd_histogram', 'bb_upper', 'bb_middle', 'bb_lower', 'atr_14'))}, 4) AS xgb_sum FROM full_f""",
)
def model_feature_views(spark, sf):
    df = ft.full_features(numbered(spark, sf))
    priced = {"ema_20", "ema_50", "sma_20", "sma_50", "macd_line", "macd_signal", "macd_histogram", "bb_upper", "bb_middle", "bb_lower", "atr_14"}
    view = [c for c in model_feature_view("xgboost", ft.FULL) if c not in priced]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in view[1:]), F.coalesce(F.col(view[0]), F.lit(0.0)))
    return df.select("symbol", day_col(), F.lit(len(model_feature_view("random_forest", ft.FULL))).alias("rf_width"), F.round(total, 4).alias("xgb_sum"))
