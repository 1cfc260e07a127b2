"""Decision, tier, regime and path rules on single hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tidebar.operators import paths as ph, regimes as rg, reports as rp, signals as sg

BASE = dict(
    symbol="s", bar_no=1, close=100.0, final_prediction=120.0, lower_bound=90.0, upper_bound=130.0, base_confidence=0.7, mean_agreement=0.8,
    signal_strength_score=0.6, trend_label="UP", p_up=0.7, p_down=0.15, p_neutral=0.15, volatility_regime="LOW", adx_14=35.0, trend_strength_adx=0.35,
    trend_consistency_score=0.7, vol_expansion_score=0.5, return_7d=0.05, recent_no_trade_fraction=0.0, is_constant_prediction=False, degraded_input=False, low_variance_warning=False,
)


def decide(spark, **over):
    row = {**BASE, **over}
    return sg.with_decision(spark.createDataFrame([tuple(row.values())], list(row))).first()


def test_aligned_move_is_bought(spark):
    r = decide(spark)
    assert r.trade_signal == "BUY" and r.rejection_reasons == [] and r.expected_move_strength == "STRONG"


def test_small_move_and_neutral_trend_are_rejected(spark):
    weak = decide(spark, final_prediction=100.5)
    assert weak.trade_signal == "NO_TRADE" and weak.expected_move_strength == "WEAK"
    flat = decide(spark, trend_label="NEUTRAL")
    assert flat.trade_signal == "NO_TRADE" and "trend is neutral" in flat.rejection_reasons


@pytest.mark.parametrize("pct,label", [(0.01, "WEAK"), (0.03, "MODERATE"), (0.06, "STRONG")])
def test_move_strength(spark, pct, label):
    assert spark.range(1).select(sg.move_strength(F.lit(pct))).first()[0] == label


def test_risk_reward_with_swapped_bounds(spark):
    f = lambda lo, hi: spark.range(1).select(sg.risk_reward(F.lit(100.0), F.lit(110.0), F.lit(lo), F.lit(hi))).first()[0]
    assert f(105.0, 115.0) == pytest.approx(1.0) == f(115.0, 105.0)


TIER = dict(
    confidence_score=0.7, base_confidence=0.7, risk_adjusted_confidence=0.68, mean_agreement=0.8, combined_agreement=0.8, directional_confidence=0.7, signal_strength_score=0.6,
    expected_move_pct=0.05, risk_reward_ratio=2.0, adx_14=30.0, sentiment_alignment=0.0, consensus_score=0.8, stability_score=0.8, trend_confirmation_score=0.8,
    agreement_trend_score=0.7, agreement_trend_label="stable", volatility_regime="LOW", trend_label="UP", market_regime="TRENDING", forecast_bullish=True, volatility_shock=False,
    feature_sanity_failed=False, cooldown_active=False, p_up=0.7, p_down=0.15, p_neutral=0.15,
)


def tier(spark, **over):
    row = {**TIER, **over}
    return sg.with_trade_tier(spark.createDataFrame([tuple(row.values())], list(row))).first()


def test_strong_in_a_trend_only(spark):
    assert tier(spark).trade_decision == "STRONG_BUY"
    assert tier(spark, market_regime="RANGING").trade_decision == "WEAK_BUY"
    assert tier(spark, volatility_shock=True).trade_decision != "STRONG_BUY"
    assert tier(spark, market_regime="VOLATILE").trade_decision == "NO_TRADE"


def test_hard_floors_and_gates(spark):
    assert tier(spark, confidence_score=0.1).reason_for_rejection == "Hard floor: confidence"
    assert tier(spark, cooldown_active=True).trade_decision == "NO_TRADE"
    r = tier(spark, directional_confidence=0.3)
    assert r.decision_blockers["directional"] and r.trade_decision == "NO_TRADE"


def test_probing_tier(spark):
    r = tier(spark, confidence_score=0.40, combined_agreement=0.48, expected_move_pct=0.04, consensus_score=0.3)
    assert r.trade_decision == "PROBING_BUY" and r.reason_for_trade.startswith("Probing")


def test_base_score_is_the_product(spark):
    r = tier(spark, confidence_score=0.5, combined_agreement=0.8, signal_strength_score=0.5, cooldown_active=True)
    assert r.score == pytest.approx(0.2)


@pytest.mark.parametrize(
    "adx,vol,tc,pos,history,want",
    [(32.0, 0.02, 0.62, 0.55, 0.02, "TRENDING"), (16.0, 0.018, 0.42, 0.48, 0.018, "RANGING"), (30.0, 0.045, 0.6, 0.5, 0.015, "VOLATILE")],
)
def test_market_regime(spark, adx, vol, tc, pos, history, want):
    rows = [("s", i, history if i < 20 else vol, adx, tc, pos) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "symbol string, bar_no bigint, ewma_vol_logret_14 double, adx_14 double, trend_consistency_score double, range_position_14d_window double")
    assert rg.with_market_regime(df).where("bar_no = 20").first().market_regime == want


def matrix(spark, rows):
    return spark.createDataFrame([("s", 1, 100.0, [float(len(r)) for r in rows], rows)], "symbol string, bar_no bigint, close double, w array<double>, matrix array<array<double>>")


def test_alternating_signs_are_chaotic(spark):
    m = matrix(spark, [[0.02, -0.02, 0.02, -0.02]] * 5)
    chaotic, share = ph.chaotic_disagreement(F.col("matrix"))
    r = m.select(chaotic.alias("c"), share.alias("s")).first()
    assert r.c and r.s == 1.0


def test_same_sign_variance_is_discounted(spark):
    m = matrix(spark, [[0.01, 0.02, 0.015]])
    eff, raw = ph.effective_variance(F.col("matrix"))
    r = m.select(eff.alias("e"), raw.alias("r")).first()
    assert r.e == pytest.approx(0.28 * r.r)
    mixed = matrix(spark, [[0.02, -0.02, 0.01]]).select(ph.effective_variance(F.col("matrix"))[0].alias("e"), ph.effective_variance(F.col("matrix"))[1].alias("r")).first()
    assert mixed.e == pytest.approx(mixed.r)


def validity(spark, **over):
    d = dict(is_constant_prediction=False, low_variance_warning=False, degraded_input=False, artifact_mode="production", guardrail=False, sanity_extreme=False, clip_saturation=0.0) | over
    df = spark.createDataFrame([tuple(d.values())], "is_constant_prediction boolean, low_variance_warning boolean, degraded_input boolean, artifact_mode string, guardrail boolean, sanity_extreme boolean, clip_saturation double")
    label, q = ph.forecast_validity({k: F.col(k) for k in d})
    return df.select(label.alias("l"), q.alias("q")).first()


def test_forecast_validity(spark):
    assert validity(spark).l == "valid"
    assert validity(spark, degraded_input=True).l == "questionable"
    assert validity(spark, artifact_mode="legacy").q < 0.5
    assert validity(spark, is_constant_prediction=True).l == "invalid"


def test_empty_path_gets_defaults(spark):
    df = spark.createDataFrame([([], [], [])], "ens array<double>, prices array<double>, raw array<array<double>>")
    q = ph.quality_signals(F.col("ens"), F.col("prices"), F.col("raw"), 0, F.lit(0.0), F.lit(False))
    r = df.select(*[c.alias(k) for k, c in q.items()]).first()
    assert r.is_constant_prediction and r.ensemble_log_return_var == 0.0 and not r.degraded_input


def test_row_audit(spark):
    df = spark.createDataFrame([(1.0, None, float("inf"), 1e9, 5.0)], "a double, b double, c double, d double, target_x double")
    issues = df.select(rp.audit_issues(["a", "b", "c", "d", "target_x"]).alias("i")).first().i
    assert issues == ["NaN in b", "Non-finite in c", "Extreme magnitude in d"]


def test_decision_sentence(spark):
    row = {**BASE, "final_prediction": 100.5}
    df = sg.with_decision(spark.createDataFrame([tuple(BASE.values()), tuple(row.values())], list(BASE)))
    yes, no = [r[0] for r in df.select(sg.decision_sentence()).collect()]
    assert yes == "BUY allowed: move STRONG"
    assert no.startswith("NO_TRADE: ") and "expected move too small" in no


def test_member_prices_follow_the_smoothed_path(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    prices = F.array(F.lit(90.0), F.lit(110.0))
    assert one(ph.scaled_members(prices, F.lit(100.0), F.lit(105.0))) == pytest.approx([94.5, 115.5])
    assert one(ph.scaled_members(prices, F.lit(0.0), F.lit(5.0))) == [90.0, 110.0]


@pytest.mark.parametrize("vol,level", [(None, "UNKNOWN"), (0.01, "LOW"), (0.015, "MEDIUM"), (0.04, "HIGH")])
def test_volatility_level(spark, vol, level):
    assert spark.range(1).select(ph.volatility_level(F.lit(vol).cast("double"))).first()[0] == level
