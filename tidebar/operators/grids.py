"""Parameter grids as one job: parameters are a small array exploded next to the signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidebar.functions.nulls import div, truth
from tidebar.operators import metrics as mt, signals as sg, trades as tr
from tidebar.operators.layout import blocked, own_rows, rolling


def experiment_grid(scored: DataFrame, horizons: list[int], thresholds: list[float], min_history: int = 200) -> DataFrame:
    """Trades, win rate, growth and profit factor per (horizon, threshold), and against buying always.

    Needs prob, realized_vol_5d, ret_lag_3 and the bar columns.
    """
    df = blocked(scored, back=50).withColumn("cutoff", rolling(lambda c: F.percentile(c, 0.8), "prob", 50))
    trades = tr.slipped_exits(own_rows(df), horizons, min_history=min_history)
    decision, _ = tr.gate(F.col("prob"), F.col("realized_vol_5d"), F.lit(False), 0.0)
    usable = truth((F.col("prob") >= F.col("cutoff")) & (decision == "BUY") & (F.col("ret_lag_3") > 0))
    # threshold -1 stands for the baseline that buys on every row
    steps = F.explode(F.array(*map(F.lit, [-1.0, *thresholds])))
    rows = trades.select("horizon", "trade_return", "prob", usable.alias("ok"), steps.alias("threshold"))
    rows = rows.where((F.col("threshold") < 0) | (F.col("ok") & (F.col("prob") >= F.col("threshold"))))
    m = mt.simple_summary(rows, ["horizon", "threshold"], extra=[F.sum(F.log1p("trade_return")).alias("log_growth")])
    base = m.where(F.col("threshold") < 0).select("horizon", F.col("profit_factor").alias("_base"))
    return (
        m.where(F.col("threshold") >= 0)
        .join(F.broadcast(base), "horizon", "left")
        .withColumn("pf_vs_baseline", F.col("profit_factor") / F.when(F.col("_base") > 0, F.col("_base")).otherwise(1.0))
        .drop("_base", "compounded_return")
    )


# What each ablation variant switches off or loosens.
VARIANTS = [
    # name, sentiment, regime filter, cooldown, gate multiplier, strict tiers
    ("A_full", True, True, True, 1.0, True),
    ("B_no_twitter", False, True, True, 1.0, True),
    ("C_no_regime_filter", True, False, True, 1.0, True),
    ("D_no_cooldown", True, True, False, 1.0, True),
    ("E_weaker_thresholds", True, True, True, 0.88, True),
    ("F_decision_layer_only", True, True, True, 1.0, False),
]


def with_variants(df: DataFrame) -> DataFrame:
    """Every row once per variant; ``symbol`` becomes the series key of the variant."""
    fields = ("variant", "use_sentiment", "use_regime", "use_cooldown", "gate", "strict")
    table = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row)]) for row in VARIANTS])
    df = df.withColumn("_v", F.explode(table)).select("*", *[F.col(f"_v.{f}").alias(f) for f in fields]).drop("_v")
    return df.withColumns({"base_symbol": F.col("symbol"), "symbol": F.concat_ws("#", "symbol", "variant")})


def variant_decisions(signals: DataFrame) -> DataFrame:
    """Trade decision of every variant; sentiment reaches alignment, signal strength and confidence."""
    heard = lambda c: F.when(F.col("use_sentiment"), F.col(c)).otherwise(0.0)
    backed = F.least(F.lit(0.045), F.least(F.lit(1.0), heard("twitter_volume") / 120.0) * F.least(F.lit(1.0), F.abs(heard("twitter_sentiment"))) * 0.03)
    df = signals.withColumns(
        {
            "sentiment_alignment": heard("sentiment_alignment"),
            "signal_strength_score": sg.with_sentiment_bump(F.col("signal_strength_score"), heard("twitter_sentiment"), heard("twitter_volume")),
            "confidence_score": F.when(heard("sentiment_alignment") > 0, F.least(F.lit(1.0), F.col("confidence_score") * (backed + 1.0))).otherwise(F.col("confidence_score")),
            "market_regime": F.when(F.col("use_regime"), F.col("market_regime")).otherwise("RANGING"),
            "cooldown_active": F.lit(False),
        }
    )
    tiers = sg.with_trade_tier(df.withColumn("_em", F.col("expected_move_pct")))
    done = sg.with_decision(tiers.drop("expected_move_pct", "risk_reward_ratio"), F.col("gate"))
    simple = sg.simple_tier(F.col("trade_signal"), F.col("high_conviction"))
    return done.withColumn("decision", F.when(F.col("strict"), F.col("trade_decision")).otherwise(simple))


def ablation(signals: DataFrame, cooldown_days: int = 3, min_history: int = 0) -> DataFrame:
    """Trade statistics of every variant per symbol, from bar ``min_history`` on (0: all bars)."""
    df = variant_decisions(with_variants(signals))
    exits = tr.first_touch_exits(tr.with_profile(df)).where(F.col("exit_reason") != "INVALID")
    rel = tr.with_release(exits, df, cooldown_days, use=F.col("use_cooldown"))
    taken = tr.non_overlapping(rel, min_history=min_history)
    return mt.trade_statistics(taken, ["base_symbol", "variant"])


def leaderboard(stats: DataFrame, by: str = "profit_factor") -> DataFrame:
    """Rows ordered by one metric, best first."""
    return stats.orderBy(F.col(by).desc_nulls_last())
