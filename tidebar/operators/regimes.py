"""Market, volatility and trend context of a bar, from the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidebar.functions.arrays import bound01
from tidebar.functions.nulls import clip, div, ladder, truth
from tidebar.operators.layout import blocked, own_rows, rolling, trailing


def with_market_regime(df: DataFrame, block: int | None = None) -> DataFrame:
    """VOLATILE, TRENDING or RANGING with a confidence.

    Volatility is compared to the positive values among the 23 bars before it.
    """
    vol = F.col("ewma_vol_logret_14")
    df = blocked(df, back=24, block=block).withColumn("_pv", F.when(vol > 0, vol))
    df = df.withColumns(
        {
            "_seen": rolling(F.count, "ewma_vol_logret_14", 24, 1),
            "_mean": trailing(F.avg, "_pv", 23, 1),
        }
    )
    df = own_rows(df)
    adx = F.coalesce("adx_14", F.lit(0.0))
    tc = F.coalesce("trend_consistency_score", F.lit(0.5))
    pos = F.coalesce("range_position_14d_window", F.lit(0.5))
    ratio = F.when((F.col("_seen") >= 8) & (F.col("_mean") > 1e-12), vol / F.col("_mean"))
    # Spike ratio, trend and range bars.
    volatile = truth(ratio >= 1.75)
    trending = (adx > 25.0) & (tc >= 0.48)
    ranging = ((adx < 22.0) & pos.between(0.25, 0.75)) | (adx < 20.0)
    conf = ladder(
        [
            (volatile, clip((ratio - 1.0) / 1.2, 0.55, 1.0)),
            (trending, bound01(F.least(F.lit(1.0), (adx - 25.0) / 30.0) * 0.28 + F.least(F.lit(1.0), tc) * 0.30 + 0.42)),
            (ranging, bound01(F.lit(0.85) - F.greatest(adx, F.lit(0.0)) * 0.02)),
        ],
        0.52,
    )
    return df.withColumns(
        {
            "market_regime": ladder([(volatile, "VOLATILE"), (trending, "TRENDING")], "RANGING"),
            "market_regime_confidence": F.round(conf, 4),
        }
    ).drop("_pv", "_seen", "_mean")


def volatility_regime() -> Column:
    """LOW / MEDIUM / HIGH from the encoded regime, else log-return, else return deviation."""
    by = lambda x, lo, hi: F.when(x < lo, "LOW").when(x < hi, "MEDIUM").when(x.isNotNull(), "HIGH")
    code = F.bround(F.col("vol_regime_encoded"))
    usable = lambda c: F.when(F.col(c) >= 0, F.col(c))
    log_vol = F.coalesce(*map(usable, ("ewma_vol_logret_30", "rolling_std_logret_14", "ewma_vol_logret_14")))
    return F.coalesce(
        F.when(code <= 0, "LOW").when(code == 1, "MEDIUM").when(code.isNotNull(), "HIGH"),
        by(log_vol, 0.012, 0.030),
        by(usable("rolling_volatility_14"), 0.015, 0.04),
        F.lit("MEDIUM"),
    )


def with_volatility_shock(df: DataFrame, ratio: float = 1.8, least: int = 8, block: int | None = None) -> DataFrame:
    """Volatility against the mean of the 30 bars before (at least ``least`` positive ones)."""
    v = F.col("ewma_vol_logret_14")
    df = blocked(df, back=31, block=block).withColumn("_pv", F.when(v > 0, v))
    df = own_rows(df.withColumn("_m", trailing(F.avg, "_pv", 30, least))).drop("_pv")
    r = F.when(F.col("_m") >= 1e-12, F.coalesce(v, F.lit(0.0)) / F.col("_m"))
    return df.withColumns(
        {"volatility_shock": truth(r > ratio), "volatility_shock_ratio": F.coalesce(F.round(r, 4), F.lit(1.0))}
    ).drop("_m")


def with_trend_confirmation(df: DataFrame, bullish: Column, block: int | None = None) -> DataFrame:
    """EMA order and steadiness of ADX over five bars."""
    df = blocked(df.withColumn("_bull", bullish), back=5, block=block)
    df = own_rows(
        df.withColumns(
            {
                "_n": rolling(F.count, "adx_14", 5, 1),
                "_am": rolling(F.avg, "adx_14", 5, 1),
                "_as": rolling(F.stddev_pop, "adx_14", 5, 1),
            }
        )
    )
    s, l = F.coalesce("ema_20", F.lit(0.0)), F.coalesce("ema_50", F.lit(0.0))
    cross = ladder([(s > l, 1.0), (s < l, 0.35)], 0.55) * F.when(F.col("_bull"), 1.0).otherwise(0.82)
    steady = F.when(F.col("_n") < 3, 0.5).otherwise(
        bound01(F.lit(1.0) - F.least(F.lit(1.0), F.col("_as") / F.greatest(F.col("_am"), F.lit(8.0))))
    )
    score = F.when((s <= 0) | (l <= 0), 0.45).otherwise(F.round(bound01(cross * 0.55 + steady * 0.45), 4))
    return df.withColumn("trend_confirmation_score", score).drop("_n", "_am", "_as", "_bull")
