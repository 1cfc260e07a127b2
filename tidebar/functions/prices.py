"""Price display and feature-name rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LEAST, MOST = 6, 14


def price_decimals(reference: Column) -> Column:
    """Decimal places that keep small moves visible at the price scale."""
    need = F.ceil(-F.log10(reference)) + 5
    return F.when(reference > 0, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), need))).otherwise(MOST).cast("int")


def round_price(x: Column, reference: Column) -> Column:
    """Round to the decimals of the reference price."""
    d = price_decimals(reference)
    out = F.round(x, LEAST)
    for k in range(LEAST + 1, MOST + 1):
        out = F.when(d == k, F.round(x, k)).otherwise(out)
    return out


# Name parts that put a feature in the volatility/momentum view, and the whole
# names and name starts that put it in the interaction/trend view.
# Feature name groups.
MOMENTUM_PARTS = [
    "atr_14", "rolling_volatility_14", "ewma_vol", "rolling_std_logret", "vol_regime_encoded", "vol_expansion",
    "compression_expansion", "bb_", "macd_", "rsi_14", "roc_", "daily_return", "return_", "log_return_1d",
    "log_return_accel", "momentum_logret", "momentum_change_rate", "ema_slope_accel", "volume_change", "breakout_",
    "dist_to_roll", "range_position", "log_close", "trend_consistency", "twitter_", "sentiment_x_",
]
TREND_NAMES = [
    "trend_strength_adx", "ema_cross_norm", "trend_consistency_score", "ema_slope_accel", "momentum_change_rate",
    "range_position_14d_window", "compression_expansion_score", "ema_20", "ema_50", "sma_20", "sma_50", "daily_return",
    "momentum_logret_7d", "momentum_logret_14d",
]
TREND_STARTS = ("interact_", "sentiment_x_", "twitter_", "adx_", "plus_di_", "minus_di_", "return_", "roc_")
LEAST_COLUMNS, LEAST_SHARE = 32, 0.58


def model_feature_view(model: str, features: list[str]) -> list[str]:
    """Input columns of an ensemble member, in feature order, filled up to the least width."""
    wanted = {
        "random_forest": lambda f: not f.startswith("interact_") and any(p in f for p in MOMENTUM_PARTS),
        "xgboost": lambda f: f in TREND_NAMES or f.startswith(TREND_STARTS),
    }.get(model.strip().lower())
    if wanted is None:
        return list(features)
    chosen = list(filter(wanted, features))
    short = max(0, max(LEAST_COLUMNS, min(len(features), int(len(features) * LEAST_SHARE))) - len(chosen))
    return chosen + [f for f in features if f not in set(chosen)][:short]
