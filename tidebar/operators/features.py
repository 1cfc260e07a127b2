"""Bar features: 16 core, 17 cross-sectional and the full set of 71.

Inputs carry ``bar_no`` (see layout.number_bars).  Each builder asks for the halo its longest
window needs, so a builder costs one shuffle on ``(symbol, block)`` whatever its column count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidebar.functions.nulls import clip, div, finite, flag
from tidebar.operators.ewm import WARMUP, Ewm, ewm_std, span, with_ewm
from tidebar.operators.layout import blocked, lag, own_rows, rolling, trailing

KEY = ["symbol", "bar_ts", "bar_no"]

# Feature names, in order, and the lags used.
CORE = [
    "return_1d", "return_5d", "return_10d", "return_20d", "realized_vol_5d", "realized_vol_20d",
    "vol_ratio", "rsi_14", "bb_position", "close_vs_sma20", "volume_ratio", "volume_trend",
    "body_pct", "hl_range_pct", "day_sin", "day_cos",
]
CROSS = [
    "returns", "log_volume", "hl_range", "close_open", "ret_lag_1", "ret_lag_2", "ret_lag_3",
    "ret_lag_5", "realized_vol_5d", "return_5d", "momentum_accel", "vol_shock",
    "range_compression", "trend_strength", "breakout", "mean_reversion", "volume_spike",
]
LAGS = [1, 2, 3, 5, 7]
FULL = [
    "rsi_14", "macd_line", "macd_signal", "macd_histogram", "bb_upper", "bb_middle", "bb_lower",
    "ema_20", "ema_50", "sma_20", "sma_50", "atr_14", "rolling_volatility_14", "daily_return",
    "return_3d", "return_7d", "return_14d", "log_return_1d", "ewma_vol_logret_14",
    "ewma_vol_logret_30", "rolling_std_logret_14", "rolling_std_logret_30", "vol_regime_encoded",
    "momentum_logret_3d", "momentum_logret_7d", "momentum_logret_14d", "roc_5", "roc_10",
    "adx_14", "plus_di_14", "minus_di_14", "trend_strength_adx", "ema_cross_norm",
    "log_return_accel", "log_return_accel2", "breakout_above_20d_high", "breakout_below_20d_low",
    "dist_to_roll_high_20", "dist_to_roll_low_20", "range_position_14d_window",
    "breakout_above_14d_high", "breakout_below_14d_low", "dist_to_roll_high_14",
    "dist_to_roll_low_14", "ema_slope_accel", "momentum_change_rate", "vol_expansion_ratio",
    "vol_expansion_score", "compression_expansion_score", "trend_consistency_score",
    "interact_mom7_vol", "interact_rsi_adx", "interact_macd_accel", "twitter_sentiment",
    "twitter_sentiment_7d_avg", "twitter_sentiment_momentum", "twitter_volume",
    "sentiment_x_momentum", "sentiment_x_volatility", "log_close", "volume_change",
    *[f"log_close_lag_{k}" for k in LAGS], *[f"daily_return_lag_{k}" for k in LAGS],
]


def change(c: Column | str, n: int = 1) -> Column:
    """Relative change against n bars ago."""
    c = F.col(c) if isinstance(c, str) else c
    return div(c, lag(c, n)) - 1.0


def log_change(c: str, n: int = 1) -> Column:
    return F.log(div(F.col(c), lag(c, n)))


def true_range(prev_close: Column) -> Column:
    """Largest of the bar range and the distances to the previous close (which may be missing)."""
    h, l = F.col("high"), F.col("low")
    return F.greatest(h - l, F.abs(h - prev_close), F.abs(l - prev_close))


# --- core -------------------------------------------------------------------------------------


def core_window_features(df: DataFrame) -> DataFrame:
    """The 15 core features that need no smoothing; df is blocked(back >= 20)."""
    c = F.col("close")
    df = df.withColumns({f"return_{n}d": log_change("close", n) for n in (1, 5, 10, 20)})
    mean20, std20 = rolling(F.avg, "close", 20), rolling(F.stddev_samp, "close", 20)
    df = df.withColumns(
        {
            "realized_vol_5d": rolling(F.stddev_samp, "return_1d", 5),
            "realized_vol_20d": rolling(F.stddev_samp, "return_1d", 20),
            "_m20": mean20,
            "_s20": std20,
            "_v5": rolling(F.avg, "volume", 5),
            "_v20": rolling(F.avg, "volume", 20),
        }
    )
    weekday = F.weekday("bar_ts").cast("double")
    angle = weekday * (2.0 * math.pi / 7.0)
    band = F.col("_s20") * 2.0
    return df.withColumns(
        {
            "vol_ratio": finite(div(F.col("realized_vol_5d"), F.col("realized_vol_20d"))),
            "bb_position": clip(div(c - (F.col("_m20") - band), band * 2.0), 0.0, 1.0),
            "close_vs_sma20": div(c, F.col("_m20")) - 1.0,
            "volume_ratio": div(F.col("volume"), F.col("_v20")),
            "volume_trend": div(F.nullif(F.col("_v5"), F.lit(0.0)), F.col("_v20")),
            "body_pct": div(c - F.col("open"), F.col("open")),
            "hl_range_pct": div(F.col("high") - F.col("low"), F.col("open")),
            "day_sin": F.sin(angle),
            "day_cos": F.cos(angle),
        }
    ).drop("_m20", "_s20", "_v5", "_v20")


def core_rsi(df: DataFrame) -> DataFrame:
    """Wilder RSI on a 0-1 scale; needs 14 price changes; missing while there is no loss."""
    move = F.col("close") - lag("close")
    df = df.withColumn("_move", move).withColumns(
        {"_up": clip(F.col("_move"), lo=0.0), "_down": clip(-F.col("_move"), lo=0.0)}
    )
    df = with_ewm(df, {"_gain": Ewm("_up", 1 / 14, 2), "_loss": Ewm("_down", 1 / 14, 2)})
    rs = div(F.col("_gain"), F.col("_loss"))
    rsi = clip(F.lit(1.0) - div(1.0, rs + 1.0), 0.0, 1.0)
    return df.withColumn("rsi_14", F.when(F.col("bar_no") >= 15, rsi)).drop(
        "_move", "_up", "_down", "_gain", "_loss"
    )


def core_features(bars: DataFrame, block: int | None = None) -> DataFrame:
    """All 16 core features per bar; missing during warm-up; no price columns."""
    df = blocked(bars, back=WARMUP + 1, block=block)
    return own_rows(core_rsi(core_window_features(df))).select(*KEY, *CORE)


# --- cross-sectional ---------------------------------------------------------------------------


def cross_features(bars: DataFrame, block: int | None = None) -> DataFrame:
    """The 17 cross-sectional features per bar (before dropping warm-up rows)."""
    c, h, l = F.col("close"), F.col("high"), F.col("low")
    df = blocked(bars, back=40, block=block).withColumns(
        {
            "returns": change("close"),
            "_tr": true_range(lag("close")),
            "return_5d": change("close", 5),
            "momentum_accel": change("close", 3) - change("close", 7),
            "_hh5": rolling(F.max, "high", 5),
            "_ll5": rolling(F.min, "low", 5),
            "_hh20": rolling(F.max, "high", 20),
            "_ll20": rolling(F.min, "low", 20),
            "_m20": rolling(F.avg, "close", 20),
            "_m10": rolling(F.avg, "close", 10),
            "_s10": rolling(F.stddev_samp, "close", 10),
            "_top10": trailing(F.max, "high", 10),
            "_v30": rolling(F.avg, "volume", 30),
        }
    )
    df = df.withColumns(
        {
            **{f"ret_lag_{k}": lag("returns", k) for k in (1, 2, 3, 5)},
            "realized_vol_5d": rolling(F.stddev_samp, "returns", 5),
            "_vol20": rolling(F.stddev_samp, "returns", 20),
            "_atr": rolling(F.avg, "_tr", 14),
        }
    )
    df = df.withColumns(
        {
            "log_volume": F.log1p("volume"),
            "hl_range": div(h - l, c),
            "close_open": div(c - F.col("open"), F.col("open")),
            "vol_shock": div(F.col("realized_vol_5d"), F.col("_vol20")),
            "range_compression": div(F.col("_hh5") - F.col("_ll5"), F.col("_hh20") - F.col("_ll20")),
            "trend_strength": div(F.abs(c - F.col("_m20")), F.col("_atr")),
            "breakout": flag(c > F.col("_top10")),
            "mean_reversion": div(c - F.col("_m10"), F.col("_s10")),
            "volume_spike": div(F.col("volume"), F.col("_v30")),
        }
    )
    return own_rows(df).select(*KEY, *CROSS)


# --- full ---------------------------------------------------------------------------------------

# Volatility regime bounds on the smoothed log-return deviation.
VOL_LOW, VOL_HIGH = 0.012, 0.030


def full_features(bars: DataFrame, sentiment: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """All 71 features per bar, warm-up rows included (drop them with nulls.drop_incomplete).

    Four rounds over one layout: look-back columns, smoothing of them, smoothing of smoothed
    columns, and windows over those.
    """
    df = blocked(bars, back=WARMUP + 64, block=block)
    df = _full_base(df)
    df = _full_rolling(df)
    df = _full_smoothed(df)
    df = _full_derived(df)
    df = own_rows(df)
    return with_sentiment(df, sentiment).select(*KEY, *FULL)


def _full_base(df: DataFrame) -> DataFrame:
    c, h, l = F.col("close"), F.col("high"), F.col("low")
    move, up, down = c - lag("close"), h - lag("high"), lag("low") - l
    df = df.withColumns(
        {
            "_up": F.coalesce(F.greatest(move, F.lit(0.0)), F.lit(0.0)),
            "_down": F.coalesce(F.greatest(-move, F.lit(0.0)), F.lit(0.0)),
            "_tr": true_range(lag("close")),
            "_pdm": F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0)),
            "_mdm": F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0)),
            "log_return_1d": F.log(clip(div(c, lag("close")), lo=1e-12)),
            "daily_return": change("close"),
            "return_3d": change("close", 3),
            "return_7d": change("close", 7),
            "return_14d": change("close", 14),
            "roc_5": change("close", 5),
            "roc_10": change("close", 10),
            "volume_change": finite(change("volume")),
            "log_close": F.log(F.greatest(c, F.lit(1e-30))),
            "_h20": trailing(F.max, "high", 20, 5),
            "_l20": trailing(F.min, "low", 20, 5),
            "_h14": trailing(F.max, "high", 14, 4),
            "_l14": trailing(F.min, "low", 14, 4),
            "sma_20": rolling(F.avg, "close", 20, 1),
            "sma_50": rolling(F.avg, "close", 50, 1),
            "_s20": rolling(F.stddev_samp, "close", 20, 1),
        }
    )
    lr = F.col("log_return_1d")
    return df.withColumns(
        {"_lr0": F.coalesce(lr, F.lit(0.0)), "_sgn": F.signum(F.coalesce(lr, F.lit(0.0))), "_lr2": lr * lr}
    )


def _full_rolling(df: DataFrame) -> DataFrame:
    lr = "log_return_1d"
    return df.withColumns(
        {
            "rolling_volatility_14": rolling(F.stddev_samp, "daily_return", 14, 1),
            "rolling_std_logret_14": rolling(F.stddev_samp, lr, 14, 2),
            "rolling_std_logret_30": rolling(F.stddev_samp, lr, 30, 3),
            **{f"momentum_logret_{n}d": rolling(F.sum, lr, n, 1) for n in (3, 7, 14)},
            "log_return_accel": F.col(lr) - lag(lr),
            "_accel_prev": lag(lr) - lag(lr, 2),
            "_sign5": F.coalesce(F.abs(rolling(F.avg, "_sgn", 5, 3)), F.lit(0.0)),
            "_sign7": F.coalesce(F.abs(rolling(F.avg, "_sgn", 7, 3)), F.lit(0.0)),
            **{f"log_close_lag_{k}": lag("log_close", k) for k in LAGS},
            **{f"daily_return_lag_{k}": lag("daily_return", k) for k in LAGS},
        }
    )


def _full_smoothed(df: DataFrame) -> DataFrame:
    wilder = 1 / 14
    df = with_ewm(
        df,
        {
            "_gain": Ewm("_up", wilder),
            "_loss": Ewm("_down", wilder),
            "atr_14": Ewm("_tr", wilder),
            "_spdm": Ewm("_pdm", wilder),
            "_smdm": Ewm("_mdm", wilder),
            "_e12": Ewm("close", span(12)),
            "_e26": Ewm("close", span(26)),
            "ema_20": Ewm("close", span(20)),
            "ema_50": Ewm("close", span(50)),
            "_m14": Ewm("log_return_1d", span(14), 2),
            "_q14": Ewm("_lr2", span(14), 2),
            "_m30": Ewm("log_return_1d", span(30), 2),
            "_q30": Ewm("_lr2", span(30), 2),
        },
    )
    atr = F.col("atr_14") + 1e-12
    df = df.withColumns(
        {
            "macd_line": F.col("_e12") - F.col("_e26"),
            "plus_di_14": div(F.col("_spdm"), atr) * 100.0,
            "minus_di_14": div(F.col("_smdm"), atr) * 100.0,
            "ewma_vol_logret_14": ewm_std(F.col("_m14"), F.col("_q14"), span(14), 2),
            "ewma_vol_logret_30": ewm_std(F.col("_m30"), F.col("_q30"), span(30), 2),
        }
    )
    p, m = F.col("plus_di_14"), F.col("minus_di_14")
    df = df.withColumn("_dx", div(F.abs(p - m) * 100.0, p + m + 1e-12))
    return with_ewm(df, {"macd_signal": Ewm("macd_line", span(9)), "adx_14": Ewm("_dx", wilder)})


def _full_derived(df: DataFrame) -> DataFrame:
    c = F.col("close")
    per_price = lambda x: div(x, F.nullif(c, F.lit(0.0)) + 1e-30)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    rs = div(F.col("_gain"), F.col("_loss"))
    width = div(F.col("_s20") * 4.0, F.abs(F.col("sma_20")) + 1e-30)
    df = df.withColumns(
        {
            "rsi_14": F.when(F.col("_loss") == 0, 100.0).otherwise(F.lit(100.0) - div(100.0, rs + 1.0)),
            "macd_histogram": F.col("macd_line") - F.col("macd_signal"),
            "bb_middle": F.col("sma_20"),
            "bb_upper": F.col("sma_20") + F.col("_s20") * 2.0,
            "bb_lower": F.col("sma_20") - F.col("_s20") * 2.0,
            "log_return_accel2": F.col("log_return_accel") - F.col("_accel_prev"),
            "_es": zero(per_price(F.col("ema_20") - lag("ema_20"))),
            "_vol_ma": rolling(F.avg, "ewma_vol_logret_14", 20, 5),
            "_adx_ma": rolling(F.avg, "adx_14", 5, 1),
            "_mom_step": zero(F.col("momentum_logret_7d") - lag("momentum_logret_7d")),
            "_width": width,
        }
    )
    df = df.withColumns(
        {
            "_es_prev": lag("_es"),
            "_es_std": zero(rolling(F.stddev_samp, "_es", 5, 2)),
            "_width_ma": rolling(F.avg, "_width", 14, 5),
        }
    )
    h20, l20, h14, l14 = (F.col(x) for x in ("_h20", "_l20", "_h14", "_l14"))
    vol = F.col("ewma_vol_logret_14")
    expansion = clip(F.coalesce(div(vol, F.col("_vol_ma") + 1e-12), F.lit(1.0)), 0.15, 5.0)
    squeeze = clip(F.coalesce(div(F.col("_width"), F.col("_width_ma") + 1e-12), F.lit(1.0)), 0.2, 4.0)
    s5, s7 = F.col("_sign5"), F.col("_sign7")
    coherence = s5 * 0.48 + s7 * 0.32 + F.least(s5, s7) * 0.20
    ema_stability = clip(div(1.0, F.col("_es_std") * 120.0 + 1.0), 0.0, 1.0)
    persistence = (clip(div(F.col("adx_14"), F.col("_adx_ma") + 1e-8), 0.5, 2.0) - 0.5) / 1.5
    adx01 = clip(F.col("adx_14") / 100.0, 0.0, 1.0)
    rstd = clip(zero(F.col("rolling_std_logret_14")), 0.0, 0.25)
    accel = clip(zero(F.col("log_return_accel")), -0.1, 0.1)
    return df.withColumns(
        {
            "vol_regime_encoded": F.when(vol < VOL_LOW, 0.0).when(vol < VOL_HIGH, 1.0).otherwise(2.0),
            "trend_strength_adx": adx01,
            "ema_cross_norm": clip(per_price(F.col("ema_20") - F.col("ema_50")), -0.5, 0.5),
            "breakout_above_20d_high": flag(c > h20),
            "breakout_below_20d_low": flag(c < l20),
            "dist_to_roll_high_20": zero(clip(per_price(h20 - c), -0.5, 0.5)),
            "dist_to_roll_low_20": zero(clip(per_price(c - l20), -0.5, 0.5)),
            "range_position_14d_window": F.coalesce(
                clip(div(c - l20, F.nullif(h20 - l20, F.lit(0.0)) + 1e-30), 0.0, 1.0), F.lit(0.5)
            ),
            "breakout_above_14d_high": flag(c > h14),
            "breakout_below_14d_low": flag(c < l14),
            "dist_to_roll_high_14": zero(clip(per_price(h14 - c), -0.5, 0.5)),
            "dist_to_roll_low_14": zero(clip(per_price(c - l14), -0.5, 0.5)),
            "ema_slope_accel": clip(zero(F.col("_es") - F.col("_es_prev")), -0.1, 0.1),
            "momentum_change_rate": clip(F.col("_mom_step"), -0.25, 0.25),
            "vol_expansion_ratio": expansion,
            "vol_expansion_score": (clip(expansion - 1.0, -0.8, 2.5) + 0.8) / 3.3,
            "compression_expansion_score": (clip(squeeze - 1.0, -0.6, 2.0) + 0.6) / 2.6,
            "trend_consistency_score": clip(
                clip(coherence, 0.0, 1.0) * 0.40
                + F.coalesce(ema_stability, F.lit(0.5)) * 0.32
                + F.coalesce(persistence, F.lit(0.5)) * 0.28,
                0.0,
                1.0,
            ),
            "interact_mom7_vol": clip(clip(F.col("return_7d"), -0.5, 0.5) * rstd, -0.15, 0.15),
            "interact_rsi_adx": clip(
                clip(F.col("rsi_14") / 100.0 - 0.5, -0.5, 0.5) * adx01, -0.5, 0.5
            ),
            "interact_macd_accel": clip(
                clip(F.col("macd_histogram"), -1e6, 1e6) * accel * 100.0, -2.0, 2.0
            ),
        }
    )


def with_sentiment(df: DataFrame, sentiment: DataFrame | None) -> DataFrame:
    """Daily sentiment columns, neutral zeros where a day (or the whole source) is absent."""
    cols = ["twitter_sentiment", "twitter_sentiment_7d_avg", "twitter_sentiment_momentum", "twitter_volume"]
    if sentiment is None:
        df = df.withColumns({c: F.lit(0.0) for c in cols})
    else:
        s = sentiment.select(
            "symbol", F.col("day").alias("_day"), *[F.col(c).cast("double").alias(c) for c in cols]
        )
        df = df.withColumn("_day", F.to_date("bar_ts")).join(s, ["symbol", "_day"], "left").drop("_day")
        bound = lambda c: (0.0, 1e6) if c == "twitter_volume" else (-1.0, 1.0)
        df = df.withColumns({c: clip(F.coalesce(c, F.lit(0.0)), *bound(c)) for c in cols})
    mom = F.coalesce("momentum_logret_7d", F.lit(0.0))
    rstd = clip(F.coalesce("rolling_std_logret_14", F.lit(0.0)), 0.0, 0.25)
    return df.withColumns(
        {
            "sentiment_x_momentum": clip(F.col("twitter_sentiment") * mom, -0.2, 0.2),
            "sentiment_x_volatility": clip(F.col("twitter_sentiment") * rstd, -0.06, 0.06),
        }
    )
