"""Queries for features and labels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidebar.functions.nulls import drop_incomplete
from tidebar.operators import features as ft, labels as lb
from tidebar.plans.registry import query, rounded, sql_rounded
from tidebar.plans.tables import bars_cte, daily, ew, lagged, led, numbered, prev, roll, weekly

def day_col():
    return F.to_date("bar_ts").alias("bar_day")


DAY_SQL = "bar_ts::DATE AS bar_day"

CORE_WINDOW = [c for c in ft.CORE if c != "rsi_14"]


def _core_sql() -> str:
    angle = f"((isodow(bar_ts) - 1) * {2 * math.pi / 7!r})"
    div = lambda a, b: f"(({a}) / nullif({b}, 0))"
    clip01 = lambda x: f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, 0), 1) END)"
    return f"""WITH {bars_cte()},
a AS (SELECT *, ln({div('close', lagged('close', 1))}) AS return_1d, ln({div('close', lagged('close', 5))}) AS return_5d,
  ln({div('close', lagged('close', 10))}) AS return_10d, ln({div('close', lagged('close', 20))}) AS return_20d,
  {roll('avg', 'close', 20)} AS m20, {roll('stddev_samp', 'close', 20)} AS s20,
  {roll('avg', 'volume', 5)} AS v5, {roll('avg', 'volume', 20)} AS v20 FROM bars),
b AS (SELECT *, {roll('stddev_samp', 'return_1d', 5)} AS realized_vol_5d,
  {roll('stddev_samp', 'return_1d', 20)} AS realized_vol_20d,
  {div('close - (m20 - 2*s20)', '4*s20')} AS pos FROM a),
c AS (SELECT *, {div('realized_vol_5d', 'realized_vol_20d')} AS vol_ratio, {clip01('pos')} AS bb_position,
  {div('close', 'm20')} - 1 AS close_vs_sma20, {div('volume', 'v20')} AS volume_ratio,
  {div('nullif(v5, 0)', 'v20')} AS volume_trend, {div('close - open', 'open')} AS body_pct,
  {div('high - low', 'open')} AS hl_range_pct, sin({angle}) AS day_sin, cos({angle}) AS day_cos FROM b)"""


@query(
    "core_features", "C1 C2 C3 C5 C6 C7 C8 C9 G1 G2 J1 J2 B2 B3 A1 A13 B5",
    _core_sql() + f" SELECT symbol, {DAY_SQL}, n AS bar_no, {sql_rounded(CORE_WINDOW)} FROM c",
)
def core_features(spark, sf):
    df = ft.core_features(numbered(spark, sf))
    return df.select("symbol", day_col(), "bar_no", *rounded(df, CORE_WINDOW))


@query(
    "core_rsi", "C4 G5",
    f"""WITH {bars_cte()},
d AS (SELECT *, close - {lagged('close', 1)} AS mv FROM bars),
e AS (SELECT *, {ew('greatest(mv, 0)', 1 / 14, 2)} AS g, {ew('greatest(-mv, 0)', 1 / 14, 2)} AS l FROM d)
SELECT symbol, {DAY_SQL}, CASE WHEN n >= 15 THEN round(1 - 1 / (1 + g / nullif(l, 0)), 6) END AS rsi_14 FROM e""",
)
def core_rsi(spark, sf):
    df = ft.core_features(numbered(spark, sf))
    return df.select("symbol", day_col(), *rounded(df, ["rsi_14"]))


CROSS_SQL = f"""a AS (SELECT *, close / nullif({lagged('close', 1)}, 0) - 1 AS returns, {lagged('close', 1)} AS pc,
  close / nullif({lagged('close', 5)}, 0) - 1 AS return_5d,
  (close / nullif({lagged('close', 3)}, 0) - 1) - (close / nullif({lagged('close', 7)}, 0) - 1) AS momentum_accel,
  {roll('max', 'high', 5)} - {roll('min', 'low', 5)} AS r5, {roll('max', 'high', 20)} - {roll('min', 'low', 20)} AS r20,
  {roll('avg', 'close', 20)} AS m20, {roll('avg', 'close', 10)} AS m10, {roll('stddev_samp', 'close', 10)} AS s10,
  {prev('max', 'high', 10)} AS top10, {roll('avg', 'volume', 30)} AS v30 FROM bars),
b AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, {lagged('returns', 1)} AS ret_lag_1,
  {lagged('returns', 2)} AS ret_lag_2, {lagged('returns', 3)} AS ret_lag_3, {lagged('returns', 5)} AS ret_lag_5,
  {roll('stddev_samp', 'returns', 5)} AS realized_vol_5d, {roll('stddev_samp', 'returns', 20)} AS vol20 FROM a),
c AS (SELECT *, {roll('avg', 'tr', 14)} AS atr FROM b),
cross_f AS (SELECT *, ln(1 + volume) AS log_volume, (high - low) / nullif(close, 0) AS hl_range,
  (close - open) / nullif(open, 0) AS close_open, realized_vol_5d / nullif(vol20, 0) AS vol_shock,
  r5 / nullif(r20, 0) AS range_compression, abs(close - m20) / nullif(atr, 0) AS trend_strength,
  coalesce((close > top10)::INT, 0)::DOUBLE AS breakout, (close - m10) / nullif(s10, 0) AS mean_reversion,
  volume / nullif(v30, 0) AS volume_spike FROM c)"""


@query(
    "cross_features", "C10 C11 C12 C13 C14 C15 C16 C17 C18 C19 G3 B1",
    f"""WITH {bars_cte()}, {CROSS_SQL}
SELECT symbol, {DAY_SQL}, {sql_rounded(ft.CROSS)} FROM cross_f
WHERE {' AND '.join(c + ' IS NOT NULL' for c in ft.CROSS)}""",
)
def cross_features(spark, sf):
    df = drop_incomplete(ft.cross_features(numbered(spark, sf)), ft.CROSS)
    return df.select("symbol", day_col(), *rounded(df, ft.CROSS))


def full_sql() -> str:
    w = 1 / 14
    z = lambda x: f"coalesce({x}, 0)"
    clip = lambda x, lo, hi: f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END)"
    pp = lambda x: f"(({x}) / (nullif(close, 0) + 1e-30))"

    def ewstd(m, q, span):
        a = 2 / (span + 1)
        r = 1 - a
        q2k = f"pow({r * r!r}, n - 2)"
        wt = f"({q2k} + {a * a / (1 - r * r)!r} * (1 - {q2k}))"
        return f"(CASE WHEN n >= 3 THEN sqrt(greatest({q} - {m}*{m}, 0) / (1 - {wt})) END)"

    lags = ", ".join(
        f"{lagged(c, k)} AS {c}_lag_{k}" for c in ("log_close", "daily_return") for k in ft.LAGS
    )
    return f"""WITH {bars_cte()},
a AS (SELECT *, {lagged('close', 1)} AS pc, high - {lagged('high', 1)} AS um, {lagged('low', 1)} - low AS dm,
  {lagged('volume', 1)} AS pv FROM bars),
b AS (SELECT *, {z('greatest(close - pc, 0)')} * (pc IS NOT NULL)::INT AS up, {z('greatest(pc - close, 0)')} * (pc IS NOT NULL)::INT AS dn,
  greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END AS pdm, CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END AS mdm,
  ln(greatest(close / nullif(pc, 0), 1e-12)) AS lr0_, close / nullif(pc, 0) - 1 AS daily_return,
  close / {lagged('close', 3)} - 1 AS return_3d, close / {lagged('close', 7)} - 1 AS return_7d,
  close / {lagged('close', 14)} - 1 AS return_14d, close / {lagged('close', 5)} - 1 AS roc_5,
  close / {lagged('close', 10)} - 1 AS roc_10, volume / nullif(pv, 0) - 1 AS volume_change,
  ln(greatest(close, 1e-30)) AS log_close,
  {prev('max', 'high', 20, 5)} AS h20, {prev('min', 'low', 20, 5)} AS l20,
  {prev('max', 'high', 14, 4)} AS h14, {prev('min', 'low', 14, 4)} AS l14,
  {roll('avg', 'close', 20, 1)} AS sma_20, {roll('avg', 'close', 50, 1)} AS sma_50,
  {roll('stddev_samp', 'close', 20, 1)} AS s20 FROM a),
b2 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN lr0_ END AS log_return_1d FROM b),
c AS (SELECT *, sign({z('log_return_1d')}) AS sgn, {roll('stddev_samp', 'daily_return', 14, 1)} AS rolling_volatility_14,
  {roll('stddev_samp', 'log_return_1d', 14, 2)} AS rolling_std_logret_14,
  {roll('stddev_samp', 'log_return_1d', 30, 3)} AS rolling_std_logret_30,
  {roll('sum', 'log_return_1d', 3, 1)} AS momentum_logret_3d, {roll('sum', 'log_return_1d', 7, 1)} AS momentum_logret_7d,
  {roll('sum', 'log_return_1d', 14, 1)} AS momentum_logret_14d,
  log_return_1d - {lagged('log_return_1d', 1)} AS log_return_accel,
  log_return_1d - 2 * {lagged('log_return_1d', 1)} + {lagged('log_return_1d', 2)} AS log_return_accel2, {lags},
  {ew('up', w)} AS g, {ew('dn', w)} AS l, {ew('tr', w)} AS atr_14, {ew('pdm', w)} AS sp, {ew('mdm', w)} AS sm,
  {ew('close', 2 / 13)} AS e12, {ew('close', 2 / 27)} AS e26, {ew('close', 2 / 21)} AS ema_20, {ew('close', 2 / 51)} AS ema_50,
  {ew('log_return_1d', 2 / 15, 2)} AS m14, {ew('log_return_1d*log_return_1d', 2 / 15, 2)} AS q14,
  {ew('log_return_1d', 2 / 31, 2)} AS m30, {ew('log_return_1d*log_return_1d', 2 / 31, 2)} AS q30 FROM b2),
d AS (SELECT *, e12 - e26 AS macd_line, 100 * sp / (atr_14 + 1e-12) AS plus_di_14, 100 * sm / (atr_14 + 1e-12) AS minus_di_14,
  {ewstd('m14', 'q14', 14)} AS ewma_vol_logret_14, {ewstd('m30', 'q30', 30)} AS ewma_vol_logret_30,
  {z(roll('avg', 'sgn', 5, 3))} AS a5, {z(roll('avg', 'sgn', 7, 3))} AS a7,
  {z(pp('ema_20 - ' + lagged('ema_20', 1)))} AS es,
  {z('momentum_logret_7d - ' + lagged('momentum_logret_7d', 1))} AS mstep,
  4 * s20 / (abs(sma_20) + 1e-30) AS wd FROM c),
e AS (SELECT *, 100 * abs(plus_di_14 - minus_di_14) / (plus_di_14 + minus_di_14 + 1e-12) AS dx,
  {ew('macd_line', 0.2)} AS macd_signal, {roll('avg', 'ewma_vol_logret_14', 20, 5)} AS vma,
  {lagged('es', 1)} AS pes, {z(roll('stddev_samp', 'es', 5, 2))} AS es_std, {roll('avg', 'wd', 14, 5)} AS wma FROM d),
f AS (SELECT *, {ew('dx', w)} AS adx_14 FROM e),
g AS (SELECT *, {roll('avg', 'adx_14', 5, 1)} AS adx_ma, CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi_14,
  macd_line - macd_signal AS macd_histogram,
  {clip(z('ewma_vol_logret_14 / (vma + 1e-12)').replace(', 0)', ', 1)'), 0.15, 5.0)} AS vol_expansion_ratio,
  {clip(z('wd / (wma + 1e-12)').replace(', 0)', ', 1)'), 0.2, 4.0)} AS squeeze,
  {clip(z('rolling_std_logret_14'), 0, 0.25)} AS rs14 FROM f),
h AS (SELECT *, sma_20 AS bb_middle, sma_20 + 2 * s20 AS bb_upper, sma_20 - 2 * s20 AS bb_lower,
  CASE WHEN ewma_vol_logret_14 < 0.012 THEN 0 WHEN ewma_vol_logret_14 < 0.030 THEN 1 ELSE 2 END::DOUBLE AS vol_regime_encoded,
  {clip('adx_14 / 100', 0, 1)} AS trend_strength_adx, {clip(pp('ema_20 - ema_50'), -0.5, 0.5)} AS ema_cross_norm,
  {z('(close > h20)::INT')}::DOUBLE AS breakout_above_20d_high, {z('(close < l20)::INT')}::DOUBLE AS breakout_below_20d_low,
  {z(clip(pp('h20 - close'), -0.5, 0.5))} AS dist_to_roll_high_20, {z(clip(pp('close - l20'), -0.5, 0.5))} AS dist_to_roll_low_20,
  coalesce({clip('(close - l20) / (nullif(h20 - l20, 0) + 1e-30)', 0, 1)}, 0.5) AS range_position_14d_window,
  {z('(close > h14)::INT')}::DOUBLE AS breakout_above_14d_high, {z('(close < l14)::INT')}::DOUBLE AS breakout_below_14d_low,
  {z(clip(pp('h14 - close'), -0.5, 0.5))} AS dist_to_roll_high_14, {z(clip(pp('close - l14'), -0.5, 0.5))} AS dist_to_roll_low_14,
  {clip(z('es - pes'), -0.1, 0.1)} AS ema_slope_accel, {clip('mstep', -0.25, 0.25)} AS momentum_change_rate,
  ({clip('vol_expansion_ratio - 1', -0.8, 2.5)} + 0.8) / 3.3 AS vol_expansion_score,
  ({clip('squeeze - 1', -0.6, 2.0)} + 0.6) / 2.6 AS compression_expansion_score,
  {clip('return_7d', -0.5, 0.5)} AS r7, {clip('rsi_14 / 100 - 0.5', -0.5, 0.5)} AS rn, {clip('adx_14 / 100', 0, 1)} AS an,
  {clip('macd_histogram', -1e6, 1e6)} AS mh, {clip(z('log_return_accel'), -0.1, 0.1)} AS ac,
  least(0.48 * abs(a5) + 0.32 * abs(a7) + 0.2 * least(abs(a5), abs(a7)), 1) AS coh,
  {clip('1 / (1 + 120 * es_std)', 0, 1)} AS stab, ({clip('adx_14 / (adx_ma + 1e-8)', 0.5, 2.0)} - 0.5) / 1.5 AS pers FROM g),
full_f AS (SELECT *, {clip('0.4 * coh + 0.32 * stab + 0.28 * pers', 0, 1)} AS trend_consistency_score,
  {clip('r7 * rs14', -0.15, 0.15)} AS interact_mom7_vol, {clip('rn * an', -0.5, 0.5)} AS interact_rsi_adx,
  {clip('mh * ac * 100', -2.0, 2.0)} AS interact_macd_accel, 0.0::DOUBLE AS twitter_sentiment, 0.0::DOUBLE AS twitter_sentiment_7d_avg,
  0.0::DOUBLE AS twitter_sentiment_momentum, 0.0::DOUBLE AS twitter_volume, 0.0::DOUBLE AS sentiment_x_momentum,
  0.0::DOUBLE AS sentiment_x_volatility FROM h)"""


# smoothed prices are compared to three places, plain means to the seven that a mean over 32 cents can have, ratios to six
PRICE_SCALE = ["macd_line", "macd_signal", "macd_histogram", "bb_upper", "bb_lower", "ema_20", "ema_50", "atr_14"]
MEANS = ["sma_20", "sma_50", "bb_middle"]
RATIOS = [c for c in ft.FULL if c not in PRICE_SCALE + MEANS]
FULL_SELECT = ", ".join([sql_rounded(PRICE_SCALE, 3), sql_rounded(MEANS, 7), sql_rounded(RATIOS)])


def _full_out(df):
    return df.select("symbol", day_col(), *rounded(df, PRICE_SCALE, 3), *rounded(df, MEANS, 7), *rounded(df, RATIOS))


@query(
    "full_features",
    "C20 C21 C22 C23 C24 C25 C26 C27 C28 C29 C30 C31 C32 C33 C34 C35 C36 C37 C38 C39 C40 C41 C42 C43 C44 C45 G4 G9",
    full_sql() + f" SELECT symbol, {DAY_SQL}, {FULL_SELECT} FROM full_f",
)
def full_features(spark, sf):
    return _full_out(ft.full_features(numbered(spark, sf)))


@query(
    "full_features_with_target", "C47 D1 B1 E5",
    full_sql()
    + f""", tgt AS (SELECT *, ln(greatest({led('close', 1)} / nullif(close, 0), 1e-12)) AS t_ , {led('close', 1)} AS nc FROM full_f)
SELECT symbol, {DAY_SQL}, {FULL_SELECT}, round(t_, 6) AS target_log_return_1d FROM tgt
WHERE nc IS NOT NULL AND {' AND '.join(c + ' IS NOT NULL' for c in ft.FULL)}""",
)
def full_features_with_target(spark, sf):
    bars = numbered(spark, sf)
    target = lb.next_log_return(bars).select("symbol", "bar_no", "target_log_return_1d")
    df = drop_incomplete(ft.full_features(bars), ft.FULL).join(
        drop_incomplete(target, ["target_log_return_1d"]), ["symbol", "bar_no"]
    )
    return df.select(
        "symbol", day_col(), *rounded(df, PRICE_SCALE, 3), *rounded(df, MEANS, 7), *rounded(df, RATIOS), F.round("target_log_return_1d", 6).alias("target_log_return_1d")
    )


@query(
    "next_log_return", "D1",
    f"""WITH {bars_cte()} SELECT symbol, {DAY_SQL}, CASE WHEN {led('close', 1)} IS NOT NULL
  THEN round(ln(greatest({led('close', 1)} / nullif(close, 0), 1e-12)), 6) END AS target_log_return_1d FROM bars""",
)
def next_log_return(spark, sf):
    df = lb.next_log_return(numbered(spark, sf))
    return df.select("symbol", day_col(), *rounded(df, ["target_log_return_1d"]))


@query(
    "forward_label", "D2",
    f"""WITH {bars_cte()}, f AS (SELECT *, {led('close', 3)} / nullif(close, 0) - 1 AS r, {led('n', 3)} AS k FROM bars)
SELECT symbol, {DAY_SQL}, (CASE WHEN r > 0.02 THEN 1 WHEN r < -0.02 THEN 0 END)::INT AS label FROM f WHERE k IS NOT NULL""",
)
def forward_label(spark, sf):
    return lb.forward_label(numbered(spark, sf), 3, 0.02).select("symbol", day_col(), "label")


@query(
    "directional_labels", "D3 D4",
    f"""WITH {bars_cte()}, f AS (SELECT *, {led('close', 5)} / nullif(close, 0) - 1 AS r, ln({led('close', 1)} / close) AS lr FROM bars)
SELECT symbol, {DAY_SQL}, (CASE WHEN r IS NULL THEN NULL WHEN r > 0.005 THEN 2 WHEN r < -0.005 THEN 0 ELSE 1 END)::INT AS direction,
  (CASE WHEN lr IS NULL THEN NULL WHEN lr > 0.0008 THEN 2 WHEN lr < -0.0008 THEN 0 ELSE 1 END)::INT AS next_direction FROM f""",
)
def directional_labels(spark, sf):
    df = lb.directional_forward_label(numbered(spark, sf))
    nxt = lb.next_log_return(df)
    return nxt.select(
        "symbol", day_col(), "direction", lb.direction_of_log_return(F.col("target_log_return_1d")).alias("next_direction")
    )


@query(
    "cross_sectional_label", "D5 G8",
    f"""WITH {bars_cte('week')}, f AS (SELECT *, {led('close', 5)} / nullif(close, 0) - 1 AS r FROM bars),
m AS (SELECT *, median(r) OVER (PARTITION BY bar_ts) AS med FROM f)
SELECT symbol, {DAY_SQL}, round(r, 6) AS fwd_return, round(med, 6) AS median_return, (r > med)::INT AS label FROM m""",
)
def cross_sectional_label(spark, sf):
    df = lb.cross_sectional_label(numbered(spark, sf, "week"))
    return df.select("symbol", day_col(), *rounded(df, ["fwd_return", "median_return"]), "label")


@query(
    "big_move_label", "D6",
    f"""WITH {bars_cte()} SELECT symbol, {DAY_SQL}, coalesce((abs({led('close', 7)} / nullif(close, 0) - 1) > 0.03)::INT, 0) AS label FROM bars""",
)
def big_move_label(spark, sf):
    return lb.big_move_label(numbered(spark, sf), 7, compat=True).select("symbol", day_col(), "label")


@query(
    "label_counts", "F19",
    f"""WITH {bars_cte()}, f AS (SELECT {led('close', 5)} / nullif(close, 0) - 1 AS r FROM bars)
SELECT (CASE WHEN r > 0.005 THEN 2 WHEN r < -0.005 THEN 0 ELSE 1 END)::INT AS direction, count(*)::BIGINT AS n FROM f WHERE r IS NOT NULL GROUP BY 1""",
)
def label_counts(spark, sf):
    df = lb.directional_forward_label(numbered(spark, sf)).dropna(subset=["direction"])
    return df.groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tail_statistics", "D7",
    f"""WITH {bars_cte()}, r AS (SELECT *, ln(close / {lagged('close', 1)}) AS x FROM bars),
s AS (SELECT *, abs({roll('sum', 'x', 14, 7)}) AS c FROM r)
SELECT symbol, CASE WHEN count(x) > 80 THEN round(quantile_cont(abs(x), 0.99), 6) END AS p99_daily,
  CASE WHEN count(c) > 40 THEN round(quantile_cont(c, 0.99), 6) END AS p99_cum FROM s GROUP BY 1""",
)
def tail_statistics(spark, sf):
    df = lb.tail_statistics(numbered(spark, sf))
    return df.select("symbol", *rounded(df, ["p99_daily", "p99_cum"]))
