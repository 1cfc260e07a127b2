"""Forecast paths: caps, ensemble, prices and bands, guardrails, agreement and quality.

A path is one row per (symbol, decision bar): ``raw`` holds the models' log returns per step
(array of steps, each an array in model order).  Every operator is a column expression over
that row; the long table is one ``explode`` away (``long_paths``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidebar.functions.arrays import amean, amedian, astd, asum, avar, bound01, column_of, count_if, cumsum, let, spread
from tidebar.functions.nulls import clip, div, ladder, truth
from tidebar.operators.layout import blocked, lag, own_rows

HORIZON = 14
# Legal bound of one step, hard and volatility-scaled caps, path cap.
OUTER_CAP, HARD_CAP, SIGMA_CAP, PATH_SIGMA = 0.12, 0.055, 3.0, 3.5


def long_paths(df: DataFrame, models: list[str]) -> DataFrame:
    """(symbol, bar_no, step, model, log_return) from the nested matrix."""
    steps = df.select("symbol", "bar_no", F.posexplode("matrix").alias("s", "row"))
    return steps.select(
        "symbol", "bar_no", (F.col("s") + 1).alias("step"), F.posexplode("row").alias("m", "log_return")
    ).select("symbol", "bar_no", "step", F.element_at(F.array(*map(F.lit, models)), F.col("m") + 1).alias("model"), "log_return")


def nest_paths(long: DataFrame, models: list[str]) -> DataFrame:
    """The nested matrix from a long table; a path holds at most steps x models values."""
    order = F.array(*map(F.lit, models))
    cell = F.struct("step", F.array_position(order, F.col("model")).alias("m"), "log_return")
    rows = long.groupBy("symbol", "bar_no").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    k = len(models)
    return rows.select(
        "symbol", "bar_no",
        F.transform(
            F.sequence(F.lit(0), (F.size("c") / k).cast("int") - 1),
            lambda i: F.transform(F.slice("c", i * k + 1, k), lambda x: x["log_return"]),
        ).alias("matrix"),
    )


def daily_cap(vol: Column, p99: Column | None = None) -> Column:
    """Largest |log return| of one step from volatility and the historical tail."""
    cap = F.least(F.lit(HARD_CAP), F.greatest(vol, F.lit(0.004)) * SIGMA_CAP)
    if p99 is not None:
        cap = F.when(truth(p99 > 1e-8), F.least(cap, p99 * 1.15)).otherwise(cap)
    return F.greatest(cap, F.lit(0.002))


def clip_step(r: Column, cap: Column) -> Column:
    return clip(clip(r, -OUTER_CAP, OUTER_CAP), -cap, cap)


def weighted_mean(row: Column, weights: Column) -> Column:
    """Weighted mean of one step; the plain mean when the weights vanish."""
    total = asum(weights)
    return F.when(total < 1e-12, amean(row)).otherwise(asum(F.zip_with(row, weights, lambda r, w: r * w)) / total)


def diversity_agreement(row: Column, cap: float = OUTER_CAP) -> Column:
    """Agreement of one step that does not mistake outputs collapsed at a bound for consent."""
    m = amean(F.transform(row, F.abs))
    cv = F.try_divide(astd(row), m)
    return ladder(
        [
            (F.size(row) < 2, 0.45),
            (spread(row) < 1e-6, 0.22),
            ((F.array_min(row) >= cap - 1e-4) | (F.array_max(row) <= -cap + 1e-4), 0.28),
            (m < 1e-10, 0.25),
        ],
        bound01(F.lit(1.0) - cv),
    )


def model_agreement(preds: Column) -> Column:
    """1 - deviation / |mean| of the models' outputs."""
    m, s = amean(preds), astd(preds)
    return F.when(F.abs(m) < 1e-10, F.when(s < 1e-10, 1.0).otherwise(0.0)).otherwise(bound01(F.lit(1.0) - s / F.abs(m)))


def with_ensemble(df: DataFrame, band: float = 2.0) -> DataFrame:
    """Clipped matrix, ensemble returns, prices, bands and step agreement.

    Needs raw, weights, close, vol, p99_daily, vol_regime_encoded.
    """
    vol = F.greatest(F.col("vol"), F.lit(0.005))
    df = df.withColumn("vol", vol).withColumn("cap", daily_cap(F.col("vol"), F.col("p99_daily")))
    cap = F.col("cap")
    df = df.withColumn("matrix", F.transform("raw", lambda row: F.transform(row, lambda r: clip_step(r, cap))))
    df = df.withColumn(
        "ens", F.transform("matrix", lambda row: clip_step(weighted_mean(row, F.col("weights")), cap))
    )
    saturated = F.transform("matrix", lambda row: F.forall(row, lambda r: F.abs(r) >= cap - 1e-6))
    df = df.withColumn("clip_saturation", count_if(saturated, lambda b: b) / F.size("matrix"))
    scale = F.coalesce(clip(F.col("vol_regime_encoded"), 0.0, 2.0) * 0.12 + 0.88, F.lit(1.0))
    return _with_prices(df, band, scale)


def _with_prices(df: DataFrame, band: float, scale: Column) -> DataFrame:
    df = df.withColumn("_cum", cumsum(F.col("ens"))).withColumn("_bs", scale)
    price = lambda c: F.col("close") * F.exp(c)
    half = lambda i: F.col("vol") * F.sqrt((i + 1).cast("double")) * F.col("_bs") * band
    return df.withColumns(
        {
            "prices": F.transform("_cum", price),
            "lower": F.transform("_cum", lambda c, i: price(c) * F.exp(-half(i))),
            "upper": F.transform("_cum", lambda c, i: price(c) * F.exp(half(i))),
            "agree": F.transform("matrix", lambda row: diversity_agreement(row)),
        }
    ).drop("_cum", "_bs")


def with_cumulative_guardrail(df: DataFrame, band: float = 2.0) -> DataFrame:
    """Scale a path whose summed log return is beyond the cap; rebuild everything that depends on it.

    Needs the columns of with_ensemble and p99_cum.
    """
    total = F.abs(asum(F.col("ens")))
    cap = F.greatest(F.col("vol"), F.lit(0.005)) * PATH_SIGMA * F.sqrt(F.size("ens").cast("double"))
    cap = F.when(truth(F.col("p99_cum") > 1e-8), F.least(cap, F.col("p99_cum") * 1.2)).otherwise(cap)
    df = df.withColumn("_f", F.when(total > cap, cap / total).otherwise(1.0)).withColumn("guardrail", F.col("_f") < 1.0)
    f = F.col("_f")
    df = df.withColumn("_old", F.col("ens")).withColumns(
        {
            "matrix": F.zip_with(
                "matrix", "ens",
                lambda row, e: F.transform(row, lambda r: r * F.when(F.abs(e) > 1e-12, f).otherwise(1.0)),
            ),
            "ens": F.transform("ens", lambda e: e * f),
        }
    )
    scale = F.coalesce(clip(F.col("vol_regime_encoded"), 0.0, 2.0) * 0.12 + 0.88, F.lit(1.0))
    return _with_prices(df, band, F.when(F.col("guardrail"), 1.0).otherwise(scale)).drop("_f", "_old")


def path_sanity(prices: Column, spot: Column, p99_cum: Column) -> tuple[Column, Column]:
    """Ratio of the path's log move to the historical tail, and whether it is an outlier."""
    move = F.log(F.greatest(F.element_at(prices, -1), F.lit(1e-12)) / spot)
    ratio = F.when(p99_cum > 0, F.abs(move) / p99_cum)
    return ratio, truth(ratio > 1.35)


def quality_signals(ens: Column, prices: Column, raw: Column, models: int, missing: Column, aligned: Column) -> dict[str, Column]:
    """Flat or suspiciously quiet paths and degraded inputs."""
    var_lr = F.coalesce(F.when(F.size(ens) > 1, avar(ens)), F.lit(0.0))
    mean_p = F.abs(amean(prices))
    rel = F.coalesce(avar(prices) / F.greatest(mean_p * mean_p, F.lit(1e-40)), F.lit(0.0))
    quiet_models = F.lit(True)
    for i in range(models):
        quiet_models = quiet_models & (avar(column_of(raw, i)) < 1e-16)
    empty = F.size(ens) <= 0
    constant = empty | ((var_lr < 1e-14) & (rel < 1e-16)) | quiet_models
    quiet = empty | (~constant & ((var_lr < 1e-10) | (rel < 1e-12) | (spread(ens) < 1e-9)))
    return {
        "is_constant_prediction": truth(constant),
        "low_variance_warning": truth(quiet),
        "degraded_input": truth((missing > 0.32) | (aligned & (missing > 0.12))),
        "ensemble_log_return_var": var_lr,
        "price_relative_variance": rel,
    }


# Typed defaults of the path diagnostics.
DIAGNOSTIC_DEFAULTS = {
    "forecast_quality": "degraded",
    "fallback_mode": True,
    "exact_feature_match": False,
    "realism_guardrail_cumulative": False,
    "clip_saturation_step_fraction": 0.0,
    "sanity_extreme": False,
    "is_constant_prediction": False,
    "low_variance_warning": False,
    "degraded_input": False,
    "ensemble_log_return_var": 0.0,
    "price_relative_variance": 0.0,
    "max_missing_feature_fill_ratio": 0.0,
}


# --- agreement ---------------------------------------------------------------------------------


def _sign(x: Column) -> Column:
    return F.when(x > 1e-6, 1).when(x < -1e-6, -1).otherwise(0)


def _step_view(row: Column) -> Column:
    """Deviations, sign shares and score of one step."""

    def view(center: Column) -> Column:
        scale = F.greatest(F.abs(center), amean(F.transform(row, F.abs)), F.lit(0.0025))
        return F.transform(row, lambda r: F.abs(r - center) / scale)

    n = F.size(row).cast("double")
    share = lambda s: count_if(row, lambda x: _sign(x) == s) / n
    return F.struct(
        let(amedian(row), view).alias("dev"), share(1).alias("pos"), share(-1).alias("neg"), row.alias("row")
    )


def with_regression_agreement(df: DataFrame, models: list[str], matrix: str = "matrix") -> DataFrame:
    """Path agreement that forgives one outlying model, with the diverging model named."""
    k = len(models)
    df = df.withColumn("_v", F.transform(matrix, _step_view))

    def score(v: Column) -> Column:
        mag = F.lit(1.0) / (amean(v["dev"]) / 0.85 + 1.0)
        flat = F.greatest(F.lit(0.0), F.lit(1.0) - v["pos"] - v["neg"])
        sign = F.greatest(v["pos"], v["neg"], flat * 0.80)
        mixed = (v["pos"] > 0) & (v["neg"] > 0)
        base = (sign * 0.45 + mag * 0.55) * F.when(mixed, 0.74).otherwise(1.0)
        near = count_if(v["dev"], lambda d: d <= 0.85) / F.size(v["dev"])
        lone = (F.array_max(v["dev"]) >= 1.35) & (near >= 0.34)
        return F.struct(
            bound01(F.when(lone, F.least(F.lit(1.0), base * 1.06)).otherwise(base)).alias("score"),
            sign.alias("sign"), mag.alias("mag"), F.when(mixed, 0.0).otherwise(1.0).alias("same"),
        )

    df = df.withColumn("_s", F.transform("_v", score))
    major = lambda v: F.when((v["pos"] > v["neg"]) & (v["pos"] >= 0.5), 1).when((v["neg"] > v["pos"]) & (v["neg"] >= 0.5), -1).otherwise(0)
    div_scores = []
    for i in range(k):
        dev = amean(F.transform("_v", lambda v: v["dev"][i]))
        off = lambda v: (major(v) != 0) & (_sign(v["row"][i]) != 0) & (_sign(v["row"][i]) != major(v))
        mismatch = count_if(F.col("_v"), off) / F.size("_v")
        hits = count_if(F.col("_v"), lambda v: v["dev"][i] >= F.greatest(F.lit(1.15), F.array_max(v["dev"]) * 0.88)) / F.size("_v")
        s = F.least(F.lit(1.0), dev / 1.25) * 0.62 + mismatch * 0.24 + hits * 0.14
        div_scores.append(F.round(bound01(s), 4))
    df = df.withColumn("model_divergence", F.array(*div_scores))
    top = F.array_max("model_divergence")
    known = top >= 0.26
    name = F.element_at(F.array(*map(F.lit, models)), F.array_position("model_divergence", top).cast("int"))
    mean_of = lambda f: amean(F.transform("_s", lambda s: s[f]))
    return df.withColumns(
        {
            "regression_agreement": F.round(bound01(mean_of("score")), 4),
            "same_sign_fraction": F.round(mean_of("same"), 4),
            "sign_consensus_mean": F.round(mean_of("sign"), 4),
            "magnitude_consensus_mean": F.round(mean_of("mag"), 4),
            "diverging_model": F.when(known, name),
            "diverging_model_score": F.when(known, top).otherwise(0.0),
        }
    ).drop("_v", "_s")


def with_filtered_ensemble(df: DataFrame, models: list[str]) -> DataFrame:
    """Final price without a model that clearly diverges; NULL when none does.

    Needs the columns of with_regression_agreement, matrix, weights, close.
    """
    ranked = F.array_sort("model_divergence")
    second = F.try_element_at(ranked, F.lit(-2))
    worst = F.col("diverging_model_score")
    drop = (F.size("model_divergence") >= 3) & (worst >= 0.56) & ((worst - second >= 0.05) | (worst >= 0.66))
    at = F.array_position(F.array(*map(F.lit, models)), F.col("diverging_model")).cast("int") - 1
    kept = lambda a: F.filter(a, lambda x, i: i != at)
    total = asum(F.transform("matrix", lambda row: weighted_mean(kept(row), kept(F.col("weights")))))
    return df.withColumn("excluded_model", F.when(truth(drop), F.col("diverging_model"))).withColumn(
        "filtered_final", F.when(F.col("excluded_model").isNotNull(), F.col("close") * F.exp(total))
    )


def agreement_trend(scores: Column) -> dict[str, Column]:
    """Whether agreement holds up along the path."""
    last = F.element_at(scores, -1)
    slope = last - F.element_at(scores, 1)
    sd, level = astd(scores), amean(scores)
    stability = bound01(F.lit(1.0) - F.least(F.lit(1.0), sd / 0.18))
    lean = clip(slope / 0.18, -1.0, 1.0) * 0.5 + 0.5
    label = ladder(
        [
            ((slope <= -0.10) | ((last < level - 0.08) & (sd > 0.06)), "collapsing"),
            (slope >= 0.08, "improving"),
            (stability >= 0.72, "stable"),
        ],
        "mixed",
    )
    return {
        "agreement_trend_score": F.round(bound01(stability * 0.5 + lean * 0.3 + level * 0.2), 4),
        "agreement_trend_label": label,
        "agreement_slope": F.round(slope, 4),
        "agreement_stability": F.round(stability, 4),
    }


def combined_agreement(regression: Column, directional: Column) -> Column:
    ra, da = bound01(regression), bound01(directional)
    mix = ra * 0.67 + da * 0.33
    return bound01(
        ladder(
            [
                ((ra >= 0.60) & (da >= 0.60), F.least(F.lit(1.0), mix + F.least(ra, da) * 0.05)),
                ((ra < 0.35) & (da < 0.55), mix * 0.92),
            ],
            mix,
        )
    )


def path_stability(ens: Column) -> Column:
    """High when steps are even and rarely change direction."""
    n = F.size(ens)
    quiet = bound01(F.lit(1.0) - F.least(F.lit(1.0), avar(ens) / 2.5e-4))
    pairs = F.zip_with(F.slice(ens, F.lit(1), n - 1), F.slice(ens, F.lit(2), n - 1), lambda a, b: F.signum(a) * F.signum(b))
    flips = count_if(pairs, lambda p: p < 0)
    steady = bound01(F.lit(1.0) - flips / F.greatest(n - 1, F.lit(1)) * 0.55)
    return F.when(n < 2, 0.55).otherwise(F.round(bound01(quiet * 0.52 + steady * 0.48), 4))


def chaotic_disagreement(matrix: Column) -> tuple[Column, Column]:
    """Share of steps with a strong split in sign, and whether the path counts as chaotic."""
    split = lambda row: (count_if(row, lambda x: x > 0) / F.size(row) >= 0.34) & (count_if(row, lambda x: x < 0) / F.size(row) >= 0.34)
    rows = F.filter(matrix, lambda row: F.size(row) >= 2)
    share = F.coalesce(F.try_divide(count_if(rows, split), F.size(rows).cast("double")), F.lit(0.0))
    return share >= 0.28, F.round(share, 4)


def effective_variance(matrix: Column) -> tuple[Column, Column]:
    """Mean variance across models per step, discounted where they share a sign; and undiscounted."""
    one = lambda row: F.struct(
        avar(row).alias("v"), (F.exists(row, lambda x: x > 0) & F.exists(row, lambda x: x < 0)).alias("mixed")
    )
    views = F.transform(matrix, one)
    eff = amean(F.transform(views, lambda s: s["v"] * F.when(s["mixed"], 1.0).otherwise(0.28)))
    return eff, amean(F.transform(views, lambda s: s["v"]))


def with_consensus(df: DataFrame, direction: str = "direction", confidence: str = "confidence", block: int | None = None) -> DataFrame:
    """Agreement of the one-step directions of the three bars before this one.

    Uses the stored one-step predictions, so nothing is recomputed on cut history.
    """
    df = blocked(df, back=3, block=block)
    past = F.array_compact(
        F.array(*[F.when(lag(direction, k).isNotNull(), F.struct(lag(direction, k).alias("d"), lag(confidence, k).alias("c"))) for k in (3, 2, 1)])
    )
    df = own_rows(df.withColumn("_p", past))
    n = F.size("_p").cast("double")
    of = lambda s: count_if(F.col("_p"), lambda x: F.signum(x["d"]) == s)
    pos, neg, flat = of(1), of(-1), of(0)
    score = ladder(
        [
            (pos == n, 0.92), (neg == n, 0.28), ((pos >= F.greatest(neg, flat)) & (pos >= n - 1), 0.72), (flat == n, 0.38),
        ],
        0.32,
    )
    conf = amean(F.transform("_p", lambda x: F.coalesce(x["c"], F.lit(0.5))))
    return df.withColumn(
        "consensus_score", F.when(n == 0, 0.45).otherwise(F.round(bound01(score * (conf * 0.45 + 0.55)), 4))
    ).drop("_p")


# --- trend -------------------------------------------------------------------------------------

# Trend score bounds and labels.
TREND_STRONG, TREND_MILD = 2.0, 0.5


def trend_label(z: Column) -> Column:
    return ladder(
        [(z >= TREND_STRONG, "STRONG UP"), (z >= TREND_MILD, "UP"), (z <= -TREND_STRONG, "STRONG DOWN"), (z <= -TREND_MILD, "DOWN")],
        "NEUTRAL",
    )


def path_trend_score(prices: Column, spot: Column, vol: Column) -> Column:
    """Cumulative and average drift of the path in units of volatility."""
    cum = F.log(F.greatest(F.element_at(prices, -1), F.lit(1e-30)) / F.greatest(spot, F.lit(1e-30)))
    n = F.size(prices).cast("double")
    v = F.greatest(F.coalesce(vol, F.lit(0.018)), F.lit(1e-6))
    z = cum / F.greatest(v * F.sqrt(n), F.lit(1e-10)) * 0.58 + cum / n / v * 0.42
    return F.when(spot > 0, clip(z, -3.5, 3.5)).otherwise(0.0)


def trend_score(spot: Column, target: Column, vol: Column, return_7d: Column) -> Column:
    """Implied move and recent momentum in units of volatility."""
    v = F.greatest(F.coalesce(vol, F.lit(0.02)), F.lit(1e-8))
    z = (target - spot) / spot / v * 0.65 + F.coalesce(return_7d / v * 0.45, F.lit(0.0))
    return F.when(spot > 0, clip(z, -3.0, 3.0)).otherwise(0.0)


def blend_trend(score: Column, previous: Column, beta: float = 0.52) -> Column:
    """Score pulled towards the previous one."""
    b = max(0.35, min(0.72, beta))
    return F.when(previous.isNotNull(), previous * b + score * (1.0 - b)).otherwise(score)


def volatility_level(vol: Column) -> Column:
    return ladder([(vol.isNull(), "UNKNOWN"), (vol < 0.015, "LOW"), (vol < 0.04, "MEDIUM")], "HIGH")


# --- presentation ------------------------------------------------------------------------------

SNAPSHOT_DAYS = {"1d": 1, "3d": 3, "7d": 7, "14d": 14}


def snapshots(df: DataFrame) -> DataFrame:
    """Price, bounds, return against spot and agreement at fixed steps, one row each."""
    picks = F.array(
        *[
            F.struct(
                F.lit(name).alias("horizon"), F.lit(d).alias("day_index"),
                *[F.try_element_at(c, F.lit(d)).alias(a) for c, a in (("prices", "predicted_price"), ("lower", "lower_bound"), ("upper", "upper_bound"), ("agree", "agreement_score"))],
            )
            for name, d in SNAPSHOT_DAYS.items()
        ]
    )
    rows = df.select("symbol", "bar_no", "close", F.explode(picks).alias("p")).select("symbol", "bar_no", "close", "p.*")
    ret = F.when(F.col("close") > 0, (F.col("predicted_price") - F.col("close")) / F.col("close"))
    return rows.where(F.col("predicted_price").isNotNull()).withColumn("implied_return_vs_spot", F.round(ret, 6)).drop("close")


def path_summary(prices: Column, spot: Column) -> dict[str, Column]:
    final = F.element_at(prices, -1)
    return {
        "final_price": final, "min_price": F.array_min(prices), "max_price": F.array_max(prices), "mean_price": amean(prices),
        "outlook": ladder([(final > spot, "up"), (final < spot, "down")], "flat"),
    }


MAX_STEP, MIN_HALF = 0.08, 0.005


def smooth_prices(prices: Column, anchor: Column) -> Column:
    """Clamp each step to 8 % of the clamped one before it, then average over neighbours."""
    prev = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), anchor)
    step = lambda acc, p: F.concat(acc, F.array(clip(p, prev(acc) * (1.0 - MAX_STEP), prev(acc) * (1.0 + MAX_STEP))))
    clamped = F.when(anchor > 0, F.aggregate(prices, F.array().cast("array<double>"), step)).otherwise(prices)

    def mean3(a: Column) -> Column:
        n = F.size(a)
        around = lambda i: F.slice(a, F.greatest(i, F.lit(1)), F.least(i + 2, n) - F.greatest(i, F.lit(1)) + 1)
        return F.when(n < 2, a).otherwise(F.transform(a, lambda x, i: amean(around(i))))

    return let(clamped, mean3)


def recentred_bounds(mid: Column, lower: Column, upper: Column, spot: Column, atr: Column, vol: Column, agreement: Column) -> Column:
    """Per step struct(lower, mid, upper): bounds around the smoothed mid, wide enough for
    volatility and disagreement, and in order."""
    v = F.coalesce(vol, F.lit(0.02))
    mult = F.least(F.lit(2.0), v / 0.02) * 0.35 + 1.0
    doubt = ladder([(agreement < 0.45, 1.35), (agreement < 0.55, 1.15)], 1.0)

    def one(x: Column, i: Column) -> Column:
        c = F.when(spot > 0, spot).otherwise(F.greatest(F.abs(x["m"]), F.lit(1.0)))
        day = F.sqrt((i + 1).cast("double"))
        atr_part = F.when(atr > 0, atr * day * mult * 1.5).otherwise(0.0)
        vol_part = c * F.greatest(v, F.lit(1e-6)) * day * mult * 1.25
        half = F.greatest((x["hi"] - x["lo"]) / 2.0, F.abs(x["m"]) * 0.004, atr_part, vol_part, c * MIN_HALF) * doubt
        half = F.greatest(half, F.abs(x["m"]) * MIN_HALF)
        return F.struct((x["m"] - half).alias("lower"), x["m"].alias("mid"), (x["m"] + half).alias("upper"))

    packed = F.transform(F.arrays_zip(mid.alias("m"), lower.alias("lo"), upper.alias("hi")), one)
    return F.transform(packed, sane_bounds)


def sane_bounds(b: Column) -> Column:
    """lower < mid < upper with a least separation."""
    eps = F.greatest(F.abs(b["mid"]) * MIN_HALF, F.lit(1e-8))
    bad = b["lower"] >= b["upper"]
    lo, hi = F.when(bad, b["mid"] - eps).otherwise(b["lower"]), F.when(bad, b["mid"] + eps).otherwise(b["upper"])
    mid = F.when((b["mid"] <= lo) | (b["mid"] >= hi), (lo + hi) / 2.0).otherwise(b["mid"])
    return F.struct(lo.alias("lower"), mid.alias("mid"), hi.alias("upper"))


def scaled_members(model_prices: Column, old_mid: Column, new_mid: Column) -> Column:
    """Member prices moved with the smoothed path."""
    ratio = F.when(F.abs(old_mid) < 1e-18, 1.0).otherwise(new_mid / old_mid)
    return F.transform(model_prices, lambda p: p * ratio)


def relative_spread(row: Column) -> Column:
    """(max - min) / mean |x| of the members at one step; NULL when it says nothing."""
    m = amean(F.transform(row, F.abs))
    return F.when((F.size(row) >= 2) & (m >= 1e-12), spread(row) / m)


def mean_relative_spread(member_prices: Column) -> Column:
    """Average spread over the path, 0.1 when no step has one."""
    return F.coalesce(amean(F.array_compact(F.transform(member_prices, relative_spread))), F.lit(0.1))


def final_relative_spread(member_prices: Column) -> Column:
    """Spread at the last step; 0 with fewer than two members, 1 when they vanish."""
    row = F.element_at(member_prices, -1)
    return F.when(F.size(row) < 2, 0.0).otherwise(F.coalesce(relative_spread(row), F.lit(1.0)))


def member_prices(matrix: Column, spot: Column, models: int) -> Column:
    """Price of every member at every step."""
    cums = [cumsum(column_of(matrix, i)) for i in range(models)]
    return F.transform(
        F.sequence(F.lit(0), F.size(matrix) - 1),
        lambda s: F.array(*[spot * F.exp(c[s]) for c in cums]),
    )


def blend_paths(new: Column, old: Column, alpha: float = 0.58) -> Column:
    """New path pulled towards the published one of the same length."""
    a = max(0.35, min(0.85, alpha))
    return F.when(F.size(old) == F.size(new), F.zip_with(new, old, lambda n, o: n * a + o * (1.0 - a))).otherwise(new)


def forecast_validity(d: dict[str, Column]) -> tuple[Column, Column]:
    """valid / questionable / invalid and a 0-1 quality score from path diagnostics."""
    constant = truth(d["is_constant_prediction"])
    quiet, degraded = truth(d["low_variance_warning"]), truth(d["degraded_input"])
    tier = F.coalesce(d["artifact_mode"], F.lit("production"))
    # Base score by tier and penalties.
    base = ladder([(tier == "legacy", 0.22), (tier == "degraded", 0.48)], 0.82)
    off = lambda c, p: F.when(c, p).otherwise(0.0)
    q = bound01(
        base - off(quiet, 0.12) - off(degraded, 0.14) - off(truth(d["guardrail"]), 0.08)
        - off(truth(d["sanity_extreme"]), 0.1) - off(truth(d["clip_saturation"] > 0.35), 0.1)
    )
    label = ladder([(constant | (q < 0.25), "invalid"), ((q < 0.55) | quiet | degraded, "questionable")], "valid")
    return label, F.when(constant, 0.08).otherwise(F.round(q, 4))
