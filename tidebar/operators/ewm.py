"""Exponentially weighted mean and standard deviation as window expressions.

``y[t] = c y[t-1] + (1-c) x[t]`` with ``c = q^g / (q^g + a)``, ``q = 1-a``, where g counts the bars
since the last observation (1 without gaps, where c is q).  A missing observation repeats the last
value and ages it, as in the usual definition without bias adjustment.

Inside runs of ``RUN`` bars this is one growing sum of ``(1-c) x`` over the product of the c so far;
what earlier runs contribute is their end value times the products of the runs between.  A block
holds ``back`` bars before its own; older ones must weigh less than the rounding of a double, and
``halo`` gives the number of bars for which they do.  Requests that need more than the block holds
are refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidebar.operators.layout import RUN

WARMUP = 1280
LIGHT = 1e-17  # share of a value that is lost in the rounding of a double


@dataclass(frozen=True)
class Ewm:
    """Smoothing request: input column, weight, first bar that has a value."""

    source: str
    alpha: float
    start: int = 1


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def halo(*alphas: float) -> int:
    """Bars before a block that smoothing with these weights needs."""
    return max(WARMUP, math.ceil(math.log(LIGHT) / math.log(1.0 - min(alphas))))


def with_ewm(df: DataFrame, requests: dict[str, Ewm], back: int = WARMUP) -> DataFrame:
    """Add one smoothed column per request; df is ``blocked`` with at least ``back`` bars before.

    Observations older than ``back`` bars are left out, which is exact while fewer than that many
    bars in a row are missing.
    """
    need = halo(*[r.alpha for r in requests.values()])
    if need > back:
        raise ValueError(f"smoothing needs {need} bars before a block, the layout has {back}")
    if min(1.0 - r.alpha for r in requests.values()) ** RUN < 1e-290:
        raise ValueError("smoothing weight too large: its powers over a run leave the range of a double")
    block = W.partitionBy("symbol", "_blk").orderBy("_run", "bar_no")
    run = W.partitionBy("symbol", "_blk", "_run").orderBy("bar_no").rowsBetween(W.unboundedPreceding, 0)
    runs = W.partitionBy("symbol", "_blk").orderBy("_run")
    # observed values and the bars since the one before, once per input
    inputs = sorted({(r.source, r.start) for r in requests.values()})
    tag = {key: i for i, key in enumerate(inputs)}
    seen = {f"_x{i}": F.when(F.col("bar_no") >= start, F.col(source).cast("double")) for (source, start), i in tag.items()}
    df = df.withColumns(seen)
    gaps = {}
    for i in tag.values():
        held = F.when(F.col(f"_x{i}").isNotNull() & ~F.isnan(f"_x{i}"), F.col("bar_no"))
        gaps[f"_g{i}"] = F.when(held.isNotNull(), F.col("bar_no") - F.last(held, ignorenulls=True).over(block.rowsBetween(W.unboundedPreceding, -1)))
        gaps[f"_h{i}"] = F.last(held, ignorenulls=True).over(block.rowsBetween(W.unboundedPreceding, 0)).isNotNull()
    df = df.withColumns(gaps)
    # log of c: 0 on a missing observation and on the first one
    kinds = sorted({(tag[r.source, r.start], r.alpha) for r in requests.values()})
    kind = {key: n for n, key in enumerate(kinds)}
    log_c = {}
    for (i, alpha), n in kind.items():
        g = F.col(f"_g{i}")
        aged = F.pow(F.lit(1.0 - alpha), g.cast("double"))
        log_c[f"_c{n}"] = F.when(g == 1, math.log(1.0 - alpha)).when(g > 1, F.log(F.try_divide(aged, aged + alpha))).otherwise(0.0)
    df = df.withColumns(log_c)
    df = df.withColumns({f"_sum{n}": F.sum(f"_c{n}").over(run) for n in kind.values()})
    local = {}
    for (i, _), n in kind.items():
        first = F.col(f"_g{i}").isNull()
        term = F.when(F.isnan(f"_x{i}"), None).otherwise(F.col(f"_x{i}")) * F.when(first, 1.0).otherwise(1.0 - F.exp(f"_c{n}"))
        local[f"_l{n}"] = F.coalesce(F.sum(term * F.exp(-F.col(f"_sum{n}"))).over(run), F.lit(0.0)) * F.exp(f"_sum{n}")
    df = df.withColumns(local)
    last = (F.col("bar_no") - 1) % RUN == RUN - 1
    full = {}
    for (i, alpha), n in kind.items():
        carry, between = F.lit(0.0), F.lit(0.0)
        for m in range(1, -(-back // RUN) + 1):
            if (1.0 - alpha) ** (RUN * (m - 1)) < LIGHT and not _sparse(m):
                break
            end = lambda c, m=m: F.coalesce(F.max(F.when(last, F.col(c))).over(runs.rangeBetween(-m, -m)), F.lit(0.0))
            carry = carry + end(f"_l{n}") * F.exp(between)
            between = between + end(f"_sum{n}")
        full[f"_v{n}"] = F.when(F.col(f"_h{i}"), F.col(f"_l{n}") + carry * F.exp(f"_sum{n}"))
    df = df.withColumns(full)
    out = {name: F.col(f"_v{kind[tag[r.source, r.start], r.alpha]}") for name, r in requests.items()}
    return df.withColumns(out).drop(*seen, *gaps, *log_c, *[f"_sum{n}" for n in kind.values()], *local, *full)


def _sparse(m: int) -> bool:
    """Missing observations don't age what came before them, so the nearest runs always count."""
    return m <= -(-WARMUP // RUN)


def ewm_std(mean: Column, mean_sq: Column, alpha: float, start: int) -> Column:
    """Bias-corrected deviation from the smoothed x and the smoothed x squared (inputs without gaps)."""
    q = 1.0 - alpha
    k = F.col("bar_no") - start
    q2k = F.pow(F.lit(q * q), k.cast("double"))
    weight = q2k + (F.lit(1.0) - q2k) * (alpha * alpha / (1.0 - q * q))
    var = F.greatest(mean_sq - mean * mean, F.lit(0.0))
    return F.when(k >= 1, F.sqrt(F.try_divide(var, F.lit(1.0) - weight)))
