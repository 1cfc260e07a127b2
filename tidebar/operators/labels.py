"""Forward-looking labels and targets; an unknown future is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidebar.functions.nulls import clip, div
from tidebar.operators.layout import blocked, lead, own_rows, rolling
from tidebar.operators.quantiles import exact_quantiles


def forward_return(c: str, h: int) -> Column:
    return div(lead(c, h), F.col(c)) - 1.0


def next_log_return(bars: DataFrame, block: int | None = None) -> DataFrame:
    """Log return of the next bar."""
    y = F.log(clip(div(lead("close"), F.col("close")), lo=1e-12))
    return own_rows(blocked(bars, ahead=1, block=block).withColumn("target_log_return_1d", y))


def forward_label(bars: DataFrame, horizon: int, threshold: float, block: int | None = None) -> DataFrame:
    """1 above +threshold, 0 below -threshold, NULL between; the last ``horizon`` bars are dropped."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    df = blocked(bars, ahead=horizon, block=block).withColumns(
        {"_f": forward_return("close", horizon), "_known": lead("bar_no", horizon).isNotNull()}
    )
    label = F.when(F.col("_f") > threshold, 1).when(F.col("_f") < -threshold, 0)
    return own_rows(df.where("_known").withColumn("label", label)).drop("_f", "_known")


def directional_forward_label(bars: DataFrame, horizon: int = 5, up: float = 0.005, down: float = -0.005, block: int | None = None) -> DataFrame:
    """0 down, 1 neutral, 2 up by the return over ``horizon`` bars; NULL if it cannot be known."""
    df = blocked(bars, ahead=horizon, block=block).withColumn("_next", lead("close", horizon))
    r = div(F.col("_next"), F.col("close")) - 1.0
    valid = (F.col("close") > 0) & (F.col("_next") > 0)
    label = F.when(valid, F.when(r > up, 2).when(r < down, 0).otherwise(1))
    return own_rows(df.withColumn("direction", label)).drop("_next")


def direction_of_log_return(x: Column, eps: float = 0.0008) -> Column:
    """0 down, 1 neutral, 2 up."""
    return F.when(x > eps, 2).when(x < -eps, 0).when(x.isNotNull(), 1)


def cross_sectional_label(bars: DataFrame, horizon: int = 5, compat: bool = False, block: int | None = None) -> DataFrame:
    """1 when the forward return beats the median of all symbols at that time.

    ``compat`` labels an unknown future 0 instead of NULL.
    """
    fwd = own_rows(
        blocked(bars, ahead=horizon, block=block).withColumn("fwd_return", forward_return("close", horizon))
    )
    mid = exact_quantiles(fwd, ["bar_ts"], "fwd_return", {"median_return": 0.5})
    beat = (F.col("fwd_return") > F.col("median_return")).cast("int")
    label = F.coalesce(beat, F.lit(0)) if compat else beat
    return fwd.join(mid, "bar_ts", "left").withColumn("label", label)


def big_move_label(bars: DataFrame, horizon: int = 3, size: float = 0.03, compat: bool = False, block: int | None = None) -> DataFrame:
    """1 when the absolute forward return exceeds ``size``."""
    big = (F.abs(forward_return("close", horizon)) > size).cast("int")
    label = F.coalesce(big, F.lit(0)) if compat else big
    return own_rows(blocked(bars, ahead=horizon, block=block).withColumn("label", label))


def tail_statistics(bars: DataFrame, block: int | None = None) -> DataFrame:
    """99th percentiles of |log return| and of its 14-bar sums, for symbols with enough rows."""
    from tidebar.operators.layout import lag

    df = blocked(bars, back=16, block=block).withColumn(
        "_r", F.log(clip(div(F.col("close"), lag("close")), lo=1e-12))
    )
    df = own_rows(df.withColumn("_s", F.abs(rolling(F.sum, "_r", 14, 7))).withColumn("_a", F.abs("_r")))
    n = df.groupBy("symbol").agg(F.count("_a").alias("n_ret"), F.count("_s").alias("n_cum"))
    p1 = exact_quantiles(df, ["symbol"], "_a", {"p99_daily": 0.99})
    p14 = exact_quantiles(df, ["symbol"], "_s", {"p99_cum": 0.99})
    return n.join(p1, "symbol", "left").join(p14, "symbol", "left").select(
        "symbol",
        F.when(F.col("n_ret") > 80, F.col("p99_daily")).alias("p99_daily"),
        F.when(F.col("n_cum") > 40, F.col("p99_cum")).alias("p99_cum"),
    )
