"""How a long table of bars is split over tasks.

``symbol`` alone is never a partition key for a window: one symbol may hold a third of all
bars.  Bars are numbered per symbol (``bar_no`` from 1), cut into blocks of ``BLOCK`` bars, and
every block also receives the neighbouring bars its windows look at (the halo).  All windows
then run over ``(symbol, _blk)``, so one shuffle serves every look-back and look-ahead
expression of an operator and the largest group is ``BLOCK + back + ahead`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 8192
RUN = 512
CHUNK_ROWS = 2048


def chunk_width(rows: DataFrame, keys: list[str] | None = None, ts: str = "bar_ts") -> int:
    """Seconds that hold about ``CHUNK_ROWS`` rows of the densest key (keys: symbol, or none for all)."""
    sec = F.unix_timestamp(F.col(ts).cast("timestamp"))
    spans = rows.groupBy(*(["symbol"] if keys is None else keys)).agg(F.countDistinct(sec).alias("n"), (F.max(sec) - F.min(sec)).alias("s"))
    width = spans.agg(F.min(F.ceil(F.col("s") * CHUNK_ROWS / F.greatest("n", F.lit(1))))).first()[0]
    return max(1, int(width or 1))


def number_bars(bars: DataFrame, chunk_seconds: int | None = None) -> DataFrame:
    """Add ``bar_no``: the 1-based position of a bar within its symbol.

    Positions inside a time chunk come from a window over ``(symbol, chunk)``; the offset of a
    chunk is a running total over the table of chunk counts (a few rows per symbol: bars are
    unique per timestamp, so their number is bounded by time, and each chunk row stands for up
    to 2048 bars).  ``chunk_seconds`` should be about 2048 bar lengths; without it the width is
    taken from the density of the bars.
    """
    if chunk_seconds is None:
        chunk_seconds = chunk_width(bars)
    keyed = bars.withColumn(
        "_chunk", F.floor(F.unix_timestamp(F.col("bar_ts").cast("timestamp")) / chunk_seconds)
    )
    sizes = keyed.groupBy("symbol", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("symbol").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select(
        "symbol", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    pos = F.row_number().over(W.partitionBy("symbol", "_chunk").orderBy("bar_ts"))
    return (
        keyed.withColumn("_pos", pos)
        .join(base, ["symbol", "_chunk"])
        .withColumn("bar_no", F.col("_base") + F.col("_pos"))
        .drop("_chunk", "_base", "_pos")
    )


def blocked(df: DataFrame, back: int = 0, ahead: int = 0, block: int | None = None) -> DataFrame:
    """Send each bar to its own block and to the blocks whose windows reach it."""
    size = block or BLOCK
    n = F.col("bar_no") - 1
    first = F.greatest(F.floor((n - ahead) / size), F.lit(0).cast("bigint"))
    last = F.floor((n + back) / size)
    return df.withColumn("_blk", F.explode(F.sequence(first, last))).withColumns(
        {"_own": F.col("_blk") == F.floor(n / size), "_run": F.floor(n / RUN)}
    )


def own_rows(df: DataFrame) -> DataFrame:
    """Keep each bar once, in its own block, and forget the layout."""
    return df.where("_own").drop("_own", "_blk", "_run")


def order() -> W:
    """Bar order within a block.

    ``_run`` (a coarse bar number) leads so that the smoothing windows, which group by it, find
    their rows already sorted: one sort serves every window of an operator.
    """
    return W.partitionBy("symbol", "_blk").orderBy("_run", "bar_no")


def lag(c: Column | str, n: int = 1) -> Column:
    return F.lag(c, n).over(order())


def lead(c: Column | str, n: int = 1) -> Column:
    return F.lead(c, n).over(order())


def rolling(fn, c: Column | str, n: int, min_periods: int | None = None) -> Column:
    """Aggregate over this bar and the n-1 before it; NULL with fewer observations."""
    return _framed(fn, c, order().rowsBetween(-(n - 1), 0), n if min_periods is None else min_periods)


def trailing(fn, c: Column | str, n: int, min_periods: int | None = None) -> Column:
    """Aggregate over the n bars before this one."""
    return _framed(fn, c, order().rowsBetween(-n, -1), n if min_periods is None else min_periods)


def _framed(fn, c, frame, min_periods):
    value = fn(c).over(frame)
    if min_periods <= 1:
        return value
    return F.when(F.count(c).over(frame) >= min_periods, value)
