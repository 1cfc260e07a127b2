"""The test tables as ticks and bars, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebar.operators.layout import number_bars
from tidebar.session import cut_lineage, utc
from tidebar.sources.bars import bars_from_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("symbol"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("price"),
        F.lit(1).cast("bigint").alias("size"),
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("value") > 0)
    return e.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.lit(1).cast("bigint").alias("size"),
    )


CHUNKS = {"day": 2048 * 86400, "week": 2048 * 604800, "hour": 2048 * 3600}


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(order_ticks(spark, sf_dir), "day", tie="seq")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(order_ticks(spark, sf_dir), "week", tie="seq")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(event_ticks(spark, sf_dir), "hour", tie="seq")


def numbered(spark: SparkSession, sf_dir: str, freq: str = "day") -> DataFrame:
    bars = {"day": daily, "week": weekly, "hour": hourly}[freq](spark, sf_dir)
    return cut_lineage(number_bars(cut_lineage(bars), CHUNKS[freq]))


ORDER_TICKS = """ticks AS (SELECT c_mktsegment AS symbol, o_orderdate AS ts, o_orderkey AS seq,
  o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey)"""
EVENT_TICKS = """ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price
  FROM events WHERE value > 0)"""


def bars_cte(freq: str = "day") -> str:
    """``ticks`` and ``bars`` (with ``n``, the bar number) as CTE text, without WITH."""
    ticks = EVENT_TICKS if freq == "hour" else ORDER_TICKS
    return f"""{ticks},
raw_bars AS (SELECT symbol, date_trunc('{freq}', ts)::TIMESTAMP AS bar_ts,
  first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, seq) AS close, count(*)::DOUBLE AS volume FROM ticks GROUP BY ALL),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n FROM raw_bars)"""


def ew(x: str, alpha: float, start: int = 1, n: str = "n", key: str = "symbol") -> str:
    """Exponentially weighted mean as a closed-form running sum (short test series only)."""
    q = 1.0 - alpha
    return (
        f"(CASE WHEN {n} >= {start} THEN pow({q!r}, {n}-{start}) * sum(CASE WHEN {n}={start} THEN {x} "
        f"WHEN {n}>{start} THEN {alpha!r}*({x}) END * pow({q!r}, {start}-{n})) "
        f"OVER (PARTITION BY {key} ORDER BY {n} ROWS UNBOUNDED PRECEDING) END)"
    )


def roll(fn: str, x: str, n: int, least: int | None = None, key: str = "symbol", end: str = "CURRENT ROW") -> str:
    """Rolling aggregate with a minimum number of observations."""
    least = n if least is None else least
    start = n if end != "CURRENT ROW" else n - 1
    over = f"OVER (PARTITION BY {key} ORDER BY n ROWS BETWEEN {start} PRECEDING AND {end})"
    return f"(CASE WHEN count({x}) {over} >= {least} THEN {fn}({x}) {over} END)"


def prev(fn: str, x: str, n: int, least: int | None = None) -> str:
    """Rolling aggregate over the n rows before this one."""
    return roll(fn, x, n, least, end="1 PRECEDING")


def lagged(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY n)"


def led(x: str, k: int) -> str:
    return f"lead({x}, {k}) OVER (PARTITION BY symbol ORDER BY n)"
