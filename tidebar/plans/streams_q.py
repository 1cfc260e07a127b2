"""Queries that run a stream over a whole table and read its result back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from tidebar.operators.ewm import WARMUP, Ewm, with_ewm
from tidebar.operators.layout import blocked, own_rows
from tidebar.plans.features_q import day_col
from tidebar.plans.registry import query
from tidebar.plans.signals_q import DECISION_SQL, SIGNALS_SQL
from tidebar.plans.tables import EVENT_TICKS, bars_cte, event_ticks, ew, numbered, prev
from tidebar.plans.trades_q import RULE_SQL, rule_signals
from tidebar.session import cut_lineage, shared_folder
from tidebar.streaming import flows


def as_stream(spark, df):
    """The rows as a file stream in one batch, for flows that do not depend on arrival order."""
    path = f"{shared_folder(spark)}/tidebar/source-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return flows.file_stream(spark, df.schema, path)


PARTS, FILES = 4, 4  # micro-batches of a replayed table at least, files per batch
BATCH_ROWS = 20_000  # rows that one symbol may bring in a micro-batch


def as_daily_stream(spark, df):
    """The rows as a file stream whose batches follow each other in time: equal spans of days."""
    path = f"{shared_folder(spark)}/tidebar/source-{uuid.uuid4().hex}"
    df = cut_lineage(df.withColumn("_day", F.datediff(F.col("bar_ts"), F.lit("1970-01-01"))))
    # rows of the busiest symbol a day, so that no batch brings more than BATCH_ROWS of one symbol
    # (a single day is not cut: it is the unit in which decisions may not be reordered)
    days = cut_lineage(df.groupBy("_day", "symbol").agg(F.count("*").alias("n")).groupBy("_day").agg(F.max("n").alias("n")))
    before = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(W.unboundedPreceding, -1))
    total = days.agg(F.sum("n")).first()[0] or 1
    size = max(1, min(BATCH_ROWS, -(-total // PARTS)))
    part = days.select("_day", F.floor(F.coalesce(before, F.lit(0)) / size).cast("int").alias("_batch"))
    df = cut_lineage(df.join(F.broadcast(part), "_day"))  # a row per day
    for r in part.select("_batch").distinct().orderBy("_batch").collect():
        df.where(F.col("_batch") == r["_batch"]).drop("_day", "_batch").repartition(FILES).write.mode("append").parquet(path)
    return flows.file_stream(spark, df.drop("_day", "_batch").schema, path, FILES)


@query(
    "stream_bars", "P5",
    f"""WITH {bars_cte('hour')}, w AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM ticks) SELECT symbol, bar_ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume
FROM bars, w WHERE bar_ts + INTERVAL 1 HOUR <= mark""",
)
def stream_bars(spark, sf):
    b = flows.run_to_table(flows.stream_bars(as_stream(spark, event_ticks(spark, sf))))
    return b.select("symbol", "bar_ts", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("stream_dedupe", "P6", f"WITH {EVENT_TICKS} SELECT seq, symbol, round(price, 6) AS price FROM ticks")
def stream_dedupe(spark, sf):
    t = event_ticks(spark, sf)
    d = flows.run_to_table(flows.stream_dedupe(as_stream(spark, t.unionByName(t)), ["seq"]))
    return d.select("seq", "symbol", F.round("price", 6).alias("price"))


@query("stream_freshness", "P4 J11", f"WITH {EVENT_TICKS} SELECT symbol, max(ts) AS latest_ts FROM ticks GROUP BY 1")
def stream_freshness(spark, sf):
    return flows.run_to_table(flows.stream_freshness(as_stream(spark, event_ticks(spark, sf))), "complete")


@query(
    "stream_cooldown", "P1",
    f"""WITH RECURSIVE {bars_cte()}, {RULE_SQL}, st AS (SELECT s.symbol, s.n, s.bar_ts, (SELECT min(u.n) FROM sig u WHERE u.symbol = s.symbol AND u.decision IN ('STRONG_BUY', 'WEAK_BUY') AND u.bar_ts > s.bar_ts + INTERVAL 3 DAY) AS nx FROM sig s WHERE decision IN ('STRONG_BUY', 'WEAK_BUY')),
acc(symbol, n) AS (SELECT symbol, min(n) FROM st GROUP BY 1 UNION ALL SELECT a.symbol, s.nx FROM acc a JOIN st s ON s.symbol = a.symbol AND s.n = a.n WHERE s.nx IS NOT NULL),
bl AS (SELECT DISTINCT b.symbol, b.n FROM acc a JOIN st s ON s.symbol = a.symbol AND s.n = a.n JOIN sig b ON b.symbol = a.symbol AND b.bar_ts > s.bar_ts AND b.bar_ts <= s.bar_ts + INTERVAL 3 DAY)
SELECT s.symbol, s.bar_ts::DATE AS bar_day, bl.n IS NOT NULL AS blocked, CASE WHEN bl.n IS NOT NULL THEN 'NO_TRADE' ELSE s.decision END AS decision FROM sig s LEFT JOIN bl ON bl.symbol = s.symbol AND bl.n = s.n""",
)
def stream_cooldown(spark, sf):
    d = rule_signals(numbered(spark, sf)).select("symbol", "bar_ts", "decision")
    return flows.run_to_table(flows.stream_cooldown(as_daily_stream(spark, d), 3)).select("symbol", day_col(), "blocked", "decision")


@query(
    "stream_idle_share", "P2",
    f"""WITH {bars_cte()}, {RULE_SQL}, q AS (SELECT *, (decision = 'NO_TRADE')::INT::DOUBLE AS idle FROM sig) SELECT symbol, bar_ts::DATE AS bar_day, round(coalesce({prev('avg', 'idle', 96, 10)}, 0), 6) AS recent_no_trade_fraction FROM q""",
)
def stream_idle_share(spark, sf):
    d = rule_signals(numbered(spark, sf)).select("symbol", "bar_ts", "decision")
    s = flows.run_to_table(flows.stream_idle_share(as_daily_stream(spark, d)))
    return s.select("symbol", day_col(), F.round("recent_no_trade_fraction", 6).alias("recent_no_trade_fraction"))


@query(
    "stream_trend_memory", "P3 L20",
    f"""WITH {bars_cte('week')}, s AS (SELECT *, close / 1e5 AS score FROM bars) SELECT symbol, bar_ts::DATE AS bar_day, round({ew('score', 0.48)}, 6) AS trend_score FROM s""",
)
def stream_trend_memory(spark, sf):
    d = numbered(spark, sf, "week").select("symbol", "bar_ts", (F.col("close") / 1e5).alias("score"))
    s = flows.run_to_table(flows.stream_trend_memory(as_daily_stream(spark, d)))
    return s.select("symbol", day_col(), F.round("trend_score", 6).alias("trend_score"))


@query(
    "trend_memory", "L20 P3",
    f"""WITH {bars_cte('week')}, s AS (SELECT *, close / 1e5 AS score FROM bars) SELECT symbol, bar_ts::DATE AS bar_day, round({ew('score', 0.48)}, 6) AS trend_score FROM s""",
)
def trend_memory(spark, sf):
    d = blocked(numbered(spark, sf, "week"), back=WARMUP).withColumn("score", F.col("close") / 1e5)
    s = own_rows(with_ewm(d, {"trend_score": Ewm("score", 0.48)}))
    return s.select("symbol", day_col(), F.round("trend_score", 6).alias("trend_score"))
