"""Streaming bars, de-duplication, freshness and keyed decision state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebar.session import shared_folder


def file_stream(spark: SparkSession, schema, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A directory of parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_bars(ticks: DataFrame, length: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Tumbling bars; a bar is emitted once the watermark passes its end, later ticks are dropped.

    The bars of the last ``lateness`` of a finite source are therefore never emitted.  Ticks with
    equal times are ordered by ``seq`` where the source has it.
    """
    at = F.struct(*[c for c in ("ts", "seq") if c in ticks.columns])
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", length))
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", at).alias("close"), F.sum("size").cast("double").alias("volume"),
        )
        .select("symbol", F.col("window.start").alias("bar_ts"), "open", "high", "low", "close", "volume")
    )


def stream_dedupe(rows: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "2 hours") -> DataFrame:
    """First record per key within the watermark."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def stream_freshness(ticks: DataFrame) -> DataFrame:
    """Newest event time per symbol (one state row per symbol)."""
    return ticks.groupBy("symbol").agg(F.max("ts").alias("latest_ts"))


# --- keyed decision state ----------------------------------------------------------------------------
# What a symbol brings in one micro-batch (bounded by the trigger) is put in time order and worked
# on by column; a small state goes on to the next batch.  Batches must arrive in time order.
# Back-fills use the batch forms instead.


def _apply(rows: DataFrame, step: Callable, out: str, state: str) -> DataFrame:
    """``step(state or None, frame in time order) -> (state, result columns)`` per symbol and batch."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames), ignore_index=True).sort_values("bar_ts", kind="stable", ignore_index=True)
        memory, columns = step(held.get if held.exists else None, frame)
        held.update(memory)
        yield pd.DataFrame({"symbol": key[0], "bar_ts": frame.bar_ts, **columns})[names]

    return rows.groupBy("symbol").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def stream_cooldown(decisions: DataFrame, days: int = 3) -> DataFrame:
    """Block decisions until ``days`` after a strong or weak buy that was let through.

    Only accepted buys are stepped through: each one leads to the next by a search in the sorted days.
    """
    wait = max(1, min(14, days))

    def step(state, f):
        day = f.bar_ts.dt.normalize().to_numpy().astype("datetime64[D]").astype(np.int64)
        buys = np.flatnonzero(f.decision.isin(["STRONG_BUY", "WEAK_BUY"]).to_numpy())
        until = -(1 << 40) if state is None or state[0] is None else state[0]
        blocked = day <= until
        at = int(np.searchsorted(day[buys], until, "right"))
        while at < len(buys):
            row = int(buys[at])
            until = int(day[row]) + wait
            stop = int(np.searchsorted(day, until, "right"))
            blocked[row + 1 : stop] = True
            at = int(np.searchsorted(buys, max(stop, row + 1), "left"))
        return (until,), {"blocked": blocked, "decision": f.decision.mask(blocked, "NO_TRADE")}

    return _apply(decisions, step, "symbol string, bar_ts timestamp, blocked boolean, decision string", "until bigint")


def stream_idle_share(decisions: DataFrame, window: int = 96, least: int = 10) -> DataFrame:
    """Share of NO_TRADE among the last ``window`` decisions, read before the current one is recorded."""

    def step(state, f):
        past = list(state[0]) if state is not None else []
        idle = pd.Series(past + (f.decision == "NO_TRADE").astype(int).tolist(), dtype=float)
        share = idle.rolling(window, min_periods=least).mean().shift(1).fillna(0.0)
        return (idle.tail(window).astype(int).tolist(),), {"recent_no_trade_fraction": share.to_numpy()[len(past) :]}

    return _apply(decisions, step, "symbol string, bar_ts timestamp, recent_no_trade_fraction double", "past array<int>")


def stream_trend_memory(scores: DataFrame, beta: float = 0.52) -> DataFrame:
    """Trend score pulled towards the last published one, which the result replaces."""
    b = max(0.35, min(0.72, beta))

    def step(state, f):
        known = [state[0]] if state is not None else []
        z = pd.Series(known + f.score.tolist(), dtype=float).ewm(alpha=1.0 - b, adjust=False).mean().to_numpy()
        return (float(z[-1]),), {"trend_score": z[len(known) :]}

    return _apply(scores, step, "symbol string, bar_ts timestamp, trend_score double", "last double")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is available and read the result back from the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/tidebar/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
