"""Exact quantiles per key without gathering a key in one task.

The wanted order statistics are narrowed twice through ``BINS`` equal bins between the known
least and greatest candidate (bin counts combine before the shuffle), then read off the sorted
distinct values of the one bin that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidebar.session import cut_lineage

BINS = 4096


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], rounds: int = 2) -> DataFrame:
    """One row per key with linearly interpolated quantiles (name -> probability)."""
    x = cut_lineage(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x")))
    stats = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")
    )
    # every probability asks for the two neighbouring ranks (0-based) around its position
    wants = F.array(
        *[
            F.struct(
                F.lit(name).alias("q"),
                F.lit(side).alias("side"),
                (F.floor if side == 0 else F.ceil)((F.col("_cnt") - 1) * F.lit(float(p))).alias("rank"),
            )
            for name, p in probs.items()
            for side in (0, 1)
        ]
    )
    target = stats.withColumn("_w", F.explode(wants)).select(
        *keys, "_cnt", "_lo", "_hi", F.col("_w.q").alias("_q"), F.col("_w.side").alias("_side"), F.col("_w.rank").alias("_rank")
    )
    tkeys = [*keys, "_q", "_side"]
    for _ in range(rounds):
        width = F.col("_hi") - F.col("_lo")
        where = F.when(width <= 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col("_x") - F.col("_lo")) * (BINS / width)), F.lit(BINS - 1))
        )
        binned = (
            x.join(target, keys)
            .where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
            .groupBy(*tkeys, where.alias("_bin"))
            .agg(
                F.first("_rank").alias("_rank"), F.first("_cnt").alias("_cnt"),
                F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
            )
        )
        cum = F.sum("_n").over(W.partitionBy(*tkeys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
        target = cut_lineage(
            binned.withColumn("_cum", cum)
            .where((F.col("_rank") < F.col("_cum")) & (F.col("_rank") >= F.col("_cum") - F.col("_n")))
            .select(*keys, "_cnt", "_lo", "_hi", "_q", "_side", (F.col("_rank") - (F.col("_cum") - F.col("_n"))).alias("_rank"))
        )
    counts = (
        x.join(target, keys)
        .where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
        .groupBy(*tkeys, "_x")
        .agg(F.count(F.lit(1)).alias("_n"), F.first("_rank").alias("_rank"), F.first("_cnt").alias("_cnt"))
    )
    cum = F.sum("_n").over(W.partitionBy(*tkeys).orderBy("_x").rowsBetween(W.unboundedPreceding, 0))
    hit = counts.withColumn("_cum", cum).where(
        (F.col("_rank") < F.col("_cum")) & (F.col("_rank") >= F.col("_cum") - F.col("_n"))
    )
    picked = []
    for name, p in probs.items():
        pos = (F.max("_cnt") - 1) * F.lit(float(p))
        low = F.max(F.when((F.col("_q") == name) & (F.col("_side") == 0), F.col("_x")))
        high = F.max(F.when((F.col("_q") == name) & (F.col("_side") == 1), F.col("_x")))
        picked.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return hit.groupBy(*keys).agg(*picked)
