"""Running totals over series too long for one task.

Rows are numbered, blocks are totalled, the totals are scanned, and each block continues from
the total before it.  Only the block table (one row per ``BLOCK`` rows) meets in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidebar.operators.layout import BLOCK
from tidebar.session import cut_lineage


def running(df: DataFrame, keys: list[str], no: str, outs: dict[str, tuple], block: int | None = None) -> DataFrame:
    """Add inclusive running aggregates; ``outs`` maps name to (kind, input column).

    ``kind`` is sum, max or min; ``no`` is a dense 1-based row number within ``keys``.
    """
    size = block or BLOCK
    fns = {"sum": F.sum, "max": F.max, "min": F.min}
    merge = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}
    df = cut_lineage(df.withColumn("_seg", F.floor((F.col(no) - 1) / size)))
    inner = W.partitionBy(*keys, "_seg").orderBy(no).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_seg").agg(
        *[fns[kind](c).alias(f"_t_{name}") for name, (kind, c) in outs.items()]
    )
    carried = totals.select(
        *keys, "_seg", *[fns[kind](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _) in outs.items()]
    )
    here = df.withColumns({f"_i_{name}": fns[kind](c).over(inner) for name, (kind, c) in outs.items()})
    joined = here.join(carried, [*keys, "_seg"])
    done = {}
    for name, (kind, _) in outs.items():
        own, before = F.col(f"_i_{name}"), F.col(f"_c_{name}")
        both = merge[kind](own, before)
        done[name] = F.when(before.isNull(), own).when(own.isNull(), before).otherwise(both)
    drop = ["_seg"] + [f"_{p}_{name}" for name in outs for p in ("i", "c")]
    return joined.withColumns(done).drop(*drop)


def number_rows(df: DataFrame, keys: list[str], ts: str, out: str, chunk: Column) -> DataFrame:
    """Dense 1-based row number by time within keys; ``chunk`` is a monotone coarse form of ts."""
    df = cut_lineage(df.withColumn("_ch", chunk))
    sizes = df.groupBy(*keys, "_ch").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_ch").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select(*keys, "_ch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    pos = F.row_number().over(W.partitionBy(*keys, "_ch").orderBy(ts))
    return (
        df.withColumn("_p", pos)
        .join(base, [*keys, "_ch"])
        .withColumn(out, F.col("_b") + F.col("_p"))
        .drop("_ch", "_b", "_p")
    )


def number_by_range(df: DataFrame, by: str, out: str) -> DataFrame:
    """Dense 1-based number of the distinct values of ``by`` (nulls first), over the whole table.

    Values are dealt by ranges, numbered inside their range, and moved on by the counts of the ranges
    before.  How densely values lie does not matter: a burst is cut like any other stretch.
    """
    dealt = df.select(by).distinct().repartitionByRange(by).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per range
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    pos = F.row_number().over(W.partitionBy("_part").orderBy(by))
    return dealt.withColumn("_p", pos).join(F.broadcast(base), "_part").select(by, (F.col("_b") + F.col("_p")).alias(out))
