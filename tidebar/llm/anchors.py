"""Minimisers of sliding windows: what cuts texts into runs that meet in one bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.session import cut_lineage

LAST = np.uint64(1 << 63)  # set in the order of values that are too frequent to lead a bucket; others lack it


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each position on (short at the end)."""
    out, size = values.copy(), 1
    while size < w:
        step = min(size, w - size)
        if len(out) > step:
            out[:-step] = np.minimum(out[:-step], out[step:])
        size += step
    return out


def order_of(values: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Order in which values lead: by the value's upper 63 bits, frequent ones (sorted ``hot``) last."""
    out = values >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, out), len(hot) - 1)
        out[hot[at] == out] |= LAST
    return out


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Start index of every run of equal rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def frequent(leads: DataFrame, most: int) -> np.ndarray:
    """Sorted leading values with more runs than one in ``most`` of all; at most ``most`` of them.

    ``leads`` has (value, runs), counted per batch before the shuffle.
    """
    counted = cut_lineage(leads.groupBy("value").agg(F.sum("runs").alias("runs")))
    total = counted.where("value = -1").agg(F.sum("runs")).first()[0] or 0
    rows = counted.where((F.col("value") >= 0) & (F.col("runs") > max(1000, total // most))).select("value").collect()
    return np.sort(np.array([r.value for r in rows], np.int64).view(np.uint64))


def lead_rows(values: np.ndarray) -> pa.RecordBatch:
    """Runs per leading value of a batch, and of all under -1.

    A value that leads one in a few thousand runs leads several in any batch, so values that lead a
    single one are left out.
    """
    found, runs = np.unique(values, return_counts=True)
    found, runs = found[runs > 1], runs[runs > 1]
    return pa.RecordBatch.from_arrays([pa.array(np.append(found.astype(np.int64), -1)), pa.array(np.append(runs, len(values)).astype(np.int64))], ["value", "runs"])
