"""First touch of a stop or target over long holds, by range minima and maxima.

A window that lists all following bars holds ``hold`` bars per row.  Here a block of bars keeps tables of
lows and highs over ranges of 1, 2, 4, ... bars, and every trade skips the largest clean range at each size:
memory grows with the bars times the logarithm of the hold, time likewise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidebar.operators.layout import BLOCK, blocked

OUT = "entry_price double, exit_price double, exit_reason string, holding_days int, exit_no long, return_pct double"


def skip_tables(low: np.ndarray, high: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Level k holds the lowest low and highest high of the 2^k bars from each position on."""
    out, size = [(low, high)], 1
    while 2 * size <= longest and 2 * size <= len(low):
        a, b = out[-1]
        out.append((np.minimum(a[:-size], a[size:]), np.maximum(b[:-size], b[size:])))
        size *= 2
    return out


def first_touch(low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, stop: np.ndarray, target: np.ndarray) -> np.ndarray:
    """First position in [first, last] whose low is at most ``stop`` or high at least ``target``; last + 1 if none is."""
    at = first.copy()
    longest = int((last - first + 1).max(initial=1))
    tables = skip_tables(low, high, longest)
    for k, (a, b) in reversed(list(enumerate(tables))):  # sizes halve, so each is skipped at most once
        fits = at + (1 << k) <= last + 1
        here = np.where(fits, at, 0)
        clean = fits & (a[here] > stop) & (b[here] < target)
        at = np.where(clean, at + (1 << k), at)
    return at


def far_exits(signals: DataFrame, max_hold: int, block: int | None = None) -> DataFrame:
    """``trades.first_touch_exits`` for long holds: the same columns, rules and order of rules."""
    df = blocked(signals, ahead=max_hold, block=block or max(BLOCK, max_hold))
    columns = signals.columns

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("bar_no")
        o, h, l, c = (t.column(x).cast(pa.float64()).to_numpy() for x in ("open", "high", "low", "close"))
        low, high = np.fmin(o, l), np.fmax(o, h)
        low, high = np.where(np.isnan(low), np.inf, low), np.where(np.isnan(high), -np.inf, high)
        mine = np.flatnonzero(t.column("_own").to_numpy(zero_copy_only=False) & t.column("hold").is_valid().to_numpy(zero_copy_only=False))
        u, n = t.take(pa.array(mine)), len(o)
        number = lambda x: u.column(x).cast(pa.float64()).to_numpy()
        first = np.minimum(mine + 1, n - 1)
        entry = np.where(mine + 1 < n, o[first], np.nan)
        entry = np.where(entry > 0, entry, np.nan)
        stop, target = entry * (1.0 - number("stop_pct")), entry * (number("take_pct") + 1.0)
        due = mine + np.maximum(number("hold"), 1).astype(np.int64)
        last = np.minimum(due, n - 1)
        ok = ~np.isnan(entry)
        at = np.full(len(mine), n)
        calm = lambda x, other: np.where(np.isnan(x), other, x)  # noqa: E731  a missing level is never touched
        if ok.any():
            at[ok] = first_touch(low, high, first[ok], last[ok], calm(stop, -np.inf)[ok], calm(target, np.inf)[ok])
        touched = ok & (at <= last)
        timed = ok & ~touched & (due <= n - 1)
        j = np.where(touched, at, np.where(timed, due, 0))
        with np.errstate(invalid="ignore"):
            rules = [o[j] <= stop, o[j] >= target, l[j] <= stop]
            price = np.where(touched, np.select(rules, [o[j], o[j], stop], target), np.where(timed, c[j], np.nan))
            reason = np.where(touched, np.select(rules, ["SL", "TP", "SL"], "TP"), np.where(timed, "TIME", "INVALID"))
        gone = ~(touched | timed)
        days = j - mine
        missing = lambda x, m, kind: pa.array(x, kind, mask=m)
        made = {
            "entry_price": missing(entry, ~ok, pa.float64()), "exit_price": missing(price, gone | np.isnan(price), pa.float64()), "exit_reason": pa.array(reason.tolist(), pa.string()),
            "holding_days": missing(days.astype(np.int32), gone, pa.int32()), "exit_no": missing(number("bar_no").astype(np.int64) + days, gone, pa.int64()),
            "return_pct": missing(price / entry - 1.0, gone | np.isnan(price), pa.float64()),
        }
        u = u.select(columns)
        for name, values in made.items():
            u = u.append_column(name, values)
        return u

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema) + ", " + OUT
    return df.groupBy("symbol", "_blk").applyInArrow(solve, schema)
