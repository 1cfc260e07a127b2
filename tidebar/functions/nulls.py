"""Missing-value rules shared by all operators.

Missing is always NULL, never NaN.  ``least``/``greatest`` skip NULL, comparisons with NULL
give NULL, division by zero raises under ANSI: the helpers below state the wanted outcome once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

Num = Column | float | int


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(v: Num) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def div(a: Num, b: Num) -> Column:
    """a / b, NULL when b is zero or either side is missing."""
    return F.try_divide(lit(a), lit(b))


def clip(x: Column, lo: Num | None = None, hi: Num | None = None) -> Column:
    """Bound x; a missing x stays missing."""
    y = x
    if lo is not None:
        y = F.greatest(y, lit(lo))
    if hi is not None:
        y = F.least(y, lit(hi))
    return F.when(x.isNotNull(), y)


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def flag(cond: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it does not or is unknown."""
    return F.coalesce(cond.cast("double"), F.lit(0.0))


def truth(cond: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def bounded(x: Column, default: float, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Default when missing, then bound."""
    return F.least(F.greatest(F.coalesce(x, F.lit(default)), F.lit(lo)), F.lit(hi))


def ladder(rules: list[tuple[Column, object]], default: object) -> Column:
    """Value of the first rule whose condition holds."""
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    if not rules:
        return wrap(default)
    out = None
    for cond, value in rules:
        out = F.when(cond, wrap(value)) if out is None else out.when(cond, wrap(value))
    return out.otherwise(wrap(default))


def tags(rules: list[tuple[Column, str]]) -> Column:
    """Array of the labels whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows that have every listed column."""
    return df.dropna("any", subset=cols)


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Typed defaults for missing columns and missing values."""
    have = set(df.columns)
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v)
            for c, v in defaults.items()
        }
    )
