"""Small statistics over array columns (a forecast path has 14 steps and a few models).

They keep a whole path in its row, so path operators need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZERO = 0.0


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(ZERO), lambda s, x: s + x)


def count_if(a: Column, pred) -> Column:
    return F.size(F.filter(a, pred)).cast("double")


def amean(a: Column) -> Column:
    return F.try_divide(asum(a), F.size(a).cast("double"))


def avar(a: Column) -> Column:
    """Population variance."""
    return let(amean(a), lambda m: amean(F.transform(a, lambda x: (x - m) * (x - m))))


def astd(a: Column) -> Column:
    return F.sqrt(avar(a))


def spread(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def amedian(a: Column) -> Column:
    mid = lambda s, n: (s[F.floor((n - 1) / 2).cast("int")] + s[F.floor(n / 2).cast("int")]) / 2.0
    return let(F.array_sort(a), lambda s: mid(s, F.size(s)))


def cumsum(a: Column) -> Column:
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(ZERO))
    return F.aggregate(
        a, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(last(acc) + x))
    )


def column_of(matrix: Column, i: int) -> Column:
    """The i-th entry of every row of an array of arrays."""
    return F.transform(matrix, lambda row: row[i])


def bound01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
