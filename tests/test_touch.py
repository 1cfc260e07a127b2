import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import touch, trades as tr


@pytest.mark.parametrize("seed", range(5))
def test_search_equals_a_scan(seed):
    rng = np.random.default_rng(seed)
    n = 500
    low = rng.normal(0, 1, n).cumsum()
    high = low + rng.random(n)
    first = rng.integers(0, n, 200)
    last = np.minimum(first + rng.integers(0, 400, 200), n - 1)
    stop, target = low[first] - rng.random(200) * 9, high[first] + rng.random(200) * 9
    got = touch.first_touch(low, high, first, last, stop, target)
    for f, e, s, t, g in zip(first, last, stop, target, got):
        want = next((j for j in range(f, e + 1) if low[j] <= s or high[j] >= t), e + 1)
        assert g == want


def walk(spark, n, hold):
    rng = np.random.default_rng(3)
    close = 100 * np.exp(rng.normal(0, 0.01, n).cumsum())
    opens = np.concatenate([[100.0], close[:-1]]) * np.exp(rng.normal(0, 0.003, n))
    rows = [("a" if i < n * 2 // 3 else "b", (i if i < n * 2 // 3 else i - n * 2 // 3) + 1, float(o), float(max(o, c) * 1.004), float(min(o, c) * 0.996), float(c)) for i, (o, c) in enumerate(zip(opens, close))]
    df = spark.createDataFrame(rows, "symbol string, bar_no bigint, open double, high double, low double, close double")
    pick = F.pmod(F.hash("bar_no"), F.lit(4))
    return df.withColumns({"stop_pct": F.when(pick < 3, 0.05), "take_pct": F.when(pick < 3, 0.06), "hold": F.when(pick < 3, pick * (hold // 2) + 1)})


def test_same_as_listing_the_bars(spark, monkeypatch):
    df = walk(spark, 900, 60)
    cols = ["symbol", "bar_no", "entry_price", "exit_price", "exit_reason", "holding_days", "exit_no", "return_pct"]
    want = tr.first_touch_exits(df, 62, block=100)
    monkeypatch.setattr(tr, "FAR", 10)
    got = tr.first_touch_exits(df, 62, block=100)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    a, b = (sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(cols).fillna(-1).collect()) for d in (got, want))
    assert a == b and len({r[4] for r in a}) == 4


def test_hold_of_ten_thousand_bars(spark):
    df = walk(spark, 30_000, 10_000).withColumns({"stop_pct": F.when(F.col("hold").isNotNull(), 0.5), "take_pct": F.when(F.col("hold").isNotNull(), 0.6)})
    out = tr.first_touch_exits(df, 10_001)
    kinds = {r["exit_reason"]: r["n"] for r in out.groupBy("exit_reason").agg(F.count("*").alias("n")).collect()}
    assert sum(kinds.values()) == df.where("hold IS NOT NULL").count() and kinds.get("TIME", 0) > 0
    bad = out.where("holding_days > hold OR (exit_reason = 'TIME' AND holding_days <> hold)").count()
    assert bad == 0
