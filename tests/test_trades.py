"""Exits, positions and equity against small hand-made cases and brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import grids as gr, metrics as mt, trades as tr
from tidebar.operators.layout import number_bars

DAY0 = dt.datetime(2020, 1, 1)


def ohlc(spark, rows, symbol="s"):
    return spark.createDataFrame(
        [(symbol, DAY0 + dt.timedelta(days=i), i + 1, *map(float, r), 1.0) for i, r in enumerate(rows)],
        "symbol string, bar_ts timestamp, bar_no bigint, open double, high double, low double, close double, volume double",
    )


def one_exit(spark, rows, stop=0.02, take=0.03, hold=3):
    # the signal is on a bar before the given ones
    df = ohlc(spark, [(100, 100, 100, 100), *rows])
    sig = df.withColumns({k: F.when(F.col("bar_no") == 1, v) for k, v in (("stop_pct", stop), ("take_pct", take), ("hold", hold))})
    return tr.first_touch_exits(sig, max_hold=3).first()


def test_stop_wins_when_both_levels_are_inside_a_bar(spark):
    r = one_exit(spark, [(100, 110, 90, 95), (95, 96, 94, 95)])
    assert (r.exit_reason, r.exit_price) == ("SL", pytest.approx(98.0))


def test_target_level(spark):
    r = one_exit(spark, [(100, 108, 99.5, 105), (105, 106, 104, 105)])
    assert (r.exit_reason, r.exit_price) == ("TP", pytest.approx(103.0))


def test_time_exit_at_the_close(spark):
    r = one_exit(spark, [(100, 101, 99.5, 100.5)], hold=1)
    assert (r.exit_reason, r.exit_price, r.holding_days) == ("TIME", 100.5, 1)


def test_gap_leaves_at_the_open(spark):
    r = one_exit(spark, [(100, 101, 99, 100), (90, 120, 85, 100)])
    assert (r.exit_reason, r.exit_price, r.holding_days) == ("SL", 90.0, 2)


def test_bars_that_run_out_are_invalid(spark):
    assert one_exit(spark, [(100, 101, 99, 100)], hold=3).exit_reason == "INVALID"
    assert one_exit(spark, []).exit_reason == "INVALID"


def test_slippage_case(spark):
    df = ohlc(spark, [(100, 100, 100, 100), (100, 101, 99, 100), (100, 104, 99, 101), (100, 100, 100, 100)])
    r = tr.slipped_exits(df.where("bar_no <= 4"), horizon=2).where("bar_no = 1").first()
    e = 100 * 1.001
    assert r.exit_price == pytest.approx(e * 1.03 * 0.999)
    assert r.trade_return == pytest.approx((e * 1.03 * 0.999 - e) / e)


@pytest.mark.parametrize("density,run", [(1.0, 8), (0.4, 16), (0.9, 5)])
def test_positions_match_a_sequential_trader(spark, density, run):
    rng = np.random.default_rng(int(density * 10) + run)
    reach, rows = 5, []
    for sym, n in (("hot", 3000), ("cold", 60)):
        for i in range(1, n + 1):
            if rng.random() < density:
                rows.append((sym, i, i + int(rng.integers(1, reach + 1))))
    df = spark.createDataFrame(rows, "symbol string, bar_no bigint, release_no bigint")
    got = {(r.symbol, r.bar_no) for r in tr.non_overlapping(df, run=run, factor=4).collect()}
    want, free = set(), {}
    for sym, at, to in rows:
        if at >= free.get(sym, 1):
            want.add((sym, at))
            free[sym] = to
    assert got == want


@pytest.mark.parametrize("far", [(40, 140_000), (1, 100_000), (139_990, 140_500)])
def test_one_far_release(spark, far):
    """A release 100 000 bars away blocks what lies between and costs nothing elsewhere."""
    n = 150_000
    df = spark.range(1, n, 3).select(F.lit("s").alias("symbol"), F.col("id").alias("bar_no"), F.when(F.col("id") == far[0], far[1]).otherwise(F.col("id") + 4).alias("release_no"))
    got = sorted(r.bar_no for r in tr.non_overlapping(df).collect())
    free, want = 0, []
    for at in range(1, n, 3):
        if at >= free:
            want.append(at)
            free = far[1] if at == far[0] else at + 4
    assert got == want


def test_no_trades(spark):
    df = spark.createDataFrame([], "symbol string, bar_no bigint, release_no bigint")
    assert tr.non_overlapping(df).count() == 0


@pytest.mark.parametrize("per_day", [200, 1])
def test_release_counts_no_bars(spark, per_day):
    n = 9000 if per_day > 1 else 400
    times = [DAY0 + dt.timedelta(seconds=86400 / per_day * i) for i in range(n)]
    if per_day == 1:
        times = [t + dt.timedelta(days=int(i / 50) * 40) for i, t in enumerate(times)]  # long gaps
    bars = spark.createDataFrame([("s", i + 1, t) for i, t in enumerate(times)], "symbol string, bar_no bigint, bar_ts timestamp")
    trades = [(k, k + 2) for k in range(5, n, 97)]
    df = bars.join(spark.createDataFrame(trades, "bar_no bigint, exit_no bigint"), "bar_no")
    got = {r.bar_no: r.release_no for r in tr.with_release(df, bars, 3).collect()}
    for at, leave in trades:
        inside = sum(times[at - 1] <= t <= times[at - 1] + dt.timedelta(days=3) for t in times[at - 1 : at + 700])
        assert got[at] == max(leave, at + inside)
    taken = tr.non_overlapping(tr.with_release(df, bars, 3), run=64, min_history=80)
    free, want = 0, set()
    for at, _ in trades:
        if at >= 80 and at >= free:
            want.add(at)
            free = got[at]
    assert {r.bar_no for r in taken.collect()} == want


def test_equity_against_a_loop(spark):
    rng = np.random.default_rng(9)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 200)))
    bars = ohlc(spark, [(c, c * 1.02, c * 0.98, c) for c in close])
    pos = [(5, 8, 1.01), (8, 9, 0.97), (30, 33, 1.05), (150, 151, 1.0)]
    df = spark.createDataFrame([("s", b, x, float(close[b]), m - 1.0) for b, x, m in pos], "symbol string, bar_no bigint, exit_no bigint, entry_price double, return_pct double")
    got = tr.equity_curve(bars, df, min_history=1, block=16).orderBy("bar_no").toPandas()
    cash, want, k, open_ = 1.0, [], 0, None
    for no in range(1, 201):
        held = open_ is not None
        if held and no == open_[1]:
            cash *= open_[2]
            eq, open_ = cash, None
        elif held:
            eq = cash * close[no - 1] / close[open_[0]]
        else:
            eq = cash
        want.append((eq, int(held)))
        if open_ is None and k < len(pos) and pos[k][0] == no:
            open_, k = pos[k], k + 1
    np.testing.assert_allclose(got.equity, [w[0] for w in want])
    assert list(got.in_position) == [w[1] for w in want]
    peak = np.maximum.accumulate(np.maximum([w[0] for w in want], 1.0))
    np.testing.assert_allclose(got.drawdown, np.array([w[0] for w in want]) / peak - 1)


def test_portfolio_metrics(spark):
    r = [0.1, -0.05, 0.0, 0.2, -0.3]
    df = spark.createDataFrame([("p", DAY0 + dt.timedelta(days=i), x) for i, x in enumerate(r)], "strategy string, bar_ts timestamp, ret double")
    m = mt.portfolio_metrics(df, ["strategy"], block=2).first()
    cum = np.cumprod(1 + np.array(r))
    assert m.compounded_return == pytest.approx(cum[-1] - 1)
    assert m.profit_factor == pytest.approx(0.3 / 0.35)
    assert m.sharpe_ratio == pytest.approx(np.mean(r) / np.std(r) * np.sqrt(252))
    assert m.max_drawdown == pytest.approx((cum / np.maximum.accumulate(cum) - 1).min())


def test_profit_factor_without_losses(spark):
    df = spark.createDataFrame([("s", 0.1, 1), ("s", 0.2, 2)], "symbol string, return_pct double, holding_days int")
    m = mt.trade_statistics(df, ["symbol"]).first()
    assert m.profit_factor is None and m.metrics_notes == ["No trade lost: there is no profit factor."]
    assert mt.simple_summary(df.withColumnRenamed("return_pct", "trade_return"), ["symbol"]).first().profit_factor == float("inf")


@pytest.mark.parametrize(
    "p,vol,cool,want",
    [
        (0.7, 0.02, False, ("BUY", [])),
        (0.5, 0.02, False, ("NO_TRADE", ["probability_below_threshold"])),
        (0.7, 0.20, False, ("NO_TRADE", ["volatility_out_of_range"])),
        (0.7, 0.001, False, ("NO_TRADE", ["volatility_out_of_range"])),
        (0.5, None, True, ("NO_TRADE", ["probability_below_threshold", "volatility_out_of_range", "cooldown_active"])),
    ],
)
def test_gate(spark, p, vol, cool, want):
    df = spark.createDataFrame([(p, vol, cool)], "p double, v double, c boolean")
    d, r = tr.gate(F.col("p"), F.col("v"), F.col("c"))
    row = df.select(d.alias("d"), r.alias("r")).first()
    assert (row.d, row.r) == want


def test_ablation_takes_trades_of_early_bars(spark, monkeypatch):
    bars = ohlc(spark, [(100, 101, 99.5, 100)] * 12)
    monkeypatch.setattr(gr, "variant_decisions", lambda df: df.withColumn("decision", F.lit("STRONG_BUY")))
    got = {r["variant"]: r["total_trades"] for r in gr.ablation(bars).collect()}
    assert set(got) == {v[0] for v in gr.VARIANTS} and min(got.values()) > 1
