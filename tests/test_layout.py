"""The block layout, scans, smoothing and quantiles against plain pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import features as ft, labels as lb, metrics as mt
from tidebar.operators.ewm import WARMUP, Ewm, halo, span, with_ewm
from tidebar.operators.layout import blocked, number_bars, own_rows
from tidebar.operators.quantiles import exact_quantiles
from tidebar.operators.scan import running


def walk(n, seed, symbol):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * np.exp(rng.normal(0, 0.005, n))
    hi, lo = np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99
    ts = [dt.datetime(2010, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    return pd.DataFrame({"symbol": symbol, "bar_ts": ts, "open": open_, "high": hi, "low": lo, "close": close, "volume": rng.integers(1, 100, n).astype(float)})


@pytest.fixture(scope="module")
def bars(spark):
    # one symbol holds most rows
    pdf = pd.concat([walk(3000, 1, "hot"), walk(400, 2, "cold")])
    return number_bars(spark.createDataFrame(pdf), 50 * 86400).cache(), pdf


def frame(df, cols):
    return df.select("symbol", "bar_no", *cols).toPandas().sort_values(["symbol", "bar_no"]).reset_index(drop=True)


def test_bar_numbers_are_dense(bars):
    df, _ = bars
    p = df.select("symbol", "bar_ts", "bar_no").toPandas().sort_values(["symbol", "bar_ts"])
    for _, g in p.groupby("symbol"):
        assert list(g.bar_no) == list(range(1, len(g) + 1))


@pytest.mark.parametrize("build,cols", [(ft.core_features, ft.CORE), (ft.cross_features, ft.CROSS), (ft.full_features, ft.FULL)])
def test_block_size_does_not_change_features(bars, build, cols):
    df, _ = bars
    big, small = frame(build(df), cols), frame(build(df, block=700), cols)
    assert len(big) == 3400 == len(small)
    for c in cols:
        np.testing.assert_allclose(small[c].astype(float), big[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)


def test_blocks_bound_the_largest_group(bars):
    df, _ = bars
    sizes = blocked(df, back=40, ahead=5, block=100).groupBy("symbol", "_blk").count().agg(F.max("count")).first()[0]
    assert sizes <= 145


def test_smoothing_matches_pandas(bars):
    df, pdf = bars
    out = own_rows(with_ewm(blocked(df, back=WARMUP, block=900), {"e50": Ewm("close", span(50)), "w14": Ewm("close", 1 / 14)}))
    got = frame(out, ["e50", "w14"])
    for sym, g in pdf.groupby("symbol"):
        want50 = g.close.ewm(span=50, adjust=False).mean().to_numpy()
        want14 = g.close.ewm(alpha=1 / 14, adjust=False).mean().to_numpy()
        mine = got[got.symbol == sym]
        np.testing.assert_allclose(mine.e50, want50, rtol=1e-12)
        np.testing.assert_allclose(mine.w14, want14, rtol=1e-12)


def test_missing_observations_are_weighted_again(spark):
    values = [1.0, None, 1.0, 1.0, 4.0, None, None, 2.0, None]
    df = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate(values)], "symbol string, bar_no bigint, x double")
    out = own_rows(with_ewm(blocked(df, back=WARMUP), {"y": Ewm("x", 0.5), "late": Ewm("x", 0.5, 5)})).orderBy("bar_no").toPandas()
    want = pd.Series([np.nan if v is None else v for v in values]).ewm(alpha=0.5, adjust=False).mean()
    np.testing.assert_allclose(out.y.astype(float), want, rtol=1e-12)
    assert out.y[:4].tolist() == [1.0] * 4
    np.testing.assert_allclose(out.late.astype(float)[4:], pd.Series([4.0, np.nan, np.nan, 2.0, np.nan]).ewm(alpha=0.5, adjust=False).mean(), rtol=1e-12)
    assert out.late[:4].isna().all()


@pytest.mark.parametrize("n", [200, 500, 1000])
def test_long_spans_over_several_blocks(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(100, 5, 24000)
    x[rng.random(24000) < 0.1] = np.nan
    x[0] = 1000.0
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "bar_no": np.arange(1, 24001), "x": x}))
    df = df.withColumns({"x": F.when(~F.isnan("x"), F.col("x")), "one": F.lit(1.0)})
    with pytest.raises(ValueError):
        with_ewm(blocked(df, back=WARMUP), {"y": Ewm("x", span(n))})
    back = halo(span(n))
    out = own_rows(with_ewm(blocked(df, back=back, block=3000), {"y": Ewm("x", span(n)), "flat": Ewm("one", span(n))}, back)).orderBy("bar_no").toPandas()
    np.testing.assert_allclose(out.y, pd.Series(x).ewm(span=n, adjust=False).mean(), rtol=1e-11)
    np.testing.assert_allclose(out.flat, 1.0, rtol=1e-12)


def test_smoothed_deviation_and_rsi_match_pandas(bars):
    df, pdf = bars
    got = frame(ft.full_features(df, block=800), ["ewma_vol_logret_14", "adx_14", "macd_signal", "rsi_14"])
    g = pdf[pdf.symbol == "hot"]
    lr = np.log(g.close / g.close.shift(1))
    mine = got[got.symbol == "hot"]
    np.testing.assert_allclose(mine.ewma_vol_logret_14.astype(float).to_numpy()[2:], lr.ewm(span=14, adjust=False).std().to_numpy()[2:], rtol=1e-8)
    macd = g.close.ewm(span=12, adjust=False).mean() - g.close.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(mine.macd_signal, macd.ewm(span=9, adjust=False).mean(), rtol=1e-7, atol=1e-9)
    d = g.close.diff()
    gain, loss = d.clip(lower=0).fillna(0), (-d).clip(lower=0).fillna(0)
    rs = gain.ewm(alpha=1 / 14, adjust=False).mean() / loss.ewm(alpha=1 / 14, adjust=False).mean()
    np.testing.assert_allclose(mine.rsi_14.to_numpy()[20:], (100 - 100 / (1 + rs)).to_numpy()[20:], rtol=1e-8)


def test_labels_across_block_borders(bars):
    df, pdf = bars
    got = frame(lb.forward_label(df, 5, 0.01, block=64), ["label"])
    g = pdf[pdf.symbol == "hot"].close.to_numpy()
    r = g[5:] / g[:-5] - 1
    want = np.where(r > 0.01, 1.0, np.where(r < -0.01, 0.0, np.nan))
    mine = got[got.symbol == "hot"].label.astype(float).to_numpy()
    np.testing.assert_array_equal(mine, want)


def test_label_arguments(bars):
    df, _ = bars
    with pytest.raises(ValueError):
        lb.forward_label(df, 0, 0.01)
    with pytest.raises(ValueError):
        lb.forward_label(df, 3, -1.0)


def test_running_totals_over_blocks(bars):
    df, pdf = bars
    got = frame(running(df, ["symbol"], "bar_no", {"s": ("sum", "volume"), "m": ("max", "close")}, block=37), ["s", "m"])
    for sym, g in pdf.groupby("symbol"):
        mine = got[got.symbol == sym]
        np.testing.assert_allclose(mine.s, g.volume.cumsum())
        np.testing.assert_allclose(mine.m, g.close.cummax())


def test_exact_quantiles_with_ties_and_outliers(spark):
    rng = np.random.default_rng(5)
    data = {"hot": np.concatenate([rng.normal(0, 1, 5000), np.full(3000, 0.25), [1e9, -1e9]]), "one": np.array([7.0]), "flat": np.full(10, 2.0)}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in data.items()])
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", {"a": 0.5, "b": 0.99, "c": 0.0, "d": 0.333}).toPandas().set_index("k")
    for k, v in data.items():
        for name, q in (("a", 0.5), ("b", 0.99), ("c", 0.0), ("d", 0.333)):
            assert got.loc[k, name] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12), (k, name)


def test_auc_matches_pair_counting(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300) * 0.7 + 0.2 * y, 2)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "y_true": y, "y_prob": p}))
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert mt.auc(df, ["k"]).first()["roc_auc"] == pytest.approx(want)
    one = spark.createDataFrame(pd.DataFrame({"k": 1, "y_true": [1, 1], "y_prob": [0.2, 0.4]}))
    assert mt.auc(one, ["k"]).first()["roc_auc"] is None
