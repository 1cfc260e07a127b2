import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tidebar.operators import features as ft, fold as fd, models as ml
from tidebar.operators.layout import number_bars

BARS = "symbol string, bar_ts timestamp, open double, high double, low double, close double, volume double"


def walk(symbol, n, seed, step=0.02):
    rng, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        o, price = price, price * math.exp(rng.gauss(0, step))
        out.append((symbol, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), o, max(o, price) * 1.01, min(o, price) * 0.99, price, float(rng.randint(0, 50))))
    return out


def frame(spark, rows):
    return number_bars(spark.createDataFrame(rows, BARS))


def state_of(spark, rows, kind=fd.CoreState):
    pdf = fd.last_bars(frame(spark, rows)).orderBy("symbol").toPandas()
    width = max(22, max(len(c) for c in pdf["close"]))
    held = {c: np.stack([np.concatenate([np.full(width - len(v), np.nan), v]) for v in pdf[c]]) for c in fd.BAR}
    return kind(held, pdf["n"].to_numpy(), pdf["ts"].dt.weekday.to_numpy(), 1.0, None)


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_state_equals_features_built_anew(spark):
    """After each pushed bar the state gives what the feature builder gives on the longer table."""
    rows = walk("a", 300, 1) + walk("b", 40, 2) + walk("c", 25, 3)
    s = state_of(spark, rows)
    pushed = {k: [r for r in rows if r[0] == k] for k in "abc"}
    for step in (0.01, -0.03, None):
        now = ft.core_features(frame(spark, [r for v in pushed.values() for r in v]))
        last = now.groupBy("symbol").agg(F.max_by(F.array(*ft.CORE), "bar_no").alias("x")).orderBy("symbol").collect()
        want = np.array([[np.nan if v is None else v for v in r["x"]] for r in last])
        np.testing.assert_allclose(s.features(), want, rtol=1e-8, atol=1e-10)
        if step is None:
            break
        close = s.close[:, -1]
        price = close * math.exp(step)
        s.push(np.full(3, step), price)
        for k, p in zip("abc", map(float, price)):
            t = pushed[k][-1]
            pushed[k] = pushed[k] + [(k, t[1] + dt.timedelta(days=1), p, p, p, p, t[6])]


def test_flat_members_predict_like_the_models(spark):
    d = spark.range(600).select((F.rand(1) * 4).cast("int").cast("double").alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    d = d.withColumn("y", F.col("a") * F.col("b") - F.col("c") * F.col("c")).persist()
    make = [RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=7, maxDepth=9, seed=1), GBTRegressor(featuresCol="x", labelCol="y", maxIter=6, maxDepth=4, seed=1), LinearRegression(featuresCol="x", labelCol="y", regParam=0.01)]
    views = (["c", "a"], ["b", "a", "c"], ["a", "b"])
    models = {f"m{i}": Pipeline(stages=[VectorAssembler(inputCols=v, outputCol="x"), m]).fit(d) for i, (m, v) in enumerate(zip(make, views))}
    rows = ml.predict_members(models, d).select("a", "b", "c", "p_m0", "p_m1", "p_m2").toPandas()
    got = fd.flat_members(models, ["a", "b", "c"])(rows[["a", "b", "c"]].to_numpy())
    np.testing.assert_allclose(got, rows[["p_m0", "p_m1", "p_m2"]].to_numpy(), rtol=1e-9, atol=1e-12)


def test_path_of_constant_members(spark):
    """Members far beyond the cap: every step saturated, the path scaled back, prices from the scaled steps."""
    bars = frame(spark, walk("a", 200, 4, 0.002))
    path = fd.recursive_fold(bars, fd.CoreState, lambda x: np.full((len(x), 3), 0.5), [0.5, 0.3, 0.2])
    r = path.first()
    assert r["clip_saturation"] == 1.0 and r["guardrail"] and r["missing_fill_ratio"] == 0.0
    assert sum(r["ens"]) < 14 * 0.055 and r["prices"][-1] == pytest.approx(r["close"] * math.exp(sum(r["ens"])))
    assert all(p[-1] == pytest.approx(r["close"] * math.exp(sum(row[i] for row in r["matrix"]))) for i, p in enumerate(r["member_prices"]))
    calm = fd.recursive_fold(bars, fd.CoreState, lambda x: np.full((len(x), 3), 0.0001), [0.5, 0.3, 0.2]).first()
    assert not calm["guardrail"] and calm["clip_saturation"] == 0.0 and all(a < p < b for a, p, b in zip(calm["lower"], calm["prices"], calm["upper"]))
    steps = fd.fold_steps(path, "guardrail").orderBy("step").collect()
    assert [s["step"] for s in steps] == list(range(1, 15)) and steps[3]["member_prices"] == [p[3] for p in r["member_prices"]]


def test_short_history_and_empty(spark):
    path = fd.recursive_fold(frame(spark, walk("a", 5, 1)), fd.CoreState, lambda x: x[:, :2] * 0, [0.5, 0.5]).first()
    assert path["missing_fill_ratio"] > 0.3 and all(math.isfinite(p) for p in path["prices"])
    assert fd.recursive_fold(frame(spark, walk("a", 5, 1)).where("false"), fd.CoreState, lambda x: x[:, :2], [0.5, 0.5]).count() == 0


def test_old_bars_weigh_nothing(spark):
    rows = walk("a", 4000, 7)
    bars = frame(spark, rows)
    full = fd.last_bars(bars, 4000).toPandas()["close"][0]
    near = fd.last_bars(bars).toPandas()["close"][0]
    assert len(near) == fd.TAIL
    up = lambda c: fd.smoothed(np.maximum(np.diff(np.asarray(c)), 0)[None, :], 1 / 14)[0]
    assert up(full) == pytest.approx(up(near), rel=1e-13)


def test_boosted_head_gives_probabilities(spark):
    d = spark.range(300).select(F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 3).cast("int").alias("y")).withColumn("a", F.col("a") + F.col("y"))
    head = ml.fit_boosted_head(d, ["a", "b"], "y", trees=6, depth=3)
    out = ml.score_direction({"trees": head}, d).select("y", "head_trees.*").collect()
    assert all(abs(r["down"] + r["neutral"] + r["up"] - 1) < 1e-9 for r in out)
    right = sum(max(("down", 0), ("neutral", 1), ("up", 2), key=lambda k: r[k[0]])[1] == r["y"] for r in out)
    assert right > 200
    two = ml.fit_boosted_head(d.where("y < 2"), ["a", "b"], "y", trees=3, depth=2)
    assert ml.score_direction({"trees": two}, d.where("y < 2")).agg(F.max("head_trees.up")).first()[0] < 0.2


def test_many_values_are_no_classes(spark):
    with pytest.raises(ValueError):
        ml.balanced(spark.range(2000).withColumnRenamed("id", "y"), "y")
