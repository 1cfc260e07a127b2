"""Plans, sinks, models and streams."""

import datetime as dt
import glob
import inspect
import pathlib
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import features as ft, models as ml, trades as tr
from tidebar.plans import tables, trades_q
from tidebar.session import shared_folder
from tidebar.sources import bars as src
from tidebar.streaming import flows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def test_features_need_one_shuffle_and_one_sort(spark):
    bars = tables.numbered(spark, SF)
    p = plan(ft.full_features(bars))
    assert p.count("Exchange hashpartitioning") == 1 and p.count("Sort [") == 1
    assert "hashpartitioning(symbol" in p and "_blk" in p


def test_first_touch_needs_no_join(spark):
    p = plan(tr.first_touch_exits(tr.with_profile(trades_q.rule_signals(tables.numbered(spark, SF)))))
    assert "Join" not in p


def test_top_n_limits_ranks_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, 1), 0.1)], "symbol string, bar_ts timestamp, score double")
    assert "WindowGroupLimit" in plan(tr.top_n_per_date(df, 2))


def test_scan_prunes_and_pushes_down(spark):
    path = folder(spark)
    src.write_features(tables.daily(spark, SF), path)
    p = plan(src.scan_features(spark, path, asof="1997-01-01").where(F.col("symbol") == "BUILDING").select("bar_ts", "close"))
    assert "PartitionFilters: [isnotnull(symbol" in p and "LessThanOrEqual(bar_ts" in p and "ReadSchema: struct<bar_ts:timestamp,close:double>" in p


def test_no_machine_local_checkpoints():
    for f in pathlib.Path(inspect.getfile(ft)).parents[1].rglob("*.py"):
        assert "local" + "Checkpoint(" not in f.read_text()


def test_empty_csv_has_its_header(spark):
    path = folder(spark)
    src.write_csv(spark.createDataFrame([], "symbol string, reasons array<string>, return_pct double"), path)
    text = "".join(pathlib.Path(f).read_text() for f in glob.glob(path + "/*.csv"))
    assert text.strip() == "symbol,reasons,return_pct"


def test_required_columns(spark):
    with pytest.raises(ValueError):
        src.require_columns(spark.range(1).withColumnRenamed("id", "open"))
    with pytest.raises(TypeError):
        src.require_columns(spark.createDataFrame([("x", 1.0, 1.0, 1.0, 1.0)], src.PRICES))


def test_first_record_of_a_time_wins(spark):
    t = dt.datetime(2020, 1, 1)
    raw = spark.createDataFrame([("s", t, 2, "9", "9", "9", "9", "9"), ("s", t, 1, "1", "2", "0.5", "1.5", None), ("s", t + dt.timedelta(1), 3, "1", "1", "1", "bad", "1")], "symbol string, bar_ts timestamp, ingest_seq long, open string, high string, low string, close string, volume string")
    rows = src.clean_prices(raw).collect()
    assert len(rows) == 1 and rows[0].close == 1.5 and rows[0].volume == 0.0


def test_folds_never_look_ahead(spark):
    df = spark.range(1, 108).withColumn("f", ml.walk_forward_fold(F.col("id"), F.lit(107))).toPandas()
    assert df.f.isna().sum() == 53 and df.f.max() == 4
    for k in range(5):
        assert df[df.f.isna() | (df.f < k)].id.max() < df[df.f == k].id.min()
    assert (df.f == 4).sum() == 107 - 53 - 4 * 10


def test_calibration_is_kept_only_when_it_helps(spark):
    good = spark.createDataFrame([(float(y), 0.9 if y else 0.1) for y in (0, 1) * 50], "label double, y_prob double")
    assert ml.fit_calibrator(good.where("label = 1"), "label") is None
    skewed = spark.createDataFrame([(float(i % 10 == 0), 0.5 + (i % 10 == 0) * 0.1 + (i % 3) * 0.1) for i in range(200)], "label double, y_prob double")
    model = ml.fit_calibrator(skewed, "label")
    brier = lambda d: d.agg(F.avg((F.col("y_prob") - F.col("label")) ** 2)).first()[0]
    assert model is not None and brier(ml.calibrated(model, skewed)) < brier(skewed)


def test_classifier_scores_are_probabilities(spark):
    df = spark.createDataFrame([(float(i % 7), float((i * 5) % 11), int(i % 7 > 3)) for i in range(300)], "a double, b double, label int")
    model = ml.fit_classifier(df, ["a", "b"], "label", trees=3, depth=2)
    r = ml.score(model, df).agg(F.min("y_prob"), F.max("y_prob"), F.avg(((F.col("y_prob") > 0.5).cast("int") == F.col("label")).cast("int"))).first()
    assert 0 <= r[0] < 0.5 < r[1] <= 1 and r[2] > 0.95


def test_cooldown_state_carries_over_batches(spark):
    path = folder(spark)
    days = [dt.datetime(2020, 1, 1) + dt.timedelta(days=i) for i in range(12)]
    decisions = ["STRONG_BUY", "WEAK_BUY", "PROBING_BUY", "NO_TRADE"] * 3
    schema = "symbol string, bar_ts timestamp, decision string"
    for i in range(0, 12, 4):  # one file after the other: three batches
        spark.createDataFrame([("s", d, x) for d, x in zip(days[i : i + 4], decisions[i : i + 4])], schema).coalesce(1).write.mode("append").parquet(path)
    stream = flows.file_stream(spark, schema, path, files_per_trigger=1)
    got = flows.run_to_table(flows.stream_cooldown(stream, 2)).orderBy("bar_ts").toPandas()
    until, want = None, []
    for d, x in zip(days, decisions):
        b = until is not None and d <= until
        if not b and x in ("STRONG_BUY", "WEAK_BUY"):
            until = d + dt.timedelta(days=2)
        want.append(b)
    assert list(got.blocked) == want


def test_late_ticks_are_dropped_by_streaming_bars(spark):
    path = folder(spark)
    schema = "symbol string, ts timestamp, price double, size bigint"
    t = dt.datetime(2020, 1, 1)
    # records are judged late by the watermark of the batch before, so the late one comes in the fourth
    batches = [[(0, 1.0), (30, 2.0)], [(400, 3.0)], [(410, 3.5)], [(10, 99.0), (460, 4.0)], [(900, 5.0)]]
    for b in batches:
        spark.createDataFrame([("s", t + dt.timedelta(minutes=m), p, 1) for m, p in b], schema).coalesce(1).write.mode("append").parquet(path)
    out = flows.run_to_table(flows.stream_bars(flows.file_stream(spark, schema, path, 1))).orderBy("bar_ts").toPandas()
    assert out.iloc[0].high == 2.0 and list(out.close) == [2.0, 3.5, 4.0]


def test_direction_heads_give_distributions(spark):
    rows = [(float(i % 9), float((i * 7) % 13), (i % 9) // 3) for i in range(270)]
    df = spark.createDataFrame(rows, "a double, b double, direction int")
    heads = ml.fit_direction_heads(df, ["a", "b"], "direction", trees=3, depth=3)
    out = ml.score_direction(heads, df)
    for h in ("head_linear", "head_trees"):
        total = F.col(h)["down"] + F.col(h)["neutral"] + F.col(h)["up"]
        assert out.agg(F.max(F.abs(total - 1.0))).first()[0] < 1e-9


def test_member_forecast_stays_within_its_caps(spark):
    rows = [(i, float(i % 10), float(i % 3), 0.5 * ((i % 10) - 5), 100.0, 0.01) for i in range(1, 301)]
    df = spark.createDataFrame(rows, "no bigint, a double, b double, y double, close double, vol double").withColumn("p99_daily", F.lit(None).cast("double"))
    models = ml.fit_members(df, ["a", "b"], "y", F.col("no"), F.lit(300), size=0.02)
    f = ml.one_step_forecast(ml.predict_members(models, df), list(models), [0.5, 0.3, 0.2])
    r = f.agg(F.max(F.abs("ensemble_log_return")), F.min("confidence"), F.max("confidence"), F.min(F.col("upper_bound") - F.col("lower_bound"))).first()
    assert r[0] <= 0.03 + 1e-12 and 0 <= r[1] and r[2] <= 1 and r[3] > 0
