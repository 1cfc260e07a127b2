from pyspark.sql import functions as F

from tidebar.operators import models as ml
from tidebar.operators.scan import number_by_range


def test_numbers_are_dense_whatever_the_density(spark):
    """A burst of 300 000 values a microsecond apart between a few lone ones."""
    burst = spark.range(300_000).select((F.lit(1_000_000_000_000) + F.col("id")).alias("us"))
    lone = spark.createDataFrame([(1,), (7,), (7,), (4_000_000_000_000_000,)], "us bigint")
    df = burst.unionByName(lone).select(F.timestamp_micros("us").alias("t"))
    n = number_by_range(df, "t", "no")
    assert n.agg(F.count("*"), F.min("no"), F.max("no"), F.countDistinct("no")).first()[:] == (300_003, 1, 300_003, 300_003)
    at = {r["us"]: r["no"] for r in n.select(F.unix_micros("t").alias("us"), "no").where("no < 5 OR no > 300000").collect()}
    assert at[1] == 1 and at[7] == 2 and at[1_000_000_000_000] == 3 and at[4_000_000_000_000_000] == 300_003


def test_dates_of_a_burst(spark):
    df = spark.range(1000).select(F.timestamp_millis((F.col("id") / 2).cast("long")).alias("bar_ts"), "id")
    out = ml.with_date_no(df).orderBy("id").collect()
    assert [r["date_no"] for r in out[:4]] == [1, 1, 2, 2] and out[-1]["date_no"] == out[0]["n_dates"] == 500
    assert number_by_range(df.where("false"), "bar_ts", "no").count() == 0
