from pyspark.sql import functions as F

from tidebar.operators.heavy import fits, heavy_keys, spread_join


def tables(spark):
    left = spark.range(0, 5000).select("id", F.when(F.col("id") % 3 == 0, "the").when(F.col("id") % 1000 == 1, None).otherwise(F.col("id").cast("string")).alias("word"))
    right = spark.range(0, 4000).select(F.col("id").cast("string").alias("word"), (F.col("id") * 2).alias("v")).unionByName(spark.range(1).select(F.lit("the").alias("word"), F.lit(-1).cast("long").alias("v")))
    return left, right


def test_same_rows_as_a_plain_join(spark):
    left, right = tables(spark)
    for how in ("left", "inner"):
        want = sorted(left.join(right, "word", how).select("id", "word", "v").collect(), key=str)
        got = spread_join(left, right, "word", how, rows=100, pieces=8)
        assert sorted(got.select("id", "word", "v").collect(), key=str) == want


def test_heavy_keys_are_dealt(spark):
    left, right = tables(spark)
    assert [r[0] for r in heavy_keys(left, "word", 100).collect()] == ["the"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = spread_join(left, right, "word", "left", rows=100, pieces=32)
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes) < 3 * 5000 / len(sizes)


def test_empty(spark):
    left, right = tables(spark)
    assert spread_join(left.where("false"), right, "word").count() == 0
    assert spread_join(left, right.where("false"), "word", rows=10).where("v IS NOT NULL").count() == 0


def test_lexicon_of_300_000_words(spark):
    """Every text holds "the": beyond the broadcast bound its rows are dealt out, and scores stay the same."""
    from tidebar.functions.text import with_compound

    lexicon = spark.range(300_000).select(F.concat(F.lit("w"), F.col("id")).alias("word"), ((F.col("id") % 7) - 3.0).alias("valence"))
    lexicon = lexicon.unionByName(spark.createDataFrame([("the", 0.1)], "word string, valence double"))
    texts = spark.range(30_000).select("id", F.concat_ws(" ", F.lit("the not"), F.concat(F.lit("w"), F.col("id") * 9), F.lit("the unknown")).alias("text"))
    want = with_compound(texts, "text", ["id"], lexicon)
    got = with_compound(texts, "text", ["id"], lexicon, most=1000)
    total = lambda d: d.agg(F.count("*"), F.round(F.sum("compound"), 6), F.round(F.sum(F.col("compound") * F.col("id")), 3)).first()
    assert total(got) == total(want)
    assert not fits(lexicon, "word", 1000) and fits(lexicon, "word")


def test_symbol_with_half_the_rows(spark):
    from tidebar.sources.bars import with_source_fallback

    rows = lambda n, shift: spark.range(n).select(F.when(F.col("id") % 2 == 0, "big").when(F.col("id") == 1, None).otherwise(F.concat(F.lit("s"), (F.col("id") / 9 + shift).cast("int"))).alias("symbol"), F.col("id").alias("v"))
    first, second = rows(60_000, 0), rows(70_000, 3)
    want = sorted(with_source_fallback(first, second, 5).collect(), key=str)
    got = sorted(with_source_fallback(first, second, 5, most=100).collect(), key=str)
    assert got == want and any(r["symbol"] is None for r in got)
