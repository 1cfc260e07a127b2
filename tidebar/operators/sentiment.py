"""Daily sentiment of posts per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidebar.functions.nulls import clip
from tidebar.functions.text import clean_text, lexicon_table, with_compound
from tidebar.operators.layout import blocked, lag, number_bars, own_rows, rolling


def scored_posts(posts: DataFrame, lexicon: dict[str, float] | DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(symbol, day, compound) of posts (symbol, text, created_at); ``key`` tells posts apart."""
    table = lexicon if isinstance(lexicon, DataFrame) else lexicon_table(posts.sparkSession, lexicon)
    rows = posts.select(key, "symbol", F.to_date("created_at").alias("day"), clean_text(F.col("text")).alias("cleaned"))
    return with_compound(rows, "cleaned", [key, "symbol", "day"], table).select("symbol", "day", "compound")


def daily_sentiment(scored: DataFrame) -> DataFrame:
    """Mean score and number of posts per symbol and day."""
    return scored.groupBy("symbol", "day").agg(
        F.avg("compound").alias("sentiment_score"), F.count("compound").cast("double").alias("sentiment_volume")
    )


def with_rolling(daily: DataFrame, block: int | None = None) -> DataFrame:
    """Three-row change (0 at the start) and seven-row mean of the daily score."""
    df = number_bars(daily.withColumn("bar_ts", F.col("day").cast("timestamp")))
    df = blocked(df, back=7, block=block).withColumns(
        {
            "twitter_sentiment_momentum": F.coalesce(F.col("sentiment_score") - lag("sentiment_score", 3), F.lit(0.0)),
            "twitter_sentiment_7d_avg": rolling(F.avg, "sentiment_score", 7, 1),
        }
    )
    return own_rows(df).drop("bar_ts", "bar_no")


def bounded_daily(daily: DataFrame) -> DataFrame:
    """Scores within [-1, 1], volumes within [0, 1e6], missing as 0."""
    return daily.withColumns(
        {
            "sentiment_score": clip(F.coalesce("sentiment_score", F.lit(0.0)), -1.0, 1.0),
            "sentiment_volume": clip(F.coalesce("sentiment_volume", F.lit(0.0)), 0.0, 1e6),
        }
    )


def as_features(daily: DataFrame) -> DataFrame:
    """Columns as the full feature builder joins them."""
    return daily.select(
        "symbol", "day", F.col("sentiment_score").alias("twitter_sentiment"), F.col("sentiment_volume").alias("twitter_volume"),
        "twitter_sentiment_7d_avg", "twitter_sentiment_momentum",
    )
