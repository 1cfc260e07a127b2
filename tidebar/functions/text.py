"""Text cleaning and lexicon sentiment of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidebar.operators.heavy import BYTES, checked_join

# A small default lexicon (word -> valence) and the words that negate the next one.
LEXICON = {
    "amazing": 2.8, "awful": -2.0, "bad": -2.5, "bearish": -2.1, "best": 3.2, "boom": 1.8, "breakout": 1.4,
    "bullish": 2.3, "collapse": -2.4, "crash": -2.7, "danger": -2.4, "dump": -1.8, "fail": -2.5, "fear": -2.2,
    "gain": 2.0, "gains": 2.0, "good": 1.9, "great": 3.1, "growth": 1.7, "hack": -2.2, "happy": 2.7, "hate": -2.7,
    "hope": 1.9, "loss": -1.8, "losses": -1.8, "love": 3.2, "lost": -1.5, "moon": 1.6, "panic": -2.3, "positive": 2.3,
    "profit": 1.9, "rally": 1.5, "risk": -1.1, "scam": -2.9, "strong": 2.3, "success": 2.7, "terrible": -2.1,
    "trust": 2.3, "up": 0.6, "weak": -1.9, "win": 2.8, "worry": -1.9, "worst": -3.1,
}
NEGATIONS = ["no", "not", "never", "cannot", "without"]
FLIP, NORM = -0.74, 15.0


# What cleaning replaces, in this order.
CLEANING = ((r"http\S+", " "), (r"www\.\S+", " "), (r"@\w+", " "), (r"#(\w+)", "$1"), (r"[^a-z\s]", " "), (r"\s+", " "))


def clean_text(text: Column) -> Column:
    """Lower case, no links or mentions, tags as words, letters and single spaces only."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern, into in CLEANING:
        t = F.regexp_replace(t, pattern, into)
    return F.trim(t)


def lexicon_table(spark: SparkSession, words: dict[str, float] | None = None) -> DataFrame:
    """(word, valence) rows of a lexicon."""
    return spark.createDataFrame(sorted((LEXICON if words is None else words).items()), "word string, valence double")


def with_compound(df: DataFrame, cleaned: str, keys: list[str], lexicon: DataFrame, most: int = BYTES) -> DataFrame:
    """``keys`` and compound: the sum of word valences, flipped after a negation, squeezed into [-1, 1].

    ``keys`` tell the rows apart.  Words meet the lexicon by a join: it is broadcast while it is below
    ``most`` bytes, beyond that words that many texts hold are dealt to many tasks.  A text without known
    words scores 0.
    """
    known = lexicon.groupBy("word").agg(F.max("valence").alias("valence"))
    words = F.split(cleaned, " ")
    before = F.concat(F.array(F.lit("")), F.slice(words, F.lit(1), F.size(words) - 1))
    rows = df.select(*keys, F.explode(F.arrays_zip(words.alias("word"), before.alias("before"))).alias("w")).select(*keys, "w.word", "w.before")
    worth = F.col("valence") * F.when(F.col("before").isin(NEGATIONS), FLIP).otherwise(1.0)
    s = F.coalesce(F.sum(worth), F.lit(0.0))
    return checked_join(rows, known, "word", "left", most).groupBy(*keys).agg(s.alias("_s")).withColumn("compound", F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + NORM)).drop("_s")
