"""Joins against a table with unique keys, with the rows of heavy keys spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HEAVY = 20_000  # rows of one key that a task still takes as they come
SPREAD = 64  # pieces that a heavy key is dealt to
KEYS = 1_000_000  # heavy keys that are broadcast at most
BYTES = 32 << 20  # bytes of a table that is broadcast whole
ROW = 48  # bytes of a row beside its key


def heavy_keys(left: DataFrame, key: str, heavy: int = HEAVY) -> DataFrame:
    """The keys with more than ``heavy`` rows, counted with partial sums; at most rows / heavy of them."""
    return left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > heavy).select(key)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", heavy: DataFrame | None = None, rows: int = HEAVY, pieces: int = SPREAD, by: Column | None = None) -> DataFrame:
    """``left`` joined with ``right`` (one row per key) so that no key's rows meet in one task.

    Rows of a heavy key are dealt to ``pieces`` by a hash of the row (or of ``by``), and the one row
    of ``right`` is repeated for each piece.  Other keys are shuffled as usual.  ``heavy`` names the
    heavy keys where the caller already counted them.  With more than ``KEYS`` heavy keys each has
    less than one row in ``KEYS``, and the plain join is used.
    Rows with a null key match nothing: they stay in a left join and go in an inner one.
    """
    known = heavy_keys(left, key, rows) if heavy is None else heavy.select(key)
    known = known.limit(KEYS + 1).collect()
    if not known or len(known) > KEYS:
        return left.join(right, key, how)
    spark = left.sparkSession
    marks = F.broadcast(spark.createDataFrame(known, left.select(key).schema).withColumn("_heavy", F.lit(True)))
    deal = F.pmod(F.xxhash64(*left.columns) if by is None else F.xxhash64(by), F.lit(pieces)).cast("int")
    one = left.join(marks, key, "left").withColumn("_piece", F.when(F.col("_heavy"), deal).otherwise(0)).drop("_heavy")
    two = right.join(marks, key, "left").withColumn("_piece", F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0))))).drop("_heavy")
    return one.join(two, [key, "_piece"], how).drop("_piece")


def fits(right: DataFrame, key: str, most: int = BYTES) -> bool:
    """Whether a narrow table (a key and a few numbers) stays below ``most`` bytes: counted, not estimated."""
    size = right.agg(F.sum(F.octet_length(F.col(key).cast("string")) + ROW)).first()[0]
    return (size or 0) <= most


def checked_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", most: int = BYTES, **spread) -> DataFrame:
    """Join with a narrow table of unique keys: broadcast below ``most`` bytes, else with heavy keys dealt to many tasks."""
    if fits(right, key, most):
        return left.join(F.broadcast(right), key, how)
    return spread_join(left, right, key, how, **spread)
