"""Corpus cleaning: each stage works on what the stage before kept.

1. Toxicity: documents predicted toxic go.
2. Exact dedup: of equal texts the row with the largest doc_id stays.
3. N-gram Jaccard join: of each group of near copies (linked directly or by others) the row with the
   smallest doc_id stays.
4. Benchmark decontamination: documents with a passage of a test item go.
5. Pieces: what is left is encoded and decoded again; the best segmentations, their scores, the
   decoded text's sha256 and whether it is the text are the result.

The first four return the columns of documents.  A stage keeps nulls and empty texts like any other
row, and an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebar.llm import decontaminate, exact_dedup, jaccard_join, pieces, toxicity
from tidebar.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_last(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # a fitted model and n-best segmentation have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
