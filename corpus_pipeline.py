"""Corpus pipeline: from raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. The first stage numbers
the rows it keeps; later ones tell rows apart by that number, since doc_id may be null or repeated. All
stages take nulls in any column, texts of any length, repeated rows and other columns of any name but
that of the number, and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.llm import decontamination, exact_dedup, ngram_join, quality, sentencepiece_codec
from voxelake.llm.common import ROW, drop_shared, shrink_heaps, table, write_shared


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with numbers. Each row is judged by its text, null as empty."""
    return quality.accepted(docs, table(spark, sf_dir, "labels")).withColumn(ROW, F.monotonically_increasing_id())


def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest id, null last, of equal ids the first. Null and empty texts are equal."""
    return exact_dedup.kept_rows(docs)


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (shingles of five words, similarity 0.8 or more): that of the smallest id.

    Null ids come last, of equal ids the first row stays. Texts without words link with nothing and stay.
    """
    return ngram_join.representatives(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item, each row by its own text. Null and empty texts stay."""
    shrink_heaps(spark)
    return decontamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with their number, checksum and whether they decode to the text (null as empty)."""
    shrink_heaps(spark)
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_filter),
    ("ngram_join", near_filter),
    ("decontamination", benchmark_filter),
    ("sentencepiece", encode_ids),
]

#: No stage's decisions can be said in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote goes once the next one has written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs, path = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_shared(spark, *before)
        before = [path]
    return docs
