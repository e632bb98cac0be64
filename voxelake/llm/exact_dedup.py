"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Three combining stages, each of which groups by the digest *and* the full content:

1. within a task, before anything is shuffled (Spark's partial aggregation);
2. among rows of one digest and salt, so that a group holding a third of all rows is merged by
   ``salts`` tasks and not by one;
3. among the salt winners, at most ``salts`` rows a group.

Rows then find their winner by digest and salt, under each salt that the group has, so that a large
group is dealt over as many tasks on the way back as on the way there. A digest that stands for two
contents (a collision) is noticed in stage 3, and its rows find their winner by digest and content
instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, numbered, smallest, table, text_of, write_shared

#: Runs of these become one space before texts are compared.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, " ")


def exact_dedup(docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): which row of its group stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256. A null text counts as empty, so empty
    and null texts form one group. Null ids never win against others; a group of null ids only has
    a null keep_id and its rows count as kept. Rows that repeat a doc_id and its text are all
    marked alike. Very long texts are compared whole. An empty table gives no rows; other columns of
    ``docs`` are not read. ``salts`` (62 at most) tell rows of one group apart by doc_id, so those
    that have none share one.

    ``digest`` replaces SHA-256 as the grouping key (tests force collisions with it).
    """
    digest = digest or (lambda text: F.unhex(F.sha2(text, 256)))
    rows = docs.select("doc_id", normalised(text_of()).alias("content")).withColumn("digest", digest(F.col("content")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # a bit for each salt of the group
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt").cast("int"))
    winners = merged.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.bit_or(bit).alias("bits"))
    by_digest = winners.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"),
        F.min("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.max(F.sha2("content", 256)).alias("text_sha256"),
        F.bit_or("bits").alias("bits"),
    )
    by_digest, _ = write_shared(by_digest, "exact-dedup")
    each = by_digest.filter("contents = 1").withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda x: F.call_function("shiftrightunsigned", "bits", x) % 2 == 1)))
    found = salted.select("doc_id", "digest", F.col("salt").cast("int").alias("salt")).join(each, ["digest", "salt"])
    found = found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    if by_digest.filter("contents > 1").isEmpty():
        return found
    collided = by_digest.filter("contents > 1").select("digest")
    exact = rows.join(collided, "digest", "left_semi").join(winners.drop("bits"), ["digest", "content"])
    return found.unionByName(exact.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.sha2("content", 256).alias("text_sha256")))


def kept_rows(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one in each group of equal texts.

    That is the row of the smallest doc_id. Null ids come last, and of rows with the same doc_id (or
    with null ones) the first stays. Rows of different texts never touch each other, whatever their ids.
    """
    rows = numbered(docs)
    found = exact_dedup(rows.select(F.col(ROW).alias("doc_id"), "text"), salts).filter("NOT kept")
    return smallest(rows, found.select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("first")), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
