"""Counts of what a batch did, taken while it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(rows: DataFrame, status: str = "status") -> tuple[DataFrame, Observation]:
    """``rows`` and an observation of how many have each status, filled by the next action on them."""
    seen = Observation("append")
    return rows.observe(seen, *(F.count_if(F.col(status) == s).alias(s) for s in ("new", "same", "conflict", "error"))), seen


#: Storage classes (fixed values).
STORAGE_CLASSES = ("STANDARD", "NEARLINE", "COLDLINE", "ARCHIVE")


def append_counts(appended: DataFrame, series: str, size: str = "size") -> DataFrame:
    """One row of what ``ingest.append`` did: true and differing duplicates, series that had either, bytes and containers written."""
    repeat = F.col("status").isin("same", "conflict")
    return appended.agg(
        F.count_if(F.col("status") == "same").alias("num_true_duplicates"),
        F.count_if(F.col("status") == "conflict").alias("num_diffhash_duplicates"),
        F.count_distinct(F.when(repeat, F.col(series))).alias("num_duplicate_series"),
        F.count_distinct(F.when(F.col("status") == "new", F.col(series))).alias("tar_success"),
        F.coalesce(F.sum(F.when(F.col("status") == "new", F.col(size))), F.lit(0)).cast("bigint").alias("tar_bytes_processed"),
    )


def deletion_counts(plan: DataFrame, instances: DataFrame) -> DataFrame:
    """One row of what an ``integrity.dependency_plan`` does for ``instances`` (uid, size): files by action, and bytes of instances that lose one."""
    named = {"delete": "num_deletes", "gone": "dep_does_not_exist", "mismatch": "instance_blob_crc32c_mismatch", "nested": "nested_dependency", "null": "null_dependency"}
    counted = plan.agg(*(F.count_if(F.col("action") == a).alias(name) for a, name in named.items()))
    gone = instances.join(plan.filter("action = 'delete'").select("uid").distinct(), "uid", "left_semi")
    # one row on either side
    return counted.crossJoin(F.broadcast(gone.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes_deleted"))))


def integrity_counts(states: DataFrame) -> DataFrame:
    """One row of what ``integrity.compare`` found."""
    return states.agg(F.count_if(F.col("state") == "missing").alias("deps_missing_from_tar"), F.count_if(F.col("state") == "mismatch").alias("tar_metadata_crc32c_mismatch"), F.count_if(F.col("state") == "extra").alias("instances_not_found"))


def storage_counts(operations: DataFrame) -> DataFrame:
    """One row of ``operations`` (op: GET or CREATE, storage_class): a count for each pair, such as num_STANDARD_gets."""
    return operations.agg(*(F.count_if((F.col("op") == op) & (F.col("storage_class") == c)).alias(f"num_{c}_{name}") for op, name in (("CREATE", "creates"), ("GET", "gets")) for c in STORAGE_CLASSES))


def series_deletion_counts(series: DataFrame) -> DataFrame:
    """One row of ``series`` (outcome: deleted, failed or not found)."""
    named = {"deleted": "series_deleted", "failed": "series_deletions_failed", "not found": "series_not_found"}
    return series.agg(*(F.count_if(F.col("outcome") == o).alias(name) for o, name in named.items()))


def thumbnail_counts(thumbnails: DataFrame) -> DataFrame:
    """One row of ``thumbnails`` (pixels, null for a series without pixel data)."""
    return thumbnails.agg(
        F.count_if(F.col("pixels").isNull()).alias("series_missing_pixel_data"),
        F.count_if(F.col("pixels").isNotNull()).alias("thumbnail_success"),
        F.coalesce(F.sum(F.octet_length("pixels")), F.lit(0)).cast("bigint").alias("thumbnail_bytes_processed"),
    )
