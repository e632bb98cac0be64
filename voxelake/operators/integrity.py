"""Checks of stored content against metadata, and plans for deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def compare(metadata: DataFrame, content: DataFrame, key: str, digest: str) -> DataFrame:
    """For each key: ok, missing (in the content), extra (in the content only) or mismatch."""
    a = metadata.select(key, F.col(digest).alias("_said"), F.lit(True).alias("_a"))
    b = content.select(key, F.col(digest).alias("_found"), F.lit(True).alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_said").eqNullSafe(F.col("_found")), "ok").otherwise("mismatch")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def deletion_plan(files: DataFrame, uri: str, size: str) -> DataFrame:
    """``files`` with ``action``: delete_remote, delete_local, or skip for members of archives and null URIs."""
    where = F.col(uri)
    action = F.when(where.isNull(), "skip").when(S.is_nested(where), "skip").when(S.is_remote(where), "delete_remote").otherwise("delete_local")
    return files.withColumn("action", action).withColumn("bytes", F.when(F.col("action") == "skip", F.lit(0)).otherwise(F.col(size)).cast("bigint"))


class IntegrityError(ValueError):
    """Container and metadata differ."""


def checked(metadata: DataFrame, content: DataFrame, key: str, digest: str) -> DataFrame:
    """``compare``, or ``IntegrityError`` if any row is not ok."""
    states = compare(metadata, content, key, digest)
    wrong = {r.state: r.n for r in states.filter("state <> 'ok'").groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    if wrong:
        raise IntegrityError(str(wrong))
    return states


def dependency_plan(instances: DataFrame, stored: DataFrame, validate: bool = True) -> DataFrame:
    """What deleting the dependencies of ``instances`` (uid, dependencies, crc, size) does: uid, uri, action.

    ``stored`` (uri, crc) are the files that exist. An action is ``delete``; ``nested`` (a member of an
    archive, which is not deleted); ``gone`` (not there any more); ``mismatch`` (with ``validate``, the
    only dependency of an instance whose checksum is not the instance's); or ``null``.
    """
    single = F.size("dependencies") == 1
    listed = instances.select("uid", F.col("crc").alias("_crc"), single.alias("_single"), F.explode("dependencies").alias("uri"))
    there = stored.select(F.col("uri").alias("_uri"), F.col("crc").alias("_found"), F.lit(True).alias("_there"))
    joined = listed.join(there, F.col("uri") == F.col("_uri"), "left")
    wrong = S.is_remote(F.col("uri")) & F.col("_single") & ~F.col("_crc").eqNullSafe(F.col("_found")) if validate else F.lit(False)
    action = F.when(F.col("uri").isNull(), "null").when(S.is_nested(F.col("uri")), "nested").when(F.col("_there").isNull(), "gone").when(wrong, "mismatch").otherwise("delete")
    return joined.select("uid", "uri", action.alias("action"))
