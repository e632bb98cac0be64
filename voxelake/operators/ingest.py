"""Ingest: first-wins deduplication, change classification, size and membership checks, grouping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

GB = 1024**3


def first_wins(batch: DataFrame, keys: list[str], order: list[str], digest: str = "crc") -> DataFrame:
    """``batch`` with ``status``: the first row of a key is new, later ones same or conflict by digest."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.first_value(digest).over(w)
    rank = F.row_number().over(w)
    return batch.withColumn("status", F.when(rank == 1, "new").when(F.col(digest).eqNullSafe(first), "same").otherwise("conflict"))


def winners(batch: DataFrame, keys: list[str], order: list[str], digest: str = "crc") -> DataFrame:
    return first_wins(batch, keys, order, digest).filter("status = 'new'").drop("status")


def classify(batch: DataFrame, existing: DataFrame, keys: list[str], digest: str = "crc", pixel: str | None = None) -> DataFrame:
    """Status of every row of a deduplicated batch against the stored instances.

    Without a stored instance of its key a row is new; with one it is the same if the digests are equal
    or, where ``pixel`` names digests of the pixel data, if those are known and equal; else a conflict.
    """
    stored = existing.select(*keys, F.col(digest).alias("_stored"), *([F.col(pixel).alias("_pixel")] if pixel else []), F.lit(True).alias("_there"))
    same: Column = F.col(digest).eqNullSafe(F.col("_stored"))
    if pixel:
        same = same | F.coalesce(F.col(pixel) == F.col("_pixel"), F.lit(False))
    joined = _joined(batch, stored, keys)
    return joined.withColumn("status", F.when(F.col("_there").isNull(), "new").when(same, "same").otherwise("conflict")).drop("_stored", "_there", *(["_pixel"] if pixel else []))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``left`` with the other columns of ``right``; a null key is a key."""
    named = right.select(*(F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)]
    return left.join(named, on, "left").drop(*(f"_key{n}" for n in range(len(keys))))


def merged(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str], digest: str = "crc") -> DataFrame:
    """The store after appending a batch: what was there and the batch's new instances."""
    fresh = winners(batch, keys, order, digest).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)


def conflict_paths(batch: DataFrame, keys: list[str], order: list[str], path: str, digest: str = "crc") -> DataFrame:
    """For each key the distinct paths of rows whose digest differs from the first row's, remote ones only."""
    rows = first_wins(batch, keys, order, digest).filter((F.col("status") == "conflict") & S.is_remote(F.col(path)))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(path)).alias("paths"))


def size_checked(batch: DataFrame, max_gb: float = 10.0, size: str = "size") -> DataFrame:
    """``batch`` with ``error``: set where an instance is larger than allowed."""
    return batch.withColumn("error", F.when(F.col(size) > F.lit(max_gb * GB), F.lit("instance too large")))


def series_sizes(batch: DataFrame, existing: DataFrame, series: str, max_gb: float = 100.0, size: str = "size") -> DataFrame:
    """Bytes of each incoming series with those stored, and whether that is too much.

    Repeats within the batch count, since sizes are checked before deduplication.
    """
    incoming = batch.groupBy(series).agg(F.sum(size).alias("incoming"))
    stored = existing.groupBy(series).agg(F.sum(size).alias("stored"))
    both = _joined(incoming, stored, [series]).withColumn("stored", F.coalesce("stored", F.lit(0)))
    return both.withColumn("too_large", (F.col("incoming") + F.col("stored")) > F.lit(max_gb * GB))


def membership(batch: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """``batch`` with ``belongs``: whether its series is among ``series``."""
    known = series.select(*keys).distinct().withColumn("belongs", F.lit(True))
    return _joined(batch, known, keys).withColumn("belongs", F.coalesce("belongs", F.lit(False)))


def belonging(batch: DataFrame, study: str, series: str, *, hashed: bool, hash_uid: Callable[[Column], Column] | None = None, names: tuple[str, str] = ("study_uid", "series_uid")) -> DataFrame:
    """``batch`` with ``belongs``: whether its identifiers, hashed if the series' are, are those of the series (``study``, ``series``).

    A series with hashed identifiers needs the function that hashes them, and one without may not be
    given one (``UidHashMissing``).
    """
    if hashed != (hash_uid is not None):
        raise S.UidHashMissing("a series has hashed identifiers if and only if its instances come with a function that hashes them")
    of = lambda name: S.uid(F.col(name), hash_uid, hashed)
    return batch.withColumn("belongs", of(names[0]).eqNullSafe(F.lit(study)) & of(names[1]).eqNullSafe(F.lit(series)))


def record_dupes(existing: DataFrame, appended: DataFrame, keys: list[str], at: Column, path: str = "path", paths: str = "diff_hash_dupe_paths", modified: str = "modified_datetime") -> DataFrame:
    """``existing`` with the remote paths of conflicting rows (of ``append``) that are not listed yet.

    ``at`` is the time of the batch, which becomes ``modified`` of the rows that got a path, as ISO 8601.
    Paths are added in order; null lists count as empty. ``existing`` has no row twice.
    """
    found = appended.filter((F.col("status") == "conflict") & S.is_remote(F.col(path))).groupBy(*keys).agg(F.array_sort(F.collect_set(path)).alias("_paths"))
    listed = F.coalesce(paths, F.array().cast("array<string>"))
    fresh = F.array_except(F.coalesce("_paths", F.array().cast("array<string>")), listed)
    joined = _joined(existing, found, keys).withColumn("_fresh", fresh)
    time = F.when(F.size("_fresh") > 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.col(modified))
    return joined.withColumn(modified, time).withColumn(paths, F.concat(listed, F.col("_fresh"))).drop("_paths", "_fresh")


class NothingAppended(ValueError):
    """All instances of a batch had errors."""


def require_some(appended: DataFrame) -> DataFrame:
    """``appended`` (of ``append``), or ``NothingAppended`` if it has rows and all of them are errors."""
    some = appended.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors")).first()
    if some.n and some.n == some.errors:
        raise NothingAppended(f"{some.n} instances")
    return appended


def grouped(batch: DataFrame, keys: list[str], *, order: str, value: str) -> DataFrame:
    """Instances of each series in order."""
    return batch.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("members"), F.count(F.lit(1)).alias("n"))


def append(
    batch: DataFrame, existing: DataFrame, keys: list[str], order: list[str], *,
    series: str, size: str = "size", digest: str = "crc", pixel: str | None = None, known: DataFrame | None = None, max_instance_gb: float = 10.0, max_series_gb: float = 100.0,
) -> DataFrame:
    """Every row of an arriving batch with ``status`` (new, same, conflict or error) and ``error``.

    In this order: rows that are too large are errors; so are all rows of a series that grows too large,
    repeats included; of equal keys the first row goes on and later ones are the same or conflicts; rows of
    series that are not among ``known`` (its column named as ``series``; None: all are) are errors; what is
    left is held against the stored instances. A null size counts as no bytes and a null key is a key.
    """
    sized = size_checked(batch, max_instance_gb, size)
    sums = series_sizes(sized.filter("error IS NULL"), existing, series, max_series_gb, size).filter("too_large").select(F.col(series).alias("_series"), F.lit("series too large").alias("_large"))
    checked = sized.join(sums, F.col(series).eqNullSafe(F.col("_series")), "left").withColumn("error", F.coalesce("error", "_large")).drop("_series", "_large")
    faulty = checked.filter("error IS NOT NULL").withColumn("status", F.lit("error"))
    ranked = first_wins(checked.filter("error IS NULL"), keys, order, digest)
    repeats, fresh = ranked.filter("status != 'new'"), ranked.filter("status = 'new'").drop("status")
    if known is not None:
        placed = membership(fresh, known, [series])
        stray = placed.filter(~F.col("belongs")).drop("belongs").withColumn("error", F.lit("not of this series")).withColumn("status", F.lit("error"))
        faulty, fresh = faulty.unionByName(stray), placed.filter("belongs").drop("belongs")
    return faulty.unionByName(repeats).unionByName(classify(fresh, existing, keys, digest, pixel))
