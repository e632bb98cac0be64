"""Retrieval requests: parsing, validation and answers at study, series, instance and frame level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


#: Tags of an answer at study level (fixed values).
STUDY_TAGS = ("00100010", "00100020", "00100030", "00100040", "00080020", "00080030", "00080050", "00080090", "0020000D", "00081030")


def parse(uri: Column) -> Column:
    """The parts of ``<store>/studies/S[/series/R[/instances/I[/frames/1,2]]][/metadata]`` as a struct."""
    frames = S.after(uri, "/frames/")
    return F.struct(
        F.when(uri.contains("/studies/"), F.substring_index(uri, "/studies/", 1)).alias("store"),
        S.after(uri, "/studies/").alias("study"),
        S.after(uri, "/series/").alias("series"),
        S.after(uri, "/instances/").alias("instance"),
        F.when(frames.isNotNull(), F.transform(F.split(frames, ","), lambda x: x.try_cast("int"))).alias("frames"),
    )


def request_fault(uri: Column, request: Column) -> Column:
    """Why a request is not valid, null if it is."""
    return (
        F.when(~uri.startswith("gs://"), "scheme")
        .when(uri.contains("?"), "query string")
        .when(~uri.contains("/studies/"), "no study")
        .when(~uri.endswith("/metadata") & ~uri.contains("/frames/"), "no metadata suffix")
        .when(~S.valid_uid(request["study"]), "study uid")
        .when(request["series"].isNotNull() & ~S.valid_uid(request["series"]), "series uid")
        .when(request["instance"].isNotNull() & ~S.valid_uid(request["instance"]), "instance uid")
    )


def level(request: Column) -> Column:
    return F.when(request["frames"].isNotNull(), "frame").when(request["instance"].isNotNull(), "instance").when(request["series"].isNotNull(), "series").otherwise("study")


def frame_fault(has_pixels: Column, n_frames: Column, frames: Column) -> Column:
    """Why frames (from 1) can't be read, null if they can."""
    return F.when(~F.coalesce(has_pixels, F.lit(False)), "no pixel data").when(F.exists(frames, lambda i: i.isNull() | (i < 1) | (i > F.coalesce(n_frames, F.lit(1)))), "out of bounds")


def study_attributes(instances: DataFrame, study: str, series: str, seq: str, attributes: list[str]) -> DataFrame:
    """Attributes of one instance of each study: the first of its least series."""
    least = F.min_by(F.struct(*attributes), F.struct(series, seq))
    return instances.groupBy(study).agg(F.min(series).alias(series), least.alias("_of")).select(study, series, "_of.*")


def answers(requests: DataFrame, instances: DataFrame) -> DataFrame:
    """Answers to ``requests`` (uri, any other columns) from ``instances``.

    ``instances`` has store, study_uid, series_uid, instance_uid, seq, metadata (JSON text) and
    frames (array<binary>, null without pixel data). Adds level, fault (why there is no answer, else
    null), body (JSON text: at study level the ten ``STUDY_TAGS`` of the first instance of its least
    series, null where it has none; at series level a list of its instances' metadata in order; at
    instance level its metadata) and content (at frame level the frames asked for).

    A request that is not valid or finds nothing has a fault and no answer. Null URIs are faulty;
    requests that repeat are each answered; with no instances every valid request finds nothing.
    """
    names = list(requests.columns)
    # faults are a column and no filter: a filter would be pushed down to where the URIs are made, with a copy of their making for each use
    parsed = requests.filter("uri IS NOT NULL").withColumn("_r", parse(F.col("uri"))).withColumn("_fault", request_fault(F.col("uri"), F.col("_r"))).withColumn("level", level(F.col("_r")))
    place = ["store", "study_uid", "series_uid"]
    at = ["_kind", "_store", "_study", "_series", "_instance"]
    blank = F.lit("")

    # each request meets answers of its own kind once; a part that its kind needs and it lacks is null and finds nothing
    good = F.col("_fault").isNull()
    kind = F.when(~good, "fault").when(F.col("level") == "frame", "instance").otherwise(F.col("level"))
    parsed = parsed.withColumn("_kind", kind)
    of = [F.when(good, F.col("_r.store")).otherwise(F.col("uri")), F.when(good, F.col("_r.study")), F.when(F.col("_kind") == "study", blank).otherwise(F.col("_r.series")), F.when(F.col("_kind") == "instance", F.col("_r.instance")).otherwise(blank)]
    asked = parsed.select(*names, "level", "_fault", "_kind", F.col("_r.frames").alias("_wanted"), *(c.alias(k) for c, k in zip(of, at[1:], strict=True)))

    none = F.lit(None).cast("array<binary>")

    def held(found: DataFrame, kind: str, keys: list[Column | str], body: Column | str, frames: Column) -> DataFrame:
        return found.select(F.lit(kind).alias("_kind"), *(F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for c, k in zip(keys, at[1:], strict=True)), F.col(body).alias("_body") if isinstance(body, str) else body.alias("_body"), frames.alias("_frames"), F.lit(True).alias("_there"))

    ordered = instances.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("seq", "instance_uid", "metadata"))).alias("_of"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("_of", lambda x: F.coalesce(x["metadata"], F.lit("null"))), ","), F.lit("]"))
    first = ordered.groupBy(*place[:2]).agg(F.min(F.struct("series_uid", F.element_at("_of", 1)["metadata"].alias("m"))).alias("_least")).select(*place[:2], "_least.m")
    tags = F.array_join(F.array(*(F.concat(F.lit(f'"{t}":'), F.coalesce(F.get_json_object("m", f"$.{t}"), F.lit("null"))) for t in STUDY_TAGS)), ",")
    found = held(first, "study", [*place[:2], blank, blank], F.concat(F.lit("{"), tags, F.lit("}")), none)
    found = found.unionByName(held(ordered, "series", [*place, blank], listed, none)).unionByName(held(instances, "instance", [*place, "instance_uid"], "metadata", F.col("frames")))
    rows = asked.join(found, at, "left")
    wanted = F.col("_wanted")
    fault = F.when(F.col("_fault").isNotNull(), F.col("_fault")).when(F.col("_there").isNull(), "not found").when(F.col("level") == "frame", frame_fault(F.col("_frames").isNotNull(), F.size("_frames"), wanted))
    answered = rows.withColumn("fault", fault).select(
        *names, "level", "fault",
        F.when(F.col("fault").isNull() & (F.col("level") != "frame"), F.col("_body")).alias("body"),
        F.when(F.col("fault").isNull() & (F.col("level") == "frame"), F.transform(wanted, lambda i: F.element_at("_frames", i))).alias("content"),
    )
    blind = requests.filter("uri IS NULL").select(*names, level(parse(F.col("uri"))).alias("level"), F.lit("no uri").alias("fault"), F.lit(None).cast("string").alias("body"), none.alias("content"))
    return answered.unionByName(blind)


class InstanceNotFound(LookupError):
    """No instance of that identifier, or at that place of its series."""


def instance(instances: DataFrame, series: str, *, uid: str | None = None, position: int | None = None, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The one instance of a series (series_uid, instance_uid) with an identifier, or at a place of its order; ``InstanceNotFound`` without one."""
    own = instances.filter(F.col("series_uid") == series)
    found = own.filter(F.col("instance_uid") == uid) if uid is not None else own.orderBy(*order).offset(position).limit(1) if position is not None and position >= 0 else own.limit(0)
    if found.isEmpty():
        raise InstanceNotFound(f"{series}: {uid if uid is not None else position}")
    return found
