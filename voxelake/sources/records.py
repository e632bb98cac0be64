"""Readers of query results and series metadata, and writers of the latter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "study_uid string, series_uid string, files array<struct<file_uri:string,size:bigint,crc32c:string,instance_uid:string>>"


def read_query_results(spark: SparkSession, path: str) -> DataFrame:
    """Instances with hints from JSON query results; a file without a URI is an error."""
    return query_result_instances(spark.read.schema(FILES).json(path))


def query_result_instances(results: DataFrame) -> DataFrame:
    rows = results.select("study_uid", "series_uid", F.inline("files"))
    uri = F.when(F.col("file_uri").isNull(), F.raise_error(F.lit("a file has no file_uri")).cast("string")).otherwise(F.col("file_uri"))
    return rows.select("study_uid", "series_uid", uri.alias("uri"), F.struct("size", "crc32c", "instance_uid").alias("hint"), F.array("file_uri").alias("dependencies"))


INSTANCES = (
    "map<string,struct<metadata:variant,uri:string,headers:struct<start_byte:bigint,end_byte:bigint>,offset_tables:variant,crc32c:string,size:bigint,"
    "original_path:string,dependencies:array<string>,diff_hash_dupe_paths:array<string>,version:string,modified_datetime:string>>"
)
#: Members of an instance in a document (fixed values).
MEMBERS = ("metadata", "uri", "headers", "offset_tables", "crc32c", "size", "original_path", "dependencies", "diff_hash_dupe_paths", "version", "modified_datetime")


def parsed_metadata(documents: DataFrame) -> DataFrame:
    """One row for each instance of the documents (value), original or de-identified, with all its members.

    ``position`` is the instance's place in its document, ``fields`` the custom fields, each as JSON text.
    """
    doc = documents.select(F.parse_json("value").alias("d"), F.from_json("value", "map<string,variant>").alias("top"), F.from_json(F.get_json_object("value", "$.cod.instances"), INSTANCES).alias("instances"))
    ours = ("study_uid", "series_uid", "deid_study_uid", "deid_series_uid", "cod")
    named = doc.select(
        F.coalesce(F.try_variant_get("d", "$.study_uid", "string"), F.try_variant_get("d", "$.deid_study_uid", "string")).alias("study_uid"),
        F.coalesce(F.try_variant_get("d", "$.series_uid", "string"), F.try_variant_get("d", "$.deid_series_uid", "string")).alias("series_uid"),
        F.try_variant_get("d", "$.deid_study_uid", "string").isNotNull().alias("hashed_uids"),
        F.transform_values(F.map_filter("top", lambda k, _: ~k.isin(*ours)), lambda _, v: F.to_json(v)).alias("fields"),
        "instances",
    )
    rows = named.select("study_uid", "series_uid", "hashed_uids", "fields", F.posexplode("instances").alias("position", "instance_uid", "i"))
    return rows.select("study_uid", "series_uid", "hashed_uids", "fields", "position", "instance_uid", "i.*")


def read_series_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``parsed_metadata`` of files, compressed by gzip if their names end in .gz."""
    return parsed_metadata(spark.read.text(path, wholetext=True))


def metadata_json(instances: DataFrame) -> DataFrame:
    """study_uid, series_uid and ``value``, the JSON document, of each series of ``instances``.

    Columns study_uid, series_uid and instance_uid are needed; ``hashed_uids`` (false if not there) says
    under which names the first two are written, ``position`` (else instance_uid) orders the instances,
    ``fields`` holds custom fields as JSON texts (those of the first instance count). Of ``MEMBERS``
    the columns that are there are written, others as null, and version as 1.0 if it is not there.
    """
    has = set(instances.columns)
    member = {name: F.col(name) if name in has else F.lit("1.0") for name in MEMBERS if name in has or name == "version"}
    known = F.to_json(F.struct(*(c.alias(name) for name, c in member.items())), {"ignoreNullFields": "false"})
    # what no row has is the same for all
    body = F.concat(F.substr(known, F.lit(1), F.length(known) - 1), F.lit("".join(f',"{name}":null' for name in MEMBERS if name not in member) + "}"))
    first = F.col("position") if "position" in has else F.col("instance_uid")
    rows = instances.select(
        "study_uid", "series_uid", F.coalesce("hashed_uids", F.lit(False)).alias("hashed") if "hashed_uids" in has else F.lit(False).alias("hashed"), first.alias("first"),
        F.concat(_json("instance_uid"), F.lit(":"), body).alias("entry"), F.col("fields") if "fields" in has else F.lit(None).cast("map<string,string>").alias("fields"),
    )
    listed = rows.groupBy("study_uid", "series_uid", "hashed").agg(F.array_sort(F.collect_list(F.struct("first", "entry"))).alias("entries"), F.min_by("fields", "first").alias("fields"))
    prefix = F.when(F.col("hashed"), F.lit("deid_")).otherwise(F.lit(""))
    custom = F.transform(F.map_entries(F.coalesce("fields", F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.lit(","), F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
    document = F.concat(
        F.lit('{"'), prefix, F.lit('study_uid":'), _json("study_uid"), F.lit(',"'), prefix, F.lit('series_uid":'), _json("series_uid"),
        F.lit(',"cod":{"instances":{'), F.array_join(F.col("entries.entry"), ","), F.lit("}}"), F.array_join(custom, ""), F.lit("}"),
    )
    return listed.select("study_uid", "series_uid", document.alias("value"))


def _json(name: str) -> Column:
    """A text column as a JSON string, null as null."""
    quoted = F.to_json(F.array(F.col(name)))
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)
