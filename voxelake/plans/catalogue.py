"""Registered queries of the library's own operators, with their DuckDB counterparts.

Tables stand for the store's relations: ``lineitem`` is a stream of arriving instances (series: order,
instance: order and line), ``customer``/``orders``/``lineitem`` is the study/series/instance
hierarchy, ``documents`` are payloads, ``labels`` optional attributes, ``conversations`` a numbered
series, ``events`` a log and field store, ``embeddings`` 8 x 8 frames, ``pages`` URIs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import counters, dml, ingest, integrity, layout, retrieval, thumbnails
from ..sources import records
from ..streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEYS = ["series_uid", "instance_uid"]
ORDER = ["arrived", "path"]


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving instances with digest, size, path and time."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("series_uid"),
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("instance_uid"),
        F.md5(F.concat_ws("|", "l_returnflag", "l_linestatus").cast("binary")).alias("crc"),
        (F.col("l_quantity").cast("bigint") * 1000 + F.col("l_linenumber")).alias("size"),
        F.concat(F.when(F.col("l_partkey") % 3 == 0, "gs://b/").when(F.col("l_partkey") % 3 == 1, "/local/").otherwise("s3://b/x.tar://"), F.md5(F.concat_ws("|", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), "l_returnflag", F.col("l_extendedprice").cast("bigint")).cast("binary"))).alias("path"),
        F.col("l_shipdate").alias("arrived"),
    )


VI = """i AS (SELECT l_orderkey AS series_uid, concat_ws('.', l_orderkey, l_linenumber) AS instance_uid,
  md5(concat_ws('|', l_returnflag, l_linestatus)) AS crc, CAST(l_quantity AS BIGINT) * 1000 + l_linenumber AS size,
  CASE l_partkey % 3 WHEN 0 THEN 'gs://b/' WHEN 1 THEN '/local/' ELSE 's3://b/x.tar://' END
    || md5(concat_ws('|', l_partkey, l_suppkey, CAST(l_quantity AS INT), l_returnflag, CAST(trunc(l_extendedprice) AS BIGINT))) AS path, l_shipdate AS arrived FROM lineitem)"""
#: Stored and arriving parts of the stream, and their first instances.
OLD = "arrived < TIMESTAMP '2000-01-01'"
SPLIT = f"""{VI}, e AS (SELECT * FROM i WHERE {OLD} QUALIFY row_number() OVER (PARTITION BY series_uid, instance_uid ORDER BY arrived, path) = 1),
 b AS (SELECT * FROM i WHERE NOT {OLD} QUALIFY row_number() OVER (PARTITION BY series_uid, instance_uid ORDER BY arrived, path) = 1)"""


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = instances(spark, sf_dir)
    old = rows.filter("arrived < TIMESTAMP_NTZ '2000-01-01'")
    return ingest.winners(old, KEYS, ORDER), ingest.winners(rows.filter("arrived >= TIMESTAMP_NTZ '2000-01-01'"), KEYS, ORDER)


# ---- ingest -------------------------------------------------------------------------------------


@query(f"WITH {VI}, s AS (SELECT CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN crc = first_value(crc) OVER w THEN 'same' ELSE 'conflict' END AS status FROM i WINDOW w AS (PARTITION BY series_uid, instance_uid ORDER BY arrived, path)) SELECT status, count(*) AS n FROM s GROUP BY status")
def ingest_dedupe(spark, sf_dir):
    return ingest.first_wins(instances(spark, sf_dir), KEYS, ORDER).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SPLIT} SELECT b.series_uid, b.instance_uid, CASE WHEN e.crc IS NULL THEN 'new' WHEN e.crc = b.crc THEN 'same' ELSE 'conflict' END AS status FROM b LEFT JOIN e USING (series_uid, instance_uid)")
def ingest_classify(spark, sf_dir):
    stored, batch = split(spark, sf_dir)
    return ingest.classify(batch, stored, KEYS).select(*KEYS, "status")


@query(f"WITH {SPLIT} SELECT 'new' AS status, count(*) AS n FROM b")
def ingest_empty_existing(spark, sf_dir):
    stored, batch = split(spark, sf_dir)
    return ingest.classify(batch, stored.limit(0), KEYS).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VI}, w AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY series_uid, instance_uid ORDER BY arrived, path) = 1) SELECT series_uid, instance_uid, crc FROM w")
def ingest_two_step_equivalence(spark, sf_dir):
    """Two overlapping batches, one after the other, give what one batch gives."""
    rows = instances(spark, sf_dir)
    first = ingest.winners(rows.filter("arrived < TIMESTAMP_NTZ '2001-01-01'"), KEYS, ORDER)
    return ingest.merged(first, rows.filter("arrived >= TIMESTAMP_NTZ '1999-01-01'"), KEYS, ORDER).select(*KEYS, "crc")


@query(f"WITH {VI} SELECT size > 40000 AS too_large, count(*) AS n, sum(size)::BIGINT AS bytes FROM i GROUP BY 1")
def size_filter_instance(spark, sf_dir):
    rows = ingest.size_checked(instances(spark, sf_dir), 40000 / ingest.GB)
    return rows.groupBy(F.col("error").isNotNull().alias("too_large")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {VI} SELECT b.series_uid, incoming::BIGINT AS incoming, coalesce(stored, 0)::BIGINT AS stored, incoming + coalesce(stored, 0) > 150000 AS too_large FROM (SELECT series_uid, sum(size) AS incoming FROM i WHERE NOT {OLD} GROUP BY 1) b LEFT JOIN (SELECT series_uid, sum(size) AS stored FROM i WHERE {OLD} GROUP BY 1) e USING (series_uid)")
def size_check_series(spark, sf_dir):
    rows = instances(spark, sf_dir)
    return ingest.series_sizes(rows.filter("arrived >= TIMESTAMP_NTZ '2000-01-01'"), rows.filter("arrived < TIMESTAMP_NTZ '2000-01-01'"), "series_uid", 150000 / ingest.GB)


@query(f"WITH {VI} SELECT o_orderkey IS NOT NULL AS belongs, count(*) AS n FROM i LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON series_uid = o_orderkey GROUP BY 1")
def belongs_to_series(spark, sf_dir):
    series = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("series_uid"))
    return ingest.membership(instances(spark, sf_dir), series, ["series_uid"]).groupBy("belongs").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, coalesce(l.quality, n_chars) AS trusted, n_chars AS actual FROM documents d LEFT JOIN labels l USING (doc_id)")
def hint_resolution(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", S.trusted(F.col("quality").cast("bigint"), F.col("n_chars")).alias("trusted"), S.trusted(F.col("quality"), F.col("n_chars"), False).alias("actual"))


@query("SELECT d.doc_id, CASE WHEN quality IS NOT NULL AND quality <> n_chars % 2 THEN 'size' WHEN toxic IS NOT NULL AND toxic <> d.doc_id % 2 THEN 'crc32c' END AS fault FROM documents d LEFT JOIN labels l USING (doc_id)")
def hint_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", S.hint_fault(size=(F.col("quality"), F.col("n_chars") % 2), crc32c=(F.col("toxic"), F.col("doc_id") % 2)).alias("fault"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fetch_needed(spark, sf_dir):
    """Instances without hints have to be fetched."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT lang, source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members, count(*) AS n FROM documents GROUP BY 1, 2")
def group_series(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("name", F.col("doc_id").cast("string"))
    return ingest.grouped(rows, ["lang", "source"], order="doc_id", value="name").withColumn("members", F.array_join("members", ","))


@query(f"WITH {VI} SELECT count(DISTINCT series_uid) AS series, count(*) AS instances, count(*) > 1 AND count(DISTINCT series_uid) / count(*) > 0.5 AS poor FROM i")
def poor_grouping_ratio(spark, sf_dir):
    rows = instances(spark, sf_dir).agg(F.count_distinct("series_uid").alias("series"), F.count(F.lit(1)).alias("instances"))
    return rows.withColumn("poor", (F.col("instances") > 1) & (F.col("series") / F.col("instances") > 0.5))


@query(f"WITH {VI}, s AS (SELECT *, first_value(crc) OVER (PARTITION BY series_uid, instance_uid ORDER BY arrived, path) AS first_crc FROM i) SELECT series_uid, instance_uid, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM s WHERE crc <> first_crc AND regexp_matches(path, '^(http|s3://|gs://)') GROUP BY 1, 2")
def dupe_path_collect(spark, sf_dir):
    return ingest.conflict_paths(instances(spark, sf_dir), KEYS, ORDER, "path").withColumn("paths", F.array_join("paths", ","))


@query(f"WITH {VI}, s AS (SELECT CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN crc = first_value(crc) OVER w THEN 'same' ELSE 'conflict' END AS status FROM i WINDOW w AS (PARTITION BY series_uid, instance_uid ORDER BY arrived, path)) SELECT count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'same') AS n_same, count(*) FILTER (status = 'conflict') AS n_conflict, 0::BIGINT AS n_error FROM s")
def append_metrics(spark, sf_dir):
    """Counts by status; ``counters.observed`` takes the same while rows are written."""
    rows, _ = counters.observed(ingest.first_wins(instances(spark, sf_dir), KEYS, ORDER))
    return rows.agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "same", "conflict", "error")))


@query(f"WITH {SPLIT} SELECT 'new' AS part, count(*) AS n FROM b UNION ALL SELECT 'kept', count(*) FROM e")
def append_union(spark, sf_dir):
    stored, batch = split(spark, sf_dir)
    return batch.select(F.lit("new").alias("part")).unionByName(stored.select(F.lit("kept").alias("part"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SPLIT} SELECT EXISTS (SELECT 1 FROM b JOIN e USING (series_uid, instance_uid)) AS any_stored")
def exists_gate(spark, sf_dir):
    stored, batch = split(spark, sf_dir)
    return batch.join(stored, KEYS, "left_semi").limit(1).agg((F.count(F.lit(1)) > 0).alias("any_stored"))


@query("SELECT l_orderkey AS series_uid, l_orderkey || '.' || l_linenumber AS instance_uid, CAST(l_quantity AS BIGINT) AS size, md5(CAST(l_partkey AS VARCHAR)) AS crc32c, 'gs://b/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS uri FROM lineitem")
def query_result_source(spark, sf_dir):
    """Nested query results, one for each series, and the instances read from them."""
    line = table(spark, sf_dir, "lineitem")
    file = F.struct(
        F.concat_ws("/", F.lit("gs://b"), "l_orderkey", "l_linenumber", "l_partkey").alias("file_uri"), F.col("l_quantity").cast("bigint").alias("size"),
        F.md5(F.col("l_partkey").cast("string").cast("binary")).alias("crc32c"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("instance_uid"),
    )
    nested = line.groupBy(F.col("l_orderkey").alias("series_uid")).agg(F.collect_list(file).alias("files")).withColumn("study_uid", F.lit("1"))
    return records.query_result_instances(nested).select("series_uid", F.col("hint.instance_uid").alias("instance_uid"), F.col("hint.size").alias("size"), F.col("hint.crc32c").alias("crc32c"), "uri")


# ---- changes ------------------------------------------------------------------------------------


@query(f"WITH {SPLIT} SELECT series_uid, instance_uid, crc FROM e WHERE (series_uid, instance_uid) IN (SELECT (series_uid, instance_uid) FROM b) UNION ALL SELECT series_uid, instance_uid, crc FROM b WHERE (series_uid, instance_uid) NOT IN (SELECT (series_uid, instance_uid) FROM e)")
def truncate(spark, sf_dir):
    return dml.truncate(*split(spark, sf_dir), KEYS).select(*KEYS, "crc")


@query(f"WITH {SPLIT} SELECT series_uid, instance_uid, crc FROM e WHERE (series_uid, instance_uid) NOT IN (SELECT (series_uid, instance_uid) FROM b)")
def remove(spark, sf_dir):
    return dml.remove(*split(spark, sf_dir), KEYS).select(*KEYS, "crc")


@query(f"WITH {SPLIT} SELECT series_uid, instance_uid FROM b WHERE (series_uid, instance_uid) NOT IN (SELECT (series_uid, instance_uid) FROM e)")
def remove_missing_report(spark, sf_dir):
    return dml.missing_requests(*split(spark, sf_dir), KEYS)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_keep(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_new(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


LATEST = "f AS (SELECT event_type AS field, arg_max(props, (ts, event_id)) AS value FROM events GROUP BY 1)"


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom fields of one series: the last value for each event type."""
    last = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("props", F.struct("ts", "event_id")).alias("value"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("fields"))


@query(f"WITH {LATEST} SELECT field, value FROM f WHERE field <> 'click' UNION ALL SELECT 'click', 'replaced' UNION ALL SELECT 'note', 'added'")
def field_put(spark, sf_dir):
    done = dml.put_field(dml.put_field(fields(spark, sf_dir), "click", "replaced"), "note", "added")
    return done.select(F.explode("fields").alias("field", "value"))


@query(f"WITH {LATEST} SELECT (SELECT value FROM f WHERE field = 'view') AS there, (SELECT value FROM f WHERE field = 'absent') AS absent")
def field_get(spark, sf_dir):
    return fields(spark, sf_dir).select(dml.get_field("view").alias("there"), dml.get_field("absent").alias("absent"))


@query(f"WITH {LATEST} SELECT field, value, true AS removed FROM f WHERE field <> 'error'")
def field_remove(spark, sf_dir):
    return dml.remove_field(fields(spark, sf_dir), "error").select(F.explode("fields").alias("field", "value"), "removed")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' WHEN md5(d.text) = l.crc THEN 'ok' ELSE 'mismatch' END AS state FROM documents d FULL JOIN (SELECT l.doc_id + (CASE WHEN l.doc_id % 11 = 0 THEN 1000000 ELSE 0 END) AS doc_id, md5(CASE WHEN quality = 1 THEN text ELSE text || 'x' END) AS crc FROM labels l JOIN documents USING (doc_id)) l ON d.doc_id = l.doc_id")
def integrity_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    said = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("crc"))
    body = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("x")))
    found = table(spark, sf_dir, "labels").join(docs, "doc_id").select((F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 1000000).otherwise(0)).alias("doc_id"), F.md5(body.cast("binary")).alias("crc"))
    return integrity.compare(said, found, "doc_id", "crc")


@query(f"WITH {VI} SELECT CASE WHEN path LIKE '%.tar://%' THEN 'skip' WHEN path LIKE 'gs://%' THEN 'delete_remote' ELSE 'delete_local' END AS action, count(*) AS n, sum(CASE WHEN path LIKE '%.tar://%' THEN 0 ELSE size END)::BIGINT AS bytes FROM i GROUP BY 1")
def deletion_plan(spark, sf_dir):
    plan = integrity.deletion_plan(instances(spark, sf_dir), "path", "size")
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT event_id, user_id, sum(CASE event_type WHEN 'signup' THEN 1 ELSE 0 END) OVER w ::BIGINT AS generation, coalesce(arg_max(event_type, event_id) OVER w, '') = 'signup' AS locked FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def lock_log_replay(spark, sf_dir):
    """Locks from a log: a signup acquires, a purchase releases; the generation counts acquisitions."""
    log = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "purchase"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("event_id", "user_id", F.sum((F.col("event_type") == "signup").cast("bigint")).over(w).alias("generation"), (F.last("event_type").over(w) == "signup").alias("locked"))


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def error_log_gate(spark, sf_dir):
    log = table(spark, sf_dir, "events")
    return log.select("user_id").distinct().join(log.filter("event_type = 'error'"), "user_id", "left_anti")


# ---- order and layout ---------------------------------------------------------------------------


@query("WITH l AS (SELECT d.doc_id, source, quality, n_chars, bool_and(quality IS NOT NULL) OVER (PARTITION BY source, lang) AS all_q, lang FROM documents d LEFT JOIN labels USING (doc_id)) SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY CASE WHEN all_q THEN quality ELSE n_chars END, doc_id) - 1 AS position FROM l")
def instance_order(spark, sf_dir):
    """Ordered by the first attribute that all instances of a series have."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return layout.fallback_sorted(rows, ["source", "lang"], ["quality", "n_chars"], "doc_id").select("doc_id", "position")


@query("SELECT conv_id, turn, md5(text) AS crc FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 2")
def instance_by_index(spark, sf_dir):
    rows = layout.fallback_sorted(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "turn")
    return rows.filter("position = 1").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("crc"))


@query("SELECT doc_id, (sum(1536 + ceil(n_chars / 512.0) * 512) OVER (PARTITION BY source ORDER BY doc_id) - ceil(n_chars / 512.0) * 512)::BIGINT AS start_byte, (sum(1536 + ceil(n_chars / 512.0) * 512) OVER (PARTITION BY source ORDER BY doc_id) - ceil(n_chars / 512.0) * 512 + n_chars)::BIGINT AS end_byte FROM documents")
def container_offsets(spark, sf_dir):
    return layout.container_offsets(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars").select("doc_id", "start_byte", "end_byte")


@query("SELECT p_partkey, i AS frame, 476 + 8 + i * (CAST(floor(p_retailprice) AS BIGINT) * 7 // p_size) AS \"offset\", CAST(floor(p_retailprice) AS BIGINT) * 7 // p_size AS length FROM part, unnest(range(p_size)) AS t(i) WHERE p_size > 1")
def frame_offsets_raw(spark, sf_dir):
    total = F.floor("p_retailprice").cast("bigint") * 7
    rows = table(spark, sf_dir, "part").select("p_partkey", layout.raw_frames(F.col("p_size"), F.lit(476).cast("bigint"), total).alias("frames"))
    return rows.select("p_partkey", F.posexplode("frames").alias("frame", "f")).select("p_partkey", F.col("frame").cast("bigint").alias("frame"), "f.offset", "f.length")


@query("WITH b AS (SELECT l_orderkey, l_linenumber, (sum(CAST(l_quantity AS BIGINT) * 8 + 8) OVER w - (CAST(l_quantity AS BIGINT) * 8 + 8))::BIGINT AS o, CAST(l_quantity AS BIGINT) * 8 AS len, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER w - 1 AS frame FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) SELECT l_orderkey, frame, 476 + n * 4 + 16 + o AS \"offset\", len AS length FROM b")
def frame_offsets_bot(spark, sf_dir):
    """Offset tables built from lines of an order, and the frames read from them."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    item = F.col("l_quantity").cast("bigint") * 8 + 8
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("no"), (F.sum(item).over(w.rowsBetween(Window.unboundedPreceding, 0)) - item).alias("o"), item.alias("item"))
    tables = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "o"))), lambda x: x["o"]).alias("offsets"), F.sum("item").alias("items"))
    table_bytes = F.size("offsets").cast("bigint") * 4
    frames = layout.table_frames(F.lit(476).cast("bigint"), table_bytes, F.col("offsets"), F.col("items") + table_bytes + 8)
    return tables.select("l_orderkey", F.posexplode(frames).alias("frame", "f")).select("l_orderkey", F.col("frame").cast("bigint").alias("frame"), "f.offset", "f.length")


@query("WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents), u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w) SELECT doc_id, (i - 1)::INT AS frame, (476 + 16 + coalesce(sum(8 + strlen(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\", strlen(x)::BIGINT AS length FROM u WHERE n > 1")
def frame_offsets_walk(spark, sf_dir):
    """Items walked one by one: each document's words become fragments after an empty table."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    return layout.word_frames(rows, "doc_id", "text", 476)


@query("SELECT doc_id, substr(text, 11, 50) AS part FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7F]*')")
def byte_range_read(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    return rows.select("doc_id", S.byte_window(F.col("text").cast("binary"), F.lit(10), F.lit(60)).cast("string").alias("part"))


@query("SELECT doc_id, strpos(text, 'tion') - 1 AS place FROM documents")
def find_pattern(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.find(F.col("text"), "tion").alias("place"))


@query("SELECT page_id, lower(substr(html, 1, 9)) = '<!doctype' AS magic FROM pages")
def magic_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (F.lower(S.byte_window(F.col("html").cast("binary"), F.lit(0), F.lit(9)).cast("string")) == "<!doctype").alias("magic"))


@query()
def crc32c_checksum(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.crc32c(F.col("text").cast("binary")).alias("crc32c"))


@query("SELECT doc_id, n_chars AS size, substr(text, 1, 512) AS head FROM documents WHERE text IS NOT NULL")
def metadata_head(spark, sf_dir):
    """Bulk elements keep their first characters in the metadata, through gzip and back."""
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", F.col("n_chars").alias("size"), S.gunzipped(S.gzipped(F.substr("text", F.lit(1), F.lit(512)))).alias("head"))


# ---- identifiers and URIs -----------------------------------------------------------------------


@query("SELECT page_id, nullif(regexp_extract(url, '^[a-z0-9]+://([^/]+)', 1), '') AS bucket, nullif(regexp_extract(url, '^[a-z0-9]+://[^/]+/(.*)$', 1), '') AS key, list_extract(string_split(url, '/'), -1) AS base FROM pages")
def uri_parts(spark, sf_dir):
    bucket, key = S.bucket_and_key(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", bucket.alias("bucket"), key.alias("key"), S.basename(F.col("url")).alias("base"))


HIERARCHY = "h AS (SELECT c_custkey, o_orderkey, l_linenumber, l_partkey, 'gs://store/studies/1.2.' || c_custkey || '/series/1.2.' || c_custkey || '.' || o_orderkey || CASE WHEN l_partkey % 3 = 0 THEN '/metadata' ELSE '/instances/1.2.' || l_linenumber || CASE WHEN l_partkey % 3 = 1 THEN '/frames/' || l_linenumber || ',' || (l_linenumber + 1) ELSE '/metadata' END END AS uri FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    line = F.col("l_linenumber")
    tail = F.when(F.col("l_partkey") % 3 == 0, F.lit("/metadata")).otherwise(F.concat(F.lit("/instances/1.2."), line, F.when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("/frames/"), line, F.lit(","), line + 1)).otherwise(F.lit("/metadata"))))
    return rows.withColumn("uri", F.concat(F.lit("gs://store/studies/1.2."), "c_custkey", F.lit("/series/1.2."), "c_custkey", F.lit("."), "o_orderkey", tail))


@query(f"WITH {HIERARCHY} SELECT o_orderkey, l_linenumber, l_partkey, 'gs://store' AS store, '1.2.' || c_custkey AS study, '1.2.' || c_custkey || '.' || o_orderkey AS series, CASE WHEN l_partkey % 3 > 0 THEN '1.2.' || l_linenumber END AS instance, CASE WHEN l_partkey % 3 = 1 THEN l_linenumber || ',' || (l_linenumber + 1) END AS frames, CASE l_partkey % 3 WHEN 0 THEN 'series' WHEN 1 THEN 'frame' ELSE 'instance' END AS level FROM h")
def request_parse(spark, sf_dir):
    rows = hierarchy(spark, sf_dir).withColumn("r", retrieval.parse(F.col("uri")))
    return rows.select("o_orderkey", "l_linenumber", "l_partkey", "r.store", "r.study", "r.series", "r.instance", F.array_join("r.frames", ",").alias("frames"), retrieval.level(F.col("r")).alias("level"))


@query("SELECT page_id, CASE WHEN NOT starts_with(url, 'gs://') THEN 'scheme' END AS fault, regexp_matches(url, '^[0-9]+(\\.[0-9]+)*$') AS uid, length(CAST(page_id AS VARCHAR)) >= 10 AS long_enough FROM pages")
def uri_validate(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("r", retrieval.parse(F.col("url")))
    return rows.select("page_id", retrieval.request_fault(F.col("url"), F.col("r")).alias("fault"), S.valid_uid(F.col("url")).alias("uid"), S.long_enough(F.col("page_id").cast("string")).alias("long_enough"))


@query("SELECT o_orderkey, 'gs://store/studies/1.2.' || o_custkey || '/series/1.2.3.' || o_orderkey AS series_uri, 'gs://store/studies/1.2.' || o_custkey || '/series/1.2.3.' || o_orderkey || '.tar' AS tar_uri FROM orders")
def derived_uris(spark, sf_dir):
    uri = S.series_uri(F.lit("gs://store"), F.concat(F.lit("1.2."), "o_custkey"), F.concat(F.lit("1.2.3."), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", uri.alias("series_uri"), F.concat(uri, F.lit(".tar")).alias("tar_uri"))


@query(f"WITH {VI} SELECT instance_uid, path, regexp_matches(path, '^(http|s3://|gs://)') AS remote, contains(path, '.tar://') AS nested FROM i")
def remote_filter(spark, sf_dir):
    return instances(spark, sf_dir).select("instance_uid", "path", S.is_remote(F.col("path")).alias("remote"), S.is_nested(F.col("path")).alias("nested"))


@query(f"WITH {VI} SELECT instance_uid, path, CASE WHEN contains(path, '.tar://') THEN string_split(path, '.tar://')[1] || '.tar' END AS container, CASE WHEN contains(path, '.tar://') THEN string_split(path, '.tar://')[2] END AS member FROM i")
def member_uri_split(spark, sf_dir):
    container, member = S.member_of(F.col("path"))
    return instances(spark, sf_dir).select("instance_uid", "path", container.alias("container"), member.alias("member"))


@query("SELECT o_orderkey, '1.2.' || o_custkey || '.' || (o_orderkey + 1) AS hashed FROM orders")
def uid_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.next_uid(F.concat(F.lit("1.2."), "o_custkey", F.lit("."), "o_orderkey")).alias("hashed"))


@query("SELECT '1.2.' || (o_custkey + 1) AS study, count(*) AS n, min('1.2.' || o_custkey || '.' || (o_orderkey + 1)) AS series FROM orders GROUP BY o_custkey")
def deid_series(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(S.next_uid(F.concat(F.lit("1.2."), "o_custkey")).alias("study"), S.next_uid(F.concat(F.lit("1.2."), "o_custkey", F.lit("."), "o_orderkey")).alias("series"))
    return rows.groupBy("study").agg(F.count(F.lit(1)).alias("n"), F.min("series").alias("series"))


@query("SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1, 2")
def identity_equality(spark, sf_dir):
    """Pairs of equal instances, from the number of each without forming them."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("each"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("each") * F.col("each")).alias("n"))


@query("SELECT source, count(DISTINCT lang) = 1 AS same_mode FROM documents GROUP BY 1")
def same_hash_mode(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg((F.count_distinct("lang") == 1).alias("same_mode"))


@query("SELECT source, bool_or(quality = 0) AS any_low, bool_and(quality = 1) AS all_high FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def any_all(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.bool_or(F.col("quality") == 0).alias("any_low"), F.bool_and(F.col("quality") == 1).alias("all_high"))


# ---- retrieval ----------------------------------------------------------------------------------


@query("SELECT c_custkey AS study, o_orderkey AS series, o_orderstatus, o_orderpriority, CAST(o_totalprice * 100 AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) = 1")
def study_request(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_custkey").alias("study"), F.col("o_orderkey").alias("series"), "o_orderstatus", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return retrieval.study_attributes(rows, "study", "series", "series", ["o_orderstatus", "o_orderpriority", "cents"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7")
def series_request(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").filter("o_custkey = 7")
    return table(spark, sf_dir, "lineitem").join(asked, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
def instance_request(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_orderkey = 7 AND l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("SELECT vec_id, CASE WHEN label > 8 THEN 'no pixel data' WHEN label + 1 > 8 THEN 'out of bounds' END AS fault, CASE WHEN label + 1 <= 8 THEN round(CAST(embedding[label * 8 + 1] AS DOUBLE), 4) END AS first_pixel FROM embeddings")
def frame_request(spark, sf_dir):
    """Row ``label`` + 1 of eight frames of eight pixels."""
    rows = table(spark, sf_dir, "embeddings").withColumn("fault", retrieval.frame_fault(F.col("label") <= 8, F.lit(8), F.array(F.col("label") + 1)))
    frame = F.slice("embedding", F.col("label") * 8 + 1, F.lit(8))
    return rows.select("vec_id", "fault", F.when(F.col("fault").isNull(), F.round(F.try_element_at(frame, F.lit(1)).cast("double"), 4)).alias("first_pixel"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def tag_extract(spark, sf_dir):
    props = F.parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(props, "$.k", "bigint").alias("k"), F.try_variant_get(props, "$.absent", "string").alias("absent"))


@query("SELECT o_custkey AS study, o_orderkey AS instance, o_orderstatus AS crc32c FROM orders")
def metadata_roundtrip(spark, sf_dir):
    """Series documents written as JSON and read again."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("study_uid"), F.lit("1").alias("series_uid"), F.col("o_orderkey").cast("string").alias("instance_uid"), F.lit("gs://b/x").alias("uri"), F.lit(1).cast("bigint").alias("size"), F.col("o_orderstatus").alias("crc32c"), F.lit("p").alias("original_path"))
    back = F.from_json("value", "study_uid string, series_uid string, cod struct<instances:map<string,struct<uri:string,size:bigint,crc32c:string>>>")
    read = records.metadata_json(rows).select(back.alias("d")).select("d.study_uid", F.explode("d.cod.instances").alias("instance", "i"))
    return read.select(F.col("study_uid").cast("bigint").alias("study"), F.col("instance").cast("bigint").alias("instance"), "i.crc32c")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
def has_pixeldata(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality IS NOT NULL"), "doc_id", "left_semi").select("doc_id", "n_chars")


# ---- thumbnails ---------------------------------------------------------------------------------

FRAMES = "t AS (SELECT conv_id, turn, f AS frame, row_number() OVER (PARTITION BY conv_id ORDER BY turn, f) - 1 AS thumbnail_index FROM conversations, unnest(range(turn % 3 + 1)) AS x(f))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turn") % 3)).alias("frame"))
    return thumbnails.numbered(rows, ["conv_id"], ["turn", "frame"]).withColumn("thumbnail_index", F.col("thumbnail_index").cast("bigint"))


@query(f"WITH {FRAMES} SELECT * FROM t")
def thumbnail_index(spark, sf_dir):
    return frames(spark, sf_dir)


@query(f"WITH {FRAMES} SELECT conv_id, turn, frame FROM t WHERE thumbnail_index = 2")
def thumbnail_lookup(spark, sf_dir):
    return frames(spark, sf_dir).filter("thumbnail_index = 2").select("conv_id", "turn", "frame")


@query(f"WITH {FRAMES} SELECT conv_id, turn, string_agg(CAST(thumbnail_index AS VARCHAR), ',' ORDER BY frame) AS indexes FROM t GROUP BY 1, 2")
def thumbnail_slice(spark, sf_dir):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("frame", "thumbnail_index"))), lambda x: x["thumbnail_index"].cast("string"))
    return frames(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_join(listed, ",").alias("indexes"))


@query("SELECT conv_id, max(turn) > 3 AS stale FROM conversations GROUP BY 1")
def thumbnail_stale(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return thumbnails.stale(turns, turns.filter("turn <= 3"), "conv_id", "turn")


GEOMETRY = "g AS (SELECT p_partkey, p_size * 10 + 7 AS h, CAST(p_partkey % 97 AS INT) * 5 + 30 AS w FROM part), a AS (SELECT *, 128.0::DOUBLE / greatest(h, w) AS scale, CAST(trunc(h * (128.0::DOUBLE / greatest(h, w))) AS INT) AS nh, CAST(trunc(w * (128.0::DOUBLE / greatest(h, w))) AS INT) AS nw FROM g)"


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10 + 7).alias("h"), ((F.col("p_partkey") % 97).cast("int") * 5 + 30).alias("w"))
    return rows.withColumn("a", thumbnails.anchors(F.col("h"), F.col("w")))


@query(f"WITH {GEOMETRY} SELECT p_partkey, nh AS new_height, nw AS new_width, (128 - nh) // 2 AS top, (128 - nw) // 2 AS \"left\", (128 - nh) // 2 + nh AS bottom, (128 - nw) // 2 + nw AS \"right\" FROM a")
def thumbnail_anchors(spark, sf_dir):
    return geometry(spark, sf_dir).select("p_partkey", "a.new_height", "a.new_width", "a.top", "a.left", "a.bottom", "a.right")


@query(f"WITH {GEOMETRY} SELECT p_partkey, CAST(floor((h / 2.0::DOUBLE) * scale + (128 - nh) // 2) AS INT) AS thumb_row, CAST(round(((h / 2.0::DOUBLE) * scale) / scale, 3) AS DOUBLE) AS back_row FROM a")
def thumbnail_coords(spark, sf_dir):
    rows = geometry(spark, sf_dir)
    forth = (F.col("h") / 2.0) * F.col("a.scale_factor")
    return rows.select("p_partkey", F.floor(forth + F.col("a.top")).cast("int").alias("thumb_row"), F.round(forth / F.col("a.scale_factor"), 3).alias("back_row"))


@query("SELECT vec_id, i AS pixel, CAST(round((embedding[i + 1]::DOUBLE - lo) / (hi - lo) * 255) AS INT) AS value FROM (SELECT vec_id, embedding, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings), unnest(range(64)) AS t(i)")
def frame_normalise(spark, sf_dir):
    pixels = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(thumbnails.normalised(pixels)).alias("p", "value")).select("vec_id", F.col("p").cast("bigint").alias("pixel"), "value")


@query("SELECT vec_id, (r * 4 + c)::BIGINT AS pixel, round((embedding[r * 16 + c * 2 + 1]::DOUBLE + embedding[r * 16 + c * 2 + 2]::DOUBLE + embedding[r * 16 + c * 2 + 9]::DOUBLE + embedding[r * 16 + c * 2 + 10]::DOUBLE) / 4, 4) + 0.0 AS value FROM embeddings, unnest(range(4)) AS a(r), unnest(range(4)) AS b(c)")
def frame_resize(spark, sf_dir):
    pixels = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(thumbnails.halved(pixels, 8)).alias("p", "v")).select("vec_id", F.col("p").cast("bigint").alias("pixel"), (F.round("v", 4) + 0.0).alias("value"))


# ---- streaming ----------------------------------------------------------------------------------


@query("SELECT DISTINCT event_id FROM events")
def stream_dedupe(spark, sf_dir):
    """Each event once, through a stream that reads the table and drops repeats within the watermark."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts")
    return streaming.drained(spark, streaming.deduplicated(timed, ["event_id"], "ts", "365 days"), f"stream_{uuid.uuid4().hex}").select("event_id")


# ---- whole operations ---------------------------------------------------------------------------

#: A batch held against the store: sizes first, then the first of equal keys, then the series, then the stored instances.
APPENDED = f"""{VI}, e AS (SELECT * FROM i WHERE {OLD} QUALIFY row_number() OVER (PARTITION BY series_uid, instance_uid ORDER BY arrived, path) = 1),
 a AS (SELECT * FROM i WHERE NOT {OLD}), small AS (SELECT * FROM a WHERE size <= 49000),
 large AS (SELECT s.series_uid FROM (SELECT series_uid, sum(size) AS n FROM small GROUP BY 1) s LEFT JOIN (SELECT series_uid, sum(size) AS n FROM e GROUP BY 1) t USING (series_uid) WHERE s.n + coalesce(t.n, 0) > 150000),
 ranked AS (SELECT *, row_number() OVER w AS rn, first_value(crc) OVER w AS first_crc FROM small WHERE series_uid NOT IN (SELECT series_uid FROM large) WINDOW w AS (PARTITION BY series_uid, instance_uid ORDER BY arrived, path)),
 r AS (SELECT series_uid, instance_uid, path, size, crc, 'error' AS status FROM a WHERE size > 49000
  UNION ALL SELECT series_uid, instance_uid, path, size, crc, 'error' FROM small WHERE series_uid IN (SELECT series_uid FROM large)
  UNION ALL SELECT series_uid, instance_uid, path, size, crc, CASE WHEN crc = first_crc THEN 'same' ELSE 'conflict' END FROM ranked WHERE rn > 1
  UNION ALL SELECT k.series_uid, k.instance_uid, k.path, k.size, k.crc, CASE WHEN o.o_orderkey IS NULL THEN 'error' WHEN e.crc IS NULL THEN 'new' WHEN e.crc = k.crc THEN 'same' ELSE 'conflict' END
   FROM ranked k LEFT JOIN orders o ON k.series_uid = o.o_orderkey AND o.o_orderstatus <> 'P' LEFT JOIN e ON k.series_uid = e.series_uid AND k.instance_uid = e.instance_uid WHERE rn = 1)"""


def appended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored instances, and every arriving row with its status."""
    rows = instances(spark, sf_dir)
    stored = ingest.winners(rows.filter("arrived < TIMESTAMP_NTZ '2000-01-01'"), KEYS, ORDER)
    known = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("series_uid"))
    batch = rows.filter("arrived >= TIMESTAMP_NTZ '2000-01-01'")
    return stored, ingest.append(batch, stored, KEYS, ORDER, series="series_uid", known=known, max_instance_gb=49000 / ingest.GB, max_series_gb=150000 / ingest.GB)


@query(f"WITH {APPENDED} SELECT series_uid, instance_uid, path, size, crc, status FROM r")
def append_batch(spark, sf_dir):
    """The whole of an append: every arriving row with what becomes of it."""
    return appended(spark, sf_dir)[1].select("series_uid", "instance_uid", "path", "size", "crc", "status")


@query(f"WITH {APPENDED} SELECT count(*) FILTER (status = 'same') AS num_true_duplicates, count(*) FILTER (status = 'conflict') AS num_diffhash_duplicates, count(DISTINCT series_uid) FILTER (status IN ('same', 'conflict')) AS num_duplicate_series, count(DISTINCT series_uid) FILTER (status = 'new') AS tar_success, coalesce(sum(size) FILTER (status = 'new'), 0)::BIGINT AS tar_bytes_processed FROM r")
def append_counters(spark, sf_dir):
    return counters.append_counts(appended(spark, sf_dir)[1], "series_uid")


@query(f"WITH {APPENDED}, c AS (SELECT series_uid, instance_uid, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM r WHERE status = 'conflict' AND regexp_matches(path, '^(http|s3://|gs://)') GROUP BY 1, 2) SELECT e.series_uid, e.instance_uid, coalesce(c.paths, '') AS paths, CASE WHEN c.paths IS NOT NULL THEN '2001-02-03T04:05:06.000000' END AS modified FROM e LEFT JOIN c USING (series_uid, instance_uid)")
def append_records_dupes(spark, sf_dir):
    """Stored instances with the remote paths of differing duplicates and the time of the batch."""
    stored, rows = appended(spark, sf_dir)
    stored = stored.withColumn("diff_hash_dupe_paths", F.lit(None).cast("array<string>")).withColumn("modified_datetime", F.lit(None).cast("string"))
    done = ingest.record_dupes(stored, rows, KEYS, F.lit("2001-02-03 04:05:06").cast("timestamp_ntz"))
    return done.select(*KEYS, F.array_join("diff_hash_dupe_paths", ",").alias("paths"), F.col("modified_datetime").alias("modified"))


@query("SELECT '1.2.' || (o_custkey + 1) AS study, o_orderkey, o_custkey % 2 = 0 AND o_orderkey % 3 > 0 AS belongs FROM orders WHERE o_custkey % 2 = 0")
def same_hash_mode_membership(spark, sf_dir):
    """Instances with a hash function held against series with hashed identifiers."""
    orders = table(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").withColumn("raw", F.concat(F.lit("1.2."), "o_custkey"))
    hashed = orders.withColumn("study", S.uid(F.col("raw"), S.next_uid, hashed=True))
    series = hashed.filter("o_orderkey % 3 > 0").select("study", F.col("o_orderkey").alias("series"))
    return ingest.membership(hashed.withColumn("series", F.col("o_orderkey")), series, ["study", "series"]).select("study", "o_orderkey", "belongs")


STORED = """m AS (SELECT 'gs://store' AS store, '1.2.' || o_custkey AS study, '1.2.' || o_custkey || '.' || o_orderkey AS series, '1.2.' || l_linenumber AS instance, min(l_linenumber) AS seq,
  '{"00080050":' || o_orderkey || ',"00200013":' || l_linenumber || '}' AS metadata FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, l_linenumber)"""


def ordered_lines(spark: SparkSession, sf_dir: str, *columns: Column | str) -> DataFrame:
    """``columns`` of ``lineitem`` with o_orderkey and o_custkey, dealt by order, so that a distinct with o_orderkey moves nothing."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *columns).repartition("o_orderkey")
    return lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


def stored_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered_lines(spark, sf_dir, "l_linenumber").distinct()
    study = F.concat(F.lit("1.2."), F.col("o_custkey"))
    return rows.select(
        F.lit("gs://store").alias("store"), study.alias("study_uid"), F.concat(study, F.lit("."), "o_orderkey").alias("series_uid"), F.concat(F.lit("1.2."), "l_linenumber").alias("instance_uid"), F.col("l_linenumber").alias("seq"),
        F.concat(F.lit('{"00080050":'), "o_orderkey", F.lit(',"00200013":'), "l_linenumber", F.lit("}")).alias("metadata"), F.array(F.encode(F.col("l_linenumber").cast("string"), "utf-8"), F.lit(b"second")).alias("frames"),
    )


@query(
    f"""WITH {STORED}, q AS (
  SELECT o_orderkey, l_linenumber, '1.2.' || o_custkey AS study, '1.2.' || o_custkey || '.' || o_orderkey AS series, '1.2.' || l_linenumber AS instance,
   CASE WHEN l_partkey % 5 = 0 THEN 'study' WHEN l_partkey % 5 = 1 THEN 'series' WHEN l_partkey % 5 = 2 THEN 'instance' WHEN l_partkey % 5 = 3 THEN 'frame' ELSE 'stray' END AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
 ser AS (SELECT study, series, '[' || string_agg(metadata, ',' ORDER BY seq) || ']' AS body FROM m GROUP BY 1, 2),
 stu AS (SELECT study, arg_min(metadata, (series, seq)) AS metadata FROM m GROUP BY 1)
SELECT o_orderkey, l_linenumber, CASE WHEN kind = 'stray' THEN 'instance' ELSE kind END AS level, CASE WHEN kind = 'stray' THEN 'not found' WHEN kind = 'frame' AND l_linenumber > 1 THEN 'out of bounds' END AS fault,
 CASE kind WHEN 'study' THEN '{{"00100010":null,"00100020":null,"00100030":null,"00100040":null,"00080020":null,"00080030":null,"00080050":' || regexp_extract(stu.metadata, '"00080050":([0-9]+)', 1) || ',"00080090":null,"0020000D":null,"00081030":null}}'
  WHEN 'series' THEN ser.body WHEN 'instance' THEN m.metadata END AS body,
 CASE WHEN kind = 'frame' AND l_linenumber = 1 THEN l_linenumber || ',second' END AS content
FROM q LEFT JOIN stu ON q.study = stu.study LEFT JOIN ser ON q.study = ser.study AND q.series = ser.series LEFT JOIN m ON q.study = m.study AND q.series = m.series AND q.instance = m.instance"""
)
def request_answers(spark, sf_dir):
    """Requests at all four levels, routed and answered; strays ask for an instance that is not there."""
    rows = ordered_lines(spark, sf_dir, "l_linenumber", F.pmod("l_partkey", F.lit(5)).alias("kind"))
    kind = F.col("kind")
    line = F.col("l_linenumber")
    series = F.concat(F.lit("gs://store/studies/1.2."), "o_custkey", F.lit("/series/1.2."), "o_custkey", F.lit("."), "o_orderkey")
    uri = (
        F.when(kind == 0, F.concat(F.lit("gs://store/studies/1.2."), "o_custkey", F.lit("/metadata"))).when(kind == 1, F.concat(series, F.lit("/metadata")))
        .when(kind == 2, F.concat(series, F.lit("/instances/1.2."), line, F.lit("/metadata"))).when(kind == 3, F.concat(series, F.lit("/instances/1.2."), line, F.lit("/frames/"), line, F.lit(","), line + 1))
        .otherwise(F.concat(series, F.lit("/instances/9.9/metadata")))
    )
    requests = rows.select("o_orderkey", "l_linenumber", uri.alias("uri")).distinct()
    got = retrieval.answers(requests, stored_instances(spark, sf_dir))
    return got.select("o_orderkey", "l_linenumber", "level", "fault", "body", F.array_join(F.transform("content", lambda x: F.decode(x, "utf-8")), ",").alias("content"))


@query("SELECT page_id, CASE WHEN regexp_matches(u, '/studies/.*/series/') THEN 'https://h' END AS store, CASE WHEN regexp_matches(u, '/studies/.*/series/') THEN 's' || page_id END AS study, CASE WHEN regexp_matches(u, '/studies/.*/series/') THEN 'r' || page_id END AS series FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://h/studies/s' || page_id || '/series/r' || page_id || '.tar' WHEN 1 THEN 'https://h/studies/s' || page_id || '/series/r' || page_id || '/metadata.json' WHEN 2 THEN 'https://h/studies/s' || page_id || '/series/r' || page_id || '.tar://instances/i.dcm' ELSE url END AS u FROM pages)")
def store_uri_parse(spark, sf_dir):
    series = S.series_uri(F.lit("https://h"), F.concat(F.lit("s"), "page_id"), F.concat(F.lit("r"), "page_id"))
    k = F.col("page_id") % 4
    uri = F.when(k == 0, S.tar_uri(series)).when(k == 1, S.metadata_uri(series)).when(k == 2, S.member_uri(series, F.lit("i"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").withColumn("p", S.parse_store_uri(uri)).select("page_id", "p.store", "p.study", "p.series")


@query("SELECT o_orderkey, u || '/metadata.json' AS metadata, u || '/index.sqlite' AS index, u || '/error.log' AS log, u || '.tar://instances/1.' || o_orderkey || '.dcm' AS member FROM (SELECT o_orderkey, 'gs://store/studies/1.2.' || o_custkey || '/series/1.2.3.' || o_orderkey AS u FROM orders)")
def file_uris(spark, sf_dir):
    u = S.series_uri(F.lit("gs://store"), F.concat(F.lit("1.2."), "o_custkey"), F.concat(F.lit("1.2.3."), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.metadata_uri(u).alias("metadata"), S.index_uri(u).alias("index"), S.error_log_uri(u).alias("log"), S.member_uri(u, F.concat(F.lit("1."), "o_orderkey")).alias("member"))


@query(f"WITH {SPLIT} SELECT e.* EXCLUDE (arrived) FROM e ANTI JOIN (SELECT series_uid, instance_uid FROM b WHERE instance_uid NOT LIKE '%.1') g USING (series_uid, instance_uid)")
def remove_with_guards(spark, sf_dir):
    """Removal that would fail if a series lost all; the first line of each order stays."""
    rows = instances(spark, sf_dir)
    old = rows.filter("arrived < TIMESTAMP_NTZ '2000-01-01'")
    # the guard and the requests need keys only, which repeats of an instance share
    given = rows.filter("arrived >= TIMESTAMP_NTZ '2000-01-01'").select(*KEYS).filter(~F.col("instance_uid").endswith(".1"))
    # series that would lose all are let go of, so that the guard holds
    dml.guard(old, given, KEYS, "series_uid", but=dml.bared(old, given, KEYS, "series_uid"))
    return dml.remove(ingest.winners(old, KEYS, ORDER), given, KEYS).drop("arrived")


@query(f"WITH {VI}, d AS (SELECT instance_uid AS uid, path AS uri, crc, size FROM i), f AS (SELECT path AS uri, min(crc) AS found FROM i WHERE size % 7 > 0 GROUP BY 1) SELECT uid, uri, CASE WHEN contains(uri, '.tar://') THEN 'nested' WHEN found IS NULL THEN 'gone' WHEN regexp_matches(uri, '^(http|s3://|gs://)') AND found <> crc THEN 'mismatch' ELSE 'delete' END AS action FROM d LEFT JOIN f USING (uri)")
def dependency_deletion(spark, sf_dir):
    rows = instances(spark, sf_dir)
    stored = rows.filter("size % 7 > 0").groupBy(F.col("path").alias("uri")).agg(F.min("crc").alias("crc"))
    return integrity.dependency_plan(rows.select(F.col("instance_uid").alias("uid"), F.array("path").alias("dependencies"), "crc", "size"), stored)


@query("WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 2 = 0 OR l_linenumber > 1 THEN l_quantity END AS k FROM lineitem), t AS (SELECT *, count(k) OVER (PARTITION BY l_orderkey) = count(*) OVER (PARTITION BY l_orderkey) AS whole FROM s) SELECT l_orderkey, count(*) FILTER (whole) AS placed, count(*) FILTER (NOT whole) AS unplaced FROM t GROUP BY 1")
def strict_order(spark, sf_dir):
    """Series whose instances all have a sort key are placed, others not at all."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when((F.col("l_orderkey") % 2 == 0) | (F.col("l_linenumber") > 1), F.col("l_quantity")).alias("k"))
    placed = layout.fallback_sorted(rows, ["l_orderkey"], ["k"], "l_linenumber", strict=True)
    return placed.groupBy("l_orderkey").agg(F.count("position").alias("placed"), F.count_if(F.col("position").isNull()).alias("unplaced"))


@query("SELECT count(*) FILTER (event_type = 'purchase') AS series_deleted, count(*) FILTER (event_type = 'error') AS series_deletions_failed, count(*) FILTER (event_type = 'click') AS series_not_found FROM events")
def deletion_outcomes(spark, sf_dir):
    named = F.when(F.col("event_type") == "purchase", "deleted").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "not found")
    return counters.series_deletion_counts(table(spark, sf_dir, "events").select(named.alias("outcome")))
