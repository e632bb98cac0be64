"""Whole operations of the store: storage, metadata documents, requests, hashing, guards, deletion, thumbnails."""

import gzip
import json
import os
import tarfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelake.functions import scalars as S
from voxelake.operators import counters, dml, ingest, integrity, layout, retrieval, thumbnails
from voxelake.sources import records, storage

KEYS = ["series", "uid"]


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# ---- checksums ----------------------------------------------------------------------------------


def plain_crc32c(data):
    """Bit by bit, from the polynomial."""
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    return (state ^ 0xFFFFFFFF).to_bytes(4, "big")


def test_crc32c_published_vectors():
    vectors = {bytes(32): "8a9136aa", b"\xff" * 32: "62a8ab43", bytes(range(32)): "46dd794e", bytes(range(31, -1, -1)): "113fdb5c", b"123456789": "e3069283"}
    import base64

    assert [base64.b64decode(x).hex() for x in S.crc32c_base64(list(vectors))] == list(vectors.values())


def test_crc32c_of_all_sizes():
    import base64

    draw = np.random.default_rng(2)
    contents = [draw.integers(0, 256, n, np.uint8).tobytes() for n in (0, 1, 511, 512, 513, 1024, 1500, 5000, 0, 3)] + [bytes(700)]
    assert [base64.b64decode(x) for x in S.crc32c_base64(contents)] == [plain_crc32c(c) for c in contents]
    assert S.crc32c_base64([]) == []


def test_crc32c_of_a_large_content():
    started = time.process_time()
    S.crc32c_base64([bytes(20_000_000)])
    assert time.process_time() - started < 10


# ---- storage ------------------------------------------------------------------------------------


def series_rows(spark, folder, names, first=0):
    data = [(f"{folder}/studies/1.2/series/1.2.{s}", f"9.{k}", k, bytes([k]) * size) for s, k, size in names]
    return spark.createDataFrame(data, "series_uri string, instance_uid string, seq long, content binary")


def test_containers_are_created_extended_and_read(spark, tmp_path):
    store = f"{tmp_path}/store"
    first = storage.write_containers(series_rows(spark, store, [(1, 1, 700), (1, 2, 0), (2, 3, 512)])).collect()
    index = spark.createDataFrame(first)
    more = storage.write_containers(series_rows(spark, store, [(1, 4, 10), (3, 5, 1)]), index).collect()
    index = spark.createDataFrame(first + more)
    for name, want in (("1.2.1", {1: 700, 2: 0, 4: 10}), ("1.2.2", {3: 512}), ("1.2.3", {5: 1})):
        with tarfile.open(f"{store}/studies/1.2/series/{name}.tar") as tar:
            assert {m.name: tar.extractfile(m).read() for m in tar} == {f"instances/9.{k}.dcm": bytes([k]) * n for k, n in want.items()}
    got = storage.read_members(index).collect()
    assert all(bytes(r.content) == bytes([r.seq]) * r.size and r.end_byte - r.start_byte == r.size for r in got) and len(got) == 5
    placed = layout.container_offsets(index, ["series_uri"], ["seq"])
    assert values(placed, "uri", "start_byte") == values(index, "uri", "start_byte")
    there = storage.pull(index, store, f"{tmp_path}/here")
    assert all(bytes(r.content) == bytes([r.seq]) * r.size and r.tar_uri.startswith(f"{tmp_path}/here") for r in storage.read_members(there).collect())
    files = storage.extract(index.filter("seq > 2"), f"{tmp_path}/out").collect()
    assert {os.path.getsize(r.uri) for r in files} == {512, 10, 1}
    assert storage.series_of_study(store, "1.2") == "1.2.1"
    with pytest.raises(FileNotFoundError):
        storage.series_of_study(store, "7.7")
    assert storage.write_containers(series_rows(spark, store, [(1, 1, 1)]).limit(0)).count() == 0


def test_members_that_are_kept(spark, tmp_path):
    store = f"{tmp_path}/store"
    index = spark.createDataFrame(storage.write_containers(series_rows(spark, store, [(1, 1, 700), (1, 2, 30), (1, 3, 5), (2, 4, 9)])).collect())
    left = storage.keep_members(index, index.filter("instance_uid IN ('9.1', '9.3')")).collect()
    assert sorted((r.instance_uid, r.start_byte, r.size) for r in left) == [("9.1", 1536, 700), ("9.3", 1536 + 1024 + 1536, 5)]
    with tarfile.open(f"{store}/studies/1.2/series/1.2.1.tar") as tar:
        assert [(m.name, tar.extractfile(m).read()) for m in tar] == [("instances/9.1.dcm", b"\1" * 700), ("instances/9.3.dcm", b"\3" * 5)]
    with tarfile.open(f"{store}/studies/1.2/series/1.2.2.tar") as tar:
        assert tar.getnames() == ["instances/9.4.dcm"]


def test_bytes_and_frames_in_files(spark):
    rows = spark.createDataFrame([(b"ab\xff\x00cd", [(1, 2), (4, 1)]), (b"", []), (None, None)], "c binary, f array<struct<offset:long,length:long>>")
    assert [r.p for r in rows.select(S.find_bytes(F.col("c"), b"\xff\x00").alias("p")).collect()] == [2, -1, None]
    got = [tuple(None if x is None else bytes(x) for x in r) for r in rows.select(*(layout.frame_bytes(F.col("c"), F.col("f"), F.lit(k)).alias(f"x{k + 1}") for k in (-1, 0, 1, 2))).collect()]
    assert got == [(None, b"b\xff", b"c", None), (None,) * 4, (None,) * 4]


def test_thumbnail_indexes(spark):
    rows = spark.createDataFrame([("s", "b", 0, 2), ("s", "a", 1, 1), ("s", "a", 0, 0), ("t", "c", 0, None)], "series string, instance string, frame int, thumbnail_index int")
    maps = thumbnails.index_map(rows, "series", "instance", "frame")
    got = maps.select(thumbnails.at_index(F.col("thumbnails"), F.lit(2)).alias("x"), thumbnails.of_instance(F.col("thumbnails"), F.lit("a")).alias("y"), thumbnails.of_instance(F.col("thumbnails"), F.lit("z")).alias("z")).first()
    assert (tuple(got.x), got.y, got.z) == (("b", 0), [0, 1], []) and maps.count() == 1
    for k in (3, -1):
        with pytest.raises(Exception, match="no thumbnail at"):
            maps.select(thumbnails.at_index(F.col("thumbnails"), F.lit(k)).alias("x")).collect()
    assert thumbnails.image(bytes(range(12)), 3, 2).shape == (2, 2, 3) and thumbnails.image(bytes(4), 1, 2).shape == (2, 2)


def test_fetching_and_errors(spark, tmp_path):
    storage.write_bytes(f"{tmp_path}/a/b.dcm", b"payload")
    rows = spark.createDataFrame([(f"file://{tmp_path}/a/b.dcm",), (f"{tmp_path}/none",), ("gs://b/x.tar://m",), (None,)], "uri string")
    got = {r.uri: (r.content, r.error) for r in storage.fetched(rows).collect()}
    assert bytes(got[f"file://{tmp_path}/a/b.dcm"][0]) == b"payload" and got[f"{tmp_path}/none"][1].startswith("FileNotFound") and got[None][1] == got["gs://b/x.tar://m"][1] == "no file of its own"


def test_deleting_files_and_prefixes(spark, tmp_path):
    for name in ("a/1", "a/2", "b/3"):
        storage.write_bytes(f"{tmp_path}/{name}", b"x")
    plan = spark.createDataFrame([(f"{tmp_path}/a/1", "delete"), (f"{tmp_path}/a/2", "mismatch"), (f"{tmp_path}/a/9", "delete")], "uri string, action string")
    assert values(storage.delete_files(plan), "uri", "deleted") == [(f"{tmp_path}/a/1", True), (f"{tmp_path}/a/9", False)] and os.path.exists(f"{tmp_path}/a/1")
    storage.delete_files(plan, dry_run=False).collect()
    assert storage.delete_below([f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/c"]) == [f"{tmp_path}/a/2", f"{tmp_path}/b/3"]
    storage.delete_below([f"{tmp_path}/a"], dry_run=False)
    assert storage.files_below(str(tmp_path)) == [f"{tmp_path}/b/3"]


# ---- metadata documents -------------------------------------------------------------------------


def document(hashed):
    prefix = "deid_" if hashed else ""
    instance = lambda k: {
        "metadata": {"0020000E": {"vr": "UI", "Value": ["1.2"]}, "7FE00010": {"vr": "OB", "BulkDataURI": {"uri": "gs://b/x", "head": 'say "é" \\ \n'}}, "00200013": {"vr": "IS", "Value": [k, 0.5, None]}},
        "uri": f"gs://b/s.tar://instances/{k}.dcm", "headers": {"start_byte": 1536, "end_byte": 1540 + k}, "offset_tables": {"CustomOffsetTable": [512, 720], "CustomOffsetTableLengths": [200, 200]} if k else {},
        "crc32c": "4waSgw==", "size": 4 + k, "original_path": "gs://b/o", "dependencies": ["gs://b/o"], "diff_hash_dupe_paths": [], "version": "1.0", "modified_datetime": "2025-02-26T01:25:49.250660",
    }
    return {f"{prefix}study_uid": "1.2", f"{prefix}series_uid": "1.2.3", "cod": {"instances": {"b": instance(0), "a": instance(7)}}, "thumbnail": {"uri": "gs://b/t", "n": [1, {"x": None}]}, "no\"te": "te\"xt", "zero": 0}


@pytest.mark.parametrize("hashed", [False, True])
@pytest.mark.parametrize("compressed", [False, True])
def test_documents_come_back_equal(spark, tmp_path, hashed, compressed):
    raw = json.dumps(document(hashed)).encode()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / ("m.json.gz" if compressed else "m.json")).write_bytes(gzip.compress(raw) if compressed else raw)
    read = records.read_series_metadata(spark, f"{tmp_path}/in")
    assert [r.instance_uid for r in read.orderBy("position").collect()] == ["b", "a"]
    again = records.metadata_json(read)
    written = storage.write_documents(again.withColumn("uri", F.lit(f"{tmp_path}/out/metadata.json")), compressed).first()
    back = (tmp_path / "out" / "metadata.json").read_bytes()
    assert written.bytes == len(back)
    got = json.loads(gzip.decompress(back) if compressed else back)
    assert got == document(hashed) and list(got["cod"]["instances"]) == ["b", "a"]


def test_documents_without_optional_members(spark):
    plain = spark.createDataFrame([("1.2", "1.2.3", "b", "u", 3)], "study_uid string, series_uid string, instance_uid string, uri string, size long")
    got = json.loads(records.metadata_json(plain).first().value)
    assert got["cod"]["instances"]["b"] == {**dict.fromkeys(records.MEMBERS), "uri": "u", "size": 3, "version": "1.0"}
    assert records.metadata_json(plain.limit(0)).count() == 0


def test_metadata_is_made_if_missing(spark):
    documents = spark.createDataFrame([("gs://b/studies/1.2/series/1.2.3", "{}")], "series_uri string, value string")
    series = spark.createDataFrame([("gs://b/studies/1.2/series/1.2.3",), ("gs://b/studies/1.2/series/1.2.4",)], "series_uri string")
    got = {r.series_uri[-1]: (r.found, json.loads(r.value)) for r in storage.series_metadata(documents, series).collect()}
    assert got == {"3": (True, {}), "4": (False, {"study_uid": "1.2", "series_uid": "1.2.4", "cod": {"instances": {}}})}


# ---- identifiers --------------------------------------------------------------------------------


def test_user_hash_of_identifiers(spark):
    rows = spark.createDataFrame([("1.2.3.4", "1.2.3.4"), ("1.2.3.9", "1.2.3.4"), (None, "1")], "study_uid string, series_uid string")
    got = ingest.belonging(rows, "1.2.3.5", "1.2.3.5", hashed=True, hash_uid=S.next_uid)
    assert [r.belongs for r in got.collect()] == [True, False, False]
    assert [r.belongs for r in ingest.belonging(rows, "1.2.3.4", "1.2.3.4", hashed=False).collect()] == [True, False, False]
    for hashed, function in ((True, None), (False, S.next_uid)):
        with pytest.raises(S.UidHashMissing):
            ingest.belonging(rows, "1", "1", hashed=hashed, hash_uid=function)
    with pytest.raises(S.UidHashMissing):
        S.uid(F.lit("1"), None, hashed=True)
    assert rows.select(S.uid(F.col("study_uid"), lambda u: F.md5(u), hashed=True).alias("u")).first().u == __import__("hashlib").md5(b"1.2.3.4").hexdigest()


def test_store_uris(spark):
    cases = {
        "gs://b/p/studies/1.2/series/1.2.3": ("gs://b/p", "1.2", "1.2.3"), "gs://b/studies/1.2/series/1.2.3.tar": ("gs://b", "1.2", "1.2.3"),
        "s3://b/studies/1/series/2/metadata.json": ("s3://b", "1", "2"), "gs://b/studies/1/series/2.tar://instances/3.dcm": ("gs://b", "1", "2"), "/local/studies/1/series/2": None, "gs://b/studies/1": None, None: None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").withColumn("p", S.parse_store_uri(F.col("u")))
    assert {r.u: tuple(r.p) if r.p else None for r in rows.collect()} == cases


# ---- append and remove --------------------------------------------------------------------------


def test_null_keys_are_keys(spark):
    schema = "series string, uid string, crc string, size long"
    stored, batch = spark.createDataFrame([(None, "1", "a", 5), ("s", None, "b", 5)], schema), spark.createDataFrame([(None, "1", "a", 7), ("s", None, "c", 7), ("t", None, "b", 7)], schema)
    assert values(ingest.classify(batch, stored, KEYS), "series", "status") == sorted([(None, "same"), ("s", "conflict"), ("t", "new")], key=str)
    assert values(ingest.series_sizes(batch, stored, "series"), "series", "incoming", "stored") == sorted([(None, 7, 5), ("s", 7, 5), ("t", 7, 0)], key=str)
    assert values(ingest.membership(batch, stored, ["series"]), "series", "belongs") == sorted([(None, True), ("s", True), ("t", False)], key=str)


def test_dupes_are_recorded_once(spark):
    stored = spark.createDataFrame([("s", "1", ["gs://b/x"], "old"), ("s", "2", None, "old")], "series string, uid string, diff_hash_dupe_paths array<string>, modified_datetime string")
    rows = spark.createDataFrame([("s", "1", "gs://b/x", "conflict"), ("s", "1", "gs://b/y", "conflict"), ("s", "1", "gs://b/y", "conflict"), ("s", "1", "/local", "conflict"), ("s", "2", "gs://b/z", "same")], "series string, uid string, path string, status string")
    got = {r.uid: (r.diff_hash_dupe_paths, r.modified_datetime) for r in ingest.record_dupes(stored, rows, KEYS, F.lit("2025-01-02 03:04:05.6").cast("timestamp_ntz")).collect()}
    assert got == {"1": (["gs://b/x", "gs://b/y"], "2025-01-02T03:04:05.600000"), "2": ([], "old")}


def test_append_with_errors_only(spark):
    rows = spark.createDataFrame([("error",), ("error",)], "status string")
    with pytest.raises(ingest.NothingAppended):
        ingest.require_some(rows)
    assert ingest.require_some(rows.limit(0)).count() == 0


def test_remove_guards(spark):
    stored = spark.createDataFrame([("s", "1"), ("s", "2"), ("t", "3")], "series string, uid string")
    given = lambda *u: spark.createDataFrame([("t" if x == "3" else "s", x) for x in u], "series string, uid string")
    assert values(dml.remove_guarded(stored, given("1"), KEYS, "series"), "uid") == [("2",), ("3",)]
    assert dml.remove_guarded(stored, given("9"), KEYS, "series").count() == 3
    with pytest.raises(dml.NothingLeft, match="t"):
        dml.remove_guarded(stored, given("3"), KEYS, "series")


def test_guard_lets_named_series_go(spark):
    stored = spark.createDataFrame([("s", "1"), ("s", "2"), ("t", "3"), ("t", "3"), (None, "4"), ("u", None)], "series string, uid string")
    given = spark.createDataFrame([("s", "1"), ("t", "3"), ("t", "3"), (None, "4"), ("u", None), ("v", "5")], "series string, uid string")
    bare = dml.bared(stored, given, KEYS, "series")
    assert values(bare, "series") == [("t",)]
    dml.guard(stored, given, KEYS, "series", but=bare)
    with pytest.raises(dml.NothingLeft, match="t"):
        dml.guard(stored, given, KEYS, "series", but=bare.limit(0))


# ---- requests -----------------------------------------------------------------------------------


def test_answers_at_all_levels(spark):
    meta = lambda k: json.dumps({"00080050": {"vr": "SH", "Value": [k]}, "0020000D": {"vr": "UI", "Value": ["1.2"]}})
    stored = spark.createDataFrame([("gs://b", "1.2", "1.2.3", "5.1", 1, meta("a"), [b"f1", b"f2"]), ("gs://b", "1.2", "1.2.3", "5.0", 2, meta("b"), None), ("gs://b", "1.2", "1.2.4", "5.2", 1, meta("c"), None)],
        "store string, study_uid string, series_uid string, instance_uid string, seq int, metadata string, frames array<binary>")
    base = "gs://b/studies/1.2"
    asked = {
        "study": f"{base}/metadata", "series": f"{base}/series/1.2.3/metadata", "instance": f"{base}/series/1.2.4/instances/5.2/metadata", "frames": f"{base}/series/1.2.3/instances/5.1/frames/2,1",
        "bounds": f"{base}/series/1.2.3/instances/5.1/frames/3", "blank": f"{base}/series/1.2.3/instances/5.0/frames/1", "none": f"{base}/series/1.2.9/metadata", "bad": f"{base}/series/1.2.3", "query": f"{base}/metadata?x=1", "null": None,
    }
    rows = spark.createDataFrame([(k, u) for k, u in asked.items()], "name string, uri string")
    got = {r.name: r for r in retrieval.answers(rows, stored).collect()}
    assert json.loads(got["study"].body) == {t: json.loads(meta("a")).get(t) for t in retrieval.STUDY_TAGS}
    assert json.loads(got["series"].body) == [json.loads(meta("a")), json.loads(meta("b"))] and json.loads(got["instance"].body) == json.loads(meta("c"))
    assert [bytes(x) for x in got["frames"].content] == [b"f2", b"f1"] and got["frames"].body is None
    assert {k: got[k].fault for k in ("bounds", "blank", "none", "bad", "query", "null")} == {"bounds": "out of bounds", "blank": "no pixel data", "none": "not found", "bad": "no metadata suffix", "query": "query string", "null": "no uri"}
    assert len(got) == len(asked) and retrieval.answers(rows, stored.limit(0)).filter("fault IS NULL").count() == 0
    assert retrieval.instance(stored, "1.2.3", position=1).first().instance_uid == "5.0" == retrieval.instance(stored, "1.2.3", uid="5.0").first().instance_uid
    for wrong in ({"position": 2}, {"uid": "x"}, {"position": -1}, {}):
        with pytest.raises(retrieval.InstanceNotFound):
            retrieval.instance(stored, "1.2.3", **wrong)


# ---- integrity, deletion, counters --------------------------------------------------------------


def test_integrity_and_deletion(spark):
    metadata = spark.createDataFrame([("1", "a"), ("2", "b")], "uid string, crc string")
    assert integrity.checked(metadata, metadata, "uid", "crc").count() == 2
    with pytest.raises(integrity.IntegrityError, match="missing"):
        integrity.checked(metadata, metadata.limit(1), "uid", "crc")
    instances = spark.createDataFrame([("1", ["gs://b/1"], "a", 10), ("2", ["gs://b/2"], "x", 20), ("3", ["gs://b/3", "gs://b/2"], "c", 30), ("4", ["gs://b/t.tar://m", None], "d", 40)], "uid string, dependencies array<string>, crc string, size long")
    stored = spark.createDataFrame([("gs://b/1", "a"), ("gs://b/2", "b")], "uri string, crc string")
    plan = integrity.dependency_plan(instances, stored)
    assert values(plan, "uid", "uri", "action") == sorted([("1", "gs://b/1", "delete"), ("2", "gs://b/2", "mismatch"), ("3", "gs://b/2", "delete"), ("3", "gs://b/3", "gone"), ("4", "gs://b/t.tar://m", "nested"), ("4", None, "null")], key=str)
    assert integrity.dependency_plan(instances, stored, validate=False).filter("action = 'mismatch'").count() == 0
    assert counters.deletion_counts(plan, instances).first().asDict() == {"num_deletes": 2, "dep_does_not_exist": 1, "instance_blob_crc32c_mismatch": 1, "nested_dependency": 1, "null_dependency": 1, "bytes_deleted": 40}
    states = spark.createDataFrame([("ok",), ("missing",), ("mismatch",), ("extra",), ("missing",)], "state string")
    assert tuple(counters.integrity_counts(states).first()) == (2, 1, 1)
    got = counters.storage_counts(spark.createDataFrame([("GET", "STANDARD"), ("CREATE", "ARCHIVE"), ("GET", "STANDARD")], "op string, storage_class string")).first()
    assert got.num_STANDARD_gets == 2 and got.num_ARCHIVE_creates == 1 and sum(got) == 3


def test_strict_order(spark):
    rows = spark.createDataFrame([("s", 1, 5, None), ("s", 2, 4, None), ("t", 1, None, 3), ("t", 2, 1, None)], "series string, seq int, a int, b int")
    got = {(r.series, r.seq): r.position for r in layout.fallback_sorted(rows, ["series"], ["a", "b"], "seq", strict=True).collect()}
    assert got == {("s", 1): 1, ("s", 2): 0, ("t", 1): None, ("t", 2): None}


# ---- thumbnails ---------------------------------------------------------------------------------


def test_thumbnails_are_generated_kept_and_renewed(spark, tmp_path):
    schema = "series string, instance string, frame int, height int, width int, channels int, pixels array<double>"
    grey, colour = [float(x) for x in range(8)], [float(x) for x in range(24)]
    rows = [("s", "a", 0, 2, 4, 1, grey), ("s", "b", 0, 2, 4, 3, colour), ("t", "c", 0, 2, 4, 1, [1.0] * 8), ("t", "d", 0, 2, 4, 1, None)]
    frames = spark.createDataFrame(rows, schema)
    made = thumbnails.generate(frames, ["series"], ["instance", "frame"], edge=8)
    got = {r.instance: r for r in made.collect()}
    assert [got[k].thumbnail_index for k in "abcd"] == [0, 1, 0, None] and [got[k].channels for k in "abcd"] == [3, 3, 1, None] and got["d"].pixels is None
    image = np.frombuffer(got["a"].pixels, np.uint8).reshape(8, 8, 3)
    assert not image[:2].any() and not image[6:].any() and image[2, 0].tolist() == [0, 0, 0] and image[5, 7].tolist() == [255, 255, 255] and got["a"].anchors.top == 2
    assert not any(got["c"].pixels) and len(got["c"].pixels) == 64
    assert tuple(counters.thumbnail_counts(made).first()) == (1, 3, 2 * 192 + 64)
    thumbnails.write_thumbnails(made, f"{tmp_path}/thumbs")
    now = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "c")], "series string, instance string")
    kept = thumbnails.current(f"{tmp_path}/thumbs", now, frames.filter("instance <> 'd'"), "series", "instance")
    assert values(kept, "instance", "thumbnail_index") == [("a", 0), ("b", 1), ("c", 0)]
    with pytest.raises(thumbnails.NoPixelData, match="u"):
        thumbnails.require_pixels(frames.unionByName(spark.createDataFrame([("u", "e", 0, 1, 1, 1, None)], schema)), ["series"])
    assert thumbnails.require_pixels(frames, ["series"]).count() == 4


def test_normalised_frames(spark):
    rows = spark.createDataFrame([([1.0, 3.0, 2.0],), ([5.0, 5.0],), ([],), (None,)], "p array<double>")
    assert [r.n for r in rows.select(thumbnails.normalised(F.col("p")).alias("n")).collect()] == [[0, 255, 128], [0, 0], [], None]


def test_gzip_of_texts(spark):
    rows = spark.createDataFrame([("é" * 9,), (None,), ("",)], "t string")
    assert [r.t for r in rows.select(S.gunzipped(S.gzipped("t")).alias("t")).collect()] == ["é" * 9, None, ""]
