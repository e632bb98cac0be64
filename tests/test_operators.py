import io
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelake.functions import scalars as S
from voxelake.operators import counters, dml, ingest, integrity, layout, retrieval, thumbnails
from voxelake.sources import containers, records

KEYS = ["series", "uid"]


def rows(spark, data, schema="series string, uid string, crc string, seq int"):
    return spark.createDataFrame(data, schema)


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_crc32c_known_value():
    assert S.crc32c_base64([b"123456789", b"", b"a"])[0] == "4waSgw=="
    assert S.crc32c_base64([])== []


def test_first_wins_and_classify(spark):
    batch = rows(spark, [("s", "1", "a", 1), ("s", "1", "a", 2), ("s", "1", "b", 3), ("s", "2", "c", 4)])
    assert values(ingest.first_wins(batch, KEYS, ["seq"]), "uid", "seq", "status") == [("1", 1, "new"), ("1", 2, "same"), ("1", 3, "conflict"), ("2", 4, "new")]
    stored = rows(spark, [("s", "1", "b", 0)])
    got = ingest.classify(ingest.winners(batch, KEYS, ["seq"]), stored, KEYS)
    assert values(got, "uid", "status") == [("1", "conflict"), ("2", "new")]


def test_equal_pixels_count_as_same(spark):
    schema = "series string, uid string, crc string, px string"
    batch, stored = rows(spark, [("s", "1", "a", "p"), ("s", "2", "a", None)], schema), rows(spark, [("s", "1", "b", "p"), ("s", "2", "b", None)], schema)
    assert values(ingest.classify(batch, stored, KEYS, pixel="px"), "uid", "status") == [("1", "same"), ("2", "conflict")]


def test_two_steps_equal_one(spark):
    all_ = [("s", "1", "a", 1), ("s", "2", "b", 2), ("s", "3", "c", 3)]
    once = ingest.winners(rows(spark, all_), KEYS, ["seq"])
    twice = ingest.merged(ingest.winners(rows(spark, all_[:2]), KEYS, ["seq"]), rows(spark, all_[1:]), KEYS, ["seq"])
    assert values(once, "uid", "crc") == values(twice, "uid", "crc")


def test_observed_counts(spark):
    df, seen = counters.observed(ingest.first_wins(rows(spark, [("s", "1", "a", 1), ("s", "1", "b", 2)]), KEYS, ["seq"]))
    df.collect()
    assert seen.get["new"] == 1 and seen.get["conflict"] == 1


def test_truncate_keeps_the_stored_payload(spark):
    stored, given = rows(spark, [("s", "1", "old", 1), ("s", "2", "x", 2)]), rows(spark, [("s", "1", "new", 1), ("s", "3", "y", 3)])
    assert values(dml.truncate(stored, given, KEYS), "uid", "crc") == [("1", "old"), ("3", "y")]
    assert values(dml.remove(stored, given, KEYS), "uid") == [("2",)]
    assert values(dml.missing_requests(stored, given, KEYS), "uid") == [("3",)]


def test_fields(spark):
    series = spark.createDataFrame([({"a": "1"},)], "fields map<string,string>")
    assert dml.put_field(series, "b", "2").select(dml.get_field("b")).first()[0] == "2"
    with pytest.raises(dml.FieldExists):
        dml.put_field(series, "a", "2", overwrite=False)
    gone = dml.remove_field(series, "a").first()
    assert gone["removed"] and gone["fields"] == {}


def test_fallback_sort(spark):
    df = spark.createDataFrame([("s", 1, None, 5.0), ("s", 2, 1, 3.0), ("t", 1, 2, None), ("t", 2, 1, None)], "series string, seq int, number int, place double")
    got = layout.fallback_sorted(df, ["series"], ["number", "place"], "seq")
    assert values(got, "series", "seq", "position") == [("s", 1, 1), ("s", 2, 0), ("t", 1, 1), ("t", 2, 0)]


def test_container_offsets_match_tar(spark):
    got = layout.container_offsets(spark.createDataFrame([("s", 1, 392018), ("s", 2, 407646)], "series string, seq int, size long"), ["series"], ["seq"])
    assert values(got, "start_byte", "end_byte") == [(1536, 393554), (395264, 802910)]


def items(frames, with_table, delimiter=True):
    item = lambda x: b"\xfe\xff\x00\xe0" + len(x).to_bytes(4, "little") + x
    body = b"".join(map(item, frames))
    entries = b"".join((sum(len(f) + 8 for f in frames[:k])).to_bytes(4, "little") for k in range(len(frames))) if with_table else b""
    return item(entries) + body


def test_frame_offsets_golden(spark):
    frames = [bytes([k]) * 200 for k in range(5)]
    assert [o for o, _ in layout.encapsulated_frames(476, items(frames, True))] == [512, 720, 928, 1136, 1344]
    assert layout.encapsulated_frames(476, items(frames, False) + b"\xfe\xff\xdd\xe0\0\0\0\0") == [(492 + 208 * k, 200) for k in range(5)]
    raw = spark.range(1).select(layout.raw_frames(F.lit(5), F.lit(476), F.lit(1000))).first()[0]
    assert [(f.offset, f.length) for f in raw] == [(484 + 200 * k, 200) for k in range(5)]
    assert spark.range(1).select(layout.raw_frames(F.lit(1), F.lit(476), F.lit(1000))).first()[0] is None
    for bad in (b"\0" * 8, b"\xfe\xff\x00\xe0\xff\xff\xff\xff"):
        with pytest.raises(layout.FrameError):
            layout.walk_items(bad)
    df = spark.createDataFrame([(476, items(frames, True), 5), (476, b"\0" * 8, 5), (476, None, 5)], "s long, d binary, n int")
    assert [len(r.frames) for r in layout.frames_udf(df, "s", "d", "n").collect()] == [5, 0, 0]


def test_items_walked_side_by_side_as_one_by_one():
    draw = random.Random(4)
    item = lambda x: b"\xfe\xff\x00\xe0" + len(x).to_bytes(4, "little") + x
    blobs = []
    for _ in range(300):
        items = [item(bytes(draw.randrange(6))) for _ in range(draw.randrange(40))]
        table = draw.choice([b"", b"", b"", bytes(4 * len(items))])
        end = draw.choice([b"\xfe\xff\xdd\xe0" + bytes(4), b"", b"x", b"unknown.", b"\xfe\xff\x00\xe0" + b"\xff" * 4])
        blobs.append(draw.choice([item(table), b""]) + b"".join(items) + end)
    for some in (blobs, blobs[:5], [b""], [b"short"]):
        ends = np.cumsum([len(b) for b in some])
        counts, own = [], []
        for k, blob in enumerate(some):
            try:
                frames = layout.encapsulated_frames(k, blob)
            except layout.FrameError:
                frames = []
            counts.append(len(frames) if len(frames) > 1 and k % 7 else 0)
            own += frames if counts[-1] else []
        n = np.array([c if k % 7 else 3000 for k, c in enumerate(counts)])
        found, offset, length = layout.frames_side_by_side(np.arange(len(some)), np.frombuffer(b"".join(some), np.uint8), np.append(0, ends[:-1]), ends, n)
        assert found.tolist() == counts and list(zip(offset.tolist(), length.tolist(), strict=True)) == own


def test_little_endian(spark):
    assert spark.createDataFrame([(b"\x01\x02\x00\x00",)], "b binary").select(S.uint32_le(F.col("b"), F.lit(0))).first()[0] == 513


def test_integrity(spark):
    a, b = (spark.createDataFrame(x, "k int, c string") for x in ([(1, "x"), (2, "y"), (3, "z")], [(1, "x"), (2, "n"), (4, "q")]))
    assert values(integrity.compare(a, b, "k", "c"), "k", "state") == [(1, "ok"), (2, "mismatch"), (3, "missing"), (4, "extra")]


def test_requests(spark):
    uris = ["gs://b/studies/1.2/series/1.3/instances/1.4/frames/1,2", "gs://b/studies/1.2/metadata", "http://b/studies/1", "gs://b/studies/x/metadata"]
    df = spark.createDataFrame([(u,) for u in uris], "u string").withColumn("r", retrieval.parse(F.col("u")))
    got = df.select("r.*", retrieval.level(F.col("r")).alias("level"), retrieval.request_fault(F.col("u"), F.col("r")).alias("fault")).collect()
    assert (got[0].study, got[0].series, got[0].instance, got[0].frames, got[0].level, got[0].fault) == ("1.2", "1.3", "1.4", [1, 2], "frame", None)
    assert (got[1].level, got[1].fault, got[2].fault, got[3].fault) == ("study", None, "scheme", "study uid")


def test_uid_hash(spark):
    assert spark.createDataFrame([("1.2.3.4",)], "u string").select(S.next_uid(F.col("u"))).first()[0] == "1.2.3.5"


def test_thumbnails():
    frame = np.arange(256 * 128, dtype=float).reshape(256, 128)
    out = thumbnails.letterbox(frame)
    assert out.shape == (128, 128) and out[:, :32].max() == 0 and np.isclose(out[0, 32], frame[:2, :2].mean())
    assert thumbnails.harmonised([np.zeros((2, 2)), np.ones((2, 2, 4))]).shape == (2, 2, 2, 3)
    with pytest.raises(ValueError):
        thumbnails.harmonised([])
    m = thumbnails.CoordinateMap(256, 128, 0, 32, 128, 96, 0.5)
    assert m.to_original(*m.to_thumbnail(10, 20)) == (10, 20)
    with pytest.raises(ValueError):
        m.to_thumbnail(300, 0)


def test_constant_frame_normalises_to_zero(spark):
    df = spark.createDataFrame([([2.0, 2.0],), ([0.0, 4.0],)], "p array<double>")
    assert [r[0] for r in df.select(thumbnails.normalised(F.col("p"))).collect()] == [[0, 0], [0, 255]]


def test_window():
    w = containers.Window(io.BytesIO(b"0123456789"), 2, 7)
    assert w.read() == b"23456" and w.read() == b"" and w.seek(-2, io.SEEK_END) == 3 and w.read(1) == b"5" and w.tell() == 4


def test_tar_members(spark, tmp_path):
    path = tmp_path / "s.tar"
    with tarfile.open(path, "w") as tar:
        info = tarfile.TarInfo("instances/1.dcm")
        info.size = 5
        tar.addfile(info, io.BytesIO(b"hello"))
    got = containers.members(containers.read_files(spark, str(path), only_instances=False)).first()
    assert bytes(got.content) == b"hello" and path.read_bytes()[got.start_byte : got.end_byte] == b"hello"
    good = b"\0" * 128 + b"DICM"
    (tmp_path / "a.dcm").write_bytes(good)
    assert containers.read_files(spark, str(tmp_path)).count() == 1


def test_metadata_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "2", "3", "gs://x", 4, "c", "p")], "study_uid string, series_uid string, instance_uid string, uri string, size long, crc32c string, original_path string")
    records.metadata_json(df).select("value").write.text(str(tmp_path / "m"))
    got = records.read_series_metadata(spark, str(tmp_path / "m" / "*.txt")).first()
    assert (got.study_uid, got.series_uid, got.instance_uid, got.size, got.hashed_uids) == ("1", "2", "3", 4, False)


def test_query_results_need_uris(spark):
    df = spark.createDataFrame([("1", "2", [(None, 1, "c", "i")])], records.FILES)
    with pytest.raises(Exception, match="file_uri"):
        records.query_result_instances(df).collect()
