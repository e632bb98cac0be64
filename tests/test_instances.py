import io
import json
import struct
import tarfile
import zlib

import pytest

from voxelake.functions.scalars import crc32c_base64
from voxelake.operators import ingest, layout
from voxelake.sources import containers, instances

LONG = instances.LONG


def element(tag, vr, value, order="<", explicit=True, undefined=False):
    head = struct.pack(order + "HH", int(tag[:4], 16), int(tag[4:], 16))
    size = 0xFFFFFFFF if undefined else len(value)
    if not explicit:
        return head + struct.pack(order + "I", size) + value
    if vr in LONG:
        return head + vr.encode() + b"\0\0" + struct.pack(order + "I", size) + value
    return head + vr.encode() + struct.pack(order + "H", size) + value


def item(value, undefined=False):
    return b"\xfe\xff\x00\xe0" + struct.pack("<I", 0xFFFFFFFF if undefined else len(value)) + value + (b"\xfe\xff\x0d\xe0\0\0\0\0" if undefined else b"")


END = b"\xfe\xff\xdd\xe0\0\0\0\0"


def dataset(order="<", explicit=True, pixels=b"\1\2" * 600, encapsulated=False, frames=3):
    e = lambda tag, vr, value, **kw: element(tag, vr, value, order, explicit, **kw)
    return b"".join([
        e("00080008", "CS", b"ORIGINAL\\PRIMARY "), e("00080018", "UI", b"1.2.3.4\0"), e("0020000D", "UI", b"1.2.3.40"), e("0020000E", "UI", b"1.2.3.41"), e("00200013", "IS", b"7 "),
        e("00280008", "IS", str(frames).encode().ljust(2)), e("00280010", "US", struct.pack(order + "H", 512)), e("00281050", "DS", b"1.5\\\\2 "),
        e("7FE00010", "OB" if encapsulated else "OW", pixels, undefined=encapsulated),
    ])


def file(body, syntax="1.2.840.10008.1.2.1"):
    raw = syntax.encode() + b"\0" * (len(syntax) % 2)
    return bytes(128) + b"DICM" + element("00020010", "UI", raw) + body


@pytest.mark.parametrize("syntax, order, explicit", [("1.2.840.10008.1.2.1", "<", True), (instances.IMPLICIT, "<", False), (instances.BIG_ENDIAN, ">", True)])
def test_encodings_read_alike(syntax, order, explicit):
    data = file(dataset(order, explicit), syntax)
    found, whole, pixels = instances.parse(data, "gs://b/x.dcm")
    assert found["00080008"] == {"vr": "CS", "Value": ["ORIGINAL", "PRIMARY"]}
    assert found["00200013"]["Value"] == [7] and found["00280010"]["Value"] == [512] and found["00281050"]["Value"] == [1.5, None, 2.0]
    assert found["7FE00010"]["BulkDataURI"] == {"uri": "gs://b/x.dcm", "head": "\1\2" * 256}
    assert whole == data and data[pixels[0] : pixels[1]] == b"\1\2" * 600
    assert [(o - pixels[0], n) for o, n in instances.frames_of(found, whole, pixels)] == [(0, 400), (400, 400), (800, 400)]
    assert found["00020010"]["Value"] == [syntax]


def test_deflated():
    squeeze = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = file(squeeze.compress(dataset()) + squeeze.flush(), instances.DEFLATED)
    assert instances.first(instances.parse(data, "x")[0], instances.INSTANCE) == "1.2.3.4"


@pytest.mark.parametrize("with_table", [True, False])
def test_encapsulated_frames_hold_the_payload(with_table):
    frames = [bytes([k]) * 200 for k in range(3)]
    entries = b"".join(struct.pack("<I", 208 * k) for k in range(3)) if with_table else b""
    body = item(entries) + b"".join(map(item, frames))
    found, whole, pixels = instances.parse(file(dataset(pixels=body + END, encapsulated=True)), "x")
    assert pixels[2] and whole[pixels[0] : pixels[1]] == body
    got = instances.frames_of(found, whole, pixels)
    assert [whole[o : o + n] for o, n in got] == frames
    assert instances.frames_of(found | {"00280008": {"vr": "IS", "Value": [4]}}, whole, pixels) == []


def test_sequences_and_text():
    name = element("00100010", "PN", "Müller^Eva=漢".encode())
    inner = element("00080060", "CS", b"CT")
    body = b"".join([
        element("00080005", "CS", b"ISO_IR 192"), element("00081140", "SQ", item(inner, True) + END, undefined=True), element("00081199", "SQ", item(inner)), element("00089999", "SQ", b""), name,
        element("00101030", "DS", b"heavy "), element("00104000", "LT", b"a\\b "), element("00280009", "AT", struct.pack("<HH", 0x18, 0x1063)), element("00420011", "OB", b"\1\2\3\4"),
        element("00189087", "FD", struct.pack("<d", float("nan"))),
    ])
    found, _, pixels = instances.parse(file(body), "x")
    assert found["00081140"] == found["00081199"] == {"vr": "SQ", "Value": [{"00080060": {"vr": "CS", "Value": ["CT"]}}]} and found["00089999"] == {"vr": "SQ"}
    assert found["00100010"]["Value"] == [{"Alphabetic": "Müller^Eva", "Ideographic": "漢"}]
    assert "00101030" not in found and found["00104000"]["Value"] == ["a\\b"] and found["00280009"]["Value"] == ["00181063"]
    assert found["00420011"] == {"vr": "OB", "InlineBinary": "AQIDBA=="} and found["00189087"]["Value"] == [None] and pixels is None


def test_read_instances(spark, tmp_path):
    good = file(dataset())
    (tmp_path / "a.dcm").write_bytes(good)
    (tmp_path / "b.dcm").write_bytes(good[:-5])
    (tmp_path / "c.txt").write_bytes(b"no instance")
    every = {r.uri.rsplit("/", 1)[1]: r for r in instances.read_instances(containers.read_files(spark, str(tmp_path), only_instances=False), "gs://store").collect()}
    r = every["a.dcm"]
    assert (r.size, r.crc32c, r.instance_uid, r.series_uid, r.study_uid, r.has_pixeldata, r.n_frames, len(r.frames), r.fault) == (len(good), crc32c_base64([good])[0], "1.2.3.4", "1.2.3.41", "1.2.3.40", True, 3, 3, None)
    assert r.pixel_crc32c == crc32c_base64([b"\1\2" * 600])[0]
    assert json.loads(r.metadata)["7FE00010"]["BulkDataURI"]["uri"] == "gs://store/studies/1.2.3.40/series/1.2.3.41.tar://instances/1.2.3.4.dcm"
    assert "beyond the end" in every["b.dcm"].fault and every["b.dcm"].metadata is None and every["c.txt"].fault == "no magic bytes"
    assert containers.read_files(spark, str(tmp_path)).count() == 2
    assert instances.read_instances(spark.createDataFrame([], "path string, content binary, uri int")).count() == 0
    assert instances.read_instances(spark.createDataFrame([("p", None)], "path string, content binary")).first().fault


def test_chunks_make_a_container(spark):
    rows = [("s", 1, "1.2", b"x" * 700), ("s", 2, "1.3", b""), ("s", 3, "1.4", b"y" * 512)]
    df = spark.createDataFrame(rows, "series string, seq int, instance_uid string, content binary").selectExpr("*", "cast(octet_length(content) AS long) AS size")
    got = layout.container_offsets(containers.chunks(df), ["series"], ["seq"]).orderBy("seq").collect()
    whole = b"".join(bytes(r.chunk) for r in got) + containers.END_OF_CONTAINER
    with tarfile.open(fileobj=io.BytesIO(whole)) as tar:
        assert [(m.name, m.offset_data, m.size) for m in tar] == [(f"instances/{r.instance_uid}.dcm", r.start_byte, r.size) for r in got]
    assert [whole[r.start_byte : r.end_byte] for r in got] == [r[3] for r in rows]


def test_append_in_order(spark):
    schema = "series string, uid string, crc string, size long, seq int"
    gb = ingest.GB
    batch = spark.createDataFrame([
        ("a", "1", "x", 1, 1), ("a", "1", "x", 1, 2), ("a", "1", "y", 1, 3), ("a", "2", "q", 1, 4), ("a", "3", "z", 1, 5), ("a", "4", "w", 11 * gb, 6),
        ("b", "1", "x", 9 * gb, 7), ("b", "1", "x", 9 * gb, 8), ("c", "1", "x", 1, 9), ("a", "5", "n", None, 10),
    ], schema)
    existing = spark.createDataFrame([("a", "2", "q", 1, 0), ("a", "3", "other", 1, 0)], schema)
    known = spark.createDataFrame([("a",), ("b",)], "series string")
    got = ingest.append(batch, existing, ["series", "uid"], ["seq"], series="series", known=known, max_series_gb=17)
    assert sorted((r.seq, r.status, r.error) for r in got.collect()) == [
        (1, "new", None), (2, "same", None), (3, "conflict", None), (4, "same", None), (5, "conflict", None), (6, "error", "instance too large"),
        (7, "error", "series too large"), (8, "error", "series too large"), (9, "error", "not of this series"), (10, "new", None),
    ]
    assert ingest.append(batch.limit(0), existing, ["series", "uid"], ["seq"], series="series").count() == 0
