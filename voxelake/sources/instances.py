"""Instance files: their data elements as JSON documents, identifiers, digests and frame places."""

from __future__ import annotations

import base64
import json
import math
import struct
import zlib
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.scalars import crc32c_base64
from ..operators.layout import FrameError, encapsulated_frames
from ..session import bounded_batches
from .containers import MAGIC

#: Binary elements longer than the first are left in the file, with so many bytes at their head as the second.
BULK_BYTES, HEAD_BYTES = 1024, 512
INSTANCE, SERIES, STUDY, FRAMES, PIXELS, CHARSET, SYNTAX = "00080018", "0020000E", "0020000D", "00280008", "7FE00010", "00080005", "00020010"
IMPLICIT, DEFLATED, BIG_ENDIAN = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
#: Representations with a four-byte length, binary ones, and those of numbers.
LONG = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
BINARY = {"OB", "OD", "OF", "OL", "OV", "OW", "UN"}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "UV": "Q", "SV": "q", "FL": "f", "FD": "d"}
#: Texts in which a backslash does not part values.
SINGLE = {"LT", "ST", "UT", "UR"}
#: Representations of elements in files that do not spell them out; more can be given as a parameter.
IMPLIED = {
    "00080005": "CS", "00080008": "CS", "00080016": "UI", "00080018": "UI", "00080020": "DA", "00080030": "TM", "00080050": "SH", "00080060": "CS", "00080090": "PN", "00081030": "LO",
    "0008103E": "LO", "00100010": "PN", "00100020": "LO", "00100030": "DA", "00100040": "CS", "00180050": "DS", "0020000D": "UI", "0020000E": "UI", "00200010": "SH", "00200011": "IS",
    "00200013": "IS", "00200032": "DS", "00200037": "DS", "00200052": "UI", "00201041": "DS", "00280002": "US", "00280004": "CS", "00280008": "IS", "00280010": "US", "00280011": "US",
    "00280030": "DS", "00280100": "US", "00280101": "US", "00280102": "US", "00280103": "US", "00281050": "DS", "00281051": "DS", "7FE00010": "OW",
}
CHARSETS = {"ISO_IR 192": "utf-8", "ISO_IR 100": "latin-1", "ISO_IR 101": "iso8859-2", "ISO_IR 144": "iso8859-5", "GB18030": "gb18030"}
UNDEFINED = 0xFFFFFFFF
ITEM, ITEM_END, SEQUENCE_END = "FFFEE000", "FFFEE00D", "FFFEE0DD"


class InstanceError(ValueError):
    """A file that is not a readable instance."""


def finite(x: float) -> float | None:
    """``x``, or None where JSON has no name for it."""
    return x if math.isfinite(x) else None


class Reader:
    """Data elements of a file's bytes."""

    def __init__(self, data: bytes, explicit: bool, order: str, implied: Mapping[str, str], uri: str, charset: str = "ascii") -> None:
        self.data, self.explicit, self.order, self.implied, self.uri, self.charset = data, explicit, order, implied, uri, charset
        self.pixels: tuple[int, int, bool] | None = None

    def head(self, at: int) -> tuple[str, str, int, int]:
        """Tag, representation, length and place of the value of the element at ``at``."""
        group, element = struct.unpack_from(self.order + "HH", self.data, at)
        tag = f"{group:04X}{element:04X}"
        if group == 0xFFFE or not self.explicit:
            vr = "" if group == 0xFFFE else "UL" if element == 0 else self.implied.get(tag, "UN")
            return tag, vr, struct.unpack_from(self.order + "I", self.data, at + 4)[0], at + 8
        vr = self.data[at + 4 : at + 6].decode("latin-1")
        if not (vr.isalpha() and vr.isupper()):
            raise InstanceError(f"no value representation at {at}")
        if vr in LONG:
            return tag, vr, struct.unpack_from(self.order + "I", self.data, at + 8)[0], at + 12
        return tag, vr, struct.unpack_from(self.order + "H", self.data, at + 6)[0], at + 8

    def elements(self, at: int, end: int, top: bool = False, groups: range = range(0x10000)) -> tuple[dict, int]:
        """The elements from ``at`` on as a JSON object, and where they end. Elements whose value is not valid are left out."""
        found: dict = {}
        while at + 8 <= end and int.from_bytes(self.data[at : at + 2], "little" if self.order == "<" else "big") in groups:
            tag, vr, size, place = self.head(at)
            if tag == ITEM_END:
                return found, place
            if vr == "SQ" or (vr == "UN" and size == UNDEFINED):
                values, at = self.items(place, size, end)
                found[tag] = {"vr": "SQ"} | ({"Value": values} if values else {})
                continue
            encapsulated = size == UNDEFINED
            stop = self.fragments_end(place, end) if encapsulated else place + size
            if stop > end:
                raise InstanceError(f"element {tag} reaches beyond the end")
            if top and tag == PIXELS:
                self.pixels = (place, stop, encapsulated)
            try:
                found[tag] = self.element(vr, place, stop)
            except (ValueError, struct.error, OverflowError):
                pass
            if tag == CHARSET:
                names = found.get(tag, {}).get("Value") or [None]
                self.charset = CHARSETS.get(names[0], "ascii")
            at = stop + (8 if encapsulated else 0)
        return found, at

    def items(self, at: int, size: int, end: int) -> tuple[list[dict], int]:
        """The items of a sequence, of stated or undefined length."""
        stop = end if size == UNDEFINED else at + size
        if stop > end:
            raise InstanceError("a sequence reaches beyond the end")
        values = []
        while at + 8 <= stop:
            tag, _, length, place = self.head(at)
            if tag == SEQUENCE_END:
                return values, place
            if tag != ITEM:
                raise InstanceError(f"tag {tag} in a sequence")
            charset = self.charset
            value, at = self.elements(place, stop if length == UNDEFINED else place + length)
            self.charset = charset
            values.append(value)
        return values, stop

    def fragments_end(self, at: int, end: int) -> int:
        """Where the delimiter after encapsulated fragments stands."""
        while at + 8 <= end:
            tag, _, size, place = self.head(at)
            if tag == SEQUENCE_END:
                return at
            if tag != ITEM or size == UNDEFINED:
                raise InstanceError(f"tag {tag} among fragments")
            at = place + size
        raise InstanceError("fragments without an end")

    def element(self, vr: str, at: int, stop: int) -> dict:
        raw = self.data[at:stop]
        if not raw:
            return {"vr": vr}
        if vr in BINARY:
            if len(raw) > BULK_BYTES:
                return {"vr": vr, "BulkDataURI": {"uri": self.uri, "head": raw[:HEAD_BYTES].decode("utf-8", "replace")}}
            return {"vr": vr, "InlineBinary": base64.b64encode(raw).decode()}
        if vr in NUMBERS:
            one = struct.calcsize("=" + NUMBERS[vr])
            return {"vr": vr, "Value": [finite(x) for x in struct.unpack(f"{self.order}{len(raw) // one}{NUMBERS[vr]}", raw)]}
        if vr == "AT":
            pairs = struct.unpack(f"{self.order}{len(raw) // 2}H", raw)
            return {"vr": vr, "Value": [f"{a:04X}{b:04X}" for a, b in zip(pairs[::2], pairs[1::2], strict=True)]}
        text = raw.decode(self.charset, "replace").rstrip("\0 ")
        if not text:
            return {"vr": vr}
        parts: list = [text] if vr in SINGLE else [p.strip("\0 ") if vr != "UC" else p for p in text.split("\\")]
        if vr in ("DS", "IS"):
            parts = [(int(p) if vr == "IS" else finite(float(p))) if p else None for p in parts]
        elif vr == "PN":
            kinds = ("Alphabetic", "Ideographic", "Phonetic")
            parts = [{k: v for k, v in zip(kinds, p.split("="), strict=False) if v} for p in parts]
        else:
            parts = [p or None for p in parts]
        return {"vr": vr, "Value": parts}


def parse(data: bytes, uri: str, implied: Mapping[str, str] = IMPLIED) -> tuple[dict, bytes, tuple[int, int, bool] | None]:
    """The elements of an instance file as one JSON object, the bytes that places refer to, and the pixel
    data's place, end and whether it is encapsulated.

    ``uri`` is what elements that are left in the file refer to. The places are those of the file, but for a
    deflated one, whose bytes from the data set on are inflated first.
    """
    if data[128:132] != MAGIC:
        raise InstanceError("no magic bytes")
    try:
        meta, at = Reader(data, True, "<", implied, uri).elements(132, len(data), groups=range(2, 3))
        syntax = first(meta, SYNTAX)
        if syntax == DEFLATED:
            data = data[:at] + zlib.decompress(data[at:], -zlib.MAX_WBITS)
        reader = Reader(data, syntax != IMPLICIT, ">" if syntax == BIG_ENDIAN else "<", implied, uri)
        found, _ = reader.elements(at, len(data), top=True)
    except (struct.error, zlib.error, RecursionError) as error:
        raise InstanceError(str(error)) from error
    return found | meta, data, reader.pixels


def first(elements: dict, tag: str):
    """The first value of an element, None if there is none."""
    values = elements.get(tag, {}).get("Value")
    return values[0] if values else None


def frames_of(elements: dict, data: bytes, pixels: tuple[int, int, bool] | None) -> list[tuple[int, int]]:
    """Places and lengths of the frames of a multi-frame instance; none if they are not as many as stated."""
    n = first(elements, FRAMES)
    if pixels is None or not isinstance(n, int) or n < 2:
        return []
    at, stop, encapsulated = pixels
    if not encapsulated:
        size = (stop - at) // n
        return [(at + k * size, size) for k in range(n)] if size else []
    try:
        found = encapsulated_frames(at, data[at:stop])
    except FrameError:
        return []
    return found if len(found) == n else []


COLUMNS = {
    "uri": "string", "size": "long", "crc32c": "string", "instance_uid": "string", "series_uid": "string", "study_uid": "string", "has_pixeldata": "boolean",
    "pixel_crc32c": "string", "n_frames": "int", "frames": "array<struct<offset:long,length:long>>", "metadata": "string", "fault": "string",
}


def read_instances(files: DataFrame, output: str | None = None, implied: Mapping[str, str] = IMPLIED) -> DataFrame:
    """One row for each of ``files`` (path, content), with ``COLUMNS``: what ingestion and retrieval need of it.

    ``metadata`` is the JSON object of all elements by tag; in it, long binary elements refer to the file's URI
    or, if ``output`` names a store, to the place there. A file that cannot be read has a ``fault`` and nulls.
    Null content counts as empty; an empty table gives no rows; other columns are not read.
    """
    bounded_batches(files.sparkSession)

    def row(path: str, data: bytes) -> tuple:
        digest = crc32c_base64([data])[0]
        try:
            elements, whole, pixels = parse(data, path, implied)
        except InstanceError as error:
            return (path, len(data), digest, *[None] * 8, str(error))
        uids = [first(elements, tag) for tag in (INSTANCE, SERIES, STUDY)]
        if output is not None:
            target = f"{output}/studies/{uids[2]}/series/{uids[1]}.tar://instances/{uids[0]}.dcm"
            for e in elements.values():
                if "BulkDataURI" in e:
                    e["BulkDataURI"]["uri"] = target
        n = first(elements, FRAMES)
        frames = [{"offset": o, "length": size} for o, size in frames_of(elements, whole, pixels)]
        own = crc32c_base64([whole[pixels[0] : pixels[1]]])[0] if pixels else None
        return (path, len(data), digest, *uids, pixels is not None, own, n if isinstance(n, int) else None, frames, json.dumps(elements), None)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [row(p, b"" if c is None else bytes(c)) for p, c in zip(part["path"], part["content"], strict=True)]
            yield pd.DataFrame(found, columns=list(COLUMNS), dtype=object)

    return files.select("path", "content").mapInPandas(rows, ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items()))
