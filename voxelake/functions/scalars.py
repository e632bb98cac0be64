"""Column-to-column functions: identifiers, URIs, hints, checksums, byte windows."""

from __future__ import annotations

import base64
import gzip
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UID = r"^[0-9]+(\.[0-9]+)*$"
#: Fixed value: least length of study and series identifiers.
MIN_UID_LENGTH = 10
REMOTE = ("http", "s3://", "gs://")


def valid_uid(uid: Column) -> Column:
    """Dotted numerals; null is not valid."""
    return F.coalesce(uid.rlike(UID), F.lit(False))


def long_enough(uid: Column) -> Column:
    return F.coalesce(F.length(uid) >= MIN_UID_LENGTH, F.lit(False))


def is_remote(uri: Column) -> Column:
    return F.coalesce(uri.rlike("^(http|s3://|gs://)"), F.lit(False))


def is_nested(uri: Column) -> Column:
    """Whether the URI names a member of an archive."""
    return F.coalesce(uri.contains(".tar://") | uri.contains(".zip://"), F.lit(False))


def after(uri: Column, mark: str) -> Column:
    """The path segment after the first ``mark``; null if there is none."""
    rest = F.substr(uri, F.instr(uri, mark) + F.lit(len(mark)))
    return F.when(uri.contains(mark), F.substring_index(rest, "/", 1))


def basename(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def without_tar(name: Column) -> Column:
    return F.regexp_replace(name, r"\.tar$", "")


def bucket_and_key(uri: Column) -> tuple[Column, Column]:
    return F.nullif(F.regexp_extract(uri, "^[a-z0-9]+://([^/]+)", 1), F.lit("")), F.nullif(F.regexp_extract(uri, "^[a-z0-9]+://[^/]+/(.*)$", 1), F.lit(""))


def member_of(uri: Column) -> tuple[Column, Column]:
    """Container and member of ``<container>.tar://<member>``."""
    nested = uri.contains(".tar://")
    return F.when(nested, F.concat(F.substring_index(uri, ".tar://", 1), F.lit(".tar"))), F.when(nested, F.substring_index(uri, ".tar://", -1))


def series_uri(store: Column, study: Column, series: Column) -> Column:
    return F.concat_ws("/", store, F.lit("studies"), study, F.lit("series"), series)


def tar_uri(series: Column) -> Column:
    """The container of a series."""
    return F.concat(series, F.lit(".tar"))


def metadata_uri(series: Column) -> Column:
    return F.concat(series, F.lit("/metadata.json"))


def index_uri(series: Column) -> Column:
    return F.concat(series, F.lit("/index.sqlite"))


def error_log_uri(series: Column) -> Column:
    return F.concat(series, F.lit("/error.log"))


def member_uri(series: Column, instance: Column) -> Column:
    """An instance in the container of its series."""
    return F.concat(tar_uri(series), F.lit("://instances/"), instance, F.lit(".dcm"))


def parse_store_uri(uri: Column) -> Column:
    """store, study and series of a URI of a series, its container or one of its files; null unless the URI is remote and has them."""
    rest = F.substring_index(F.substr(uri, F.instr(uri, "/studies/") + F.lit(len("/studies/"))), "/series/", -1)
    valid = is_remote(uri) & uri.rlike("/studies/.*/series/")
    parts = F.struct(
        F.substring_index(uri, "/studies/", 1).alias("store"),
        F.regexp_extract(uri, "/studies/(.*?)/series/", 1).alias("study"),
        without_tar(F.substring_index(F.substring_index(rest, "://", 1), "/", 1)).alias("series"),
    )
    return F.when(valid, parts)


class UidHashMissing(ValueError):
    """Hashed identifiers were asked for without a function that hashes them, or the other way round."""


def uid(value: Column, hash_uid: Callable[[Column], Column] | None = None, hashed: bool = False) -> Column:
    """An identifier as it is, or hashed by the given function (column to column)."""
    if not hashed:
        return value
    if hash_uid is None:
        raise UidHashMissing("hashed identifiers need a function that hashes them")
    return hash_uid(value)


def next_uid(uid: Column) -> Column:
    """The example de-identification: one more in the last component."""
    parts = F.split(uid, r"\.")
    last = (F.element_at(parts, -1).cast("decimal(38,0)") + 1).cast("decimal(38,0)").cast("string")
    return F.concat_ws(".", F.slice(parts, 1, F.size(parts) - 1), last)


def trusted(hint: Column, actual: Column, trust: bool = True) -> Column:
    """The hint if hints are trusted and it is there, else what is known."""
    return F.coalesce(hint, actual) if trust else actual


def hint_fault(**pairs: tuple[Column, Column]) -> Column:
    """The first hint, in the order given, that differs from what is true; null if none does."""
    fault = F.lit(None).cast("string")
    for name, (hint, true) in reversed(pairs.items()):
        fault = F.when(hint.isNotNull() & ~hint.eqNullSafe(true), F.lit(name)).otherwise(fault)
    return fault


def padded512(size: Column) -> Column:
    return F.ceil(size / F.lit(512)).cast("bigint") * 512


def find(text: Column, pattern: str) -> Column:
    """0-based place of the first occurrence, -1 if there is none."""
    return (F.instr(text, pattern) - 1).cast("bigint")


def find_bytes(content: Column, pattern: bytes) -> Column:
    """0-based place of the first occurrence of some bytes in binary content, -1 if there is none; null for null."""

    @F.pandas_udf(T.LongType())
    def place(content: pd.Series) -> pd.Series:
        return content.map(lambda x: None if x is None else bytes(x).find(pattern)).astype("Int64")

    return place(content)


def byte_window(content: Column, start: Column, stop: Column) -> Column:
    """Bytes [start, stop) of binary content."""
    return F.substr(content, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))


def uint32_le(content: Column, at: Column) -> Column:
    """The little-endian unsigned number in the four bytes from ``at`` (0-based)."""
    return F.conv(turned(F.hex(F.substr(content, (at + 1).cast("int"), F.lit(4)))), 16, 10).cast("bigint")


def turned(hex8: Column) -> Column:
    """Eight hexadecimal digits with their four bytes in reverse order."""
    return F.concat(*(F.substring(hex8, k, 2) for k in (7, 5, 3, 1)))


@cache
def _castagnoli() -> np.ndarray:
    """The byte table of the reflected Castagnoli polynomial, from its rule."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


#: Bytes of a content that are read in step with those of others.
_LANE = 512


@cache
def _zeros(power: int) -> np.ndarray:
    """Tables (4 x 256) of what ``2 ** power`` zero bytes make of a checksum's register, by its bytes."""
    if power:
        before = _zeros(power - 1)
        basis = _after_zeros(before, _after_zeros(before, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    else:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        basis = _castagnoli()[bits & 0xFF] ^ (bits >> np.uint32(8))
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(np.arange(256) >> bit & 1, basis[8 * k + bit], 0).astype(np.uint32)
    return out


def _after_zeros(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 0xFF] ^ tables[1][state >> 8 & 0xFF] ^ tables[2][state >> 16 & 0xFF] ^ tables[3][state >> 24]


def crc32c_base64(contents: list[bytes]) -> list[str]:
    """Base64 of the big-endian CRC-32C of each content.

    A checksum is linear in the bytes, so contents are cut into blocks of one size (zeros in front change
    nothing) that all go byte by byte in step; neighbours are then combined, what stands before a block
    being moved on by as many zero bytes as the block has.
    """
    if not contents:
        return []
    table = _castagnoli()
    sizes = np.array([len(c) for c in contents], np.int64)
    counts = np.maximum(1, -(-sizes // _LANE))
    flat = np.zeros(int(counts.sum()) * _LANE, np.uint8)
    for end, content in zip((np.cumsum(counts) * _LANE).tolist(), contents, strict=True):
        flat[end - len(content) : end] = np.frombuffer(content, np.uint8)
    blocks = np.ascontiguousarray(flat.reshape(-1, _LANE).T)
    state = np.zeros(blocks.shape[1], np.uint32)
    for row in blocks:
        state = table[(state ^ row) & 0xFF] ^ (state >> np.uint32(8))
    power = _LANE.bit_length() - 1
    while counts.max() > 1:
        starts = np.cumsum(counts) - counts
        state = np.insert(state, starts[counts % 2 == 1], 0).reshape(-1, 2)
        state = _after_zeros(_zeros(power), state[:, 0]) ^ state[:, 1]
        counts, power = (counts + 1) // 2, power + 1
    begin = np.full(len(contents), 0xFFFFFFFF, np.uint32)
    for power in range(int(sizes.max()).bit_length()):
        begin = np.where(sizes >> power & 1, _after_zeros(_zeros(power), begin), begin)
    return [base64.b64encode(x.to_bytes(4, "big")).decode() for x in (state ^ begin ^ np.uint32(0xFFFFFFFF)).tolist()]


@F.pandas_udf(T.StringType())
def crc32c(content: pd.Series) -> pd.Series:
    """CRC-32C of binary content as base64; null for null."""
    known = content.notna()
    out = pd.Series([None] * len(content), dtype=object)
    out[known.to_numpy()] = crc32c_base64(content[known].tolist())
    return out


@F.pandas_udf(T.BinaryType())
def gzipped(text: pd.Series) -> pd.Series:
    """A text as UTF-8, compressed by gzip without a time, so that equal texts give equal bytes; null for null."""
    return text.map(lambda x: None if x is None else gzip.compress(x.encode(), mtime=0))


@F.pandas_udf(T.StringType())
def gunzipped(content: pd.Series) -> pd.Series:
    """What ``gzipped`` was given."""
    return content.map(lambda x: None if x is None else gzip.decompress(bytes(x)).decode())
