"""Containers: windows over files, members of tar archives, and their packing."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_batches

#: Fixed value: what stands at byte 128 of an instance file.
MAGIC = b"DICM"


def read_files(spark: SparkSession, path: str, only_instances: bool = True) -> DataFrame:
    """path, length and content of files; those without the magic bytes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    return files.filter(F.substring("content", 129, 4) == F.lit(MAGIC)) if only_instances else files


def members(files: DataFrame) -> DataFrame:
    """uri, start_byte, end_byte (exclusive) and content of the members of tar ``files`` (path, content)."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    out += [(f"{path}://{m.name}", m.offset_data, m.offset_data + m.size, content[m.offset_data : m.offset_data + m.size]) for m in tar if m.isfile()]
            yield pd.DataFrame(out, columns=["uri", "start_byte", "end_byte", "content"])

    bounded_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(rows, "uri string, start_byte long, end_byte long, content binary")


def chunks(instances: DataFrame) -> DataFrame:
    """``instances`` (instance_uid, content) with ``chunk``: header and padded payload of the member in a container.

    The chunks of a series in order, and two empty blocks, are its container; where each payload begins is
    what ``layout.container_offsets`` says. Each chunk is made by itself, so no series lies in one task.
    """
    bounded_batches(instances.sparkSession)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(chunk=[chunk(u, b"" if c is None else bytes(c)) for u, c in zip(part["instance_uid"], part["content"], strict=True)])

    return instances.mapInPandas(rows, T.StructType([*instances.schema.fields, T.StructField("chunk", T.BinaryType())]))


#: Two empty blocks at the end of a container.
END_OF_CONTAINER = bytes(2 * tarfile.BLOCKSIZE)


def chunk(uid: str, payload: bytes) -> bytes:
    """One member: extended header, header, payload and padding; the headers take 1536 bytes."""
    info = tarfile.TarInfo(f"instances/{uid}.dcm")
    info.size = len(payload)
    head = info.create_pax_header({**info.get_info(), "mtime": 0.5}, "utf-8")
    return head + payload + bytes(-len(payload) % tarfile.BLOCKSIZE)


class Window(io.RawIOBase):
    """A read-only view of the bytes [start, stop) of a seekable file."""

    def __init__(self, master: io.IOBase, start: int, stop: int) -> None:
        self.master, self.start, self.stop = master, start, stop
        self.seek(0)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def writable(self) -> bool:
        return False

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        base = {io.SEEK_SET: 0, io.SEEK_CUR: getattr(self, "at", 0), io.SEEK_END: self.stop - self.start}[whence]
        self.at = max(0, min(base + offset, self.stop - self.start))
        return self.at

    def read(self, size: int = -1) -> bytes:
        left = self.stop - self.start - self.at
        size = left if size is None or size < 0 else min(size, left)
        self.master.seek(self.start + self.at)
        data = self.master.read(size)
        self.at += len(data)
        return data
