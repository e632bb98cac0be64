"""Files on storage, local or remote: fetching, byte ranges, whole containers, extraction and deletion.

Paths and URIs go through Arrow's file systems, which know local folders, ``file://``, ``s3://``,
``gs://`` and ``hdfs://``; tasks open them by themselves, so nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import layout
from ..session import bounded_batches
from .containers import END_OF_CONTAINER, chunk

#: Bytes that are copied at a time.
PIECE = 8 << 20


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_bytes(uri: str, start: int = 0, stop: int | None = None) -> bytes:
    """A file's bytes from ``start`` up to ``stop``, or to its end."""
    files, path = located(uri)
    with files.open_input_file(path) as f:
        f.seek(start)
        return f.read() if stop is None else f.read(max(0, stop - start))


def write_bytes(uri: str, content: bytes) -> None:
    files, path = located(uri)
    files.create_dir(path.rpartition("/")[0] or ".", recursive=True)
    with files.open_output_stream(path) as f:
        f.write(content)


def fetched(rows: DataFrame, uri: str = "uri") -> DataFrame:
    """``rows`` with ``content`` and ``error``: the bytes of the file that each ``uri`` names.

    Members of archives, null URIs and files that can't be read have null content and an error, which
    does not stop the others.
    """
    bounded_batches(rows.sparkSession)
    schema = rows.withColumn("content", F.lit(None).cast("binary")).withColumn("error", F.lit(None).cast("string")).schema

    def one(uri: str | None) -> tuple[bytes | None, str | None]:
        if uri is None or ".tar://" in uri or ".zip://" in uri:
            return None, "no file of its own"
        try:
            return read_bytes(uri), None
        except (OSError, ValueError) as error:
            return None, f"{type(error).__name__}: {error}"

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (whole.iloc[k : k + 1] for whole in parts for k in range(len(whole))):
            content, error = one(part[uri].iloc[0])
            yield part.assign(content=[content], error=[error])

    return rows.mapInPandas(read, schema)


def read_members(index: DataFrame) -> DataFrame:
    """``index`` (tar_uri, start_byte, end_byte exclusive) with ``content``, read by byte range from the containers."""
    bounded_batches(index.sparkSession)
    schema = index.withColumn("content", F.lit(None).cast("binary")).schema

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (whole.iloc[k : k + 1] for whole in parts for k in range(len(whole))):
            row = part.iloc[0]
            yield part.assign(content=[read_bytes(row["tar_uri"], int(row["start_byte"]), int(row["end_byte"]))])

    return index.mapInPandas(read, schema)


def _store_container(uri: str, members: Iterator[tuple[str, bytes]], kept: int) -> int:
    """Write a container of ``kept`` bytes of the one that is there and new members; its bytes.

    It is written beside the old one and moved over it, so a task that fails or runs twice leaves a whole one.
    """
    files, path = located(uri)
    files.create_dir(path.rpartition("/")[0] or ".", recursive=True)
    fresh = f"{path}.part"
    with files.open_output_stream(fresh) as out:
        if kept:
            with files.open_input_file(path) as old:
                while kept > old.tell():
                    out.write(old.read(min(PIECE, kept - old.tell())))
        for uid, content in members:
            out.write(chunk(uid, content))
        out.write(END_OF_CONTAINER)
        size = out.tell()
    files.move(fresh, path)
    return size


def write_containers(instances: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Create or extend the containers of the series of ``instances`` (series_uri, instance_uid, seq, content).

    Each series' container, ``<series_uri>.tar``, gets its instances in order of seq; where ``stored``
    (series_uri, end_byte) says what it holds already, that is kept in front. Returns the index, one row
    an instance: series_uri, instance_uid, seq, size, tar_uri, uri, start_byte, end_byte (exclusive). Null
    content counts as empty. A container is written by one task, which holds one instance at a time.

    The index is what is to be kept (as a table, or by ``write_index``); call an action once.
    """
    bounded_batches(instances.sparkSession)
    rows = instances.select("series_uri", "instance_uid", "seq", F.coalesce("content", F.lit(b"")).alias("content"))
    held = None if stored is None else stored.groupBy("series_uri").agg(F.max("end_byte").alias("held"))
    rows = rows.withColumn("held", F.lit(0).cast("long")) if held is None else rows.join(held, "series_uri", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    ordered = rows.repartition("series_uri").sortWithinPartitions("series_uri", "seq", "instance_uid")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single = ((row.series_uri, row.instance_uid, int(row.seq), bytes(row.content), int(row.held)) for part in parts for row in part.itertuples(index=False))
        ahead = next(single, None)
        while ahead is not None:
            series, found = ahead[0], []
            kept = -(-ahead[4] // 512) * 512

            def members(series: str = series, found: list = found, kept: int = kept) -> Iterator[tuple[str, bytes]]:
                nonlocal ahead
                at = kept
                while ahead is not None and ahead[0] == series:
                    _, uid, seq, content, _ = ahead
                    start = at + layout.HEADER
                    found.append((series, uid, seq, len(content), f"{series}.tar", f"{series}.tar://instances/{uid}.dcm", start, start + len(content)))
                    at = -(-(start + len(content)) // 512) * 512
                    yield uid, content
                    ahead = next(single, None)

            _store_container(f"{series}.tar", members(), kept)
            yield pd.DataFrame(found, columns=["series_uri", "instance_uid", "seq", "size", "tar_uri", "uri", "start_byte", "end_byte"])

    return ordered.mapInPandas(write, "series_uri string, instance_uid string, seq long, size long, tar_uri string, uri string, start_byte long, end_byte long")


def keep_members(index: DataFrame, keep: DataFrame) -> DataFrame:
    """Write the containers of ``index`` anew with the members in ``keep`` (series_uri, instance_uid) only; the new index.

    Members are read by byte range from the old containers before any new one is written. Series that
    keep nothing are not touched.
    """
    kept = index.join(keep.select("series_uri", "instance_uid").distinct(), ["series_uri", "instance_uid"], "left_semi")
    return write_containers(read_members(kept).select("series_uri", "instance_uid", "seq", "content"))


def write_documents(documents: DataFrame, compressed: bool = False) -> DataFrame:
    """Write each of ``documents`` (uri, value) to its URI, by gzip if ``compressed``; uri and bytes of each."""
    rows = documents.select("uri", (S.gzipped("value") if compressed else F.col("value").cast("binary")).alias("content"))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                write_bytes(row.uri, bytes(row.content))
            yield pd.DataFrame({"uri": part["uri"], "bytes": part["content"].map(len)})

    return rows.mapInPandas(write, "uri string, bytes long")


def series_metadata(documents: DataFrame, series: DataFrame) -> DataFrame:
    """The document (series_uri, value) of each of ``series`` (series_uri); one that has none gets a new one without instances.

    The new one says ``found`` false.
    """
    there = documents.select("series_uri", "value", F.lit(True).alias("_there"))
    at = S.parse_store_uri(F.col("series_uri"))
    empty = F.to_json(F.struct(at["study"].alias("study_uid"), at["series"].alias("series_uid"), F.struct(F.struct().alias("instances")).alias("cod")))
    return series.select("series_uri").join(there, "series_uri", "left").select("series_uri", F.coalesce("value", empty).alias("value"), F.coalesce("_there", F.lit(False)).alias("found"))


def repointed(uri: Column, old: Column, new: Column) -> Column:
    """A URI below ``old`` as one below ``new``; others stay."""
    return F.when(uri.startswith(old), F.concat(new, F.substr(uri, F.length(old) + 1))).otherwise(uri)


def pull(index: DataFrame, store: str, folder: str) -> DataFrame:
    """Copy the containers of ``index`` (tar_uri, uri) below ``store`` to ``folder``; the index with both URIs pointing there."""
    copies = index.select("tar_uri").distinct().withColumn("to", repointed(F.col("tar_uri"), F.lit(store), F.lit(folder)))

    def copy(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                (a, source), (b, target) = located(row.tar_uri), located(row.to)
                b.create_dir(target.rpartition("/")[0] or ".", recursive=True)
                with a.open_input_stream(source) as old, b.open_output_stream(target) as new:
                    while data := old.read(PIECE):
                        new.write(data)
            yield part

    done = copies.mapInPandas(copy, "tar_uri string, to string")
    pointed = index.join(done, "tar_uri").withColumn("uri", repointed(F.col("uri"), F.lit(store), F.lit(folder)))
    return pointed.withColumn("tar_uri", F.col("to")).drop("to").select(index.columns)


def extract(index: DataFrame, folder: str) -> DataFrame:
    """Write the members of ``index`` to files of their own in ``folder``; the index with ``uri`` pointing there."""
    files = read_members(index)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            targets = [f"{folder}/{uid}.dcm" for uid in part["instance_uid"]]
            for target, content in zip(targets, part["content"], strict=True):
                write_bytes(target, bytes(content))
            yield part.drop(columns="content").assign(uri=targets)

    return files.mapInPandas(write, index.schema)


def delete_files(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """Delete the files of a plan (uri, action) whose action is delete: uri and ``deleted``.

    With ``dry_run``, which is the default, it only says which would be. A file that is gone is not an error.
    """

    def delete(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for uri in part["uri"]:
                files, path = located(uri)
                there = files.get_file_info(path).type == fs.FileType.File
                if there and not dry_run:
                    files.delete_file(path)
                done.append(there)
            yield pd.DataFrame({"uri": part["uri"], "deleted": done})

    return plan.filter("action = 'delete'").select("uri").distinct().mapInPandas(delete, "uri string, deleted boolean")


def files_below(prefix: str) -> list[str]:
    """All files below a prefix, as URIs or paths like it."""
    files, path = located(prefix)
    found = files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(prefix.rstrip("/") + f.path[len(path.rstrip("/")) :] for f in found if f.type == fs.FileType.File)


def delete_below(prefixes: list[str], dry_run: bool = True) -> list[str]:
    """Delete all that lies below some prefixes; the files that were there. With ``dry_run``, the default, nothing goes."""
    gone = [uri for prefix in prefixes for uri in files_below(prefix)]
    if not dry_run:
        for uri in gone:
            files, path = located(uri)
            files.delete_file(path)
    return gone


def series_of_study(store: str, study: str) -> str:
    """The least series that has a container or a folder below a study; ``FileNotFoundError`` if there is none."""
    files, path = located(f"{store}/studies/{study}/series")
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = sorted({f.base_name.removesuffix(".tar") for f in found if f.type == fs.FileType.Directory or f.base_name.endswith(".tar")})
    if not names:
        raise FileNotFoundError(f"no series of study {study} in {store}")
    return names[0]
