"""What the text operators share: tables in the shared folder, chunking of texts, interned words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import TypeVar

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

T = TypeVar("T")

#: Characters of text that a Python worker holds as separate words at a time.
CHUNK_CHARS = 1_500_000
#: Distinct words that a worker keeps before it starts its table anew.
MAX_WORDS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes that go to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def write_shared(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and return it as read from there, with its path.

    This cuts the lineage: later stages survive the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    # what was shuffled for the table is of no use once it is written
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Have rows go to Python workers in batches of at most ``BATCH_ROWS`` and about ``BATCH_BYTES``.

    Settings of the session that are smaller already stay.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(re.sub("[^0-9-]", "", spark.conf.get(key)))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
    return spark


def drop_shared(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``write_shared`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shrink_heaps(spark: SparkSession) -> None:
    """Have the executors collect garbage, so that their JVMs give back the heap that shuffles made them take.

    A JVM keeps all that it ever took otherwise, beside the Python workers of the stage that follows. Two tasks
    for each core make it likely that every executor gets one; one that gets none keeps its heap.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    collected = spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done"))
    collected.write.format("noop").mode("overwrite").save()


#: Ids that are broadcast at most; with more, the other side is shuffled as well.
BROADCAST_IDS = 500_000


#: The column of row numbers by which the pipeline's stages tell rows apart, whatever their doc_id.
ROW = "voxelake_row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ROW``, a number of its own for each row.

    A table that has the column, as all written by the pipeline have, is taken as it is; any other is
    written with it first, so that a row keeps its number however often it is read.
    """
    return docs if ROW in docs.columns else write_shared(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")[0]


def without(docs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of numbered ``docs`` whose ``ROW`` is not among ``rows`` (``ROW``); that column stays if ``columns`` have it.

    The numbers are written and counted first: at most ``BROADCAST_IDS`` of them are broadcast. Columns of
    ``docs`` may have any other names. No ``rows`` leave all of ``docs``; null numbers match none.
    """
    gone, _ = write_shared(rows.select(F.col(ROW)).distinct(), "gone")
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    # joined by the column's name, so that no name of ``docs`` can be ambiguous
    kept = docs.join(gone, ROW, "left_anti").select(docs.columns)
    return kept if ROW in columns else kept.drop(ROW)


def smallest(docs: DataFrame, others: DataFrame, columns: list[str]) -> DataFrame:
    """One row of each group of numbered ``docs``: that of the smallest doc_id, null last, of equal ones the first.

    ``others`` (``ROW``, first) are the rows of groups of two and more, each with the number of one row
    that stands for the group and is not listed itself.
    """
    others, path = write_shared(others.select(ROW, "first"), "others")
    members = others.unionByName(others.select(F.col("first").alias(ROW), "first").distinct())
    ids = members.join(docs.select(ROW, "doc_id"), ROW)
    winners = ids.groupBy("first").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", ROW)).alias("one")).select(f"one.{ROW}")
    kept = without(docs, members.join(winners, ROW, "left_anti"), columns)
    drop_shared(docs.sparkSession, path)
    return kept


def chunks(texts: Iterable[str | bytes], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters together, at least one text each."""
    start = size = 0
    end = 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= limit:
            yield start, end
            start, size = end, 0
    if start < end:
        yield start, end


def segments(text: str, limit: int = CHUNK_CHARS, at: str = " ") -> Iterator[str]:
    """A text in pieces of ``limit`` characters or more that join to it, cut before an ``at`` or a run of them, never inside."""
    start = 0
    run = re.compile(f"(?<!{re.escape(at)}){re.escape(at)}")
    while len(text) - start > limit:
        cut = run.search(text, start + limit)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Interner(dict):
    """Numbers for words in the order they come; ``fresh`` lists those not yet taken up."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def take(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Answers:
    """Answers (of ``size`` bits) to questions (whole numbers below ``limit``) that ``ask`` gives, kept in a table.

    Each has a place of ``bits`` bits that its hash gives, where a later one takes the place of an earlier one.
    """

    def __init__(self, ask: Callable[[np.ndarray], np.ndarray], bits: int, size: int, limit: int) -> None:
        self.ask, self.bits, self.size = ask, bits, size
        # a question and its answer in one number
        self.held = np.full(1 << bits, -1, np.int32 if limit << size < 1 << 31 else np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        place = ((key.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.intp)
        held = self.held.take(place)
        found = held & ((1 << self.size) - 1)
        missed = np.flatnonzero(held >> self.size != key)
        if len(missed):
            fresh, at, back = np.unique(key[missed], return_index=True, return_inverse=True)
            answer = self.ask(fresh)
            self.held[place[missed[at]]] = fresh << self.size | answer
            found[missed] = answer[back]
        return found


class WordHashes:
    """64-bit hashes of words (bytes, or text as UTF-8), each distinct word hashed once while the table lasts."""

    def __init__(self, seed: int = 0) -> None:
        self.seed = seed
        self.reset()

    def reset(self) -> None:
        self.words, self.values, self.n = Interner(), np.empty(1 << 12, np.uint64), 0

    def take(self, words: list[bytes] | list[str]) -> np.ndarray:
        if len(self.words) > MAX_WORDS:
            self.reset()
        at = self.words.take(words)
        if fresh := self.words.fresh:
            new = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in fresh), np.uint64, len(fresh))
            if self.n + len(new) > len(self.values):
                self.values = np.concatenate([self.values[: self.n], np.empty(max(len(new), self.n), np.uint64)])
            self.values[self.n : self.n + len(new)] = new
            self.n += len(new)
            self.words.fresh = []
        return self.values[at]


_HELD: dict[str, object] = {}


def worker_table(key: str, make: Callable[[], T]) -> T:
    """A table that all tasks of a worker process share. A worker holds one: asking for another lets go of it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def forget_table() -> None:
    """Let go of the worker's table: for tasks that need none, in a process that has run others before."""
    _HELD.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of ``x``."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: Which bytes of a UTF-8 text stand between words: ASCII white space, or all of ASCII but letters and digits.
ASCII_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALPHANUMERIC = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_FACTOR = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2 ** 64
#: Bytes that are hashed at a time.
_STRETCH = 1 << 21


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd factor and of its inverse, modulo 2 ** 64."""
    inverse = pow(_FACTOR, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, f, np.uint64)])) for f in (_FACTOR, inverse))


def _stretch_hashes(data: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in some bytes: a polynomial in the bytes, by differences of one running sum."""
    inside = ~between[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    size = 1 << max(16, len(data).bit_length())
    power, inverse = powers(size)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
        hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts


def hashed_words(texts: list[bytes], between: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some UTF-8 texts in a row, ASCII capitals lowered, and how many each text has."""
    joined = b" ".join(texts).lower()
    data = np.frombuffer(joined, np.uint8)
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    at = 0
    while at < len(data):
        end = min(len(data), at + _STRETCH)
        if end < len(data):
            cut = np.flatnonzero(between[data[at:end]])
            # a word longer than a stretch is taken whole
            end = at + int(cut[-1]) + 1 if len(cut) else next((e for e in range(end, len(data)) if between[data[e]]), len(data))
        own, places = _stretch_hashes(data[at:end], between)
        hashes.append(own)
        starts.append(places + at)
        at = end
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
