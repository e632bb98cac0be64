"""Suffix-array dedup: removal of bytes in strings of ``LENGTH`` bytes that start in two places.

Places where a ``LENGTH``-byte string starts are *windows*. Sorting all suffixes of a corpus to that
depth would move every byte many times, so windows are first dealt into buckets by content: the
*anchor* of a window is the leftmost of its ``GRAM``-byte strings with the least hash, and the windows
of one anchor follow each other; together they cover the anchor's *context*. Equal windows have equal
anchors at equal places, so they fall into one bucket, named by the anchor's string.

1. Anchors of all documents are found, with hashes of string and context.
2. A context that occurs twice as a whole makes all its windows repeats; this settles exact copies and
   the inside of long repeats by counting, however large the group.
3. Buckets with two or more different contexts are sorted: one representative of each context goes to
   the bucket, and the bucket's suffixes (the starts of windows) are sorted blockwise: the ranks of a
   difference-cover sample of a block's text are computed first, then one bucket of suffixes at a time
   is sorted by its first ``PERIOD`` bytes, and longer ties are resolved by the sample's ranks at the
   offset that both suffixes reach. Neighbours in that order that agree on ``LENGTH`` bytes repeat.
   A bucket whose contexts have more than ``BLOCK_BYTES`` is not sorted but dealt out again, its contexts
   taken as documents and anchored by another hash: the shorter contexts that come of it are mostly
   alone or settled by counting. After ``LEVELS`` hashes what is left is sorted as it is.
4. Repeated windows go back to the documents, where the bytes they cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, drop_shared, flat_ranges, mixed, table, text_of, write_shared

LENGTH = 200
GRAM = 32
#: A difference cover modulo 31: every difference is that of two of its members (a fixed value).
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of contexts after which a block is sorted; a bucket of more is dealt out again by another hash.
BLOCK_BYTES = 1_000_000
#: Hashes by which buckets are dealt out, one after the other.
LEVELS = 3
#: Bytes of text that are taken up at a time.
TAKE = 600_000
_FACTOR = 0x9E3779B97F4A7C55


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size``-byte string (a power of two) at each place where one fits."""
    h = mixed(data.astype(np.uint64) + np.uint64(1))
    factor, width = _FACTOR, 1
    with np.errstate(over="ignore"):
        while width < size:
            h = h[:-width] * np.uint64(factor) + h[width:]
            factor, width = factor * factor & 0xFFFFFFFFFFFFFFFF, width * 2
    return h


def _sums(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums that give a polynomial hash of any stretch, and the inverse powers."""
    factor = (_FACTOR + 2 * seed * 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF | 1
    n = len(data)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, factor, np.uint64)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(factor, -1, 1 << 64), np.uint64)]))
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(data.astype(np.uint64) + np.uint64(seed)) * power[:n])]), inverse


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, level: int = 0) -> tuple[np.ndarray, ...]:
    """Text number, first window, windows, place, string hash and context hash of all anchors.

    Windows and places are byte positions in the text. Texts shorter than ``length`` have none.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    starts = np.cumsum(sizes) - sizes
    hashes = _gram_hashes(data, gram)
    if level:
        hashes = mixed(hashes + np.uint64(level))
    keys = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    place = (_sliding_least(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of every window
    window = np.arange(len(place))
    text = np.repeat(np.arange(len(texts)), sizes)[: len(window)]
    fits = window + length <= (starts + sizes)[text]
    window, place, text = window[fits], place[fits], text[fits]
    if not len(window):
        return none, none, none, none, none, none
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    w, p, t = window[first], place[first], text[first]
    context = np.zeros(len(w), np.uint64)
    for seed in (1, 2):
        sums, inverse = _sums(data, seed)
        with np.errstate(over="ignore"):
            context ^= mixed((sums[w + count - 1 + length] - sums[w]) * inverse[w] + np.uint64(seed)) * np.uint64(2 * seed - 1)
    # where the anchor lies in its context counts as well
    context = mixed(context ^ ((p - w).astype(np.uint64) << np.uint64(32)) ^ count.astype(np.uint64))
    return t, w - starts[t], count, p - starts[t], hashes[p].view(np.int64), context.view(np.int64)


# ---- blockwise suffix sorting -------------------------------------------------------------------


def _difference_table() -> np.ndarray:
    """For residues a, b the least offset d with a + d and b + d both in the cover (modulo ``PERIOD``)."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if inside[(a + d) % PERIOD] and inside[(b + d) % PERIOD])
    return out


OFFSETS = _difference_table()


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number, zeros after the end."""
    key = np.concatenate([data, np.zeros(2 * PERIOD + 16, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        key = (key[:-width] << np.uint64(8 * width)) | key[width:]
    return key


def _packed(eights: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The ``PERIOD`` bytes from each place as four keys, first key first."""
    return [eights[at], eights[at + 8], eights[at + 16], eights[at + 24] >> np.uint64(8)]


def _named(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows of keys, equal for equal rows."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for key in keys:
        own = key[order]
        step[1:] |= own[1:] != own[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


class CoverRanks:
    """Ranks of the suffixes of a text that start at places of the difference cover."""

    def __init__(self, eights: np.ndarray, n: int) -> None:
        inside = np.zeros(PERIOD, bool)
        inside[list(COVER)] = True
        sample = np.flatnonzero(inside[np.arange(n) % PERIOD])
        self.rank = np.full(n + 2 * PERIOD, -1, np.int64)
        self.rank[sample] = _named(_packed(eights, sample))
        known = PERIOD
        # a sample place and the one ``known`` bytes on (of the same residue) together give twice the depth
        while known < n and len(sample) and self.rank[sample].max() + 1 < len(sample):
            self.rank[sample] = _named([self.rank[sample], self.rank[np.minimum(sample + known, len(self.rank) - 1)] + 1])
            known *= 2


def suffix_order(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places ``at`` in the order of the suffixes there.

    One bucket (of suffixes that begin with the same byte) is sorted at a time.
    """
    eights = _eights(data)
    ranks = CoverRanks(eights, len(data))
    lead = data[at]
    by_bucket = at[np.argsort(lead, kind="stable")]
    bounds = np.append(np.flatnonzero(np.diff(np.sort(lead).astype(np.int64), prepend=-1)), len(at))
    return np.concatenate([np.empty(0, np.int64), *(_sort_bucket(eights, ranks, by_bucket[a:b]) for a, b in zip(bounds, bounds[1:], strict=False))])


def _sort_bucket(eights: np.ndarray, ranks: CoverRanks, at: np.ndarray) -> np.ndarray:
    if len(at) < 2:
        return at
    head = _named(_packed(eights, at))
    at = at[np.argsort(head, kind="stable")]
    head = np.sort(head)
    # ties: merge ever longer runs within groups of one head, comparing by the sample's ranks
    group = np.flatnonzero(np.diff(head, prepend=-1))
    size = np.diff(np.append(group, len(at)))
    tied = size > 1
    if not tied.any():
        return at
    start, size = group[tied], size[tied]
    rows = flat_ranges(start, size)  # places in ``at`` of all tied suffixes
    begin, end = np.repeat(start, size), np.repeat(start + size, size)
    local = rows - begin
    width = 1
    while (size > width).any():
        run = local // width
        mate = begin + (run ^ 1) * width
        low, high = np.minimum(mate, end), np.minimum(mate + width, end)
        mine = at[rows]
        lo, hi = low.copy(), high.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            other = at[np.minimum(mid, len(at) - 1)]
            d = OFFSETS[mine % PERIOD, other % PERIOD]
            x, y = ranks.rank[mine + d], ranks.rank[other + d]
            after = open_ & (y < x)
            lo = np.where(after, mid + 1, lo)
            hi = np.where(open_ & ~after, mid, hi)
        to = begin + (run >> 1) * 2 * width + (local - run * width) + (lo - low)
        at[to] = mine
        width *= 2
    return at


def repeated_windows(contexts: list[bytes], windows: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context which of its first ``windows`` places start a string that another context has too."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    at = flat_ranges(starts, windows)
    order = suffix_order(data, at)
    sums, inverse = _sums(data, 3)
    with np.errstate(over="ignore"):
        name = (sums[order + length] - sums[order]) * inverse[order]
    same = name[1:] == name[:-1]
    check = np.flatnonzero(same)
    eights = _eights(data)
    for k in [*range(0, length - 7, 8), length - 8]:  # and byte by byte
        same[check] &= eights[order[check] + k] == eights[order[check + 1] + k]
    flag = np.zeros(len(data) + 1, bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return [flag[s : s + w] for s, w in zip(starts.tolist(), windows.tolist(), strict=True)]


# ---- Spark --------------------------------------------------------------------------------------


def _anchor_rows(docs: DataFrame, length: int, gram: int, level: int) -> DataFrame:
    """row_id, first, windows, gram, context of all anchors of ``docs`` (row_id, scope, data); those of other scopes never meet."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scopes, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a, b in chunks(texts, TAKE):
                text, first, count, _, name, context = anchors(texts[a:b], length, gram, level)
                if len(text):
                    name = name ^ scopes[a:b][text]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][text]), pa.array(first), pa.array(count), pa.array(name), pa.array(context)], ["row_id", "first", "windows", "gram", "context"])

    return docs.mapInArrow(rows, "row_id long, first long, windows long, gram long, context long")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """gram, context, windows and bytes of the ``wanted`` (row_id, first, windows, gram, context)."""
    listed = wanted.groupBy("row_id").agg(F.collect_list(F.struct("first", "windows", "gram", "context")).alias("cuts"))
    return docs.join(listed, "row_id").select("data", F.inline("cuts")).select("gram", "context", "windows", F.expr(f"substring(data, CAST(first + 1 AS INT), CAST(windows + {length - 1} AS INT))").alias("bytes"))


def _sorted_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """gram, context, at (0), windows and flags (one byte a window, 1: it repeats) of contexts that share a window with another."""
    ordered = contexts.repartition("gram").sortWithinPartitions("gram")

    def block(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        # equal windows have equal grams: contexts of other grams in the block can't match, and don't harm
        flags = repeated_windows([h[3] for h in held], np.array([h[2] for h in held]), length)
        some = [k for k, f in enumerate(flags) if f.any()]
        if some:
            numbers = [pa.array(c, pa.int64()) for c in zip(*((held[k][0], held[k][1], 0, held[k][2]) for k in some), strict=True)]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array([flags[k].astype(np.uint8).tobytes() for k in some], pa.binary())], ["gram", "context", "at", "windows", "flags"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield from block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from block(held)

    return ordered.mapInArrow(rows, "gram long, context long, at long, windows long, flags binary")


def _hits(docs: DataFrame, length: int, gram: int, level: int = 0) -> tuple[DataFrame, list[str]]:
    """row_id, first, windows, flags (null: all of them) of places in ``docs`` (row_id, scope, data) whose windows repeat.

    With the paths of the tables that it reads.
    """
    spark = docs.sparkSession
    found, found_path = write_shared(_anchor_rows(docs, length, gram, level), "suffix-anchors")
    counted = found.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "first", "windows")).alias("one"))
    several = counted.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("places"), F.sum(F.col("one.windows") + (length - 1)).alias("bytes")).filter("places > 1")
    repeated, repeated_path = write_shared(counted.join(several, "gram").select("gram", "context", "n", "contexts", "bytes", "one.*"), "suffix-repeated")
    # a context that occurs once can share windows with others only; one that occurs twice is settled
    wanted = repeated.filter("contexts > 1").select("row_id", "first", "windows", "gram", "context", "bytes")
    large = F.col("bytes") > (BLOCK_BYTES if level < LEVELS - 1 else 1 << 62)
    flags = _sorted_buckets(_contexts(docs, wanted.filter(~large), length), length)
    again = []
    if not wanted.filter(large).isEmpty():
        parts = _contexts(docs, wanted.filter(large), length).select(F.monotonically_increasing_id().alias("row_id"), F.col("gram").alias("scope"), "context", F.col("bytes").alias("data"))
        parts, parts_path = write_shared(parts, "suffix-parts")
        inner, paths = _hits(parts.select("row_id", "scope", "data"), length, gram, level + 1)
        inner = inner.join(parts.select("row_id", F.col("scope").alias("gram"), "context"), "row_id")
        flags = flags.unionByName(inner.select("gram", "context", F.col("first").alias("at"), "windows", "flags"))
        again += [parts_path, *paths]
    settled = repeated.filter("n > 1").select("gram", "context", F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("windows"), F.lit(None).cast("binary").alias("flags"))
    partial = flags.join(repeated.filter("n = 1").select("gram", "context"), ["gram", "context"], "left_semi").select("gram", "context", "at", "windows", "flags")
    marks, marks_path = write_shared(settled.unionByName(partial), "suffix-marks")
    drop_shared(spark, repeated_path, *again)
    marks = marks.withColumnRenamed("windows", "some")
    hits = found.join(marks, ["gram", "context"]).select("row_id", (F.col("first") + F.col("at")).alias("first"), F.coalesce("some", "windows").alias("windows"), "flags")
    return hits, [found_path, marks_path]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """What is left of ``docs`` (doc_id, text) without bytes of repeated strings.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for,
    spans (array of [start, end) in bytes) and kept (binary). Every byte that a ``length``-byte string
    covers which also starts anywhere else goes, in all its places; strings lie within one document
    and are judged on the input.

    A null text counts as empty. Rows that repeat, with a doc_id or without, are documents of their
    own. A very long text is anchored as a whole, so its size bounds a task's memory from below. An
    empty table gives no rows; other columns are not read.
    """
    spark = bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # a number for every row, so that repeated and null ids do no harm; kept in the shared folder since it isn't stable
    numbered, numbered_path = write_shared(docs.select("doc_id", text_of().cast("binary").alias("data")).withColumn("row_id", F.monotonically_increasing_id()), "suffix-docs")
    hits, paths = _hits(numbered.select("row_id", F.lit(0).cast("long").alias("scope"), "data"), length, gram)
    per_row = hits.groupBy("row_id").agg(F.collect_list(F.struct("first", "windows", "flags")).alias("hits"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, hits_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                starts = np.zeros(len(data) + 1, np.int64)
                for hit in hits_ or ():
                    at = hit["first"] + (np.arange(hit["windows"]) if hit["flags"] is None else np.flatnonzero(np.frombuffer(hit["flags"], np.uint8)))
                    starts[at] = 1
                # a byte is covered if one of the ``length`` places up to it starts a repeated string
                sums = np.concatenate([[0], np.cumsum(starts[:-1])])
                covered = sums[1:] > sums[np.maximum(np.arange(1, len(data) + 1) - length, 0)]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).view(np.int8)))
                kept = data if not len(edge) else np.frombuffer(data, np.uint8)[~covered].tobytes()
                out.append((len(data), int(covered.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge, kept))
            columns = {"doc_id": batch.column(0)}
            columns |= {name: pa.array([o[k] for o in out], t) for k, (name, t) in enumerate((("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())))}
            if with_text:
                columns["spans"] = pa.array([o[4].reshape(-1, 2).tolist() for o in out], pa.list_(pa.list_(pa.int64())))
                columns["kept"] = pa.array([o[5] for o in out], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<bigint>>, kept binary" * with_text
    result, _ = write_shared(numbered.join(per_row, "row_id", "left").select("doc_id", "data", "hits").mapInArrow(rows, schema), "suffix-result")
    drop_shared(spark, numbered_path, *paths)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), with_text=False)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_slice(b, i + 1, i + 200)) AS name FROM (SELECT doc_id, b, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)
), repeated AS (
  SELECT doc_id, i FROM windows JOIN (SELECT name FROM windows GROUP BY name HAVING count(*) > 1) USING (name)
), runs AS (
  SELECT doc_id, min(i) AS first, max(i) + 200 AS stop FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
      SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM repeated)
  ) GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, first, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY first), 0) AS before FROM runs
), cut AS (
  SELECT doc_id, CAST(sum(stop - first) AS BIGINT) AS n_removed, count(*) AS n_spans, max(stop) AS last,
         string_agg(CASE WHEN first > before THEN hex(array_slice(b, before + 1, first)) ELSE '' END, '' ORDER BY first) AS kept
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || CASE WHEN n > coalesce(last, 0) THEN hex(array_slice(b, coalesce(last, 0) + 1, n)) ELSE '' END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
