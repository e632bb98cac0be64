"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items are read as words (ASCII capitals lowered, words of letters and digits).
A *mask* looks at ``weight`` of the words in a window of ``span`` and ignores the others, so that a
replaced word at an ignored place leaves the hash unchanged. Hashes of all windows of the items,
under all masks, are matched with those of the documents. A hit says where the two would lie side
by side; there, and only there, all words are compared. Any stretch counts that has enough equal
words and in which they are a large enough share.

The masks alone do not reach every such stretch. Its replaced words cut it into runs of equal words,
though, of which the longest cannot be short: all windows of so many words, a number that hangs on
the item's length, are seeds as well. For items shorter than the masks they are the only ones.

Where a text and items share a long passage, every window of it is a hit of the same places side by
side. A window whose items all have one and the same window before it, which the text has before it as
well, adds none and is passed over; and of places for one text and item only those are compared word by
word that can still give more equal words than the best so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_ALPHANUMERIC, ROW, bounded_batches, chunks, flat_ranges, hashed_words, numbered, table, text_of, without, worker_table

#: Masks over a window of words: 1 is compared, 0 ignored. Wherever two of thirteen words in a row are
#: replaced, some window under some mask is left whole (a test tries all places).
MASKS = ("1110110011", "110101111", "110011111", "10101101011")
#: Words that must be equal in a stretch.
MIN_WORDS = 13
#: Of items too short for that, the share of words that must be equal.
SHORT_SHARE = 0.85
#: Items of fewer words match nothing: a name or a phrase of everyday use would mark every text that has it.
MIN_ITEM_WORDS = 5
#: The share of a stretch's words that must be equal.
MIN_IDENTITY = 0.8
#: Bytes of text that are taken up at a time: what is held of them fits a processor's cache.
TAKE = 600_000
#: Benchmarks of at most so many words go to every task as a whole; larger ones are joined in parts of that size.
PART_WORDS = 2_000_000
#: Hits, and words of hits, that are looked at together.
BLOCK = 1_000_000
#: Bits of a hash that tables of presence are indexed by, at most.
SEEN_BITS = 24


def mask_places(mask: str) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(mask.encode(), np.uint8) == ord("1"))


def window_hashes(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash under ``mask`` of every window of a row of word hashes."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15 + salt, np.uint64)
    with np.errstate(over="ignore"):
        for k in mask_places(mask).tolist():
            out = (out ^ hashes[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(32)
    return out


def words_needed(length: int, min_words: int = MIN_WORDS) -> int:
    """Words of an item of ``length`` words that must be equal in a stretch."""
    return int(min(min_words, np.ceil(SHORT_SHARE * length)))


@cache
def sure_words(length: int, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> int:
    """So many equal words stand in a row in every stretch that counts, of an item of ``length`` words."""
    share = Fraction(str(min_identity))
    replaced = lambda n: min(length - n, int(n * (1 - share) / share) if share else length)
    return min(-(-n // (replaced(n) + 1)) for n in range(max(1, words_needed(length, min_words)), length + 1))


class SeedIndex:
    """All windows of a benchmark's items under all masks, looked up by hash."""

    def __init__(self, items: list[tuple[object, str]], masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, min_item_words: int = MIN_ITEM_WORDS) -> None:
        self.masks, self.share = masks, Fraction(str(min_identity))
        hashes, counts = hashed_words([(text or "").encode("utf-8", "surrogatepass") for _, text in items], NOT_ALPHANUMERIC)
        rows = [(item_id, x) for (item_id, _), x in zip(items, np.split(hashes, np.cumsum(counts)[:-1]), strict=False) if len(x) >= max(1, min_item_words)]
        self.item_ids, self.items = [i for i, _ in rows], [x for _, x in rows]
        self.seeds: list[tuple[int, str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.lengths = np.fromiter(map(len, self.items), np.int64, len(self.items))
        self.firsts, self.words = np.cumsum(self.lengths) - self.lengths, np.concatenate([np.empty(0, np.uint64), *self.items])
        self.needed = np.array([words_needed(n, min_words) for n in self.lengths.tolist()], np.int64)
        sure = [sure_words(n, min_words, min_identity) for n in self.lengths.tolist()]
        for salt, mask in enumerate([*masks, *("1" * n for n in sorted(set(sure)))]):
            whole = salt >= len(masks)
            rows = [(window_hashes(x, mask, salt), i) for i, x in enumerate(self.items) if (sure[i] == len(mask) if whole else len(x) >= len(mask))]
            if not rows:
                continue
            keys = np.concatenate([h for h, _ in rows])
            item = np.repeat([i for _, i in rows], [len(h) for h, _ in rows])
            place = np.concatenate([np.arange(len(h)) for h, _ in rows])
            order = np.argsort(keys, kind="stable")
            before = np.concatenate([[np.uint64(0)], keys[:-1]])[order]
            keys, place = keys[order], place[order]
            # of each key: whether all of its windows have a window before them, and the same
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            one = (np.minimum.reduceat(before, starts) == np.maximum.reduceat(before, starts)) & (np.minimum.reduceat(place, starts) > 0)
            one = np.repeat(one, np.diff(np.append(starts, len(keys))))
            bits = max(16, min(SEEN_BITS, int(len(keys)).bit_length() + 6))
            seen = np.zeros(1 << bits, bool)
            seen[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.seeds.append((salt, mask, keys, np.where(one, before, 0), item[order], place, seen, one))

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, offset of the item's first word in the text, equal words in all), distinct, of seed hits with enough equal words."""
        wide = len(hashes) + int(self.lengths.max(initial=0)) + 1
        known, equal = np.empty(0, np.int64), np.empty(0, np.int64)
        for salt, mask, keys, before, item, place, seen, one in self.seeds:
            own = window_hashes(hashes, mask, salt)
            bits = len(seen).bit_length() - 1
            near = np.flatnonzero(seen[(own >> np.uint64(64 - bits)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, own[near], "left"), np.searchsorted(keys, own[near], "right")
            near, lo, hi = (x[hi > lo] for x in (near, lo, hi))
            fresh = ~(one[lo] & (near > 0) & (own[near - 1] == before[lo]))
            near, lo, hi = near[fresh], lo[fresh], hi[fresh]
            for a, b in blocks(hi - lo):
                n = (hi - lo)[a:b]
                at = flat_ranges(lo[a:b], n)
                both = np.unique(item[at] * (2 * wide) + np.repeat(near[a:b], n) - place[at] + wide)
                both = both[~np.isin(both, known)]
                count = self._equal(hashes, both // (2 * wide), both % (2 * wide) - wide)
                keep = count >= self.needed[both // (2 * wide)]
                known, equal = np.concatenate([known, both[keep]]), np.concatenate([equal, count[keep]])
        return known // (2 * wide), known % (2 * wide) - wide, equal

    def _equal(self, hashes: np.ndarray, item: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """How many words of an item, laid at an offset, are equal in all."""
        out = np.zeros(len(item), np.int64)
        for a, b in blocks(self.lengths[item]):
            n = self.lengths[item[a:b]]
            at = flat_ranges(offset[a:b], n)
            equal = (at >= 0) & (at < len(hashes)) & (hashes[at.clip(0, len(hashes) - 1)] == self.words[flat_ranges(self.firsts[item[a:b]], n)])
            out[a:b] = np.add.reduceat(equal.astype(np.int64), np.cumsum(n) - n)
        return out

    def overlaps(self, hashes: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """By document and item: first word, end word, first word in the item, equal words of the best verified stretch.

        ``starts`` are the places where documents begin in ``hashes``, with its length at the end. Of
        stretches with as many equal words that with the least first word stays, then that with the
        least first word in the item.
        """
        item, offset, equal = self.hits(hashes)
        # the documents that an item lies over, of which there can be several
        low = np.searchsorted(starts, np.maximum(offset, 0), "right") - 1
        high = np.minimum(np.searchsorted(starts, offset + self.lengths[item], "left"), len(starts) - 1)
        n = np.maximum(high - low, 0)
        doc = flat_ranges(low, n)
        item, offset, equal = (np.repeat(x, n) for x in (item, offset, equal))
        order = np.lexsort((offset, -equal, item, doc))
        doc, item, offset, equal = (x[order] for x in (doc, item, offset, equal))
        cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), [True]])) if len(doc) else np.zeros(1, np.int64)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for first, end in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            d, i, kept = int(doc[first]), int(item[first]), None
            own, begin, stop = self.items[i], int(starts[d]), int(starts[d + 1])
            for row in range(first, end):
                o, most = int(offset[row]), int(equal[row])
                a, b = max(o, begin), min(o + len(own), stop)
                # neither this nor any later place can have more equal words, or as many and a lesser first word
                if kept and (kept[3] > most or kept[3] == most and kept[0] < a - begin):
                    break
                for x, y, count in stretches(hashes[a:b] == own[a - o : b - o], int(self.needed[i]), self.share):
                    found = (a + x - begin, a + y - begin, a + x - o, count)
                    if not kept or (-found[3], found[0], found[2]) < (-kept[3], kept[0], kept[2]):
                        kept = best[d, i] = found
        return best


def blocks(sizes: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive places whose ``sizes`` add up to about ``limit``, one place at least."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def stretches(equal: np.ndarray, needed: int, share: Fraction) -> list[tuple[int, int, int]]:
    """(first, end, equal words) of stretches with ``needed`` equal words or more that are ``share`` of all, or more.

    The one of the most equal words comes first, then those of the words before it and after it.
    """
    at = np.flatnonzero(equal)
    out, open_ = [], [(0, len(at))]
    # from the i-th to the j-th equal word the share holds if score[j] - score[i] >= num - den
    score = share.denominator * np.arange(len(at)) - share.numerator * at
    while open_:
        a, b = open_.pop()
        if b - a < max(1, needed):
            continue
        own = score[a:b]
        begin = np.searchsorted(-np.minimum.accumulate(own), share.numerator - share.denominator - own, "left")
        count = np.arange(b - a) - begin + 1
        j = int(np.argmax(count))
        if count[j] >= needed:
            first, last = a + int(begin[j]), a + j
            out.append((int(at[first]), int(at[last]) + 1, int(count[j])))
            open_ += [(last + 1, b), (a, first)]
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, part_words: int = PART_WORDS, min_item_words: int = MIN_ITEM_WORDS
) -> DataFrame:
    """Overlaps of ``docs`` (doc_id, text) with items of ``benchmark`` (item_id, text).

    Returns one row for each document and item that overlap: doc_id, item_id, first_word and end_word
    (the place among the document's words of the stretch of the most equal words), item_word (its first
    word in the item), n_equal (its equal words). Documents without an overlap have no row.

    The benchmark is cut into parts of at most ``part_words`` words (or one item, if that is longer);
    documents pass once for each part, so that a task's memory stays bounded for any benchmark. A
    worker sets up the hashes of a part once and joins those of its documents with them.

    Null texts count as empty and overlap with nothing; items of fewer than ``min_item_words`` words,
    and those without any, match nothing; very long texts are read whole; repeated rows are judged
    each; empty tables give no rows; other columns are not read.
    """
    spark = bounded_batches(docs.sparkSession)
    sized = benchmark.select("item_id", text_of().alias("text"))
    words = sized.select(F.sum(F.char_length("text") / 2 + 1)).first()[0] or 0
    parts = max(1, int(-(-words // part_words)))
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_no long, first_word long, end_word long, item_word long, n_equal long"
    result = None
    for part in range(parts):
        items = sized.filter(key == part).orderBy("item_id", "text").toArrow()
        held = spark.sparkContext.broadcast(items.column("text").to_pylist())
        name = f"seeds {uuid.uuid4().hex}"

        def rows(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            index = worker_table(name, lambda: SeedIndex(list(enumerate(held.value)), min_words=min_words, min_identity=min_identity, min_item_words=min_item_words))
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in chunks(texts, TAKE):
                    hashes, counts = hashed_words(texts[a:b], NOT_ALPHANUMERIC)
                    best = index.overlaps(hashes, np.concatenate([[0], np.cumsum(counts)]))
                    if best:
                        at = pa.array([a + doc for doc, _ in best])
                        columns = [[index.item_ids[i] for _, i in best], *([v[k] for v in best.values()] for k in range(4))]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "item_no", "first_word", "end_word", "item_word", "n_equal"])

        found = docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(rows, schema)
        # as an Arrow table: rows from a list would start Python workers of another kind on every executor, which stay
        named = pa.table([pa.array(range(items.num_rows), pa.int64()), items.column("item_id")], ["item_no", "item_id"])
        names = spark.createDataFrame(named, f"item_no long, item_id {benchmark.schema['item_id'].dataType.simpleString()}")
        # names of one part's items, of which there are no more than its words
        found = found.join(F.broadcast(names), "item_no").drop("item_no")
        result = found if result is None else result.unionByName(found)
    return result.select("doc_id", "item_id", "first_word", "end_word", "item_word", "n_equal")


def clean_rows(docs: DataFrame, benchmark: DataFrame, min_item_words: int = MIN_ITEM_WORDS) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with their columns; each by its own text, whatever its doc_id.

    Null and empty texts stay, repeated rows are judged each, and an empty benchmark keeps every row.
    """
    rows = numbered(docs)
    found = decontaminate(rows.select(F.col(ROW).alias("doc_id"), "text"), benchmark, min_item_words=min_item_words)
    return without(rows, found.select(F.col("doc_id").alias(ROW)), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)
), iw AS (
  SELECT item_id, needed, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS q FROM (
    SELECT item_id, ws, least(13, ceil(0.85 * len(ws))) AS needed FROM (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
    WHERE len(ws) >= 5)
), equal AS (
  SELECT doc_id, item_id, needed, p - q AS diagonal, p, q FROM dw JOIN iw USING (word)
), near AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS k FROM equal
  QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, diagonal) >= needed
), stretches AS (
  SELECT a.doc_id, a.item_id, a.p AS first_word, b.p + 1 AS end_word, a.q AS item_word, b.k - a.k + 1 AS n_equal
  FROM near a JOIN near b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.diagonal = b.diagonal AND b.k >= a.k
  WHERE b.k - a.k + 1 >= a.needed AND 10 * (b.k - a.k + 1) >= 8 * (b.p - a.p + 1)
)
SELECT doc_id, item_id, first_word, end_word, item_word, n_equal FROM stretches
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, first_word, item_word) = 1
"""
