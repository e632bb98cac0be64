"""SentencePiece BPE encoding and decoding by suffix-array matching and relaxation.

A text is turned into the model's form (a space becomes the mark U+2581, one mark goes before it) and
cut before each run of marks: no piece reaches over such a cut. A batch's distinct cuts, its *units*,
are joined into one text, and then

1. the joined text is indexed by a suffix array (to the depth of the longest piece);
2. every piece is binary-searched for its range of the array: its occurrences, the *edges*;
3. the edges are sorted by the position where they end;
4. positions are relaxed in that order: an edge from ``a`` to ``b`` with piece ``t`` is taken if the
   encoding of the unit up to ``a`` ends with a piece ``u`` such that merging never crosses the seam
   of ``u`` and ``t``. Exactly one edge into a position passes, and the path back from a unit's end
   is the encoding that merging in order of score gives.

A character without a piece of its own becomes byte pieces. Decoding joins pieces, gathers byte pieces
into characters, turns marks into spaces and drops the first.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_WORDS, Answers, Interner, bounded_batches, chunks, flat_ranges, segments, table, text_of, worker_table

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Characters of distinct units that are indexed at a time, each with some 250 bytes of edges.
INDEX_CHARS = 64_000
#: Bits of the places of pairs of pieces whose seams were looked at.
ASKED_BITS = 20
_UNITS = re.compile(" +[^ ]*")


class Pieces:
    """A model's pieces, and for each the borders of the merges that make it."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        self.ids = {self.text[i]: i for i in plain}
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        #: Equal scores share a rank; the leftmost merge goes first among them.
        self.rank = np.full(n, 1 << 30, np.int64)
        scores: dict[float, int] = {}
        for i in order:
            self.rank[i] = scores.setdefault(model.get_score(i), len(scores))
        self.plain = np.array(plain)
        self.length = np.array([len(t) for t in self.text])
        self._pairs()
        self._seams(n)
        #: Of pairs asked for, the key of ``u`` and ``t`` as in ``_pairs``.
        self.verdicts = Answers(lambda key: self.compatible(key // n, key % n), ASKED_BITS, 1, n * n)

    def _pairs(self) -> None:
        """Sorted keys of all pairs of pieces that merge into a piece, and the piece's rank."""
        keys, ranks = [], []
        n = len(self.text)
        for text, i in self.ids.items():
            for cut in range(1, len(text)):
                a, b = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(self.rank[i])
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys)[order], np.array(ranks)[order]

    def merges(self, text: str) -> list[tuple[int, int, int]]:
        """The merges that encode ``text`` makes, in order: (left position, rank, merged piece)."""
        at: dict[int, tuple[int, str]] = {i: (i + 1, c) for i, c in enumerate(text)}
        before = {i + 1: i for i in range(len(text))}
        queue: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b, left = at[a]
            if b in at and (piece := self.ids.get(left + at[b][1])) is not None:
                heapq.heappush(queue, (int(self.rank[piece]), a, at[b][0], piece))

        for i in range(len(text) - 1):
            offer(i)
        done = []
        while queue:
            rank, a, end, piece = heapq.heappop(queue)
            if a not in at or at[a][0] not in at or at[at[a][0]][0] != end or at[a][1] + at[at[a][0]][1] != self.text[piece]:
                continue
            del at[at[a][0]]
            at[a] = (end, self.text[piece])
            before[end] = a
            done.append((a, rank, piece))
            if end in at:
                offer(a)
            if a in before and before[a] in at and at[before[a]][0] == a:
                offer(before[a])
        return done

    def _seams(self, n: int) -> None:
        """For each piece the pieces that stand at its left and right border while it is merged.

        ``*_piece[i, k]`` stands there from time ``*_time[i, k]`` until time ``*_time[i, k + 1]``. A
        merge's time is the largest rank of its unit's merges so far.
        """
        depth = int(self.length[self.plain].max()) + 1
        self.left_piece, self.right_piece = np.full((n, depth), -1, np.int64), np.full((n, depth), -1, np.int64)
        self.left_time, self.right_time = np.full((n, depth + 1), 1 << 40, np.int64), np.full((n, depth + 1), 1 << 40, np.int64)
        self.usable = np.zeros(n, bool)
        for i in self.plain:
            text = self.text[i]
            done = self.merges(text)
            left, right, time = [(-1, self.ids.get(text[0], -1))], [(-1, self.ids.get(text[-1], -1))], -1
            for a, rank, piece in done:
                time = max(time, rank)
                if a == 0:
                    left.append((time, piece))
                if a + len(self.text[piece]) == len(text):
                    right.append((time, piece))
            self.usable[i] = left[-1][1] == i
            for k, (time, piece) in enumerate(left):
                self.left_piece[i, k], self.left_time[i, k] = piece, time
            for k, (time, piece) in enumerate(right):
                self.right_piece[i, k], self.right_time[i, k] = piece, time

    def compatible(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether merging the characters of ``u`` and ``t`` together never crosses their seam."""
        good = np.ones(len(u), bool)
        live = np.arange(len(u))
        i, j = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        n = len(self.text)
        while len(live):
            a, b = u[live], t[live]
            x, y = self.right_piece[a, i], self.left_piece[b, j]
            since = np.maximum(self.right_time[a, i], self.left_time[b, j])
            end_x, end_y = self.right_time[a, i + 1], self.left_time[b, j + 1]
            key = x * n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merge = np.where((self.pair_keys[at] == key) & (x >= 0) & (y >= 0), np.maximum(self.pair_ranks[at], since), 1 << 41)
            # of equal ranks the leftmost goes first: u's own merge before the seam's, the seam's before t's
            crossed = (merge < end_x) & (merge <= end_y) & (merge < 1 << 41)
            good[live[crossed]] = False
            on = ~crossed & ((end_x < 1 << 40) | (end_y < 1 << 40))
            first = end_x <= end_y
            i, j, live = (i + first)[on], (j + ~first)[on], live[on]
        return good

    def fits(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """``compatible`` by the table of pairs asked before."""
        return self.verdicts(u * len(self.text) + t).astype(bool)


@cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _bits(n: int) -> int:
    """Bits of the numbers from 0 to ``n`` and of one that is larger, in whole bytes."""
    return 8 if n < 255 else 16 if n < 65535 else 32


class Words:
    """Words as keys of ``64 // bits`` characters: the least and the largest that suffixes beginning with a word have.

    ``grid`` has the numbers (below 2 ** bits - 1) of a word's characters in each row, which zeros follow; rows ascend.
    """

    def __init__(self, grid: np.ndarray, bits: int) -> None:
        per_key = 64 // bits
        self.bits, self.lengths = bits, (grid > 0).sum(1)
        self.n_keys = -(-grid.shape[1] // per_key)
        self.low, self.high = [], []
        for k in range(self.n_keys):
            low, high = np.zeros(len(grid), np.uint64), np.zeros(len(grid), np.uint64)
            for c in range(k * per_key, (k + 1) * per_key):
                own = (grid[:, c] if c < grid.shape[1] else np.zeros(len(grid), np.int64)).astype(np.uint64)
                low, high = (low << np.uint64(bits)) | own, (high << np.uint64(bits)) | np.where(own > 0, own, np.uint64((1 << bits) - 1))
            self.low.append(low)
            self.high.append(high)


class SuffixIndex:
    """A suffix array of texts joined by separators, sorted to the depth of some words; ``numbers`` are below 2 ** bits - 1."""

    def __init__(self, numbers: np.ndarray, words: Words) -> None:
        self.words = words
        self.per_key = 64 // words.bits
        n = len(numbers)
        key = np.zeros(n + self.per_key * (words.n_keys + 1), np.uint64)
        key[:n] = numbers
        # of one character, of two, of four ... up to a key's
        width = 1
        while width < self.per_key:
            key = (key[:-width] << np.uint64(words.bits * width)) | key[width:]
            width *= 2
        self.order = np.argsort(key[:n])
        self.keys = [key[:n][self.order]]
        # those with equal keys so far are put in order by the next
        tied = np.concatenate([[False], self.keys[0][1:] == self.keys[0][:-1], [False]])
        for k in range(1, words.n_keys):
            own = np.flatnonzero(tied[1:] | tied[:-1])
            self.order[own] = self.order[own[np.lexsort((key[self.order[own] + k * self.per_key], np.cumsum(~tied[:-1])[own]))]]
            self.keys.append(key[self.order + k * self.per_key])
            tied[1:-1] &= self.keys[k][1:] == self.keys[k][:-1]

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word the range of the array where suffixes begin with it."""
        words = self.words
        # words ascend, so that one's search looks where the one before it looked
        lo, hi = np.searchsorted(self.keys[0], words.low[0], "left"), np.zeros(len(words.lengths), np.int64)
        on = np.flatnonzero(self.keys[0][np.minimum(lo, len(self.order) - 1)] <= words.high[0])
        hi[on] = np.searchsorted(self.keys[0], words.high[0][on], "right")
        hi = np.maximum(hi, lo)
        for k in range(1, words.n_keys):
            on = np.flatnonzero((lo < hi) & (words.lengths > k * self.per_key))
            a, b = (self._search(self.keys[k], lo[on], hi[on], value[k][on], after) for value, after in ((words.low, False), (words.high, True)))
            lo[on], hi[on] = a, np.maximum(a, b)
        return lo, hi

    @staticmethod
    def _search(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of each value within its own sorted range."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            here = keys[np.minimum(mid, len(keys) - 1)]
            right = open_ & ((here <= value) if after else (here < value))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo


class Encoder:
    """Encodes texts into ids; distinct units are matched once while the table lasts."""

    def __init__(self, path: str) -> None:
        self.pieces = pieces_of(path)
        p = self.pieces
        searched = p.plain[p.usable[p.plain]]
        codes = [np.array(list(map(ord, p.text[i])), np.int64) for i in searched]
        #: Characters of pieces, in order, have numbers from 1; all others 0, as no piece holds them.
        characters = np.unique(np.concatenate(codes))
        self.number = np.zeros(0x110000, np.int32)
        self.number[characters] = np.arange(1, len(characters) + 1)
        grid = np.zeros((len(codes), max(map(len, codes))), np.int32)
        for row, own in zip(grid, codes, strict=True):
            row[: len(own)] = self.number[own]
        order = np.lexsort(grid.T[::-1])
        self.all, self.grid = searched[order], grid[order]
        self.is_piece = np.zeros(len(characters) + 1, bool)
        self.is_piece[self.grid[self.grid[:, 1] == 0, 0]] = True
        self.width = np.append(p.length, 1)  # the last of a character without a piece (-1)
        self.present = np.zeros(len(characters) + 1, bool)
        self._search_for(self.present)
        self._reset()

    def _reset(self) -> None:
        self.units = Interner()
        self.ids, self.n_ids = np.empty(1 << 14, np.int32), 0
        self.starts, self.counts, self.n = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0
        self.asked = np.zeros(1 << 12, np.int32)

    def _forget(self) -> None:
        """Keep the units that were met twice or more, half of ``MAX_WORDS`` at most, and let go of the others."""
        words, asked = list(self.units), self.asked[: self.n]
        kept = np.flatnonzero(asked > 1)
        if len(kept) > MAX_WORDS // 2:
            kept = np.sort(kept[np.argsort(-asked[kept], kind="stable")[: MAX_WORDS // 2]])
        ids, counts, asked = self.ids[flat_ranges(self.starts[kept], self.counts[kept])], self.counts[kept], asked[kept] // 2
        self._reset()
        self.units.update((words[i], k) for k, i in enumerate(kept.tolist()))
        self._add(ids, counts)
        self.asked[: self.n] = asked

    def _search_for(self, present: np.ndarray) -> None:
        """Set up the keys of the pieces whose characters (by number) are all ``present``."""
        self.present = present.copy()
        self.present[0] = False
        self.local = np.cumsum(self.present) * self.present
        inside = self.present.copy()
        inside[0] = True
        own = inside[self.grid].all(1)
        self.searched, self.words = self.all[own], Words(self.local[self.grid[own]], _bits(int(self.present.sum())))

    def _index(self, numbers: np.ndarray) -> SuffixIndex:
        """The index of some characters. The keys of pieces stay while no others come; few characters have shorter keys."""
        present = np.bincount(numbers, minlength=len(self.present)) > 0
        present[0] = False
        if (present & ~self.present).any():
            both = present | self.present
            self._search_for(both if _bits(int(both.sum())) == _bits(int(present.sum())) else present)
        return SuffixIndex(self.local[numbers], self.words)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many belong to each. Units are in the model's form, not empty."""
        p = self.pieces
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        numbers = self.number[codes]
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        index = self._index(numbers)
        lo, hi = index.ranges()
        begin = index.order[flat_ranges(lo, hi - lo)]
        piece = np.repeat(self.searched, hi - lo)
        unit = np.repeat(np.arange(len(units)), lengths + 1)  # of every position, separators included
        # a character without a piece: an edge that nothing merges with
        lost = ~self.is_piece[numbers]
        lost[starts + lengths] = False
        alone = np.flatnonzero(lost)
        begin, piece = np.concatenate([begin, alone]), np.concatenate([piece, np.full(len(alone), -1)])
        local = begin - starts[unit[begin]] + self.width[piece]
        longest = int(lengths.max(initial=0))
        if longest < 1 << 16:
            local = local.astype(np.uint16)  # sorted by its digits
        order = np.argsort(local, kind="stable")
        begin, piece = begin[order], piece[order]
        end = begin + self.width[piece]
        last = np.full(len(unit) + 1, -3, np.int64)  # -3: not reached, -2: a unit's start, -1: a character without a piece
        last[starts] = -2
        step = np.concatenate([[0], np.cumsum(np.bincount(local, minlength=longest + 1)[1:])])
        for a, b in zip(step.tolist(), step[1:].tolist(), strict=False):
            before, t = last[begin[a:b]], piece[a:b]
            fine = before > -3
            check = np.flatnonzero((before >= 0) & (t >= 0))
            fine[check] = p.fits(before[check], t[check])
            last[end[a:b][fine]] = t[fine]
        # back from every unit's end, all units in step
        chosen = np.full(len(unit), -3, np.int64)
        at, first = (starts + lengths)[lengths > 0], starts[lengths > 0]
        while len(at):
            t = last[at]
            at = at - self.width[t]
            chosen[at] = t
            on = at > first
            at, first = at[on], first[on]
        place = np.flatnonzero(chosen > -3)
        owner, ids = unit[place], chosen[place]
        if (ids == -1).any():
            owner, ids = self._as_bytes(owner, ids, codes[place])
        return ids.astype(np.int32), np.bincount(owner, minlength=len(units))

    def _as_bytes(self, owner: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lost = np.flatnonzero(ids < 0)
        spelt = [[self.pieces.byte_ids[b] for b in chr(c).encode("utf-8", "replace")] for c in codes[lost].tolist()]
        times = np.ones(len(ids), np.int64)
        times[lost] = list(map(len, spelt))
        out = np.repeat(ids, times)
        out[flat_ranges((np.cumsum(times) - times)[lost], times[lost])] = [i for s in spelt for i in s]
        return np.repeat(owner, times), out

    def _learn(self, fresh: list[str]) -> None:
        for a, b in chunks(fresh, INDEX_CHARS):
            self._add(*self.encode_units([u.replace(" ", MARK) for u in fresh[a:b]]))

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Take up the ids of units that follow those held."""
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.empty(max(len(ids), self.n_ids), np.int32)])
        if self.n + len(counts) > len(self.counts):
            more = max(len(counts), self.n)
            self.counts, self.starts, self.asked = (np.concatenate([x[: self.n], np.zeros(more, x.dtype)]) for x in (self.counts, self.starts, self.asked))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.counts[self.n : self.n + len(counts)] = counts
        self.starts[self.n : self.n + len(counts)] = self.n_ids + np.cumsum(counts) - counts
        self.n_ids += len(ids)
        self.n += len(counts)

    def _take(self, units: list[str]) -> np.ndarray:
        at = self.units.take(units)
        if self.units.fresh:
            fresh, self.units.fresh = self.units.fresh, []
            self._learn(fresh)
        self.asked[: self.n] += np.bincount(at, minlength=self.n).astype(np.int32)
        return at

    def __call__(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.empty(0, np.int32)
        found = []
        for part in segments(" " + text.replace(MARK, " ")):
            if len(self.units) > 4 * MAX_WORDS:
                self._forget()
            at = self._take(_UNITS.findall(part))
            found.append(self.ids[flat_ranges(self.starts[at], self.counts[at])])
        return found[0] if len(found) == 1 else np.concatenate(found)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of several texts, whose units are split once and share an index. A text by itself goes in segments."""
        if len(self.units) > MAX_WORDS:
            self._forget()
        if len(texts) == 1:
            return [self(texts[0])]
        split = [_UNITS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        at = self._take([u for us in split for u in us])
        row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, split), np.int64, len(split)))
        counts = self.counts[at]
        ends = np.cumsum(np.bincount(row, counts, len(texts)).astype(np.int64))
        return np.split(self.ids[flat_ranges(self.starts[at], counts)], ends[:-1]) if len(texts) else []


class Decoder:
    """Turns ids back into text."""

    def __init__(self, path: str) -> None:
        p = pieces_of(path)
        self.bytes = p.bytes
        self.table = np.array(["" if i in p.control else t.replace(MARK, " ") for i, t in enumerate(p.text)], object)
        self.is_byte = np.zeros(len(p.text), bool)
        self.is_byte[list(p.bytes)] = True

    def __call__(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        parts = self.table[ids]
        spelt = self.is_byte[ids]
        if spelt.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], spelt.view(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                parts[a] = bytes(self.bytes[i] for i in ids[a:b].tolist()).decode("utf-8", "replace")
                parts[a + 1 : b] = ""
        text = "".join(parts.tolist())
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, path: str = f"{TOKENIZERS}/{MODEL}", with_ids: bool = True) -> DataFrame:
    """Ids of every row of ``docs`` (doc_id, text).

    Returns doc_id, n_tokens, ids (array<int>; left out without ``with_ids``), ids_crc32 (unsigned,
    of the ids as little-endian unsigned 32-bit integers), round_trip (whether decoding the ids gives
    the text, with marks as spaces, back).

    A null text counts as empty: no ids. Repeated rows are encoded each; an empty table gives no
    rows; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker_table(f"pieces {path}", lambda: Encoder(path)), Decoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids = encoder.batch(texts[a:b])
                columns = {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    "round_trip": pa.array([decoder(x) == t.replace(MARK, " ") for x, t in zip(ids, texts[a:b], strict=True)], pa.bool_()),
                }
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
                yield pa.RecordBatch.from_pydict(columns)

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(rows, schema)


def decode(encoded: DataFrame, path: str = f"{TOKENIZERS}/{MODEL}") -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids); null ids give an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for batch in batches:
            texts = [decoder(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(rows, f"doc_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
