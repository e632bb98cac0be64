"""Token ids in compressed binary files: an adaptive context-mixing range coder.

Format of a *segment* (little-endian; one binary value of the written table, a file of its own)::

    magic "VXTK", u8 version, u32 documents, u64 ids, u32 blocks, u32 file, u64 ids before, u32 names
    names: the documents' doc_ids, an Arrow stream of one column compressed by zlib
    u32 ids of each document
    for each block: u32 ids, u32 lanes, u32 payload bytes, u32 crc32 of the block's ids, payload

"file" is the number of the range of doc_ids that the segment belongs to, "ids before" counts the ids of
that range's segments before it. A block is reset independently: it is decoded without any other. Its
ids are dealt over lanes of consecutive ids that are coded in step, each by a range coder of its own and
all by one model, so that every step of the model is one vector operation over the lanes. A payload
holds the lanes' byte counts, then their bytes.

The model predicts an id from the two before it (order 2), from the one before it (order 1) and from
how often ids came (order 0), and mixes the three predictions into one distribution: an id's interval
is as wide as its order-0 share of the width that is left to order 0, and wider by order 2's and by
order 1's weight if they predict it. The weights follow how often such predictions held so far, at
the candidates' counts and their agreement. An id is coded in one interval of that mixture. All of the
model is whole numbers, updated after every step in coder and decoder alike; where lanes write to one
place of a table the largest value stays, so the outcome hangs on no order of writing.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Answers, bounded_batches, chunks, flat_ranges, mixed, table, text_of, worker_table, write_shared

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "word_bpe_49k.json"
#: Lists of ids that a worker keeps before it starts its table anew, and bits of the table's places.
TABLE_LISTS, TABLE_BITS = 1_500_000, 22
#: Bytes of text that are taken up at a time: what is held of them fits a processor's cache.
STRETCH = 1 << 18
#: Bytes of text whose new words are taken up together.
TAKE = 3_000_000
#: Punctuation that the vocabulary splits from letters before it.
_MARKS = b".,;:!?"
_PUNCTUATION = np.isin(np.arange(256), list(_MARKS))
#: The second bytes of the letters from U+00C0 to U+00FF (the first is 0xC3), which no normal form changes.
_LATIN = np.array([0x80 <= c <= 0xBF and c not in (0x97, 0xB7) for c in range(256)])
#: Kinds of the bytes of words that are merged here: spaces between, digits, letters, and punctuation.
_BETWEEN, _DIGIT = 0, 1
_KIND = np.array([_BETWEEN if c == 0x20 else _DIGIT if 0x30 <= c <= 0x39 else 2 if c >= 128 or chr(c).isalpha() else 3 for c in range(256)], np.int8)
#: What each count of a word's bytes leaves of eight, and a factor of words' hashes. Longer words are hashed one by one.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTOR, _FOLD = np.uint64(0x9FB21C651E98DF25), np.uint64(32)
HASHED = 64
#: What the vocabulary's tokens at the end of a run of letters, of punctuation or of a digit end with.
WORD_END = "</w>"
#: Words that are merged here: of letters whose lower case and normal form are plain, digits, and ASCII punctuation but
#: the apostrophe (``_PLAIN``, with the space after a word); of at most ``MERGED`` bytes, without the beginning of a token
#: that stands for itself.
_PLAIN = np.array([0x20 <= c <= 0x7E and c != 0x27 for c in range(256)])
MERGED = 32
#: Bits of the places of pairs whose ranks were looked up.
RANK_BITS = 18
#: Widths of the grids that runs are merged in, and runs of a grid at most.
GRIDS, GRID_ROWS = (4, 8, 12, 16, MERGED), 1 << 14
#: A character that is a token of its own, which no text without it holds.
MARK = "\x01"
#: Units that go to the library in one text.
JOINED = 500
#: The id after each document.
END_ID = 2
MAGIC, VERSION = b"VXTK", 2
HEAD = struct.Struct("<4sBIQIIQI")
BLOCK = struct.Struct("<IIII")
#: Ids of a block and lanes that it is dealt over, at most, and ids of a lane at least.
BLOCK_IDS, LANES, LANE_IDS = 1 << 21, 1 << 12, 256
#: Ids of a segment after which no further document is added.
SEGMENT_IDS = 1 << 21
#: Bytes of the input that one task writes.
TASK_BYTES = 64 << 20


# ---- model -------------------------------------------------------------------------------------

#: The width of all intervals, and of the order-0 distribution before it is scaled to what is left to it.
TOTAL_BITS, ORDER0_BITS = 26, 20
#: What order 0 keeps at least, so that every id's scaled interval is 1 wide or more.
ORDER0_LEAST = 1 << ORDER0_BITS
#: Entries of the order-2 table, a power of two.
ORDER2 = 1 << 20
#: Steps after which order-0 frequencies are summed anew, and the weights.
ORDER0_STEPS, WEIGHT_STEPS = 32, 4
#: Steps after which the counts behind the weights lose a part (a shift).
FADE_STEPS, FADE = 16, 6
#: Bits of an id in the tables, whose entries are count << ID_BITS | candidate.
ID_BITS = 20
#: Counts that a prediction reaches at most, a power of two less 1.
MOST = 15
COUNT_BITS = MOST.bit_length()
_ID, _COUNT = np.int32((1 << ID_BITS) - 1), np.int32(1 << ID_BITS)


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a // b`` of numbers from 0 to 2 ** 53, by floats: no quotient below a whole number is rounded up to it."""
    return (a / b).astype(np.int64)


class Mixer:
    """Predictions of order 0 to 2 for all lanes of a block, and their mixture."""

    def __init__(self, symbols: int, lanes: int) -> None:
        self.symbols = symbols
        # order 2's places, then order 1's: what is done for both is done at once, in two rows
        self.table = np.zeros(ORDER2 + symbols, np.int32)
        # how often order 2, only order 1, or neither held, by (count of order 2, count of order 1, agreement)
        self.seen = np.tile(np.array([8, 8, 16, 0], np.int64), ((MOST + 1) ** 2 * 2, 1))
        self.frequency, self.missed = np.zeros(symbols, np.int64), [np.empty(0, np.int32)]
        self.steps = 0
        # numpy takes places of its own kind as they are, and casts any other at each use
        self.before, self.before2 = np.zeros(lanes, np.intp), np.zeros(lanes, np.intp)
        self.places: np.ndarray | None = None
        self._sum()
        self._weigh()

    def _sum(self) -> None:
        """Borders of the ids' order-0 intervals; each is at least 1 wide."""
        self.frequency += np.bincount(np.concatenate(self.missed), minlength=self.symbols)
        self.missed = [np.empty(0, np.int32)]
        sums = np.concatenate([[0], np.cumsum(self.frequency)])
        each = np.arange(self.symbols + 1)
        spare = ORDER0_LEAST - self.symbols
        self.borders = (sums * spare // sums[-1] if sums[-1] else each * spare // self.symbols) + each
        self.places = None

    def _weigh(self) -> None:
        tried = self.seen.sum(1)
        weights = self.seen[:, :2] * ((1 << TOTAL_BITS) - ORDER0_LEAST) // tried[:, None]
        self.weights = weights.T.copy()

    def predict(self, lanes: int) -> None:
        """Candidates and weights of the first ``lanes`` lanes."""
        b1, b2 = self.before[:lanes], self.before2[:lanes]
        self.places_of = np.empty(2 * lanes, np.intp)
        self.slot = self.places_of[:lanes]
        self.slot[:] = ((b1.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (b2.astype(np.uint32) * np.uint32(0x85EBCA77))) >> np.uint32(32 - ORDER2.bit_length() + 1)
        np.add(b1, ORDER2, out=self.places_of[lanes:])
        self.held = self.table.take(self.places_of).reshape(2, lanes)
        self.guess, self.count = self.held & _ID, self.held >> ID_BITS
        self.row = (((self.count[0] << COUNT_BITS) | self.count[1]) << 1) | (self.guess[0] == self.guess[1])
        self.row = self.row.astype(np.intp)
        self.share = self.weights.take(self.row, 1)
        self.share0 = (1 << TOTAL_BITS) - self.share[0] - self.share[1]

    def _scaled(self, ids: np.ndarray) -> np.ndarray:
        """Where the order-0 intervals of ids begin, scaled to what is left to order 0."""
        return (self.borders.take(ids) * self.share0) >> ORDER0_BITS

    def intervals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and widths of the intervals of ids, one a lane."""
        self.right = self.guess == ids
        self.at = ids.astype(np.intp)
        low = self._scaled(self.at)
        size = self._scaled(self.at + 1) - low
        for x, where in ((low, self.guess < ids), (size, self.right)):
            weight = self.share * where
            x += weight[0]
            x += weight[1]
        # none is below 0
        return low.view(np.uint64), size.view(np.uint64)

    def find(self, place: np.ndarray) -> np.ndarray:
        """The ids in whose intervals ``place`` lies, one a lane."""
        if self.places is None:
            self.places = np.repeat(np.arange(self.symbols, dtype=np.int32), np.diff(self.borders))
        guess2, guess1 = self.guess
        share2, share1 = self.share
        lower = share2 + (guess1 < guess2) * (share1 - share2)
        # a weight lies before the order-0 interval of its id: taken out, the lower id's first, only order 0 is left
        for guess, share in ((np.minimum(guess1, guess2), lower), (np.maximum(guess1, guess2), share1 + share2 - lower)):
            place = np.maximum(np.minimum(place, self._scaled(guess)), place - share)
        return self.places.take(_divided(((place + 1) << ORDER0_BITS) - 1, self.share0))

    def learn(self, ids: np.ndarray) -> None:
        """Take up the ids of a step, whose intervals were asked for."""
        n = len(ids)
        miss = ~(self.right[0] | self.right[1])
        kind = miss.view(np.int8) + (~self.right[0]).view(np.int8)
        self.seen += np.bincount((self.row << 2) + kind, minlength=self.seen.size).reshape(self.seen.shape) << 4
        # a candidate that held counts one more, one that failed half, and if its count was 1 or less the id takes its place
        # (sums, since choices that hardly can be foreseen take longer)
        value, fresh = self.held - ((self.count + 1 >> 1) << ID_BITS), ids | _COUNT
        value = fresh + (self.held >= 2 * _COUNT) * (value - fresh)
        value += self.right * (self.held + _COUNT * (self.held < MOST * _COUNT) - value)
        self.table[self.places_of] = 0
        np.maximum.at(self.table, self.places_of, value.reshape(-1))
        self.missed.append(ids[np.flatnonzero(miss)])
        self.before2[:n] = self.before[:n]
        self.before[:n] = self.at
        self.steps += 1
        if self.steps % FADE_STEPS == 0:
            self.seen -= self.seen >> FADE
        if self.steps % ORDER0_STEPS == 0 or self.steps & (self.steps - 1) == 0:
            self._sum()
        if self.steps % WEIGHT_STEPS == 0 or self.steps < WEIGHT_STEPS:
            self._weigh()


# ---- range coder -------------------------------------------------------------------------------
#
# A carry-less range coder over 48 bits that moves 16 bits at a time, with a state for every lane.

WORD = np.uint64(16)
STATE = np.uint64((1 << 48) - 1)
TOP, BOTTOM = np.uint64(1 << 32), np.uint64(1 << 30)
ONE = np.uint64(1)
_TOTAL = np.uint64(TOTAL_BITS)


def _due(low: np.ndarray, range_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lanes have settled their top word, and which must move one word on."""
    same = (low ^ (low + range_)) < TOP
    return same, same | (range_ < BOTTOM)


def _moved(low: np.ndarray, range_: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of lanes one word on; those that have not settled are cut where the top word changes."""
    return (low << WORD) & STATE, np.where(same, range_, (~low + ONE) & (BOTTOM - ONE)) << WORD


class LaneWriter:
    """Range coders of all lanes, writing."""

    def __init__(self, lanes: int, steps: int) -> None:
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, STATE)
        self.out = np.zeros((lanes, 8 + 3 * steps), np.uint16)
        self.at = np.zeros(lanes, np.int64)

    def put(self, start: np.ndarray, size: np.ndarray) -> None:
        """Narrow the first lanes to their intervals."""
        n = len(start)
        low, rng = self.low[:n], self.range[:n]
        unit = rng >> _TOTAL
        low += start * unit
        np.multiply(unit, size, out=rng)
        same, go = _due(low, rng)
        rows = np.flatnonzero(go)
        same = same[rows]
        while len(rows):
            at = self.at[rows]
            if at.max() >= self.out.shape[1]:
                self.out = np.concatenate([self.out, np.zeros_like(self.out)], 1)
            l = low[rows]
            self.out[rows, at] = (l >> np.uint64(32)).astype(np.uint16)
            self.at[rows] = at + 1
            l, r = _moved(l, rng[rows], same)
            low[rows], rng[rows] = l, r
            same, go = _due(l, r)
            rows, same = rows[go], same[go]

    def finish(self) -> bytes:
        rows = np.arange(len(self.low))
        self.out = np.concatenate([self.out, np.zeros((len(rows), 3), np.uint16)], 1)
        for _ in range(3):
            self.out[rows, self.at] = (self.low >> np.uint64(32)).astype(np.uint16)
            self.at += 1
            self.low = (self.low << WORD) & STATE
        width = np.arange(self.out.shape[1]) < self.at[:, None]
        return self.at.astype("<u4").tobytes() + self.out[width].astype("<u2").tobytes()


class LaneReader:
    """Range coders of all lanes, reading what ``LaneWriter`` wrote."""

    def __init__(self, payload: bytes, lanes: int) -> None:
        sizes = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
        self.data = np.concatenate([np.frombuffer(payload, "<u2", offset=4 * lanes), np.zeros(8, np.uint16)])
        self.at = np.cumsum(sizes) - sizes
        self.low, self.range, self.code = np.zeros(lanes, np.uint64), np.full(lanes, STATE), np.zeros(lanes, np.uint64)
        for _ in range(3):
            self.code = (self.code << WORD) | self.data[self.at]
            self.at += 1

    def peek(self, lanes: int) -> np.ndarray:
        """The place in the total width that the next interval of each of the first lanes holds."""
        self.unit = self.range[:lanes] >> _TOTAL
        place = (self.code[:lanes] - self.low[:lanes]) / self.unit
        return np.minimum(place, (1 << TOTAL_BITS) - 1).astype(np.int64)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        """Narrow the first lanes to their intervals, after ``peek``."""
        n = len(start)
        low, rng, code = self.low[:n], self.range[:n], self.code[:n]
        low += start * self.unit
        np.multiply(self.unit, size, out=rng)
        same, go = _due(low, rng)
        rows = np.flatnonzero(go)
        same = same[rows]
        while len(rows):
            at = self.at[rows]
            code[rows] = ((code[rows] << WORD) & STATE) | self.data[at]
            self.at[rows] = at + 1
            l, r = _moved(low[rows], rng[rows], same)
            low[rows], rng[rows] = l, r
            same, go = _due(l, r)
            rows, same = rows[go], same[go]


def _lanes(n_ids: int, lanes: int) -> tuple[int, int]:
    """Steps, and lanes that have an id in the last step."""
    steps = -(-n_ids // lanes)
    return steps, n_ids - (steps - 1) * lanes


#: Rows that are turned into columns at a time: all of a block's have places that a processor's cache can't hold at once.
TURNED = 64


def _turned(rows: np.ndarray, out: np.ndarray) -> None:
    """Write ``rows`` as the columns of ``out``."""
    for a in range(0, max(rows.shape), TURNED):
        if len(rows) >= rows.shape[1]:
            out[:, a : a + TURNED] = rows[a : a + TURNED].T
        else:
            out[a : a + TURNED] = rows[:, a : a + TURNED].T


def encode_block(ids: np.ndarray, symbols: int) -> tuple[int, bytes]:
    """Lanes and payload of a block of ids (each below ``symbols``, one at least)."""
    lanes = max(1, min(LANES, len(ids) // LANE_IDS))
    steps, full = _lanes(len(ids), lanes)
    model, coder = Mixer(symbols, lanes), LaneWriter(lanes, steps)
    grid = np.empty((steps, lanes), np.int32)  # the ids of each step
    _turned(ids[: full * steps].reshape(full, steps), grid[:, :full])
    _turned(ids[full * steps :].reshape(lanes - full, steps - 1), grid[:-1, full:])
    for step in range(steps):
        n = lanes if step < steps - 1 else full
        now = grid[step, :n]
        model.predict(n)
        coder.put(*model.intervals(now))
        model.learn(now)
    return lanes, coder.finish()


def decode_block(payload: bytes, n_ids: int, lanes: int, symbols: int) -> np.ndarray:
    """The ids of a block."""
    steps, full = _lanes(n_ids, lanes)
    grid = np.empty((steps, lanes), np.int32)
    model, coder = Mixer(symbols, lanes), LaneReader(payload, lanes)
    for step in range(steps):
        n = lanes if step < steps - 1 else full
        model.predict(n)
        now = grid[step, :n]
        now[:] = model.find(coder.peek(n))
        coder.take(*model.intervals(now))
        model.learn(now)
    out = np.empty(n_ids, np.int64)
    _turned(grid[:, :full], out[: full * steps].reshape(full, steps))
    _turned(grid[:-1, full:], out[full * steps :].reshape(lanes - full, steps - 1))
    return out


class CorruptSegment(ValueError):
    """A segment whose bytes are not what was written."""


@dataclass(frozen=True)
class Segment:
    """What a segment holds: its documents' ids and names, its file, and the ids of that file before it."""

    documents: list[np.ndarray]
    names: pa.Array
    file_no: int
    n_before: int


def write_segment(documents: list[np.ndarray], symbols: int, names: pa.Array | None = None, file_no: int = 0, n_before: int = 0) -> bytes:
    """The bytes of a segment with the ids of each document; ``names`` (numbers unless given) are any Arrow array."""
    ids = np.concatenate([np.empty(0, np.int64), *documents]).astype(np.int64)
    blocks = []
    for a in range(0, len(ids), BLOCK_IDS):
        own = ids[a : a + BLOCK_IDS]
        lanes, payload = encode_block(own, symbols)
        blocks += [BLOCK.pack(len(own), lanes, len(payload), zlib.crc32(own.astype("<u4").tobytes())), payload]
    counts = np.array(list(map(len, documents)), "<u4").tobytes()
    batch = pa.record_batch([pa.array(range(len(documents)), pa.int64()) if names is None else names], ["doc_id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    named = zlib.compress(sink.getvalue())
    return b"".join([HEAD.pack(MAGIC, VERSION, len(documents), len(ids), len(blocks) // 2, file_no, n_before, len(named)), named, counts, *blocks])


def file_and_ids(head: bytes) -> tuple[int, int]:
    """A segment's file and number of ids, from its first bytes."""
    found = HEAD.unpack_from(head)
    return found[5], found[3]


def read_segment(data: bytes, symbols: int) -> Segment:
    """What a segment holds; ``CorruptSegment`` if a checksum or length does not hold."""
    try:
        magic, version, n_docs, n_ids, n_blocks, file_no, n_before, n_names = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise CorruptSegment("not a segment of this format")
        at = HEAD.size + n_names
        with pa.ipc.open_stream(zlib.decompress(data[HEAD.size : at])) as stream:
            names = stream.read_all().column(0).combine_chunks()
        counts = np.frombuffer(data, "<u4", n_docs, at).astype(np.int64)
        at, blocks = at + 4 * n_docs, []
        for _ in range(n_blocks):
            n, lanes, size, crc = BLOCK.unpack_from(data, at)
            payload = data[at + BLOCK.size : at + BLOCK.size + size]
            at += BLOCK.size + size
            ids = decode_block(payload, n, lanes, symbols)
            if len(payload) != size or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise CorruptSegment("a block does not match its checksum")
            blocks.append(ids)
    except (struct.error, zlib.error, pa.ArrowException, IndexError, ValueError, ZeroDivisionError) as error:
        raise error if isinstance(error, CorruptSegment) else CorruptSegment(str(error)) from error
    ids = np.concatenate([np.empty(0, np.int64), *blocks])
    if len(ids) != n_ids or counts.sum() != n_ids or len(names) != n_docs:
        raise CorruptSegment("the documents' lengths do not add up")
    return Segment(np.split(ids, np.cumsum(counts)[:-1]) if n_docs else [], names, file_no, n_before)


# ---- tokens ------------------------------------------------------------------------------------


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def byte_characters() -> list[str]:
    """The characters that byte-level vocabularies write bytes as."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Merges:
    """The vocabulary's merges, made for many runs of bytes side by side: in each run the merge of the least rank, the
    leftmost of those, again and again, as the library does in one after the other."""

    def __init__(self, vocabulary: Tokenizer) -> None:
        model = json.loads(vocabulary.to_str())["model"]
        ids, self.symbols = model["vocab"], vocabulary.get_vocab_size()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * self.symbols + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)  # by rank
        #: Of pairs that don't merge; larger than all ranks.
        self.NONE = np.int32(len(pairs))
        self.answers = Answers(self._search, RANK_BITS, len(pairs).bit_length(), self.symbols**2)
        self.inner, self.last = (np.array([ids[c + end] for c in byte_characters()], np.int32) for end in ("", WORD_END))

    def _search(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs; ``NONE`` where there is none, or no id (``b`` below 0)."""
        found = self.answers(a.astype(np.int64) * self.symbols + np.maximum(b, 0))
        return np.where(b >= 0, found, self.NONE).astype(np.int32)

    def _grid(self, grid: np.ndarray) -> np.ndarray:
        """Merge the ids in each row, which -1 follow, as far as they go."""
        rank = np.full(grid.shape, self.NONE)
        filled = grid[:, 1:] >= 0
        rank[:, :-1][filled] = self._rank(grid[:, :-1][filled], grid[:, 1:][filled])
        out, rows, columns = grid, np.arange(len(grid)), np.arange(grid.shape[1])
        grid = grid.copy()
        while len(rows):
            at = rank.argmin(1)
            each = np.arange(len(rows))
            least = rank[each, at]
            if (least == self.NONE).any():
                out[rows] = grid
                on = least < self.NONE
                rows, grid, rank, at, least = rows[on], grid[on], rank[on], at[on], least[on]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            # what stands right of the pair moves up by one
            after = columns[:-1] > at[:, None]
            for x, empty in ((grid, -1), (rank, self.NONE)):
                np.copyto(x[:, :-1], x[:, 1:].copy(), where=after)
                x[:, -1] = empty
            made = self.made[least]
            grid[each, at] = made
            right = grid[each, np.minimum(at + 1, len(columns) - 1)]
            rank[each, at] = self._rank(made, np.where(at + 1 < len(columns), right, -1))
            left = at > 0
            rank[each[left], at[left] - 1] = self._rank(grid[each[left], at[left] - 1], made[left])
        return out

    def __call__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each run of bytes gives, and the ids one after the other. Runs have 1 to ``MERGED`` bytes."""
        counts = np.empty(len(starts), np.int64)
        parts, low = [], 0
        for width in GRIDS:
            of_width = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for k in range(0, len(of_width), GRID_ROWS):
                own = of_width[k : k + GRID_ROWS]
                inside = np.arange(width) < lengths[own, None]
                grid = np.full(inside.shape, -1, np.int32)
                grid[inside] = self.inner[data[flat_ranges(starts[own], lengths[own])]]
                ends = lengths[own] - 1
                grid[np.arange(len(own)), ends] = self.last[data[starts[own] + ends]]
                grid = self._grid(grid)
                counts[own] = (grid >= 0).sum(1)
                parts.append((own, grid[grid >= 0]))
        ids = np.empty(int(counts.sum()), np.int32)
        begin = np.cumsum(counts) - counts
        for own, found in parts:
            ids[flat_ranges(begin[own], counts[own])] = found
        return counts, ids


@cache
def merges_of(path: str) -> Merges:
    return Merges(tokenizer(path))


class IdLists:
    """A growing list of lists of ids."""

    def __init__(self) -> None:
        self.ids, self.n_ids = np.empty(1 << 14, np.int32), 0
        self.starts, self.counts, self.n = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    def add(self, counts: np.ndarray, ids: np.ndarray) -> None:
        """Add lists of ``counts`` ids each, which lie in ``ids`` one after the other."""
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.empty(max(len(ids), self.n_ids), np.int32)])
        if self.n + len(counts) > len(self.counts):
            more = max(len(counts), self.n)
            self.counts, self.starts = (np.concatenate([x[: self.n], np.empty(more, np.int64)]) for x in (self.counts, self.starts))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.counts[self.n : self.n + len(counts)] = counts
        self.starts[self.n : self.n + len(counts)] = self.n_ids + np.cumsum(counts) - counts
        self.n_ids += len(ids)
        self.n += len(counts)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists' lengths, and their ids one after the other."""
        counts = self.counts[at]
        return counts, self.ids[flat_ranges(self.starts[at], counts)]


class WordTokens:
    """Ids of texts (UTF-8). This vocabulary drops white space and no token reaches over it, so the ids of each
    distinct word between spaces and line ends are found once while the table lasts.

    It lowers letters too and splits letters from what follows, so a word of plain letters and at most one
    punctuation mark is put together from its letters and the mark's id. Short words of plain letters, digits and
    punctuation are merged here, side by side; all others go to the library. All words of a stretch of bytes
    are found, hashed (64 bits) and looked up side by side; only those that the table does not have become
    strings. The table has one place for each ``TABLE_BITS`` bits of a hash, where a later word replaces an
    earlier one, so its size does not grow.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.symbols = self.tokenizer.get_vocab_size()
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.merges = merges_of(path)
        self.marks = np.zeros(256, np.int32)
        for c in _MARKS:
            (self.marks[c],) = self.tokenizer.encode(chr(c), add_special_tokens=False).ids
        self._reset()

    def _reset(self) -> None:
        self.keys, self.lists = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
        self.ids = IdLists()
        self.ids.add(np.zeros(1, np.int64), np.empty(0, np.int32))  # of the empty word, whose hash is 0

    def _joined(self, texts: list[str]) -> np.ndarray:
        got = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.int32), *got])

    @staticmethod
    def _mergeable(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are merged here, and these words' bytes in lower case, a space after each."""
        short = np.flatnonzero(lengths <= MERGED)
        sizes = lengths[short] + 1
        ends = np.cumsum(sizes)
        own = data[np.minimum(flat_ranges(starts[short], sizes), len(data) - 1)]
        own[ends - 1] = 0x20
        good = _PLAIN[own]
        pair = np.flatnonzero(own == 0xC3)
        pair = pair[_LATIN[own[pair + 1]]]
        good[pair] = good[pair + 1] = True
        good[np.flatnonzero(own == 0x3C)] &= own[np.flatnonzero(own == 0x3C) + 1] != 0x7C
        fine = np.ones(len(short), bool)
        fine[np.searchsorted(ends, np.flatnonzero(~good), "right")] = False
        own[pair + 1] += (own[pair + 1] <= 0x9E).astype(np.uint8) << 5
        own |= (own - np.uint8(0x41) < 26).astype(np.uint8) << 5
        merged = np.zeros(len(starts), bool)
        merged[short[fine]] = True
        return merged, own if fine.all() else own[np.repeat(fine, sizes)]

    def _merged(self, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the ``n`` words of ``_mergeable``: the vocabulary splits them into runs of letters or of punctuation and single digits."""
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        kind = _KIND[data]
        first = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)])
        edges = np.append(np.flatnonzero(first), len(data))
        starts, lengths = edges[:-1], np.diff(edges)
        runs = kind[starts] != _BETWEEN
        unit = np.cumsum(~runs)[runs]
        counts, ids = self.merges(data, starts[runs], lengths[runs])
        return np.bincount(unit, counts, n).astype(np.int64), ids

    def _others(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any units, many in a call, with a mark after each."""
        joined = [f" {MARK} ".join([*units[a : a + JOINED], ""]) for a in range(0, len(units), JOINED)]
        if sum(t.count(MARK) for t in joined) != len(units):  # the mark stands in a unit
            got = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            return np.fromiter(map(len, got), np.int64, len(got)), np.array([i for x in got for i in x], np.int32)
        ids = self._joined(joined)
        marks = ids == self.mark
        return np.diff(np.flatnonzero(marks), prepend=-1) - 1, ids[~marks]

    def _learn(self, joined: bytes, begin: np.ndarray, end: np.ndarray) -> int:
        """Take up the words that lie in ``joined``; the number of the first one's list."""
        first = self.ids.n
        counts, starts = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
        merged, data = self._mergeable(np.frombuffer(joined, np.uint8), begin, end - begin)
        others = [joined[a:b].decode("utf-8", "replace") for a, b in zip(begin[~merged].tolist(), end[~merged].tolist(), strict=True)]
        found, held = [], 0
        for of_kind, (own, ids) in ((merged, self._merged(data, int(merged.sum()))), (~merged, self._others(others))):
            counts[of_kind] = own
            starts[of_kind] = held + np.cumsum(own) - own
            held += len(ids)
            found.append(ids)
        self.ids.add(counts, np.concatenate(found)[flat_ranges(starts, counts)])
        return first

    @staticmethod
    def _hashes(joined: bytes, starts: np.ndarray, lengths: np.ndarray, lowered: np.ndarray) -> np.ndarray:
        """Hashes of words, eight bytes of each at a time; of those ``lowered`` with capitals lowered."""
        both = b"".join([joined.lower(), joined, bytes(8)])
        eight = np.ndarray(len(both) - 7, "<u8", both, strides=(1,))
        at, left = np.where(lowered, starts, starts + len(joined)), lengths
        hashes, own = np.zeros(len(starts), np.uint64), slice(None)
        with np.errstate(over="ignore"):
            h = (lengths + 1).astype(np.uint64) * _FACTOR
            h ^= h >> _FOLD
            while len(at):
                h = (h ^ (eight[at] & _FIRST[np.minimum(left, 8)])) * _FACTOR
                h ^= h >> _FOLD
                hashes[own] = h
                more = np.flatnonzero((left > 8) & (left <= HASHED))
                own = more if isinstance(own, slice) else own[more]
                at, left, h = at[more] + 8, left[more] - 8, h[more]
            for k in np.flatnonzero(lengths > HASHED).tolist():
                a = int(starts[k]) + (0 if lowered[k] else len(joined))
                hashes[k] = xxhash.xxh64_intdigest(memoryview(both)[a : a + int(lengths[k])])
            return mixed(hashes)

    @classmethod
    def _words(cls, joined: bytes) -> tuple[np.ndarray, ...]:
        """Of the words of some bytes: starts, ends of what is looked up, the mark after it (0: none), hashes."""
        data = np.frombuffer(joined, np.uint8)
        # compared, since to look each byte up in a table takes longer
        space = np.concatenate([[True], (data == 0x20) | (data == 0x0A), [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edge[::2], edge[1::2]
        letter = (data | np.uint8(0x20)) - np.uint8(0x61) < 26
        if 0xC3 in joined:
            first = np.flatnonzero(data[:-1] == 0xC3)
            first = first[_LATIN[data[first + 1]]]
            letter[first] = letter[first + 1] = True
        others = np.concatenate([np.zeros(1, np.int32), np.cumsum(~letter, dtype=np.int32)])
        last = data[ends - 1]
        mark = _PUNCTUATION[last] & (ends - starts > 1)
        plain = others[ends - mark] == others[starts]
        mark &= plain
        core = ends - mark
        # capitals count in words that are not plain
        return starts, core, np.where(mark, last, 0), cls._hashes(joined, starts, core - starts, plain)

    def _lists(self, joined: bytes, starts: np.ndarray, core: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The numbers of the words' lists of ids; words that the table does not have are taken up."""
        if self.ids.n > TABLE_LISTS:
            self._reset()
        place = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        lists = self.lists.take(place)
        missed = np.flatnonzero(self.keys.take(place) != hashes)
        if len(missed):
            fresh, at, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at = missed[at]
            numbers = self._learn(joined, starts[at], core[at]) + np.arange(len(at), dtype=np.int32)
            lists[missed] = numbers[back]
            # of words with one place the first goes there
            there, one = np.unique(place[at], return_index=True)
            self.keys[there], self.lists[there] = fresh[one], numbers[one]
        return lists

    def __call__(self, text: str | bytes) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, texts: list[str] | list[bytes]) -> list[np.ndarray]:
        """Ids of several texts, however long."""
        raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
        joined = b"\n".join(raw)
        parts, at = [], 0
        while at < len(joined):
            end = min(len(joined), at + STRETCH)
            if end < len(joined):
                cut = max(joined.rfind(b" ", at, end), joined.rfind(b"\n", at, end))
                if cut < 0:  # a word longer than a stretch is taken whole
                    cut = min((x for x in (joined.find(b" ", end), joined.find(b"\n", end)) if x >= 0), default=len(joined))
                end = cut + 1
            starts, core, *rest = self._words(joined[at:end])
            parts.append((starts + at, core + at, *rest))
            at = end
        if not parts:
            return [np.empty(0, np.int32)] * len(texts)
        starts, core, mark, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        lists = self._lists(joined, starts, core, hashes)
        counts = self.ids.counts.take(lists)
        marked = mark > 0
        sums = np.concatenate([[0], np.cumsum(counts + marked)])
        out = np.empty(int(sums[-1]), np.int32)
        out[flat_ranges(sums[:-1], counts)] = self.ids.ids.take(flat_ranges(self.ids.starts.take(lists), counts))
        out[sums[1:][marked] - 1] = self.marks[mark[marked]]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        return np.split(out, sums[np.searchsorted(starts, ends)][:-1])


def input_bytes(df: DataFrame) -> int:
    """What the planner takes a table's size to be (of files: their bytes)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def write_tokens(docs: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}", end_id: int = END_ID, partitions: int | None = None) -> tuple[DataFrame, str]:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; the written table and its path.

    The table has one column, data: the bytes of a segment in each row. It lies in the shared folder.
    Unless ``partitions`` says so, a task gets about ``TASK_BYTES`` of the input.
    """
    spark = bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", text_of().cast("binary").alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(texts) // TASK_BYTES))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_table(f"tokens {path}", lambda: WordTokens(path))
        file_no, n_before = None, 0
        held: list[np.ndarray] = []
        owners: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, owners, size, n_before
            segment = write_segment(held, words.symbols, pa.concat_arrays(owners), file_no, n_before)
            held, owners, size, n_before = [], [], 0, n_before + size
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], ["data"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            if file_no is None and len(batch):
                file_no = batch.column(2)[0].as_py()
            for a, b in chunks(texts, TAKE):
                for k, own in enumerate(words.batch(texts[a:b]), a):
                    held.append(np.append(own, end_id))
                    owners.append(batch.column(0).slice(k, 1))
                    size += len(held[-1])
                    if size >= SEGMENT_IDS:
                        yield flush()
        if held:
            yield flush()

    # rows that share an id, or have none, are dealt by their text and where they come from
    order = [F.asc_nulls_first("doc_id"), F.asc("mark"), F.asc("part")]
    marked = texts.withColumn("mark", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    ordered = marked.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    return write_shared(ordered.select("doc_id", "text", F.spark_partition_id().alias("file_no")).mapInArrow(rows, "data binary"), "token-files")


def read_tokens(files: DataFrame, kind: str = "long", path: str = f"{TOKENIZERS}/{VOCABULARY}", with_ids: bool = True) -> DataFrame:
    """The documents that written files (data) hold: doc_id (of type ``kind``), start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` is the number of ids of all documents before.
    """
    symbols = tokenizer(path).get_vocab_size()

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [file_and_ids(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in found], pa.int64()) for k in (0, 1)], ["file_no", "n_ids"])

    # one row for each file, and there are as many files as partitions
    headed = files.select(F.substring("data", 1, HEAD.size)).mapInArrow(heads, "file_no long, n_ids long")
    per_file = headed.groupBy("file_no").agg(F.sum("n_ids").alias("n_ids")).collect()
    before, total = {}, 0
    for r in sorted(per_file):
        before[r.file_no], total = total, total + r.n_ids
    held = files.sparkSession.sparkContext.broadcast(before)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                segment = read_segment(data.as_py(), symbols)
                counts = np.fromiter(map(len, segment.documents), np.int64, len(segment.documents))
                columns = {
                    "doc_id": segment.names,
                    "start": pa.array(held.value[segment.file_no] + segment.n_before + np.cumsum(counts) - counts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in segment.documents], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(segment.documents).astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    return files.select("data").mapInArrow(rows, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_digests(docs: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """Write the ids of ``docs`` and read the files back: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty, so it has the end id only. Null doc_ids come first; rows that repeat
    a doc_id are put in order by a hash of the text and written each. Texts are
    taken in stretches that end between words, however long they are. An empty table gives no
    rows; other columns are not read.
    """
    files, _ = write_tokens(docs, path)
    return read_tokens(files, docs.schema["doc_id"].dataType.simpleString(), path, with_ids=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
