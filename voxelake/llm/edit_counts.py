"""Token counts that follow edits: a segment tree of pre-token counts per document.

A text is cut into *units*, each a run of white space with the run of other characters after it. A
unit holds whole pre-tokens of the byte-level pattern (no pre-token reaches across the start of a
run of white space), so the number of tokens of a text is the sum over its units.

Each document is a segment tree: a leaf holds some ``LEAF`` units with their text, lengths and token
counts, an inner node the sums of its subtree. An edit walks down to the leaves it touches by their
characters, re-encodes the units it touches with one unit of context on either side, and walks up
again to update the sums. A leaf that has grown too large becomes an inner node over parts of it, in
its place; when a tree has become too deep or too empty, its nodes are set up anew over the leaves as
they are, without encoding anything. So an edit costs a leaf and the depth of the tree, however long
the document is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_WORDS, Interner, bounded_batches, table, text_of, worker_table

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern that cuts text into pre-tokens (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


@cache
def encoding(path: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_NONE = np.empty(0, np.int64)


class UnitCounter:
    """Token counts of units; each distinct unit is encoded once while the table lasts."""

    def __init__(self, path: str) -> None:
        self.encode = encoding(path).encode_ordinary
        self._reset()

    def _reset(self) -> None:
        self.units, self.counts, self.n = Interner(), np.empty(1 << 12, np.int64), 0

    def __call__(self, units: list[str]) -> np.ndarray:
        if len(self.units) > MAX_WORDS:
            self._reset()
        at = self.units.take(units)
        if fresh := self.units.fresh:
            new = np.fromiter((len(self.encode(u)) for u in fresh), np.int64, len(fresh))
            if self.n + len(new) > len(self.counts):
                self.counts = np.concatenate([self.counts[: self.n], np.empty(max(len(new), self.n), np.int64)])
            self.counts[self.n : self.n + len(new)] = new
            self.n += len(new)
            self.units.fresh = []
        return self.counts[at]


#: Units of a leaf, when set up; it is parted when it has more than twice as many.
LEAF = 256


class Node:
    """A leaf with its units' text, lengths and token counts, or an inner node; with the sums of the subtree."""

    __slots__ = ("chars", "counts", "left", "lengths", "parent", "right", "text", "tokens", "units")

    def __init__(self, text: str = "", lengths: np.ndarray = _NONE, counts: np.ndarray = _NONE) -> None:
        self.parent = self.left = self.right = None
        self.fill(text, lengths, counts)

    def fill(self, text: str, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.text, self.lengths, self.counts = text, lengths, counts
        self.chars, self.tokens, self.units = len(text), int(counts.sum()), len(counts)

    def over(self, left: Node, right: Node) -> Node:
        """Make this the inner node over two others."""
        self.left, self.right, left.parent, right.parent = left, right, self, self
        self.text, self.lengths, self.counts = "", _NONE, _NONE
        self.add()
        return self

    def add(self) -> None:
        self.chars, self.tokens, self.units = (self.left.chars + self.right.chars, self.left.tokens + self.right.tokens, self.left.units + self.right.units)


def _leaves(text: str, lengths: np.ndarray, counts: np.ndarray) -> list[Node]:
    if len(counts) <= 2 * LEAF:
        return [Node(text, lengths, counts)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return [Node(text[ends[a] : ends[min(a + LEAF, len(counts))]], lengths[a : a + LEAF], counts[a : a + LEAF]) for a in range(0, len(counts), LEAF)]


def _tree(nodes: list[Node], top: Node | None = None) -> Node:
    """A balanced tree over some nodes, ``top`` its root if given."""
    while len(nodes) > 2:
        nodes = [Node().over(a, b) for a, b in zip(nodes[::2], nodes[1::2], strict=False)] + nodes[len(nodes) - len(nodes) % 2 :]
    if len(nodes) == 1:
        return nodes[0]
    return (top or Node()).over(*nodes)


class CountedText:
    """A text with the token counts of its units, kept right under edits.

    ``reencoded`` counts units encoded again, ``touched`` the nodes that edits walked through.
    """

    def __init__(self, text: str, count: UnitCounter) -> None:
        self.count, self.reencoded, self.touched = count, 0, 0
        units = UNIT.findall(text)
        leaves = _leaves(text, np.fromiter(map(len, units), np.int64, len(units)), count(units))
        self.root, self.n_leaves = _tree(leaves), len(leaves)

    @property
    def n_tokens(self) -> int:
        return self.root.tokens

    @property
    def n_units(self) -> int:
        return self.root.units

    @property
    def n_chars(self) -> int:
        return self.root.chars

    def leaves(self) -> list[Node]:
        """All leaves with units, in order."""
        out, open_ = [], [self.root]
        while open_:
            node = open_.pop()
            if node.left is None:
                out.append(node)
            else:
                open_ += [node.right, node.left]
        return [x for x in out if x.units] or out[:1]

    @property
    def text(self) -> str:
        return "".join(x.text for x in self.leaves())

    def _leaf(self, at: int) -> tuple[Node, int, int]:
        """The leaf of the character ``at`` (the last one for the end), where it begins, its depth."""
        node, start, depth = self.root, 0, 0
        while node.left is not None:
            depth += 1
            if at < start + node.left.chars or not node.right.chars:
                node = node.left
            else:
                start += node.left.chars
                node = node.right
        self.touched += depth + 1
        return node, start, depth

    def _sum(self, node: Node | None) -> None:
        while node is not None:
            node.add()
            self.touched += 1
            node = node.parent

    def edit(self, start: int, n_deleted: int, inserted: str) -> None:
        """Replace the characters [start, start + n_deleted), cut off at the text's ends, by ``inserted``."""
        start = min(max(start, 0), self.n_chars)
        stop = min(start + max(n_deleted, 0), self.n_chars)
        first, begin, deepest = self._leaf(start)
        held = [first]
        end = begin + first.chars
        # the unit before the one with ``start``, and two from the one that ends at ``stop`` or after, must be held
        if begin and start < begin + (first.lengths[0] if first.units else 1):
            before, begin, depth = self._leaf(begin - 1)
            held.insert(0, before)
            deepest = max(deepest, depth)
        while end < self.n_chars and (stop >= end or int(np.searchsorted(np.cumsum(held[-1].lengths), stop - end + held[-1].chars, "left")) + 2 > held[-1].units):
            after, _, depth = self._leaf(end)
            enough = stop < end
            held.append(after)
            end += after.chars
            deepest = max(deepest, depth)
            if enough and after.units > 1:
                break
        lengths, counts, text = (np.concatenate([x.lengths for x in held]), np.concatenate([x.counts for x in held]), "".join(x.text for x in held))
        start, stop = start - begin, stop - begin
        ends = np.cumsum(lengths)
        low = max(0, int(np.searchsorted(ends, start, "right")) - 1)
        high = min(len(ends), int(np.searchsorted(ends, stop, "left")) + 2)
        a, b = int(ends[low - 1]) if low else 0, int(ends[high - 1]) if high else 0
        text = text[:start] + inserted + text[stop:]
        units = UNIT.findall(text[a : b + len(inserted) - (stop - start)])
        self.reencoded += len(units)
        lengths = np.concatenate([lengths[:low], np.fromiter(map(len, units), np.int64, len(units)), lengths[high:]])
        counts = np.concatenate([counts[:low], self.count(units), counts[high:]])
        parts = _leaves(text, lengths, counts)
        for other in held[1:]:
            other.fill("", _NONE, _NONE)
            self._sum(other.parent)
        if len(parts) == 1:
            held[0].fill(text, lengths, counts)
        else:
            _tree(parts, held[0])
        self._sum(held[0].parent)
        self.n_leaves += len(parts) - 1
        if deepest > 2 * self.n_leaves.bit_length() + 8 or self.n_leaves > 16 + 4 * self.n_units // LEAF:
            leaves = self.leaves()
            self.root, self.n_leaves = _tree(leaves), len(leaves)
            self.root.parent = None


EDITS = "array<struct<start:bigint,n_deleted:bigint,inserted:string>>"


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the edits (doc_id, seq, start, n_deleted, inserted) of each, in order of seq.

    Edits of one seq are put in order by their fields; a null seq comes first. Edits of a null doc_id
    go to the rows with a null doc_id; a doc_id that repeats gets its edits on every row. A row without
    edits has null; edits of a doc_id that no row has are not used. Other columns are not read.
    """
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "n_deleted", "inserted"))).alias("edits"))
    listed = listed.select("doc_id", F.transform("edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["n_deleted"].cast("long").alias("n_deleted"), e["inserted"].alias("inserted"))).alias("edits"))
    rows = docs.select("doc_id", "text")
    return rows.join(listed.withColumnRenamed("doc_id", "edited_id"), F.col("doc_id").eqNullSafe(F.col("edited_id")), "left").drop("edited_id")


def count_edited(docs: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """Token counts of ``docs`` (doc_id, text, edits) before and after their edits.

    Returns doc_id, n_tokens_before, n_tokens, n_units (after), n_reencoded (units encoded again),
    n_chars (after). Edits apply in order, each to the text as the ones before left it; a start
    beyond the text or a deletion past its end is cut off there.

    A null text counts as empty, null edits as none, null fields of an edit as 0 or empty. Repeated
    rows are counted each; a very long text is a tree of many leaves and counted whole; an empty table
    gives no rows; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_table(f"units {path}", lambda: UnitCounter(path))
        for batch in batches:
            got = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = CountedText(text, count)
                before = own.n_tokens
                for e in edits or ():
                    if e is not None:
                        own.edit(e["start"] or 0, e["n_deleted"] or 0, e["inserted"] or "")
                got.append((before, own.n_tokens, own.n_units, own.reencoded, own.n_chars))
            columns = list(zip(*got, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_tokens_before", "n_tokens", "n_units", "n_reencoded", "n_chars"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text"), F.col("edits").cast(EDITS).alias("edits")).mapInArrow(rows, f"doc_id {kind}, n_tokens_before long, n_tokens long, n_units long, n_reencoded long, n_chars long")


def scripted_edits(doc_id: Column, text: Column) -> Column:
    """Three edits that follow from a row: an insertion, a deletion across words, a replacement."""
    size, salt = F.char_length(text).cast("long"), F.crc32(doc_id.cast("string").cast("binary"))

    def edit(start: Column, n_deleted: Column, inserted: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), n_deleted.cast("long").alias("n_deleted"), inserted.alias("inserted"))

    return F.array(
        edit(F.pmod(salt, size + 1), F.lit(0), F.concat(F.lit(" passage "), doc_id.cast("string"), F.lit(" put in"))),
        edit(F.pmod(salt * 7, size + 1), F.lit(17), F.lit("")),
        edit(F.pmod(salt * 31, size + 1), F.lit(5), F.lit("it's\n ")),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_edited(docs.select("doc_id", "text", scripted_edits(F.coalesce("doc_id", F.lit(0)), text_of()).alias("edits")))
