"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Two sets of word shingles link if their Jaccard similarity is at least ``num / den``. Sets fall into
bands of sizes such that linked sets are in the same or in neighbouring bands; a set takes part in its
own band and in the next. In a band whose largest size is ``u``, linked sets differ in at most ``K =
2 u (den - num) / (den + num)`` shingles. The domain of shingles is partitioned by a hash into ``K + 1
+ x`` parts: the differing shingles touch at most ``K`` of them, so the sets agree on at least ``1 +
x`` whole parts. A signature stands for the content of one part; linked sets share one.

Parts that a set has nothing in carry no information and get no signature. They matter only for a set
with ``1 + x`` or more empty parts, since with fewer any partner agrees with it on some part that is
not empty. Such a set is signed again under another partitioning, up to ``LEVELS`` times; what is
empty even then is signed as such. So no link is lost.

Signatures give candidates in two rounds, and never all pairs of a group. First every member of a
signature's group is compared with one centre of the group. Then only those groups whose members are
not yet in one component are looked at again, groups of the same members once: members outside a
group's largest component are held against all of other components, in tiles of bounded size, by a
lower bound on the sets' difference (parity sketches). Of the pairs that the bound lets pass, a tile
gives only a forest that spans them: less than one for each member. Those are verified by the whole
sets, a pair once however many groups it comes from. If all of a tile's forest are links, every pair
that passed there is within one component.

Groups of other tiles are looked at a last time, with the components as they are then. The pairs that
still pass join nodes to clusters, each node in one. A cluster is held together in tiles with the whole
sets, so what it gives is a forest of links and settles all of its pairs.

Equal sets are one node from the start, named by a 64-bit hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, bounded_batches, chunks, drop_shared, flat_ranges, forget_table, hashed_words, mixed, numbered, smallest, table, text_of, write_shared
from .components import connected_components

LEVELS = 4
#: A set's sketch has so many bits for each shingle in which a linked set of its size may differ, within these limits.
SKETCH_SHARE, SKETCH_LEAST, SKETCH_MOST = 32, 256, 1 << 16
#: Members of either side of a tile, and shingles that count as one member where whole sets are held.
BLOCK, MEMBER = 4096, 256
#: Orders by which a group's centre is chosen, so that a set meets different centres.
CENTRES = mixed(np.arange(16))
#: Bytes of text that are taken up at a time: what is held of them fits a processor's cache.
TAKE = 600_000


@dataclass(frozen=True)
class Similarity:
    """Words of a shingle, and the least similarity ``num / den`` of linked sets."""

    words: int = 5
    num: int = 80
    den: int = 100

    @cached_property
    def bands(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First sizes of the bands, and for each K and the number of parts."""
        first, difference, parts = [], [], []
        low = 1
        while low < 1 << 40:
            high = max(low, low * self.den // self.num)
            k = 2 * high * (self.den - self.num) // (self.den + self.num)
            first.append(low)
            difference.append(k)
            parts.append(k + 1 + -(-k // 10) + min(6, k // 2))
            low = high + 1
        return np.array(first), np.array(difference), np.array(parts)

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (a + b - common)

    def most_different(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most shingles in which linked sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct shingles of each text (UTF-8) as sorted 64-bit hashes.

    Shingles are ``n`` consecutive words; a text of fewer words is one shingle, one without words none.
    """
    hashes, counts = hashed_words(texts)
    total = len(hashes) - n + 1
    if total > 0:
        rolled = np.full(total, 0x9E3779B97F4A7C15 + n, np.uint64)
        for k in range(n):
            with np.errstate(over="ignore"):
                rolled = (rolled ^ hashes[k : k + total]) * np.uint64(0x9FB21C651E98DF25)
            rolled ^= rolled >> np.uint64(29)
        rolled = mixed(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= n:
            own = np.sort(rolled[at : at + count - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif count:
            one = np.uint64(0x51ED270B35A4C8E7 + count)
            for h in hashes[at : at + count]:
                one = mixed(np.array([one ^ h]))[0]
            out.append(np.array([one]))
        else:
            out.append(np.empty(0, np.uint64))
        at += count
    return out


def set_hash(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        total = mixed(shingles ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed(np.array([total])).view(np.int64)[0])


def signatures(sets: list[np.ndarray], like: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Which set (by number) has which signatures (unsigned 64-bit)."""
    first, difference, parts = like.bands
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    everything = np.concatenate([np.empty(0, np.uint64), *sets])
    own = np.searchsorted(first, np.maximum(sizes, 1), "right") - 1
    found_set, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for band in (own, own + 1):
        live = np.flatnonzero((sizes > 0) & (difference[band] > 0))
        for level in range(LEVELS):
            if not len(live):
                break
            n_parts = parts[band[live]]
            base = np.cumsum(n_parts) - n_parts
            length = sizes[live]
            starts = (np.cumsum(sizes) - sizes)[live]
            at = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())
            x = mixed(everything[at] + np.uint64(level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
            part = np.repeat(base, length) + ((x >> np.uint64(20)) % np.repeat(n_parts, length).astype(np.uint64)).astype(np.int64)
            total = int(n_parts.sum())
            with np.errstate(over="ignore"):
                content = np.bincount(part, (x & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64) + (np.bincount(part, (x >> np.uint64(32)).astype(np.float64), total).astype(np.uint64) << np.uint64(32))
            filled = np.bincount(part, minlength=total)
            which = np.repeat(np.arange(len(live)), n_parts)
            number = np.arange(total) - base[which]
            empty = np.bincount(which[filled == 0], minlength=len(live))
            at_risk = empty >= n_parts - difference[band[live]]
            keep = (filled > 0) | (at_risk[which] if level == LEVELS - 1 else False)
            tag = (band[live][which].astype(np.uint64) << np.uint64(48)) ^ (np.uint64(level) << np.uint64(44)) ^ number.astype(np.uint64)
            with np.errstate(over="ignore"):
                signed = mixed(content + filled.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mixed(tag))
            found_set.append(live[which[keep]])
            found.append(signed[keep])
            live = live[at_risk]
    return np.concatenate(found_set), np.concatenate(found)


def sketch(shingles: np.ndarray, like: Similarity) -> bytes:
    """Parities of counts: the sketches of two sets differ in no more bits than the sets in shingles."""
    bits = SKETCH_SHARE * int(like.most_different(len(shingles), len(shingles)))
    bits = max(SKETCH_LEAST, min(SKETCH_MOST, 1 << max(1, bits - 1).bit_length()))
    parity = np.bincount((shingles >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def unpacked(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit numbers, all folded to the length of the shortest, which keeps the bound."""
    least = min(map(len, sketches))
    if least < max(map(len, sketches)):
        sketches = [x if len(x) == least else np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, least), 0).tobytes() for x in sketches]
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _sorted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        yield batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, order): the members of every group of two or more, each with the group's first.

    The first itself comes as a member too, along with the second.
    """
    last_sig = last_order = last_first = None
    open_ = False  # whether the last group's first was given
    for sig, order in _sorted_batches(batches):
        if not len(sig):
            continue
        new = np.concatenate([[last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]])
        same = np.concatenate([[not new[0] and order[0] == last_order], (order[1:] == order[:-1]) & ~new[1:]])
        group = np.cumsum(new)  # 0: goes on from the batch before
        at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        first = np.where(at >= 0, order[np.maximum(at, 0)], last_first if last_first is not None else 0)
        keep = np.flatnonzero(~new & ~same & (order != first))
        second = keep[np.concatenate([[True], group[keep][1:] != group[keep][:-1]])] if len(keep) else keep
        if open_:
            second = second[group[second] > 0]
        if len(keep):
            rows = np.concatenate([second, keep])
            undo = CENTRES[(sig[rows].view(np.uint64) & np.uint64(15)).astype(np.int64)].view(np.int64)
            node = np.concatenate([first[second], order[keep]])
            yield pa.RecordBatch.from_arrays([pa.array(sig[rows]), pa.array(first[rows] ^ undo), pa.array(node ^ undo)], ["sig", "centre", "node"])
        open_ = bool(len(keep) and group[keep[-1]] == group[-1]) or (open_ and group[-1] == 0)
        last_sig, last_order, last_first = sig[-1], order[-1], first[-1]


def _nodes(docs: DataFrame, like: Similarity) -> DataFrame:
    """doc_id, n_shingles, node and mark (a hash of the text) of every row; node is null for a text without shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_table()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, TAKE):
                sets = shingle_sets(texts[a:b], like.words)
                found = [pa.array(list(map(len, sets)), pa.int64()), pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *found, batch.column(2).slice(a, b - a)], ["doc_id", "n_shingles", "node", "mark"])

    return docs.withColumn("mark", F.xxhash64("text")).mapInArrow(rows, f"doc_id {kind}, n_shingles long, node long, mark long")


def _signed(docs: DataFrame, like: Similarity) -> DataFrame:
    """sig and order (the node, changed by the signature's order of centres) of all sets, each once for a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_table()
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, TAKE):
                own: dict[int, np.ndarray] = {}
                for s in shingle_sets(texts[a:b], like.words):
                    if len(s) and (node := set_hash(s)) not in seen:
                        seen.add(node)
                        own[node] = s
                if own:
                    which, sig = signatures(list(own.values()), like)
                    node = np.fromiter(own, np.int64, len(own))[which]
                    order = node ^ CENTRES[(sig & np.uint64(15)).astype(np.int64)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(order)], ["sig", "order"])

    return docs.mapInArrow(rows, "sig long, order long")


def _sets(docs: DataFrame, wanted: DataFrame, like: Similarity) -> DataFrame:
    """node, n, sketch and shingles (sorted, 8 bytes each) of the ``wanted`` (doc_id, mark, node), once for each node."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nodes = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in chunks(texts, TAKE):
                sets = shingle_sets(texts[a:b], like.words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[a:b], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array([sketch(s, like) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                    ["node", "n", "sketch", "shingles"],
                )

    wanted = wanted.select(F.col("doc_id").alias("wanted_id"), F.col("mark").alias("wanted_mark"), "node")
    found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.xxhash64("text") == F.col("wanted_mark")))
    # rows that repeat, with an id or without, are merged within a task before they are shuffled
    return found.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(rows, "node long, n long, sketch binary, shingles binary")


def _sides(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col(column).alias(f"of_{end}")), end)
    return pairs.select("a", "b", "n_a", "n_b", "of_a", "of_b")


def _near(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """Those of ``pairs`` (a, b) that the sketches' bound lets pass."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            a, b = (batch.column(k).to_pylist() for k in (4, 5))
            length = np.fromiter((min(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(batch))
            apart = np.empty(len(batch), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                both = unpacked([a[k] for k in at.tolist()] + [b[k] for k in at.tolist()])
                apart[at] = np.bitwise_count(both[: len(at)] ^ both[len(at) :]).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((apart <= like.most_different(na, nb)) & like.linked(np.minimum(na, nb), na, nb)))

    return _sides(pairs, sets, "sketch").mapInArrow(rows, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = np.array([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            keep = like.linked(common, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(keep.astype(bool)))

    return _sides(pairs, sets, "shingles").mapInArrow(rows, "a long, b long")


def _tiles(groups: DataFrame, roots: DataFrame, least: int = 3) -> DataFrame:
    """sig, i, j, row, root and node: members of the ``groups`` (sig, node, size) that hold several components, in tiles.

    Groups of fewer than ``least`` members are left out: of a signature's two, the only pair has been verified.

    A group's members outside its largest component are dealt over blocks of a total size of about
    ``BLOCK``, as are those inside it. Tile (i, j) holds the outside block i as its rows, and with it the
    outside block j (if j > i) and the inside block j. Groups of the same members are taken once.
    """
    members = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    by_root = members.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), *names)
    held = by_root.groupBy("sig").agg(F.sum("n").alias("members"), F.max(F.struct("n", "root", "size")).alias("top"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("components"), *[F.bit_xor(c).alias(c) for c in "xy"])
    one = F.min(F.struct("sig", "top", "size")).alias("one")
    split = held.filter(f"components > 1 AND members >= {least}").groupBy("members", "x", "y").agg(one).select("one.*")
    out, inside = F.col("size") - F.col("top.size"), F.col("top.size")
    split = split.select("sig", F.col("top.root").alias("top"), F.ceil(out / BLOCK).cast("int").alias("out_blocks"), F.ceil(inside / BLOCK).cast("int").alias("in_blocks"))
    dealt = members.join(split, "sig").withColumn("row", F.col("root") != F.col("top"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("row"), F.col("out_blocks")).otherwise(F.col("in_blocks"))).cast("int"))
    rows = F.transform(F.sequence(F.lit(0), F.greatest("out_blocks", "in_blocks") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    before = F.when(F.col("block") > 0, F.transform(F.sequence(F.lit(0), F.col("block") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    inside = F.transform(F.sequence(F.lit(0), F.col("out_blocks") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    tiles = F.when(F.col("row"), F.concat(rows, before)).otherwise(inside)
    return dealt.select("sig", "row", "block", "root", "node", F.inline(tiles)).select("sig", "i", "j", (F.col("row") & (F.col("block") == F.col("i"))).alias("row"), "root", "node")


def spanning(row: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray, like: Similarity, sets: list[np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """A forest that spans a tile's pairs of different components (``root``) which may link, by their sketches ``bits``.

    Pairs have one or two members of ``row``. With whole ``sets`` they are pairs that do link.
    """
    own = np.unique(root, return_inverse=True)[1]
    place = np.arange(len(own))
    if sets is not None:
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        starts, held = np.cumsum(n) - n, np.zeros(int(codes.max()) + 1, bool)
    for k in np.flatnonzero(row).tolist():
        rest = np.flatnonzero((own != own[k]) & (~row | (place > k)))
        rest = rest[like.linked(np.minimum(n[rest], n[k]), n[rest], n[k])]
        apart = np.bitwise_count(bits[rest] ^ bits[k]).sum(1, dtype=np.int64)
        close = apart <= like.most_different(n[rest], n[k])
        rest, apart = rest[close], apart[close]
        if sets is not None and len(rest):
            mine = codes[starts[k] : starts[k] + n[k]]
            held[mine] = True
            common = np.add.reduceat(held[codes[flat_ranges(starts[rest], n[rest])]], np.cumsum(n[rest]) - n[rest], dtype=np.int64)
            held[mine] = False
            links = like.linked(common, n[rest], n[k])
            rest, apart = rest[links], apart[links]
        if len(rest):
            rest = rest[np.argsort(apart, kind="stable")]
            joined, first = np.unique(own[rest], return_index=True)
            yield from ((k, other) for other in rest[first].tolist())
            own[np.isin(own, joined)] = own[k]


def _across(tiles: DataFrame, sets: DataFrame, like: Similarity, column: str) -> DataFrame:
    """Pairs (sig, a, b) that span those of different components within the ``tiles``, less than one for each member.

    By ``column`` sketch they are pairs that the sketches' bound lets pass, by shingles links.
    """
    ordered = tiles.join(sets.select("node", "n", column), "node").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "node")

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(held)
        row, root, node, n = (tile.column(k).to_numpy() for k in ("row", "root", "node", "n"))
        given, whole = tile.column(column).to_pylist(), None
        if column == "shingles":
            whole = [np.frombuffer(x, "<u8") for x in given]
            given = [sketch(x, like) for x in whole]
        pairs = np.array(list(spanning(row, root, n, unpacked(given), like, whole)), np.int64).reshape(-1, 2)
        if len(pairs):
            ends = node[pairs]
            sig = np.full(len(pairs), tile.column("sig")[0].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(ends.min(1)), pa.array(ends.max(1))], ["sig", "a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_table()
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in ("sig", "i", "j")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if held and tuple(keys[a]) != key:
                    yield from found(held)
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from found(held)

    return ordered.mapInArrow(rows, "sig long, a long, b long")


def ngram_components(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """Components of linked rows of ``docs`` (doc_id, text).

    Returns doc_id, n_shingles (size of the row's set) and component_id (the smallest doc_id that
    links reach, its own included). A null or empty text has no shingles and links with nothing; equal
    sets link. Null doc_ids never are a component's id unless it has no other. Rows that repeat a
    doc_id are judged each by its own text. Sets of very long texts are whole. Empty tables give no rows;
    other columns are not read.
    """
    spark = bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", text_of().cast("binary").alias("text"))
    nodes, _ = write_shared(_nodes(docs, like), "ngram-nodes")
    signed = _signed(docs, like).repartition("sig").sortWithinPartitions("sig", "order")
    groups, groups_path = write_shared(signed.mapInArrow(_starred, "sig long, centre long, node long"), "ngram-groups")
    first = groups.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).filter("a <> b").distinct()
    members = groups.select("node").distinct()
    wanted = nodes.join(members, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("one")).select("one.*", "node")
    sets, sets_path = write_shared(_sets(docs, wanted, like), "ngram-sets")
    near, near_path = write_shared(_near(first, sets, like), "ngram-near")
    links, links_path = write_shared(_verified(near, sets, like), "ngram-links")
    roots = connected_components(links)
    paths = [groups_path, sets_path, near_path, links_path]
    one = F.lit(1.0).alias("size")
    found, found_path = write_shared(_across(_tiles(groups.select("sig", "node", one), roots), sets, like, "sketch"), "ngram-found")
    fresh, fresh_path = write_shared(found.select("a", "b").distinct().join(near, ["a", "b"], "left_anti"), "ngram-near")
    more, more_path = write_shared(_verified(fresh, sets, like), "ngram-links")
    paths += [found_path, fresh_path, more_path]
    if not more.isEmpty():
        links = links.union(more)
        roots = connected_components(links)
    failed = found.join(links, ["a", "b"], "left_anti").select("sig").distinct()
    if not failed.isEmpty():
        # the tiles read their groups twice, so these are written
        again, again_path = write_shared(groups.select("sig", "node", one).join(failed, "sig", "left_semi"), "ngram-again")
        still, still_path = write_shared(_across(_tiles(again, roots), sets, like, "sketch"), "ngram-found")
        size = F.greatest(F.lit(1.0), F.col("n") / MEMBER).alias("size")
        clusters = connected_components(still.select("a", "b")).withColumnRenamed("root", "sig").join(sets.select("node", "n"), "node").select("sig", "node", size)
        last, last_path = write_shared(_across(_tiles(clusters, roots, 2), sets, like, "shingles"), "ngram-links")
        paths += [again_path, still_path, last_path]
        if not last.isEmpty():
            roots = connected_components(links.union(last.select("a", "b")))
    drop_shared(spark, *paths)
    nodes = nodes.select("doc_id", "n_shingles", "node")
    least = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return nodes.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """One row of ``docs``, with its columns, of each component: that of the smallest doc_id.

    Null ids come last, and of rows with the same doc_id (or with null ones) the first stays. Rows that
    do not link never touch each other, whatever their ids.
    """
    rows = numbered(docs)
    found = ngram_components(rows.select(F.col(ROW).alias("doc_id"), "text"), like).filter("doc_id <> component_id")
    return smallest(rows, found.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("first")), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), Similarity(words=4, num=85, den=100))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), places AS (
  SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS shingle FROM places
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reached.doc_id, links.y FROM reached JOIN links ON reached.other = links.x
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reached r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
