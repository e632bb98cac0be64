"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

A document's features are its hashed words (tf, scaled to unit length) and dense statistics of its
structure and size. The score is the logistic of

    b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

where the bracket is the sum-of-squares form of all pairwise interactions, so that scoring takes
time in proportion to the number of features and not to its square. Id, source, language and label
columns are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_WORDS, Interner, WordHashes, bounded_batches, chunks, table, text_of, worker_table

#: Hash buckets for words; the dense statistics come after them.
BUCKETS = 1 << 15
FACTORS = 6
#: At most so many labelled rows train the model, chosen by a hash of their ids.
MAX_TRAIN_ROWS = 8000
STATISTICS = (
    "log_words", "log_chars", "mean_word_chars", "sd_word_chars", "upper_words", "symbol_end_words", "symbol_words", "digit_words",
    "non_ascii_words", "distinct_share", "top_word_share", "line_words", "repeated_lines", "end_punct_lines", "upper_chars", "space_share", "long_words", "capital_words",
)


class Features:
    """Turns texts into sparse rows: word buckets with values, and dense statistics."""

    def __init__(self) -> None:
        self.hashes = WordHashes()
        self._reset()

    def _reset(self) -> None:
        self.words, self.table, self.n = Interner(), np.empty((1 << 12, 9), np.float32), 0

    def _word_rows(self, words: list[str]) -> np.ndarray:
        if len(self.words) > MAX_WORDS:
            self._reset()
        at = self.words.take(words)
        if fresh := self.words.fresh:
            rows = np.empty((len(fresh), 9), np.float32)
            for i, w in enumerate(fresh):
                end = w[-1]
                letters = w.strip(".,;:!?\"'()")
                rows[i] = (len(w), w.isupper(), not (end.isalnum() or end in ".,;:"), not any(c.isalnum() for c in w), any(c.isdigit() for c in w), not w.isascii(), sum(map(str.isupper, w)), len(w) > 20, letters[:1].isupper() and not letters.isupper())
            if self.n + len(rows) > len(self.table):
                self.table = np.concatenate([self.table[: self.n], np.empty((max(len(rows), self.n), 9), np.float32)])
            self.table[self.n : self.n + len(rows)] = rows
            self.n += len(rows)
            self.words.fresh = []
        return self.table[at]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, buckets and values of the word features; the matrix of statistics."""
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for ws in split for w in ws]
        row = np.repeat(np.arange(len(texts)), counts)
        n = np.maximum(counts, 1).astype(np.float64)
        traits = self._word_rows(words) if words else np.empty((0, 9), np.float32)
        total = np.stack([np.bincount(row, traits[:, k], len(texts)) for k in range(9)], 1)
        squares = np.bincount(row, traits[:, 0].astype(np.float64) ** 2, len(texts))
        bucket = (self.hashes.take(words) % np.uint64(BUCKETS)).astype(np.int64) if words else np.empty(0, np.int64)
        keys, tf = np.unique(row * BUCKETS + bucket, return_counts=True)
        at, bucket = keys // BUCKETS, keys % BUCKETS
        norm = np.sqrt(np.bincount(at, tf.astype(np.float64) ** 2, len(texts)))
        value = tf / norm[at]
        top = np.zeros(len(texts))
        np.maximum.at(top, at, tf)
        lines = [t.split("\n") for t in texts]
        n_lines = np.fromiter(map(len, lines), np.float64, len(lines))
        chars = np.fromiter(map(len, texts), np.float64, len(texts))
        mean = total[:, 0] / n
        dense = np.stack(
            [
                np.log1p(counts), np.log1p(chars), mean, np.sqrt(np.maximum(squares / n - mean**2, 0)), total[:, 1] / n, total[:, 2] / n, total[:, 3] / n, total[:, 4] / n,
                total[:, 5] / n, np.bincount(at, minlength=len(texts)) / n, top / n, np.log1p(counts / n_lines), 1 - np.fromiter((len(set(x)) for x in lines), np.float64, len(lines)) / n_lines,
                np.fromiter((sum(x.endswith((".", "!", "?", ":")) for x in ls) for ls in lines), np.float64, len(lines)) / n_lines,
                total[:, 6] / np.maximum(total[:, 0], 1), 1 - total[:, 0] / np.maximum(chars, 1), total[:, 7] / n, total[:, 8] / n,
            ],
            1,
        )
        return at, bucket, value, dense


@dataclass
class FactorisationMachine:
    """Weights for word buckets and statistics; ``score`` in linear time."""

    bias: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + len(STATISTICS)))
    v: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + len(STATISTICS), FACTORS)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(STATISTICS)))
    sd: np.ndarray = field(default_factory=lambda: np.ones(len(STATISTICS)))

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.sd, -4, 4)

    def _sums(self, rows: int, at: np.ndarray, index: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        linear = np.bincount(at, self.w[index] * x, rows)
        s = np.stack([np.bincount(at, self.v[index, f] * x, rows) for f in range(FACTORS)], 1)
        squares = np.bincount(at, (self.v**2).sum(1)[index] * x**2, rows)
        return self.bias + linear + 0.5 * ((s**2).sum(1) - squares), s

    @staticmethod
    def joined(at: np.ndarray, bucket: np.ndarray, value: np.ndarray, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word features and statistics as one sparse list, ordered by row."""
        rows, k = scaled.shape
        order = np.argsort(np.concatenate([at, np.repeat(np.arange(rows), k)]), kind="stable")
        return (
            np.concatenate([at, np.repeat(np.arange(rows), k)])[order],
            np.concatenate([bucket, np.tile(np.arange(k) + BUCKETS, rows)])[order],
            np.concatenate([value, scaled.ravel()])[order],
        )

    def score(self, at: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
        if not len(dense):
            return np.empty(0)
        z, _ = self._sums(len(dense), *self.joined(at, bucket, value, self.scaled(dense)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, at: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.08, batch: int = 128, decay: float = 1e-4) -> FactorisationMachine:
        """Adagrad on the logistic loss, deterministic."""
        random = np.random.default_rng(7)
        self.mean, self.sd = dense.mean(0), dense.std(0) + 1e-6
        self.v = random.normal(0, 0.01, self.v.shape)
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(prior / (1 - prior)))
        at, index, x = self.joined(at, bucket, value, self.scaled(dense))
        starts = np.searchsorted(at, np.arange(len(y) + 1))
        gw, gv, gb = np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = random.permutation(len(y))
            for first in range(0, len(y), batch):
                rows = order[first : first + batch]
                lengths = starts[rows + 1] - starts[rows]
                take = np.repeat(starts[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                r, i, xi = np.repeat(np.arange(len(rows)), lengths), index[take], x[take]
                z, s = self._sums(len(rows), r, i, xi)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                used, slot = np.unique(i, return_inverse=True)
                e = error[r] * xi
                dw = np.bincount(slot, e, len(used)) + decay * self.w[used]
                dv = np.stack([np.bincount(slot, e * (s[r, f] - self.v[i, f] * xi), len(used)) for f in range(FACTORS)], 1) + decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                gb += error.sum() ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
                self.bias -= rate * error.sum() / np.sqrt(gb)
        return self


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out part, chosen by a hash of the id.

    The features are made on the executors; the driver gets those of ``max_rows`` texts at most.
    Null ids, labels and texts: rows without id or label are left out, a null text counts as empty.
    A doc_id that repeats in ``labels`` counts once, as does one that repeats in ``docs`` (with its least
    text). Ids may be of any type that has an order. Without any row the model scores 0.5.
    """
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # the broadcast has ``max_rows`` rows at most, and so has what is left of their texts
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = worker_table("features", Features)
        for batch in batches:
            ids, quality, texts_ = batch.column("doc_id"), batch.column("quality").to_pylist(), batch.column("text").to_pylist()
            for a, b in chunks(texts_):
                at, bucket, value, dense = make(texts_[a:b])
                cut = np.searchsorted(at, np.arange(b - a + 1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(a, b - a), "quality": pa.array(quality[a:b], pa.int32()),
                        "bucket": [bucket[cut[k] : cut[k + 1]].astype("<u2").tobytes() for k in range(b - a)],
                        "value": [value[cut[k] : cut[k + 1]].astype("<f4").tobytes() for k in range(b - a)],
                        "dense": [dense[k].astype("<f8").tobytes() for k in range(b - a)],
                    }
                )

    got: pd.DataFrame = texts.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(rows, f"doc_id {kind.simpleString()}, quality int, bucket binary, value binary, dense binary").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    model = FactorisationMachine()
    if got.empty:
        return model
    bucket = [np.frombuffer(x, "<u2").astype(np.int64) for x in got["bucket"]]
    at = np.repeat(np.arange(len(got)), [len(x) for x in bucket])
    value = np.concatenate([np.frombuffer(x, "<f4") for x in got["value"]]).astype(np.float64)
    dense = np.stack([np.frombuffer(x, "<f8") for x in got["dense"]])
    return model.fit(at, np.concatenate(bucket), value, dense, (got["quality"].to_numpy() > 0).astype(np.float64))


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id and score of every row of ``docs``; null and empty texts are scored as empty ones.

    Repeated rows are scored each; texts are read whole, however long; an empty table gives no rows; other
    columns are not read.
    """
    held = bounded_batches(docs.sparkSession).sparkContext.broadcast((model.bias, model.w.astype(np.float32), model.v.astype(np.float32), model.mean, model.sd))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, own = worker_table("features", Features), FactorisationMachine(*held.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(own.score(*make(texts[a:b])), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns, whatever these are named.

    A null or empty text is scored as an empty one and stays as it is; repeated rows are judged each, by
    their own text; texts are read whole, however long. Without labels every row scores 0.5. An empty
    table gives no rows.
    """
    held = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((held.bias, held.w.astype(np.float32), held.v.astype(np.float32), held.mean, held.sd))
    names, at = docs.columns, docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, own = worker_table("features", Features), FactorisationMachine(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in chunks(texts):
                yield batch.slice(a, b - a).filter(pa.array(own.score(*make(texts[a:b])) >= threshold))

    return docs.select(names).mapInArrow(rows, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
