"""License scans: exact phrases, and short notices with a bounded number of edits.

Texts are scanned in a normal form: ASCII capitals lowered, words (runs of ASCII letters and digits
and of characters beyond ASCII) set apart by single spaces.

*Base phrases* count where their words stand consecutively. *Notices* are longer wordings that may
be misspelt: a notice with at most ``k`` edits (inserted, deleted, replaced characters) is cut into
``k + 1`` pieces, of which at least one must occur unchanged (pigeonhole). Each occurrence of a piece
gives a window of its own, and the ``regex`` library's bounded-error matching verifies each window and
reports the span and its edits.
"""

from __future__ import annotations

import json
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices (in normal form) and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit-notice"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

#: ASCII bytes other than letters and digits become spaces; capitals become small letters.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_form(text: str) -> bytes:
    """Words of the text, one space before, between and after them."""
    words = text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()
    return b" " + b" ".join(words) + b" " if words else b""


@dataclass(frozen=True)
class Match:
    """A notice found at characters [start, end) of the normal form, with the number of its edits."""

    label: str
    start: int
    end: int
    edits: int
    length: int


class NoticeScanner:
    """Finds notices with bounded errors in texts of the normal form.

    Of matches that overlap, that with the smallest share of edits stays, then the longest.
    """

    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> None:
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for number, (notice, label) in enumerate(notices):
            k = max(1, len(notice) // chars_per_edit)
            bounds = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                pieces.setdefault(notice[a:b], []).append((number, a, len(notice) - b))
            self.notices.append((label, len(notice), k, regex.compile(rf"(?b)(?:{regex.escape(notice, special_only=True)}){{e<={k}}}")))
        for piece, places in pieces.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def __call__(self, text: str) -> list[Match]:
        windows: set[tuple[int, int, int]] = set()
        for last, (size, places) in self.seeds.iter(text):
            for number, before, after in places:
                k = self.notices[number][2]
                windows.add((number, max(0, last + 1 - size - before - k), min(len(text), last + 1 + after + k)))
        found: set[Match] = set()
        for number, start, end in windows:
            label, length, _, pattern = self.notices[number]
            # the pattern finds the best match of a window, so what lies before that is searched as well
            open_ = [(start, end)]
            while open_:
                a, b = open_.pop()
                if hit := pattern.search(text, a, b):
                    found.add(Match(label, hit.start(), hit.end(), sum(hit.fuzzy_counts), length))
                    open_ += [(c, d) for c, d in ((a, hit.start()), (hit.end(), b)) if d - c < b - a]
        best: list[Match] = []  # in order of place, without overlaps
        for m in sorted(found, key=lambda m: (m.edits / m.length, -m.length, m.start, m.label)):
            at = bisect(best, m.start, key=lambda o: o.start)
            if (at == 0 or best[at - 1].end <= m.start) and (at == len(best) or m.end <= best[at].start):
                best.insert(at, m)
        return best


SCHEMA = pa.schema(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
        ("labels", pa.string()), ("score", pa.float64()), ("n_notices", pa.int64()), ("spans", pa.string()),
    ]
)


def scan_text(text: str, scanner: NoticeScanner, base: tuple[tuple[str, str], ...] = BASE) -> tuple:
    """One row of ``SCHEMA`` for a text."""
    flat = normal_form(text)
    n_words = max(0, flat.count(b" ") - 1)
    starts, base_labels = [], set()
    for phrase, label in base:
        needle = b" " + phrase.encode() + b" "
        at = flat.find(needle)
        while at >= 0:
            starts.append(flat.count(b" ", 0, at))
            base_labels.add(label)
            at = flat.find(needle, at + 1)
    matches = scanner(flat.decode("utf-8", "surrogatepass"))
    score = 1.0 if starts else max((1 - m.edits / m.length for m in matches), default=0.0)
    return (
        n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | {m.label for m in matches})), score, len(matches), json.dumps([[m.label, m.start, m.end, m.edits] for m in matches]),
    )


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """License marks of every row of ``docs`` (doc_id, text).

    Returns doc_id and: n_words; n_base (places of base phrases), first_word and last_word (their
    smallest and largest first word, from 0, else null); base_labels and labels (distinct, sorted,
    comma-joined, empty if none; the latter with the notices' labels too); score (1 with a base
    phrase, else the best notice's share of unedited characters, 0 without any); n_notices and spans
    (JSON list of [label, start, end, edits] in characters of the normal form).

    A null text counts as empty: no words, no marks. Repeated rows are scanned each; texts are read whole,
    however long; an empty table gives no rows; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = NoticeScanner(notices, chars_per_edit)
        for batch in batches:
            got = [scan_text(text, scanner) for text in batch.column(1).to_pylist()]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), SCHEMA, strict=True)] if got else [pa.array([], f.type) for f in SCHEMA]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *SCHEMA.names])

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(
        rows, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_notices long, spans string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
