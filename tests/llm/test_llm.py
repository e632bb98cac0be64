"""Each operator against a brute-force version, a round trip or a library, and on edge cases."""

import base64
import collections
import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from voxelake.llm import (
    catalogue,
    chat_format,
    common,
    components,
    decontamination,
    edit_counts,
    exact_dedup,
    license_scan,
    ngram_join,
    quality,
    sentencepiece_codec,
    suffix_dedup,
    token_files,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, node string, words string, sig string"
ODD = [None, "", " ", "\n", "a", "a a a a a a a a", "é日本 \U0001f600 x", "x" * 3000, "word " * 2000, "\0 nul", "tab\tand\x0bvt"]


def docs_of(spark, texts, first=0):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(first + i, t, "n", "w", "s") for i, t in enumerate(texts)], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def prose(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


RUN = {
    "op1": lambda d: sentencepiece_codec.encode(d),
    "op2": license_scan.scan,
    "op3": lambda d: quality.score(d, quality.FactorisationMachine()),
    "op4": lambda d: edit_counts.count_edited(d.withColumn("edits", F.lit(None).cast(edit_counts.EDITS))),
    "op5": suffix_dedup.suffix_dedup,
    "op6": exact_dedup.exact_dedup,
    "op7": ngram_join.ngram_components,
    "op10": token_files.token_digests,
}


@pytest.mark.parametrize("name", RUN)
def test_every_row_comes_back_once(spark, name):
    odd = docs_of(spark, ODD).unionByName(spark.createDataFrame([(None, "x", "", "", ""), (3, "again", "", "", ""), (3, "again", "", "", "")], SCHEMA))
    assert sorted(r.doc_id or -1 for r in RUN[name](odd).select("doc_id").collect()) == sorted([*range(1, len(ODD)), -1, 3, 3, -1])
    assert RUN[name](docs_of(spark, [])).count() == 0


def test_sentencepiece_equals_library(prose):
    path = f"{sentencepiece_codec.TOKENIZERS}/{sentencepiece_codec.MODEL}"
    library, encoder, decoder = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Encoder(path), sentencepiece_codec.Decoder(path)
    r = random.Random(1)
    made = ["".join(r.choice("ab  the\n\t'sé日\x1c　 1.!▁\0ﬃ") for _ in range(r.randrange(30))) for _ in range(500)]
    for text in [t for t in ODD if t] + made + prose[:60] + [" " * k for k in range(40)] + ["<s></s><unk><0x0A>"]:
        ids = encoder(text)
        assert ids.tolist() == library.encode(text)
        assert decoder(ids) == text.replace("▁", " ")


def test_seams_are_looked_at_once(monkeypatch, prose):
    """Units that are learned again, and pieces of a known alphabet, are not worked out anew."""
    encoder = sentencepiece_codec.Encoder(f"{sentencepiece_codec.TOKENIZERS}/{sentencepiece_codec.MODEL}")
    looked, compatible = [], encoder.pieces.compatible
    monkeypatch.setattr(encoder.pieces, "compatible", lambda u, t: looked.append(len(u)) or compatible(u, t))
    first = encoder.batch(prose[:60])
    n = sum(looked)
    encoder._reset()
    words = encoder.words
    assert all((x == y).all() for x, y in zip(first, encoder.batch(prose[:60]), strict=True))
    assert sum(looked) - n < sum(map(len, prose[:60])) // 50 and encoder.words is words


def test_units_met_often_outlast_the_table(monkeypatch):
    """Letting go of a full table keeps what is asked for again and again, in any alphabet."""
    path = f"{sentencepiece_codec.TOKENIZERS}/{sentencepiece_codec.MODEL}"
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Encoder(path)
    monkeypatch.setattr(sentencepiece_codec, "MAX_WORDS", 60)
    draw, learned, learn = random.Random(7), [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda units: learned.extend(units) or learn(units))
    alphabets = ["abcdefgh", "абвгдежз", "日本語中文字的一", "".join(map(chr, range(0x4E00, 0x5200))), "가나다라마바사아", "éàüößñç\0"]
    for k in range(60):
        texts = ["of the " + " ".join("".join(draw.choices(alphabets[k % 6], k=draw.randrange(1, 30))) for _ in range(20)) for _ in range(3)]
        assert [x.tolist() for x in encoder.batch(texts)] == [library.encode(t) for t in texts]
    assert learned.count(" the") == 1 and len(encoder.units) == encoder.n <= 60 + 3 * 22


def test_decode_frame(spark):
    coded = sentencepiece_codec.encode(docs_of(spark, ["a  b\né", None]))
    assert {k: r.text for k, r in by_id(sentencepiece_codec.decode(coded)).items()} == {0: "a  b\né", 1: ""}


def test_license_scan():
    s = license_scan.NoticeScanner()
    row = lambda t: dict(zip(license_scan.SCHEMA.names, license_scan.scan_text(t, s), strict=True))
    got = row("A MIT-license, apache  License; mit licenses. mit license")
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"], got["score"]) == (9, 3, 1, 7, "apache,mit", 1.0)
    got = row("xx Relased under the MIT Licence yy")
    assert got["labels"] == "mit-notice" and got["n_base"] == 0 and got["first_word"] is None and 0 < got["score"] < 1
    assert row("licensed under the gnu general public license version 3 this work is")["base_labels"] == "gpl"
    assert row("nothing here")["score"] == 0 and row("")["n_words"] == 0
    three = row("this work is licensed under the gnu general public license version 3")
    assert three["labels"] == "gpl,gpl-3.0"


def test_notices_with_few_edits_are_found():
    s, r = license_scan.NoticeScanner(), random.Random(3)
    for notice, label in license_scan.NOTICES:
        for _ in range(5):
            text = list(notice)
            for _ in range(max(1, len(notice) // license_scan.CHARS_PER_EDIT) - 1):
                text[r.randrange(len(text))] = r.choice("qxz")
            assert any(m.label == label or m.edits <= 2 for m in s(f"before {''.join(text)} after")), (label, "".join(text))


def edit_distances(notice, text):
    """For each place of the text the least edits of the notice against any stretch that ends there."""
    row = list(range(len(notice) + 1))
    out = []
    for c in text:
        before, row[0] = row[0], 0
        for k, d in enumerate(notice, 1):
            before, row[k] = row[k], min(before + (c != d), row[k] + 1, row[k - 1] + 1)
        out.append(row[-1])
    return out


def spoilt(draw, text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = draw.randrange(len(out)), draw.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [draw.choice("qxz e")]
    return "".join(out)


def test_notices_equal_brute_force_under_all_kinds_of_edits():
    s, draw = license_scan.NoticeScanner(), random.Random(13)
    found_all = 0
    for notice, _ in license_scan.NOTICES:
        most = max(1, len(notice) // license_scan.CHARS_PER_EDIT)
        for edits in range(most + 3):
            text = license_scan.normal_form(f"words before {spoilt(draw, notice, edits)} and after").decode()
            found = s(text)
            for m in found:
                own = next(n for n, label in license_scan.NOTICES if label == m.label)
                assert edit_distances(own, text[m.start : m.end])[-1] <= m.edits <= max(1, len(own) // license_scan.CHARS_PER_EDIT)
            for other, label in license_scan.NOTICES:
                k = max(1, len(other) // license_scan.CHARS_PER_EDIT)
                ends = [e for e, d in enumerate(edit_distances(other, text), 1) if d <= k]
                # wherever any stretch is near enough, a match of this notice or a better one lies there
                assert all(any(m.start - k <= e <= m.end + k for m in found) for e in ends), (label, text)
                found_all += bool(ends)
    assert found_all > 50


def test_quality_held_out(spark):
    got = quality.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out")
    assert got.filter("predicted = quality").count() >= 0.97 * got.count()
    assert quality.train(docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int")).bias == 0


def test_quality_scores_equal_the_double_sum(spark, prose):
    """Every score against the plain sum over pairs, from the model that training gives."""
    docs = docs_of(spark, [*prose[:30], None, "", "a"])
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = by_id(quality.score(docs, model))
    make = quality.Features()
    w, v = model.w.astype(np.float32).astype(float), model.v.astype(np.float32).astype(float)
    for k, text in enumerate([*prose[:30], "", "", "a"]):
        at, bucket, value, dense = make([text])
        _, index, x = model.joined(at, bucket, value, model.scaled(dense))
        z = model.bias + (w[index] * x).sum() + sum(v[index[a]] @ v[index[b]] * x[a] * x[b] for a, b in itertools.combinations(range(len(x)), 2))
        assert got[k].score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-6)


def test_quality_of_other_ids_and_columns(spark, prose):
    docs = spark.createDataFrame([(f"d{k % 20}" if k % 7 else None, t, k) for k, t in enumerate([*prose[:40], None])], "doc_id string, text string, quality int")
    labels = spark.createDataFrame([*((f"d{k}", k % 2) for k in range(20)), ("d1", 1), (None, 1), ("d2", None)], "doc_id string, quality int")
    model = quality.train(docs, labels, max_rows=7)
    assert quality.score(docs, model).count() == 41
    kept = quality.accepted(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == 41 and quality.accepted(docs, labels, 1.1).count() == 0
    assert quality.accepted(docs.limit(0), labels.limit(0)).count() == 0


def test_sum_of_squares_identity():
    random_ = np.random.default_rng(0)
    m = quality.FactorisationMachine(v=random_.normal(size=(quality.BUCKETS + len(quality.STATISTICS), quality.FACTORS)))
    index, x = np.array([3, 9, 40]), np.array([0.5, 2.0, -1.0])
    z, _ = m._sums(1, np.zeros(3, int), index, x)
    assert np.isclose(z[0], sum(m.v[index[a]] @ m.v[index[b]] * x[a] * x[b] for a, b in itertools.combinations(range(3), 2)))


def test_edits_equal_full_counts():
    path = f"{edit_counts.TOKENIZERS}/{edit_counts.VOCABULARY}"
    count, whole, r, letters = edit_counts.UnitCounter(path), edit_counts.encoding(path), random.Random(1), "ab  \n\t'sé日\x1c\x85　 1.!"
    for _ in range(400):
        own = edit_counts.CountedText("".join(r.choice(letters) for _ in range(r.randrange(40))), count)
        for _ in range(4):
            assert own.n_tokens == len(whole.encode_ordinary(own.text)) and own.n_chars == len(own.text)
            own.edit(r.randrange(-2, 45), r.randrange(10), "".join(r.choice(letters) for _ in range(r.randrange(6))))


@pytest.mark.parametrize("leaf", [1, 3])
def test_edits_over_many_leaves(monkeypatch, leaf):
    monkeypatch.setattr(edit_counts, "LEAF", leaf)
    path = f"{edit_counts.TOKENIZERS}/{edit_counts.VOCABULARY}"
    count, whole, r, letters = edit_counts.UnitCounter(path), edit_counts.encoding(path), random.Random(leaf), "ab  \n'sé日\x85　1."
    for _ in range(60):
        text = "".join(r.choice(letters) for _ in range(r.randrange(200)))
        own = edit_counts.CountedText(text, count)
        for _ in range(25):
            start, n, new = r.randrange(-2, 205), r.choice([0, 0, 1, 5, 120]), "".join(r.choice(letters) for _ in range(r.choice([0, 3, 40])))
            own.edit(start, n, new)
            start = min(max(start, 0), len(text))
            text = text[:start] + new + text[start + n :]
            assert own.text == text and own.n_tokens == len(whole.encode_ordinary(text))
            assert own.n_units == len(edit_counts.UNIT.findall(text)) and own.n_chars == len(text)


def test_edits_of_a_long_text_touch_few_nodes():
    count, r = edit_counts.UnitCounter(f"{edit_counts.TOKENIZERS}/{edit_counts.VOCABULARY}"), random.Random(2)
    own = edit_counts.CountedText("some words " * 450_000, count)
    for k in range(300):
        before = own.touched, own.reencoded
        own.edit(r.randrange(own.n_chars) if k % 2 else 2_000_000, r.randrange(12), "and more of them ")
        assert own.touched - before[0] < 150 and own.reencoded - before[1] < 20


def test_edits_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, None), (2, "a")], "doc_id long, text string")
    edits = spark.createDataFrame([(None, 1, 0, 1, "x "), (1, None, 0, 0, "y "), (1, 0, 0, 1, None), (9, 0, 0, 0, "z")], "doc_id long, seq int, start long, n_deleted long, inserted string")
    got = edit_counts.count_edited(edit_counts.with_edits(docs, edits)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 4), (1, 1), (1, 4), (2, 1)]


def test_edits_reencode_little(spark):
    docs = docs_of(spark, ["word " * 5000])
    edits = spark.createDataFrame([(0, 1, 10000, 3, "new"), (0, 0, 5, 0, "x")], "doc_id long, seq int, start long, n_deleted long, inserted string")
    got = edit_counts.count_edited(edit_counts.with_edits(docs, edits)).first()
    assert got.n_reencoded < 20 and got.n_chars == 25001


def removed(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((len(t), int(cover.sum()), runs, hashlib.sha256(bytes(b for b, c in zip(t, cover, strict=True) if not c)).hexdigest()))
    return out


def test_suffix_dedup(spark, prose):
    r = random.Random(4)
    texts = prose[:60] + [prose[3][10:700] + "ü" * 300, "ab" * 400, "a" * 199, "a" * 200, None] + ["".join(r.choice("ab") for _ in range(600)) for _ in range(4)]
    got = by_id(suffix_dedup.suffix_dedup(docs_of(spark, texts)))
    raw = [(t or "").encode() for t in texts]
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == removed(raw, 200)
    assert all(len(got[i].kept) == len(raw[i]) - got[i].n_removed == len(raw[i]) - sum(b - a for a, b in got[i].spans) for i in range(len(texts)))


@pytest.mark.parametrize("limit", [1, 3000])
def test_suffix_dedup_of_large_buckets(spark, monkeypatch, limit):
    """A string of 40 bytes in many surroundings, a passage that many texts share, and copies of both."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", limit)
    r = random.Random(11)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, passage = noise(40), noise(260)
    texts = [noise(150) + line + noise(150) for _ in range(40)] + [noise(90) + passage + noise(90) for _ in range(30)]
    texts += [texts[3], texts[50] + "x", noise(50) + texts[4][20:320], passage[:210], "ab" * 300, None]
    got = by_id(suffix_dedup.suffix_dedup(docs_of(spark, texts)))
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == removed([(t or "").encode() for t in texts], 200)


def test_suffix_order():
    r = random.Random(2)
    for _ in range(40):
        data = bytes(r.choice(b"ab") for _ in range(r.randrange(1, 300))) + b"ab" * r.randrange(200)
        at = np.array(sorted(r.sample(range(len(data)), min(len(data), 200))))
        order = suffix_dedup.suffix_order(np.frombuffer(data, np.uint8), at).tolist()
        assert order == sorted(at.tolist(), key=lambda i: data[i:])


def test_exact_dedup_with_colliding_digests(spark):
    texts = ["a b", "a \t b", "c", None, "", "a b", "d"] * 3
    docs = docs_of(spark, texts)
    plain, collided = by_id(exact_dedup.exact_dedup(docs)), by_id(exact_dedup.exact_dedup(docs, digest=lambda t: F.length(t) % 2))
    assert plain == collided and plain[1].keep_id == 0 and plain[3].group_size == 6
    assert sorted(r.doc_id for r in exact_dedup.kept_rows(docs).collect()) == [0, 2, 3, 6]


def classes(texts, n, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (1, 50)])
def test_ngram_components(spark, prose, n, num):
    r = random.Random(n)
    texts = [*ODD, "one two", "one  TWO", *prose[:25]]
    for base in (prose[1].split()[:60], prose[2].split()[:200], "a b c d e f g h".split()):
        for _ in range(12):
            own = list(base)
            for _ in range(r.randrange(1, 4)):
                own[r.randrange(len(own))] = f"w{r.randrange(9)}"
            texts.append(" ".join(own))
    got = by_id(ngram_join.ngram_components(docs_of(spark, texts), ngram_join.Similarity(n, num, 100)))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == classes(texts, n, num, 100)


def test_near_copies_that_hardly_miss_a_link(spark, monkeypatch):
    """Groups of near copies give rows in proportion to their members, and all of their links."""
    draw = random.Random(11)
    base = [f"b{k}" for k in range(100)]
    # copies changed at one place link; of different places they differ in one shingle too many, which the sketches can't always tell
    texts = [" ".join([*base[:at], f"x{draw.randrange(10**9)}", *base[at + 1 :]]) for at in (draw.randrange(4, 96, 4) for _ in range(300))]
    rows = {"ngram-groups": 0, "ngram-found": 0}

    def counted(df, name):
        table, path = common.write_shared(df, name)
        if name in rows:
            rows[name] += table.count()
        return table, path

    monkeypatch.setattr(ngram_join, "write_shared", counted)
    got = by_id(ngram_join.ngram_components(docs_of(spark, texts), ngram_join.Similarity(4, 85, 100)))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == classes(texts, 4, 85, 100)
    assert 0 < rows["ngram-found"] < rows["ngram-groups"]


def test_groups_of_the_last_look_are_joined_once(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"b{k}" for k in range(100)]
    texts = [" ".join([*base[:at], f"x{draw.randrange(10**9)}", *base[at + 1 :]]) for at in (draw.randrange(4, 96, 4) for _ in range(300))]
    names = []
    monkeypatch.setattr(ngram_join, "write_shared", lambda df, name: (names.append(name), common.write_shared(df, name))[1])
    got = by_id(ngram_join.ngram_components(docs_of(spark, texts), ngram_join.Similarity(4, 85, 100)))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == classes(texts, 4, 85, 100)
    assert names.count("ngram-again") == 1


def test_forest_of_a_tile_spans_its_links():
    draw = np.random.default_rng(3)
    like = ngram_join.Similarity(4, 85, 100)
    for _ in range(20):
        bases = [draw.integers(0, 2**63, 60, dtype=np.uint64) for _ in range(3)]
        sets = []
        for _ in range(40):
            own = bases[draw.integers(3)].copy()
            own[draw.integers(0, 60, draw.integers(0, 7))] = draw.integers(0, 2**63, dtype=np.uint64)
            sets.append(np.unique(own))
        n = np.array([len(s) for s in sets])
        row, root = draw.random(40) < 0.6, draw.integers(0, 30, 40)
        bits = ngram_join.unpacked([ngram_join.sketch(s, like) for s in sets])
        links = [(a, b) for a, b in itertools.combinations(range(40), 2) if (row[a] or row[b]) and like.linked(len(np.intersect1d(sets[a], sets[b])), n[a], n[b])]

        def parts(pairs, label=root):
            label = label.copy()
            for a, b in pairs:
                label[label == label[b]] = label[a]
            return {(a, b) for a, b in itertools.combinations(range(40), 2) if label[a] == label[b]}

        found = list(ngram_join.spanning(row, root, n, bits, like, sets))
        assert {tuple(sorted(p)) for p in found} <= set(links) and parts(found) == parts(links)
        near = list(ngram_join.spanning(row, root, n, bits, like))
        assert parts(near) >= parts(links) and max(len(found), len(near)) < len(np.unique(root))


def test_memory_of_a_tile_of_near_copies():
    """What a tile holds follows its members, not its pairs: these 4.5 million would take 100 MB."""
    draw = np.random.default_rng(8)
    like = ngram_join.Similarity(5, 80, 100)
    base = draw.integers(0, 2**63, 100, dtype=np.uint64)
    bits = np.stack([ngram_join.unpacked([ngram_join.sketch(np.append(base, x), like)])[0] for x in draw.integers(0, 2**63, 3000, dtype=np.uint64)])
    tracemalloc.start()
    found = list(ngram_join.spanning(np.ones(3000, bool), np.arange(3000), np.full(3000, 101), bits, like))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2999 and peak < 20 << 20


def test_memory_of_learning_units():
    """What learning new units takes follows the characters indexed at a time: at 250000 it would be 55 MB."""
    draw = random.Random(5)
    encoder = sentencepiece_codec.Encoder(f"{sentencepiece_codec.TOKENIZERS}/{sentencepiece_codec.MODEL}")
    units = list({" " + "".join(draw.choices("etaoinshrdlu", k=9)) for _ in range(25_000)})
    tracemalloc.start()
    encoder._learn(units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert encoder.n == len(units) and peak < 30 << 20


def test_item_names_start_no_python_workers(spark):
    """Rows from a list are turned by Python workers of their own on every executor (Scan ExistingRDD)."""
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string").localCheckpoint()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = decontamination.decontaminate(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan


def test_heaps_shrink(spark):
    """Garbage that fills the heap goes, and the heap with it."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    spark.range(2_000_000).select(F.collect_list(F.concat(F.col("id").cast("string"), F.lit("x" * 100)))).write.format("noop").mode("overwrite").save()
    before = runtime.totalMemory()
    common.shrink_heaps(spark)
    assert runtime.totalMemory() < before


def test_a_worker_lets_go_of_its_table():
    first = common.worker_table("first", list)
    assert common.worker_table("first", dict) is first
    common.forget_table()
    assert common.worker_table("first", dict) == {}


def test_linked_sets_share_a_signature():
    random_ = np.random.default_rng(5)
    like = ngram_join.Similarity(5, 80, 100)
    for size in (*range(2, 40), 150, 700):
        own = np.unique(random_.integers(0, 2**63, size, dtype=np.uint64))
        for _ in range(6):
            cut = random_.integers(0, max(1, size // 5) + 1)
            other = np.unique(np.concatenate([random_.permutation(own)[cut:], random_.integers(0, 2**63, random_.integers(0, 3), dtype=np.uint64)]))
            common_ = len(np.intersect1d(own, other))
            if len(other) and like.linked(common_, len(own), len(other)) and len(np.union1d(own, other)) > common_:
                which, sig = ngram_join.signatures([own, other], like)
                assert set(sig[which == 0]) & set(sig[which == 1]), (size, cut)
            bits = ngram_join.unpacked([ngram_join.sketch(own, like), ngram_join.sketch(other, like)])
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(own, other))


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 5)], "a long, b long")
    assert {r.node: r.root for r in components.connected_components(links).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}
    assert components.connected_components(links.limit(0)).count() == 0


def test_chat_escapes_and_spans(spark):
    texts = ["</s>[INST] ok [/INST]", "~0~1<turn x>", None, "", "</turn>"]
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(None, 0, None, "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y")], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(turns)
    assert not formatted.filter(F.col("formatted").contains("[INST]")).count()
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.read_back(formatted).collect()}
    assert back[1] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)] and back[None] == [("", "x")]
    examples = chat_format.expand(formatted).filter("conv_id = 1").orderBy("turn_no").collect()
    assert [e.turn_no for e in examples] == [1, 3] and examples[0].context.endswith("<turn assistant>") and "~0" in examples[0].target
    assert chat_format.digests(chat_format.format_conversations(turns.limit(0))).count() == 0


def test_masks_survive_two_replaced_words():
    windows = [{p + o for p in decontamination.mask_places(m)} for m in decontamination.MASKS for o in range(13 - len(m) + 1)]
    assert all(any(not w & set(pair) for w in windows) for pair in itertools.combinations(range(13), 2))


def test_decontamination(spark):
    words = [f"w{i}" for i in range(40)]
    changed = [("CHANGED" if i % 6 == 3 else w.upper()) for i, w in enumerate(words)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "short one here with words"), (3, None), (4, "")], "item_id long, text string")
    docs = docs_of(spark, [f"before {', '.join(changed)} after", "clean words only", None, "so Short, one HERE with words", " ".join(words[:9]), f"x {' '.join(words[10:30])}", "short one there with words"])
    got = {(r.doc_id, r.item_id): r for r in decontamination.decontaminate(docs, bench).collect()}
    assert set(got) == {(0, 1), (3, 2), (5, 1)} and got[0, 1].first_word == 1 and got[5, 1].n_equal == 20
    parts = {(r.doc_id, r.item_id) for r in decontamination.decontaminate(docs, bench, part_words=10).collect()}
    assert parts == set(got)
    assert sorted(r.doc_id for r in decontamination.clean_rows(docs, bench).collect()) == [1, 2, 4, 6]
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[5], list(range(1000)), [0] * 5000, [49407] * 300])
def test_block_round_trip(ids):
    ids = np.array(ids, np.int64)
    lanes, payload = token_files.encode_block(ids, 49408)
    assert (token_files.decode_block(payload, len(ids), lanes, 49408) == ids).all()


def test_segment_checks_itself():
    random_ = np.random.default_rng(1)
    documents = [random_.integers(0, 49408, n) for n in (0, 5, 3000)]
    data = token_files.write_segment(documents, 49408)
    read = token_files.read_segment(data, 49408)
    assert all((a == b).all() for a, b in zip(documents, read.documents, strict=True)) and read.names.to_pylist() == [0, 1, 2]
    for bad in (b"", b"xxxx" + data[4:], data[:-40], data[:-9] + bytes([data[-9] ^ 255]) + data[-8:]):
        with pytest.raises(token_files.CorruptSegment):
            token_files.read_segment(bad, 49408)


GOLDEN = (
    "VlhUSwIDAAAAegAAAAAAAAABAAAAAwAAAAsAAAAAAAAAkAAAAHicXU87DsIwFHOakBSUoUOFOnIQht6kA12YuAIjtw5+T5YasPR+eY7jtNbaG8AEwwUVGSeM7IiQOIPTyJyUecyY/c7Ms4zirEkaYbB6E9eQGfvrsT1306qM4lpGXsWhjfaRrqHiKifV1RETFulCXhdukrze9YeIA0PXB1W961r9Lv7xMn5RVM+dX6tf"
    "IwgSZz0AAAAAAAAAPQAAAHoAAAABAAAApgAAAMEVEHNRAAAAx37Zn3WfTPegTTpwpgG/pr8yc5NSsZvaELJtPIVeP90yKz6e4I2IiJsOx15ctbsXuL7BgCgQFXSLh06JbAM+Yv//nXDBrkkydOBTuCRm/YaRDSO/VvvAxgHfq+WpRKTEQdXHP3vPPSzjOOEactrfwzLXinLNNi4eqF+uA68vdRWwKQQEZBeJ9Db8vLNcRlHFS6bVsdD5qyLI6o3soZLr/LY+"
)


def test_a_segment_written_once_is_read_by_any_build():
    read = token_files.read_segment(base64.b64decode(GOLDEN), 1000)
    assert [d.tolist() for d in read.documents] == [[5, 6, 7] * 20 + [2], [], [k * k % 1000 for k in range(60)] + [2]]
    assert (read.names.to_pylist(), read.file_no, read.n_before) == ([None, 7, 9], 3, 11)


def test_places_in_the_tables_need_no_cast():
    model = token_files.Mixer(100, 8)
    for step in range(3):
        ids = (np.arange(8, dtype=np.int32) * 7 + step) % 100
        model.predict(8)
        model.intervals(ids)
        model.learn(ids)
        assert {x.dtype for x in (model.slot, model.row, model.before, model.before2)} == {np.dtype(np.intp)}


def test_a_block_is_smaller_than_order_0_allows(prose):
    words = token_files.WordTokens(f"{token_files.TOKENIZERS}/{token_files.VOCABULARY}")
    ids = np.concatenate([np.append(x, token_files.END_ID) for x in words.batch(prose)])
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    _, payload = token_files.encode_block(ids, 49408)
    assert 8 * len(payload) < 0.98 * len(ids) * -(share * np.log2(share)).sum()


def test_intervals_of_all_ids_fill_the_range():
    model, random_ = token_files.Mixer(300, 40), np.random.default_rng(3)
    for _ in range(60):
        model.predict(40)
        spans = [model.intervals(np.full(40, k, np.int32)) for k in range(300)]
        ends = np.zeros(40, np.uint64)
        for low, size in spans:
            assert (low == ends).all() and (size > 0).all()
            ends = low + size
        assert (ends == 1 << token_files.TOTAL_BITS).all()
        k = int(random_.integers(0, 300))
        assert all((model.find(place.astype(np.int64)) == k).all() for place in (spans[k][0], spans[k][0] + spans[k][1] - np.uint64(1)))
        ids = random_.integers(0, 12, 40).astype(np.int32)
        model.predict(40)
        model.intervals(ids)
        model.learn(ids)


def test_words_across_stretches(monkeypatch, prose):
    words = token_files.WordTokens(f"{token_files.TOKENIZERS}/{token_files.VOCABULARY}")
    texts = ["", "x" * 90, " \n ", "THE!! the!! The é É, Éa.b É.. ÷, a× \xc3", *prose[:3]]
    want = [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for size in (7, 64):
        monkeypatch.setattr(token_files, "STRETCH", size)
        monkeypatch.setattr(token_files, "TABLE_LISTS", 50)
        assert [x.tolist() for x in words.batch(texts)] == want
        assert [words(t.encode()).tolist() for t in texts] == want


def test_words_are_merged_as_by_the_library(monkeypatch, prose):
    """Ordinary words don't go to the library, and have its ids."""
    words = token_files.WordTokens(f"{token_files.TOKENIZERS}/{token_files.VOCABULARY}")
    draw = random.Random(3)
    odd = ["".join(draw.choices("aabeinstzAEÉéßÿÀ0129!!..,&%#<|>~_-()'×÷ªñ", k=draw.randint(1, 40))) for _ in range(4000)]
    texts = [*prose[:20], "", "'", " ".join(odd), *(f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1" for c in range(33, 0x180)), "<|endoftext|> x<|startoftext|>y <| |>"]
    assert [x.tolist() for x in words.batch(texts)] == [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [len(x) for x in words.batch(["'", ""])] == [1, 0]
    plain = "Zwischenzeitlich fragments, ÉTÉ!! (see) 2024 a&&& " + "q" * 32
    want = words.tokenizer.encode(plain, add_special_tokens=False).ids
    words._reset()
    monkeypatch.setattr(words, "tokenizer", None)
    monkeypatch.setattr(words, "_others", lambda units: (np.zeros(0, np.int64), np.zeros(0, np.int32)) if not units else pytest.fail(f"to the library: {units}"))
    assert words.batch([plain])[0].tolist() == want


def test_ranks_are_looked_up_once_a_pair(monkeypatch, prose):
    words = token_files.WordTokens(f"{token_files.TOKENIZERS}/{token_files.VOCABULARY}")
    looked, search = [], words.merges._search
    monkeypatch.setattr(words.merges.answers, "ask", lambda key: looked.append(len(key)) or search(key))
    first = words.batch(prose)
    n = sum(looked)
    words._reset()
    assert all((x == y).all() for x, y in zip(first, words.batch(prose), strict=True))
    assert sum(looked) - n < sum(map(len, prose)) // 50


def test_words_merged_are_no_strings(monkeypatch):
    """Only words for the library are decoded; those merged stay bytes, in lower case with a space after each."""
    units = ["Abc", "éÀ1!", "x" * 32, "a<b", "a|b<", "", "x" * 33, "don't", "a<|b", "日", "÷", "a\x7f", "×y"]
    joined = " ".join(units).encode() + b" \xc3"
    ends = np.cumsum([len(u.encode()) + 1 for u in units]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    merged, data = token_files.WordTokens._mergeable(np.frombuffer(joined, np.uint8), np.append(starts, len(joined) - 1), np.append(ends, len(joined)) - np.append(starts, len(joined) - 1))
    assert merged.tolist() == [True] * 6 + [False] * 8
    assert bytes(data).decode() == "".join(u.lower() + " " for u in units[:6])


def test_hashes_of_words_tell_all_bytes():
    draw = random.Random(2)
    units = {"".join(draw.choices("abAB", k=n)) for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 63, 64, 65, 66, 200) for _ in range(30)}
    units = sorted({u.lower() for u in units} | {f"{u.lower()}1" for u in units} | {f"{u}2" for u in units} | {"a" * n for n in range(1, 140)} | {"\x01", "\x02", "\0", "\0\0", "a\0", "b\0\0", *map(chr, range(33, 65))} - set(token_files._MARKS.decode()))
    for joined in (" ".join(units), "\n".join(units) + " "):
        starts, core, mark, hashes = token_files.WordTokens._words(joined.encode())
        assert [joined[a:b] for a, b in zip(starts, core, strict=True)] == units and not mark.any() and len({0, *hashes.tolist()}) == len(units) + 1
    # capitals count in words that are not plain only
    hashes = token_files.WordTokens._words("ABCDEFGHIJ abcdefghij, ABCDEFGHIJ1 abcdefghij1".encode())[-1]
    assert hashes[0] == hashes[1] and len(set(hashes.tolist())) == 3


def test_quotients_by_floats_are_exact():
    random_ = np.random.default_rng(4)
    b = random_.integers(1, 1 << 26, 100_000)
    a = random_.integers(1, (1 << 46) // b, 100_000) * b
    for x in (a - 1, a, a + 1):
        assert (token_files._divided(x, b) == x // b).all()


@pytest.mark.parametrize(("lanes", "n"), [(1, 5), (3, 3), (70, 70 * 4), (70, 70 * 3 + 1), (130, 130 * 300 + 129)])
def test_ids_of_a_step_lie_together(lanes, n):
    steps, full = token_files._lanes(n, lanes)
    ids, grid = np.arange(n), np.full((steps, lanes), -1)
    token_files._turned(ids[: full * steps].reshape(full, steps), grid[:, :full])
    token_files._turned(ids[full * steps :].reshape(lanes - full, steps - 1), grid[:-1, full:])
    columns = [c[c >= 0].tolist() for c in grid.T]
    assert sum(columns, []) == ids.tolist() and {len(c) for c in columns[full:]} <= {steps - 1}


def test_rows_that_share_an_id_are_written_once_each(spark):
    texts = ["a b", "c", None, "a b", "c d e"] * 40
    docs = spark.createDataFrame([(None if k % 3 == 0 else 7, t, k) for k, t in enumerate(texts)], "doc_id long, text string, data int")
    files, _ = token_files.write_tokens(docs, partitions=6)
    got = token_files.read_tokens(files).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((None if k % 3 == 0 else 7 for k in range(200)), key=lambda x: x or 0)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist() and sum(r.n_tokens for r in got) == sum(len((t or "").split()) + 1 for t in texts)


def test_token_files_equal_library(spark, prose):
    texts = [*ODD, *prose[:50], "<|endoftext|> don't  STOP"]
    path = f"{token_files.TOKENIZERS}/{token_files.VOCABULARY}"
    got, before = by_id(token_files.token_digests(docs_of(spark, texts))), 0
    for i, text in enumerate(texts):
        ids = np.array([*token_files.tokenizer(path).encode(text or "", add_special_tokens=False).ids, token_files.END_ID], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)


def test_bulk_word_hashes():
    texts = [b"A b\tc", b"", b" x  A ", "é A".encode()]
    hashes, counts = common.hashed_words(texts)
    assert counts.tolist() == [3, 0, 2, 2] and hashes[0] == hashes[4] == hashes[6] and len(set(hashes.tolist())) == 5


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out.values())
    kept = docs.filter(F.col("doc_id").isin(list(out))).select("text").collect()
    assert len({" ".join(r.text.split()) for r in kept}) == len(out)
    low = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0")
    assert low.filter(F.col("doc_id").isin(list(out))).count() <= 1


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    result = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.select(*names).collect(), key=str) and {tuple(r) for r in df.select(*names).collect()} == set(result.fetchall())


def test_words_from_units_equal_the_library():
    """Marks inside texts, letters that lowering or normal forms change, and punctuation runs."""
    draw = random.Random(5)
    letters = "aB.,!?'ÀéßİΣς \n\t1２ªµ̈K\x01<|>中K"
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(3000)]
    texts += ["", "\x01", "a\x01b \x01", "<|endoftext|>x <|startoftext|>", "I'LL don't. x.. H̱ ́a"]
    for part in (texts, [t.replace("\x01", "") for t in texts], texts[:1], []):
        words = token_files.WordTokens(f"{token_files.TOKENIZERS}/{token_files.VOCABULARY}")
        want = [e.ids for e in words.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in words.batch(part)] == want
        assert [words(t).tolist() for t in part[-20:]] == want[-20:]


def test_pieces_of_a_batch_equal_those_of_each_text():
    encoder = sentencepiece_codec.Encoder(f"{sentencepiece_codec.TOKENIZERS}/{sentencepiece_codec.MODEL}")
    texts = ["", " ", "  a  b ", "▁x", "x" * 3000, "\n\t", "Ünï 中\U0001f600", "a b"]
    each = [encoder(t).tolist() for t in texts]
    assert [x.tolist() for x in encoder.batch(texts)] == each and encoder.batch([]) == [] and encoder.batch(texts[2:3])[0].tolist() == each[2]


def every_stretch(doc, item):
    """The most equal words of any stretch that counts, over all places side by side; 0 if none."""
    needed, most = min(13, -(-85 * len(item) // 100)), 0
    for offset in range(1 - len(item), len(doc)):
        equal = [item[k] == doc[offset + k] for k in range(max(0, -offset), min(len(item), len(doc) - offset))]
        for a in range(len(equal)):
            n = 0
            for b in range(a, len(equal)):
                n += equal[b]
                if n >= needed and 10 * n >= 8 * (b + 1 - a):
                    most = max(most, n)
    return most


def spoilt_copies(draw, lengths, copies):
    """Items, and documents that hold each of them with a few words replaced, whole or in part."""
    items = [[f"w{draw.randrange(60)}" for _ in range(n)] for n in lengths]
    docs = []
    for item in items:
        for _ in range(copies):
            own = item[draw.randrange(3) : len(item) - draw.randrange(3)]
            for k in draw.sample(range(len(own)), min(len(own), draw.randrange(6))):
                own[k] = "other"
            docs.append([f"v{draw.randrange(9)}" for _ in range(draw.randrange(4))] + own + ["end"] * draw.randrange(2))
    return items, docs


def overlaps_found(spark, items, docs, **parameters):
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id): r.n_equal for r in decontamination.decontaminate(docs_of(spark, [" ".join(d) for d in docs]), bench, **parameters).collect()}


def test_overlaps_equal_all_stretches(spark):
    items, docs = spoilt_copies(random.Random(7), [13, 14, 15, 16, 17, 18, 20, 25, 30, 40], 40)
    want = {(d, i): n for d, doc in enumerate(docs) for i, item in enumerate(items) if (n := every_stretch(doc, item))}
    assert overlaps_found(spark, items, docs) == want and len(want) > 100


def test_stretches_are_not_trimmed():
    item = [f"w{k}" for k in range(16)]
    spoilt = ["other" if k in (1, 14) else w for k, w in enumerate(item)]
    share = decontamination.Fraction(4, 5)
    assert decontamination.stretches(np.array(item) == np.array(spoilt), 13, share) == [(0, 16, 14)]
    apart = np.array([True] * 14 + [False] * 9 + [True] * 15)
    assert decontamination.stretches(apart, 13, share) == [(23, 38, 15), (0, 14, 14)]
    assert decontamination.stretches(apart[:0], 13, share) == []


def texts_kept(df, columns):
    assert df.columns == columns
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


@pytest.mark.parametrize("column", [[], [common.ROW]])
def test_rows_with_null_and_repeated_ids(spark, column):
    base = " ".join(f"w{k}" for k in range(40))
    near = base.replace("w20", "other")
    rows = [(5, base), (None, base), (None, "alone and without a number"), (None, None), (7, "one text"), (7, "other text"), (8, "other  text"), (9, "twice"), (9, "twice"), (None, "no id"), (None, "no  id"), (2, near), (2, "x y z")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"doc_id long, text string, {common.ROW} long").select("doc_id", "text", *column)
    exact = [(5, base), (None, "alone and without a number"), (None, None), (7, "one text"), (7, "other text"), (9, "twice"), (2, near), (2, "x y z")]
    as_rows = lambda kept: sorted((i is None, i or 0, t or "") for i, t in kept)
    got = exact_dedup.kept_rows(docs)
    assert texts_kept(got.filter("text IS NULL OR text NOT LIKE 'no %id'"), docs.columns) == as_rows(exact) and got.count() == len(exact) + 1
    got = ngram_join.representatives(docs, ngram_join.Similarity(2, 80, 100))
    assert texts_kept(got.filter("text IS NULL OR text NOT LIKE 'no %id'"), docs.columns) == as_rows([r for r in exact if r[1] != base]) and got.count() == len(exact)
    bench = spark.createDataFrame([(1, base), (2, "other text")], "item_id long, text string")
    assert texts_kept(decontamination.clean_rows(docs, bench, 2), docs.columns) == as_rows([r for r in rows if r[1] not in (base, near, "other text", "other  text")])


def test_short_items_with_a_replaced_word(spark):
    items = [[f"w{n}x{k}" for k in range(n)] for n in range(1, 13)]
    docs = [["before", *item[:k], "other", *item[k + 1 :]] for item in items for k in range(len(item))] + items
    want = {(d, i): n for d, doc in enumerate(docs) for i, item in enumerate(items) if (n := every_stretch(doc, item))}
    assert overlaps_found(spark, items, docs, min_item_words=1) == want
    assert overlaps_found(spark, items, docs) == {k: n for k, n in want.items() if len(items[k[1]]) >= 5}
    # of seven words and more, one may be replaced anywhere
    assert len(want) == sum(range(7, 13)) + len(items)


def test_a_line_that_many_items_and_texts_share():
    line = " ".join(f"l{k}" for k in range(30))
    items = [(i, f"a{i} b{i} {line} c{i}") for i in range(1000)]
    text = " ".join(f"x{k} {line} y{k % 7}" for k in range(1000)).encode()
    started = time.process_time()
    index = decontamination.SeedIndex(items)
    hashes, counts = common.hashed_words([text, b"none of it"], common.NOT_ALPHANUMERIC)
    found = index.overlaps(hashes, np.concatenate([[0], np.cumsum(counts)]))
    assert set(found) == {(0, i) for i in range(1000)} and set(found.values()) == {(1, 31, 2, 30)}
    assert time.process_time() - started < 12


def test_passages_repeated_in_items_and_texts(spark):
    draw = random.Random(9)
    passages = [[f"p{n}x{k}" for k in range(n)] for n in (8, 15, 20)]
    mixed = lambda: [w for _ in range(4) for w in draw.choice([*passages, [f"z{draw.randrange(5)}"] * 3])]
    items, docs = [mixed() for _ in range(12)], [mixed() for _ in range(40)]
    want = {(d, i): n for d, doc in enumerate(docs) for i, item in enumerate(items) if (n := every_stretch(doc, item))}
    assert overlaps_found(spark, items, docs) == want and want


def test_rows_of_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 1, 2, 3), (2, "a b  c d e f g", 4, 5, 6), (3, "other words are here today now", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, first int, node int")
    bench = spark.createDataFrame([(1, "other words are here today now")], "item_id long, text string")
    for kept, want in ((exact_dedup.kept_rows(docs), [1, 3]), (ngram_join.representatives(docs), [1, 3]), (decontamination.clean_rows(docs, bench), [1, 2])):
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_on_tables_that_are_odd(spark, tmp_path, prose):
    """Nulls in any column, repeated rows and ids, and columns named as the stages name theirs; then no rows at all."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.unionByName(spark.createDataFrame([(None, None), (7, "")], bench.schema)).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    item = bench.filter("length(text) > 60").first().text
    plain = prose[0]
    rows = [(None, None), (None, ""), (None, plain), (1, plain), (1, plain), (1, f"{plain} again"), (2, f"so it says: {item}"), (3, "é" * 5000), (3, "\0")]
    schema = "doc_id long, text string, first long, _gone long, lang string, n_chars long"
    odd = spark.createDataFrame([(i, t, None, 1, None, None) for i, t in rows], schema)
    numbered = odd.withColumn(common.ROW, F.monotonically_increasing_id())
    kept = {}
    for name in ("exact_dedup", "ngram_join", "decontamination"):
        got = stage(name)(spark, numbered, str(tmp_path))
        assert got.columns == numbered.columns
        kept[name] = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    # of the two texts that are empty or null, and of the three plain ones, one each
    assert len(kept["exact_dedup"]) == 6 and (1, plain) in kept["exact_dedup"] and (1, f"{plain} again") in kept["exact_dedup"]
    assert {t for _, t in kept["decontamination"]} == {t for _, t in rows if t is None or item not in t} and len(kept["decontamination"]) == 8
    assert (1, f"{plain} again") not in kept["ngram_join"] and (1, plain) in kept["ngram_join"] and (None, None) in kept["ngram_join"]
    coded = stage("sentencepiece")(spark, numbered, str(tmp_path)).collect()
    assert len(coded) == len(rows) and all(r.round_trip for r in coded)
    docs = odd
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs.limit(0), str(tmp_path))
        assert docs.count() == 0, name


def test_stages_equal_brute_force(spark, tmp_path):
    """What each filtering stage keeps of the small table, held against plain versions of the same rules."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn(common.ROW, F.col("doc_id"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    same = {}
    for i in ids:
        same.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert {r.doc_id for r in stage("exact_dedup")(spark, docs, SF).collect()} == set(same.values())
    roots = classes([texts[i] for i in ids], 5, 80, 100)
    assert {r.doc_id for r in stage("ngram_join")(spark, docs, SF).collect()} == {i for k, i in enumerate(ids) if roots[k][1] == k}
    items = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in r.text or "")) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = {i: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in texts[i])) for i in ids}
    clean = {r.doc_id for r in stage("decontamination")(spark, docs, SF).collect()}
    for i in ids:
        # no stretch that counts can be without two neighbouring words of the item
        pairs = set(zip(words[i], words[i][1:], strict=False))
        near = [x for x in items if len(x) >= 5 and pairs & set(zip(x, x[1:], strict=False))]
        assert (i in clean) == (not any(stretch_there(words[i], x) for x in near)), i


def stretch_there(doc, item):
    """Whether any stretch counts, by running sums over every diagonal."""
    needed = min(13, -(-85 * len(item) // 100))
    a, b = np.array([hash(w) for w in doc], np.int64), np.array([hash(w) for w in item], np.int64)
    for offset in range(1 - len(b), len(a)):
        x, y = a[max(0, offset) : offset + len(b)], b[max(0, -offset) : max(0, -offset) + len(a[max(0, offset) : offset + len(b)])]
        equal = x == y
        if equal.sum() < needed:
            continue
        n = len(equal)
        if any(equal[p:q].sum() >= needed and 10 * equal[p:q].sum() >= 8 * (q - p) for p in range(n) for q in range(p + 1, n + 1)):
            return True
    return False


def test_segments_part_no_unit():
    draw = random.Random(3)
    texts = ["", " ", " " * 50, "a" + " " * 12 + "b", "ab" * 30, *("".join(draw.choice(["a", "bc", " ", " " * draw.randrange(30)]) for _ in range(40)) for _ in range(50))]
    for text in texts:
        for limit in range(1, 40):
            parts = list(common.segments(" " + text, limit))
            assert "".join(parts) == " " + text
            assert [u for p in parts for u in sentencepiece_codec._UNITS.findall(p)] == sentencepiece_codec._UNITS.findall(" " + text)


def test_long_text_by_itself_and_among_others():
    encoder = sentencepiece_codec.Encoder(f"{sentencepiece_codec.TOKENIZERS}/{sentencepiece_codec.MODEL}")
    text = "ab " * (common.CHUNK_CHARS // 3 - 2) + "a" + " " * 12 + "b c"
    assert encoder.batch([text])[0].tolist() == encoder.batch([text, "x"])[0].tolist()
    assert encoder("a" + " " * 12 + "b").tolist() == [264, 17422, 287]


def test_notices_next_to_each_other():
    s = license_scan.NoticeScanner()
    found = lambda t: [(m.label, t[m.start : m.end].strip(), m.edits) for m in s(t)]
    mit, gpl = "released under the mit license", "this work is licensed under the gnu general public license version"
    assert found(f"relesed under the mit license {mit}") == [("mit-notice", "relesed under the mit license", 1), ("mit-notice", mit, 0)]
    spoilt = gpl.replace("licensed", "licenced").replace("general", "genral")
    assert found(f"{spoilt} 3 {gpl} 2") == [("gpl-3.0", f"{spoilt} 3", 2), ("gpl-2.0", f"{gpl} 2", 0)]
    for notice, label in license_scan.NOTICES:
        # one letter of each copy but the last is wrong
        copies = [notice[:k] + "q" + notice[k + 1 :] for k in (1, len(notice) // 2)] + [notice]
        assert [m.label for m in s(" ".join(copies))] == [label] * 3, label
