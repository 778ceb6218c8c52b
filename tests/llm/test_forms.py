"""Ogg round trips, packing invariants, multiset hashes and language ID."""

import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
import pandas as pd
from chronoloom.llm import language, multiset, ogg, packing
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def _slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 191, 192, 193, 3840, 5000, 130_000, 1_000_003):
        payload = ogg.padded("x" * n)
        media = ogg.write(payload)
        assert ogg.payload_of(ogg.read(media)) == payload
        assert ogg.write(payload) == media
    assert all(ogg.page_checksum(d) == _slow_crc(d) for d in (b"", b"a", rng.randbytes(999)))
    data = bytearray(ogg.write(rng.randbytes(192 * 700)))
    streams = ogg.read(bytes(data))
    assert len(streams) == 2 and all(s.times == sorted(s.times) for s in streams.values())
    assert max(s.times[-1] for s in streams.values()) == 192 * 350 / ogg.RATE
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        ogg.read(bytes(data))
    whole = ogg.write(rng.randbytes(192 * 700))
    second = whole.index(b"OggS", whole.index(b"OggS", 1) + 1)
    third = whole.index(b"OggS", second + 1)
    for broken in (whole[:-5], whole[:second] + whole[third:], whole[:second]):
        with pytest.raises(ValueError):
            ogg.read(broken)


def test_ogg_rows(spark):
    rows = [(1, "abc"), (1, "abc"), (2, None), (3, ""), (None, "é" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("m"))
    got = {r.doc_id: r for r in ogg.described(ogg.media_table(docs)).collect()}
    assert got[1].payload_sha256 == hashlib.sha256(b"abc" + b" " * 189).hexdigest()
    assert got[2].payload_bytes == got[3].payload_bytes == 192 and got[2].media_sha256 == got[3].media_sha256
    assert got[None].n_bytes == 800 and got[None].payload_bytes == 960
    assert got[1].tail_crc32 == zlib.crc32(b" " * 16)


def test_tokens_are_those_of_tokenizers():
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = ["", " ", "Hello world!\n\n  x", "Éàü ß naïve 12345 ½ ٣", "a\tb\r\n  z", "it's we'll I'D", "👩‍👩‍👧 日本語テスト", "é​", "\x00\x1f"]
    texts += ["<|endoftext|>x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "<|endoftext|", "x<|ENDOFTEXT|>"]
    for text in texts:
        assert packing.ids_of(text) == t.encode(text, add_special_tokens=False).ids, text
    assert 50256 in packing.ids_of("a <|endoftext|> b")


def test_pieces_hold_the_tokens_of_table_texts(spark):
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()} | {-1: "tail <|endoftext|>" * 900}
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, texts[-1])], "doc_id long, text string"))
    got = {}
    for r in packing.pieces(docs).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for doc_id, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want = [(i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(got[doc_id]) == want


def _check_plan(counts, capacity):
    plans = [packing.Plan(counts, capacity, long) for long in (False, True)]
    best = packing.best_plan(counts, capacity)
    assert best.sequences == min(p.sequences for p in plans)
    return [_check_places(p, counts, capacity) for p in (*plans, best)][-1]


def test_sums_fill_gaps_exactly():
    rng = random.Random(14)
    for _ in range(200):
        capacity = rng.choice([8, 20, 40])
        counts = {rng.randint(1, capacity): rng.randint(1, 3) for _ in range(rng.randint(1, 9))}
        sums = packing.Sums(list(counts), capacity)
        left = np.array([counts.get(k, 0) for k in range(capacity + 1)])
        enough = lambda xs: all(counts.get(x, 0) >= xs.count(x) for x in xs)
        for gap in range(1, capacity + 1):
            ways = [xs for n in (1, 2, 3) for xs in itertools.combinations_with_replacement(sorted(counts), n) if sum(xs) == gap and enough(xs)]
            got = sums.of(gap, left)
            assert (tuple(sorted(got)) in ways if got else not ways), (counts, gap, got, ways)


def _check_places(plan, counts, capacity):
    filled, seen = {}, {}
    for length, slots in plan.slots.items():
        for start, stop, first, offset in slots:
            for i in range(stop - start):
                filled.setdefault(first + i, []).append((offset, length))
            seen.setdefault(length, []).extend(range(start, stop))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    for slots in filled.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) == plan.sequences == sum(plan.filled.values())
    return plan.sequences


def test_plan_fills_sequences():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([1, 2, 7, 30, 64])
        counts = {rng.randint(1, capacity): rng.randint(0, 9) for _ in range(rng.randint(0, 20))}
        got = _check_plan(counts, capacity)
        assert got >= -(-sum(k * n for k, n in counts.items()) // capacity)
    assert _check_plan({10: 3, 6: 1, 3: 1, 1: 1, 5: 2}, 10) == 5
    many = {rng.randint(1, 2048): rng.randint(1, 50) for _ in range(1500)}
    least = max(sum(k * n for k, n in many.items()) / 2048, sum(n for k, n in many.items() if k > 1024))
    assert _check_plan(many, 2048) <= least * 1.015
    few = {rng.randint(1, 900): rng.randint(1, 50) for _ in range(600)}
    assert _check_plan(few, 2048) <= sum(k * n for k, n in few.items()) / 2048 * 1.001 + 1


def test_packed_rows(spark):
    rng = random.Random(6)
    texts = [None, "", "a", "a", " ".join(f"w{rng.random()}" for _ in range(1500))] + ["same text here"] * 1500
    docs = spark.createDataFrame([(i % 1400, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("rank", F.lit(1))
    got = packing.pack(docs).collect()
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in texts)
    assert sum(r.length for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-want // 2048) + 1
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 4 and r.length > 100)
    assert all(n == 2048 for _, _, n in long[1:]) and [s for _, s, _ in long][0] == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_multiset_algebra(spark):
    rows = [(1, "One. Two! Three\nfour"), (2, "four\nThree\nTwo! One."), (3, "One. Two!"), (4, "Three\nfour"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("vector", F.lit(0))
    v = {r.doc_id: r for r in multiset.fingerprints(docs).collect()}
    assert v[1].fingerprint == v[2].fingerprint != v[3].fingerprint
    assert v[5].fingerprint == v[6].fingerprint == "0" * 8 * multiset.HEAD
    pair = spark.createDataFrame([(v[3].vector, v[4].vector, v[1].vector)], "a array<long>, b array<long>, c array<long>")
    r = pair.select(multiset.plus(F.col("a"), F.col("b")).alias("p"), multiset.minus(F.col("c"), F.col("b")).alias("m")).first()
    assert r.p == v[1].vector and r.m == v[3].vector


def test_multiset_edits_match_recomputation(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "b c", ". ", "! ", "\n", "é", "? x", "."]) for _ in range(rng.randint(0, 60))) for _ in range(900)]
    ids = rng.sample(range(10**6), 900)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("next_text", F.lit("x"))
    got = {r.doc_id: r for r in multiset.edit_report(docs).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    edited = []
    for i, (k, t) in enumerate(order):
        m = len(t) // 3
        edited.append((k, t[: len(t) - m] + order[(i + 1) % len(order)][1][:m]))
    again = {r.doc_id: r.fingerprint for r in multiset.fingerprints(spark.createDataFrame(edited, "doc_id long, text string")).collect()}
    assert len(got) == 900
    for k, t in edited:
        assert got[k].edited_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert got[k].edited_fingerprint == again[k]
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1


def test_likeness_is_near_the_true_one(spark):
    """Texts of up to 100,000 units: the estimate against the similarity of the unit multisets."""
    rng = random.Random(18)
    rows, want = [], {}
    for n in (3, 40, 900, 10_000, 100_000):
        for share in (0.0, 0.1, 0.34, 0.8):
            lines = [f"unit {n} {i}" for i in range(n)]
            other = [f"other {x}" if rng.random() < share else x for x in lines] + lines[: n // 50]
            a, b = Counter(lines), Counter(other)
            want[len(rows)] = sum((a & b).values()) / sum((a | b).values())
            rng.shuffle(other)
            rows.append((len(rows), "\n".join(lines), "\n".join(other)))
    pairs = spark.createDataFrame(rows, "k int, a string, b string").repartition(8)
    for c in "ab":
        pairs = multiset.with_vector(pairs, c, f"{c}v")
    got = {r.k: r.near for r in pairs.select("k", multiset.likeness(F.col("av"), F.col("bv")).alias("near")).collect()}
    for k, true in want.items():
        assert abs(got[k] - true) < 0.17, (k, got[k], true)


def test_next_rows_with_hot_and_null_ids(spark, monkeypatch):
    """A third of the rows share an id and some have none: one ring in the order of id and text hash."""
    monkeypatch.setattr(multiset, "BUCKET_ROWS", 7)
    rng = random.Random(5)
    ids = [5] * 150 + [None] * 60 + [rng.randint(-50, 900) for _ in range(240)]
    docs = spark.createDataFrame([(i, f"t{k % 400}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(((i, t) for i, t in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    got = Counter((r.doc_id, r.text, r.next_text) for r in multiset.with_next(docs, "doc_id", ["text"]).collect())
    assert got == Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    sizes = [r["count"] for r in multiset._bucketed(docs, F.coalesce("doc_id", F.lit(-99)), F.xxhash64("text")).groupBy("__bucket").count().collect()]
    assert max(sizes) < 60


def test_multiset_small_tables(spark):
    one = spark.createDataFrame([(5, "abc")], "doc_id long, text string")
    r = multiset.edit_report(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    assert multiset.edit_report(one.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x"), (3, "abc"), (3, "abc"), (3, "zzz"), (1, None)], "doc_id long, text string")
    assert multiset.edit_report(odd).count() == 5


def test_language(spark):
    rng = random.Random(9)
    vocab = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(80)] for k, letters in {"xx": "abcdeo", "yy": "fghiju"}.items()}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(60)), k) for i in range(300) for k in [rng.choice(["xx", "yy"])]]
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "12 34!", "xx"), (None, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s"))
    model = language.learn(docs, ~language.held_out())
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[k].lang_pred == lang for k, t, lang in rows[:300])
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _, _ in rows[:300])
    assert {got[k].lang_pred for k in (900, 901, 902)} == {"und"} and got[None].lang_pred == rows[0][2]
    marks = spark.createDataFrame([(1, "½ ² Ⅷ ① 42"), (2, "ª"), (3, "_"), (4, "ö½")], "doc_id long, text string")
    assert {r.doc_id for r in language.identify(marks, model).collect() if r.lang_pred == "und"} == {1, 3}
    assert language.learn(docs.limit(0), F.lit(True)) == {}
    assert language.identify(docs, {}).first().lang_pred == "und"


def test_language_sizes_are_the_plain_ones(spark):
    """Every text compressed anew with every dictionary; ties go to the commonest language."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(docs, ~language.held_out())
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    names = list(model)
    assert len(got) == docs.count() and len(names) > 2
    for row in docs.collect():
        r = got[row.doc_id]
        if not any(c.isalpha() for c in row.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        data = language.words_of(row.text).encode()
        sizes = []
        for name in names:
            d = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[i : i + language.CHUNK_BYTES])) for i in range(0, len(data), language.CHUNK_BYTES)))
        assert r.lang_pred == names[sizes.index(min(sizes))]
        assert abs(r.score - 1 / sum(math.exp((min(sizes) - x) / language.SOFTNESS) for x in sizes)) < 1e-12
        assert r.rejected == (sorted(sizes)[1] - min(sizes) < language.LEAST_MARGIN * max(sizes))


def test_equal_languages_tie(spark):
    rows = [(i, "same words in both", "bb" if i % 3 else "aa") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(True))
    assert list(model) == ["bb", "aa"]
    same = {k: model["bb"] for k in model}
    assert {(r.lang_pred, r.score, r.rejected) for r in language.identify(docs, same).collect()} == {("bb", 0.5, True)}
    many = spark.range(1200).selectExpr("id AS doc_id", "'a' AS text", "'l' || id AS lang")
    with pytest.raises(ValueError):
        language.learn(many, F.lit(True))


def test_tokens_are_never_python_objects(monkeypatch):
    texts = ["plain words", "", None, "ä 漢 \U0001f600 1,234\n\n  x", "a <|endoftext|> b"]
    want = [[*packing.ids_of(t), packing.END] for t in texts]
    got = [packing.closed_ids(t) for t in texts]
    assert [g.tolist() for g in got] == want and all(g.dtype == "<u4" for g in got)
    monkeypatch.setattr(packing, "ids_of", None)
    cut = packing.pieces_udf(4).func(pd.Series(texts[:4]))
    assert [sum(p["length"] for p in c) for c in cut] == [len(w) for w in want[:4]]
