"""Source divergence, ranked search and nearest vectors against plain Python and numpy."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from chronoloom.llm import divergence, lexical, neighbours, terms
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string"


def _words(pattern, text):
    return pattern.findall((text or "").translate(LOWER))


def test_cut_is_the_pattern():
    rng = random.Random(4)
    texts = [None, "", " ", "a", "É éa,B9_c d e", "x" * 9000, "\x00\x7f@[`{z"]
    texts += ["".join(rng.choice("aB9 ,_É中 \n.@") for _ in range(rng.randrange(60))) for _ in range(200)]
    for table, pattern in ((terms.LETTERS, LETTERS), (terms.WORDS, WORDS)):
        for at, part in terms.slices(pa.array(texts)):
            row, names, code = terms.cut(part, table)
            names, got = names.to_pylist(), defaultdict(list)
            for r, c in zip(row, code):
                got[r + at].append(names[c])
            assert [got[i] for i in range(len(texts))] == [_words(pattern, t) for t in texts]


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(terms, "SLICE_BYTES", 10)
    texts = pa.array([None, "abc", "x" * 50, "", "ab", "cd", "e" * 9, None])
    found = [(at, part.to_pylist()) for at, part in terms.slices(texts)]
    assert sum((p for _, p in found), []) == texts.to_pylist()
    assert [at for at, _ in found] == [sum(len(p) for _, p in found[:i]) for i in range(len(found))]


def _divergence(rows, least, top):
    rows = [(t or "", la or "", s or "") for _, t, la, s in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for t, la, s in rows:
        words = _words(LETTERS, t)
        seen[la].update(set(words))
        counts[la, s].update(words)
    out = []
    for la in {r[1] for r in rows}:
        kept = [t for t, n in seen[la].items() if n >= least]
        v, sources = len(kept), {s for x, s in counts if x == la}
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept})(sum(c[t] for t in kept))  # noqa: B023, E731
        p = {s: share(counts[la, s]) for s in sources}
        q = share(sum((counts[la, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            own = [(t, f(p[s][t], q[t])) for t in kept if counts[la, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(la, s, part, t, x, i + 1) for i, (t, x) in enumerate(items[:most])]
    return sorted(out)


def test_divergence_is_brute_force(spark):
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "É", "日本", "x1y", "delta", "eps"] + [f"w{c}" for c in "abcdefgh"]
    rows = []
    for i in range(120):
        picked = rng.choices(words[: 4 + 3 * (i % 5)], k=rng.randrange(12))
        rows.append((i % 90, " ".join(picked), rng.choice(["en", "fr"]), rng.choice(["a", "b", "ß", "c"])))
    rows += [(None, None, None, None), (1, "", None, "s"), (2, "alpha", "solo", "one"), (3, "!! 12", "en", "none"), (4, "alpha " * 30_000, "en", "a")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"term": F.lit("clash"), "p": F.lit(1), "n": F.lit(2), "value": F.lit(3)})
    got = sorted(map(tuple, divergence.divergence(df, least_docs=4, top_terms=3).collect()))
    assert got == _divergence(rows, 4, 3)
    assert divergence.divergence(df.limit(0)).collect() == []


def test_divergence_hands_on_partial_sums(monkeypatch):
    rng = random.Random(1)
    rows = [("en" if i % 3 else "", f"s{i % 4}", " ".join(rng.choices("abcdefghij", k=20)).encode()) for i in range(60)]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("lang", "source", "text"), zip(*rows[i : i + 7])))) for i in range(0, 60, 7)]
    whole = Counter()
    monkeypatch.setattr(divergence, "HELD_ROWS", 20)
    for out in divergence._counted(iter(batches)):
        for r in out.to_pylist():
            whole[r["lang"], r["source"], r["term"], "n"] += r["n"]
            whole[r["lang"], r["source"], r["term"], "d"] += r["d"]
    want = Counter()
    for la, s, t in rows:
        for w, n in Counter(t.decode().split()).items():
            want[la, s, w, "n"] += n
            want[la, s, w, "d"] += 1
    assert whole == want


def _ranked(docs, items, k):
    tokens = [_words(WORDS, t) for _, t in docs]
    n_docs, length = sum(1 for t in tokens if t), sum(map(len, tokens))
    df = Counter(w for t in tokens for w in set(t))
    out = []
    for item, text in items:
        asked, scores = Counter(_words(WORDS, text)), []
        for (doc, _), own in zip(docs, tokens):
            tfs, m = Counter(own), 25 + (75 * len(own) * n_docs) // max(length, 1)
            gain = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tfs[t]) // (1000 * tfs[t] + 8 * m))  # noqa: B023, E731
            scores.append((sum(c * gain(t) for t, c in asked.items() if tfs[t]), doc))
        scores = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, i + 1, doc, s) for i, (s, doc) in enumerate(scores)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_ranked_search_is_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(lexical, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(lexical, "ROUND", 2)
    rng = random.Random(shard_rows)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda most: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(most)))
    docs = [(i, text(80)) for i in range(150)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, docs[3][1]), (900, None), (901, ""), (902, "w1 " * 20_000), (903, "ÀÉ w3")]
    items = [(i, text(12)) for i in range(12)] + [(3, "w1 w1 W2"), (None, "w5"), (50, None), (51, ""), (52, "absent"), (53, "ÀÉ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit(2), "item": F.lit(3)})
    it = spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit(1), "rank": F.lit(2)})
    got = sorted(map(tuple, lexical.search(df, it, k=4).collect()), key=repr)
    assert got == _ranked(docs, items, 4)


def test_ranked_search_in_passes_and_empty(spark, monkeypatch):
    docs = [(i, f"a{i % 5} b{i % 3} c") for i in range(40)]
    items = [(i, f"a{i % 5} c") for i in range(9)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "ITEMS", 4)
    assert sorted(map(tuple, lexical.search(df, it).collect()), key=repr) == _ranked(docs, items, 10)
    assert lexical.search(df.limit(0), it).collect() == lexical.search(df, it.limit(0)).collect() == []


def _least(scores, cost, longest):
    best = [0]
    for i in range(len(scores)):
        ways = []
        for j in range(max(0, i + 1 - longest), i + 1):
            part = scores[j : i + 1]
            ways.append(best[j] + cost + max(part) * len(part) - sum(part))
        best.append(min(ways))
    return best[-1]


def test_block_boundaries_are_the_best():
    rng = np.random.default_rng(3)
    lengths = [0, 1, 2, 9, 40, 0, 130, 17]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.integers(0, 1000, offsets[-1])
    cost = rng.integers(0, 3000, len(lengths))
    starts = lexical.block_starts(scores, offsets, cost, longest=8)
    for t, n in enumerate(lengths):
        own, marks = scores[offsets[t] : offsets[t + 1]], np.flatnonzero(starts[offsets[t] : offsets[t + 1]])
        parts = np.split(own, marks[1:]) if n else []
        assert not n or marks[0] == 0
        assert all(len(p) <= 8 for p in parts)
        assert sum(cost[t] + p.max() * len(p) - p.sum() for p in parts) == (_least(own.tolist(), int(cost[t]), 8) if n else 0)


def test_blocks_are_skipped():
    rng = np.random.default_rng(5)
    held = np.repeat(np.arange(12), 3000)
    docs = np.concatenate([np.sort(rng.choice(5000, 3000, replace=False)) for _ in range(12)])
    scores = rng.integers(1, 50, len(docs))
    spikes = held < 4
    scores[np.isin(docs, rng.choice(5000, 30, replace=False)) & spikes] += 5000
    shard = lexical.Shard(docs, held, scores, 5000, 12)
    total = np.bincount(docs, weights=scores, minlength=5000)
    found, best = shard.search(np.arange(12), np.ones(12, np.int64), 10)
    want = np.lexsort((np.arange(5000), -total))[:10]
    assert found.tolist() == want.tolist() and best.tolist() == total[want].tolist()
    assert shard.read < len(docs) // 2


# Nearest vectors.


def _nearest(vectors, k):
    real = [(i, np.array(v)) for i, v in vectors if v and None not in v and np.isfinite(v).all() and any(v)]
    width = max((len(v) for _, v in real), default=0)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in real])
    out = {}
    for a, (i, _) in enumerate(real):
        if i is None or i % 20:
            continue
        s = (x * x[a]).sum(1)
        order = [b for b in sorted(range(len(real)), key=lambda b: (-s[b], real[b][0] is None, real[b][0] or 0)) if b != a]
        out.setdefault(i, []).append([(real[b][0], s[b]) for b in order[:k]])
    return out


def _run(spark, vectors, k=20):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"row": F.lit(1), "vec": F.lit(2), "hits": F.lit(3)})
    out = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k).collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in out.items()}


def _recall(got, want):
    hits = [sum(v in {x for _, x, _ in got.get(q, [])} for v, _ in lists[0]) / max(len(lists[0]), 1) for q, lists in want.items()]
    return sum(hits) / len(hits)


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(11)
    lone = rng.standard_normal((2500, 24))
    tight = rng.standard_normal(24) + 0.05 * rng.standard_normal((900, 24))
    x = np.concatenate([lone, tight])
    vectors = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    got, want = _run(spark, vectors), _nearest(vectors, 20)
    assert set(got) == set(want) and _recall(got, want) >= 0.93
    by_id = {i: np.array(v) for i, v in vectors}
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21)) and q not in {v for _, v, _ in rows}
        assert all(abs(s - by_id[q] @ by_id[v]) < 1e-12 for _, v, s in rows)
        assert rows == [(i + 1, v, s) for i, (v, s) in enumerate(sorted(((v, s) for _, v, s in rows), key=lambda p: (-p[1], p[0])))]


def test_nearest_of_unequal_lengths(spark):
    rng = np.random.default_rng(12)
    vectors = [(i, (v * rng.uniform(0.2, 3)).tolist()) for i, v in enumerate(rng.standard_normal((1500, 16)))]
    assert _recall(_run(spark, vectors), _nearest(vectors, 20)) >= 0.9


def test_nearest_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(13)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((700, 8)))]
    whole = _run(spark, vectors)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    assert _run(spark, vectors) == whole


def test_nearest_defined_results(spark):
    odd = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (1, [math.nan, 1.0]), (2, [math.inf, 1.0])]
    same = [(i, [1.0, 2.0]) for i in (100, 7, 3, 120, 5, 5, None)]
    got = _run(spark, odd + same + [(9, [-1.0]), (11, [1.0, 2.0, 0.0])])
    assert set(got) == {100, 120}
    assert [(v, s) for _, v, s in got[100]] == [(3, 5.0), (5, 5.0), (5, 5.0), (7, 5.0), (11, 5.0), (120, 5.0), (None, 5.0), (9, -1.0)]
    assert _run(spark, odd) == {} and _run(spark, [(20, [1.0])]) == {}


def test_cells_come_in_order_of_success():
    tables = neighbours.Tables(20_000, 16)
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    q = np.append(unit(rng.standard_normal(16)), 0.0)
    likeness, met, n = 0.8, 0, 4000
    table, cells = tables.best_cells(tables.projected(q[None])[0], likeness, 0.9)
    visited = set(zip(table.tolist(), map(tuple, cells.tolist())))
    assert len(visited) == len(table)
    # Vectors of exactly that likeness are met about as often as estimated.
    side = rng.standard_normal((n, 17))
    side = unit(side - (side @ q)[:, None] * q)
    found = tables.cells(tables.projected(likeness * q + math.sqrt(1 - likeness**2) * side))
    met = sum(any((t, tuple(found[i, t])) in visited for t in range(neighbours.TABLES)) for i in range(n)) / n
    assert 0.8 <= met <= 0.99
