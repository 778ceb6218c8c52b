"""Toxicity: marginals against enumeration, held-out accuracy, spans and edge rows."""

import itertools
import random
import zlib

import numpy as np
import pytest
from chronoloom.llm import crf, toxicity
from pyspark.sql import functions as F

BAD = ["vileword", "nastyword", "grimword"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(rows), dict(labels)


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.fit(tables[0], tables[1])


def test_marginals_and_viterbi_by_enumeration():
    rng = np.random.default_rng(1)
    field = crf.Crf(np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for steps in (1, 2, 5):
        e = rng.normal(size=(steps, 2))
        scores = {
            y: field.starts[y[0]] + sum(e[t, s] for t, s in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
            for y in itertools.product((0, 1), repeat=steps)
        }
        assert tuple(field.viterbi(e)) == max(scores, key=scores.get)
        z = np.logaddexp.reduce(list(scores.values()))
        nodes, _, _ = crf.forward_backward(e[None], np.ones((1, steps), bool), field.moves, field.starts)
        for t in range(steps):
            want = sum(np.exp(v - z) for y, v in scores.items() if y[t])
            assert abs(nodes[0, t, 1] - want) < 1e-9


def test_text_marginals_by_enumeration():
    """The located tokens' marginals, gaps stepped over, against all paths over all tokens."""
    rng = np.random.default_rng(7)
    forms = ("bad$", "bad", "vile", "foul$", "vilen")
    text_of = {(0,): "bad", (1,): "badly", (2,): "viler", (2, 4): "vileness", (3,): "foul"}
    for _ in range(40):
        model = toxicity.Model(forms, rng.normal(size=6), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(0), 0.5)
        words = [("plain", ()) if rng.random() < 0.6 else next((w, f) for f, w in [list(text_of.items())[rng.integers(5)]]) for _ in range(int(rng.integers(1, 10)))]
        text = " ".join(w for w, _ in words)
        found = toxicity.locate(text, forms)
        assert [f for _, _, f in found] == [f for _, f in words if f]
        scores = {}
        for y in itertools.product((0, 1), repeat=len(words)):
            e = sum(s * sum(model.weights[i] for i in (f or (5,))) for s, (_, f) in zip(y, words))
            scores[y] = model.starts[y[0]] + e + sum(model.moves[a, b] for a, b in zip(y, y[1:]))
        z = np.logaddexp.reduce(list(scores.values()))
        want = [sum(np.exp(v - z) for y, v in scores.items() if y[t]) for t, (_, f) in enumerate(words) if f]
        assert np.allclose(model.marginals(found, toxicity.gaps(text, found)), want) if found else not want


def test_windows_hold_every_located_token():
    rng = random.Random(2)
    for _ in range(200):
        tokens = [(rng.choice([0, 0, 1, 3, 8, 9, 500]), [rng.randrange(5)]) for _ in range(rng.randint(0, 150))]
        after = rng.choice([0, 2, 700])
        got = toxicity.windows(tokens, after, 1, 9)
        assert all(len(xs) == len(ys) <= toxicity.WINDOW for xs, ys in got)
        assert [x for xs, _ in got for x in xs if x != [9]] == [f for _, f in tokens]
        assert all(y == (x != [9]) for xs, ys in got for x, y in zip(xs, ys))
        near = sum(g if g <= 8 else 8 for g, _ in tokens[1:]) + sum(min(g, 4) for g in ([tokens[0][0], after] if tokens else []))
        assert sum(x == [9] for xs, _ in got for x in xs) == near


def test_repeated_sequences_count_as_often(tables):
    rng = random.Random(6)
    some = [([[rng.randrange(4)] for _ in range(n)], [rng.randrange(2) for _ in range(n)]) for n in (1, 3, 3, 9, 30)]
    many = crf.train([s for s in some for _ in range(3)], 4, settled=0)
    assert np.allclose(many.weights, crf.train(some, 4, settled=0).weights)
    assert np.allclose(many.moves, crf.train(some, 4, weights=[2.0] * 5, settled=0).moves)


def test_held_out_rows(tables, model):
    docs, _, texts, toxic = tables
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts)
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in texts)
    assert sum(got[i].predicted == toxic[i] for i in held) >= 0.95 * len(held)
    for i in held:
        for span in filter(None, got[i].spans.split(",")):
            a, b = map(int, span.split(":"))
            assert texts[i][a:b] in BAD
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in texts if not got[i].predicted}


def test_odd_rows(spark, tables, model):
    rows = [(1, None), (2, ""), (None, "vileword"), (4, "x " * 200_000 + "vileword nastyword"), (5, "vileword"), (5, "vileword")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].score == by[2].score and by[1].predicted == 0 and 0 <= by[4].score <= 1
    assert by[None].score == by[5].score and not by[None].held_out
    docs, labels = tables[0], tables[1]
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    one_kind = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, one_kind).collect()} == {0}
