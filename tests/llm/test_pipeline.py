"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib
import math
import random

import corpus_pipeline
import pytest
from chronoloom.llm import mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}" for i in range(900)]
    texts, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        if i % 5 == 0:
            text[3:3] = ["awfulword", "dreadword"]
        texts.append(" ".join(text))
        labels.append((i, int(i % 5 == 0), 1))
    for i in range(60):
        base = texts[rng.randrange(1, 48) * 5 - 1]
        texts.append(base if i % 2 else base + " tail")
    texts += [None, "", "write to a.b@example.com or call +1 555 123 4567 today", "one two"]
    rows = [(i, t, "en", "big" if i % 3 else "small", len(t or "")) for i, t in enumerate(texts)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp(name)}/out"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{sf_dir}/documents.parquet"), *out]


def _by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    assert all(df.columns == corpus_pipeline.COLUMNS for df in steps[:5])


def test_toxic_documents_go(steps):
    before, after = _by_id(steps[0]), _by_id(steps[1])
    assert set(before) - set(after) == {i for i, t in before.items() if "awfulword" in (t or "")}


def test_one_of_each_group_stays(steps):
    before, after = _by_id(steps[1]), _by_id(steps[2])
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in before.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] | sets[j])
            if i < j and (not both or len(sets[i] & sets[j]) / both >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(after) == {find(i) for i in sets}


def test_personal_data_is_replaced(steps):
    before, after = _by_id(steps[2]), _by_id(steps[3])
    want = {i: t and t.replace("a.b@example.com", "<email>").replace("+1 555 123 4567", "<phone>") for i, t in before.items()}
    assert after == want
    assert all(r.n_chars == len(r.text or "") for r in steps[3].collect())


def test_copies_follow_the_poisson_numbers(steps):
    rows = steps[3].select("doc_id", "source").collect()
    count = {}
    for r in rows:
        count[r.source] = count.get(r.source, 0) + 1
    total = sum(math.sqrt(n) for n in count.values())
    want = {}
    for r in rows:
        mean = math.sqrt(count[r.source]) / total * len(rows) / count[r.source]
        u = int(hashlib.md5(f"17:{r.doc_id}:1".encode()).hexdigest()[:13], 16) / 2**52
        n, p, c = 0, math.exp(-mean), math.exp(-mean)
        while c <= u:
            n += 1
            p *= mean / n
            c += p
        if n:
            want[r.doc_id] = n
    got = {r.doc_id: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert mixing.MAX_MEAN > 2 and got == want


def test_every_copy_is_packed(spark, steps, sf_dir):
    copies = {r.doc_id: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    packed = steps[5].collect()
    assert {d: sum(r.doc_id == d and r.piece == 0 for r in packed) for d in copies} == copies
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    rows = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, steps[5].select(*rows.columns).collect()), key=str)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
