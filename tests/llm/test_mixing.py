"""Poisson replication: means, weights and edge rows."""

from chronoloom.llm import mixing
from pyspark.sql import functions as F


def test_rates_meet_weights(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 5000, "big").when(F.col("id") < 5990, "mid").otherwise(None).alias("source"),
        F.lit("x").alias("copy"),
    )
    got = mixing.mix(docs, weights={"big": 1, "mid": 2, None: 1}, total=20000)
    n = {r.source: r.n for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["big"] - 5000) < 300 and abs(n["mid"] - 10000) < 500 and abs(n[None] - 5000) < 300
    per = {r.doc_id: (r.n, r.m) for r in got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m")).collect()}
    assert all(a == b for a, b in per.values())


def test_absent_weight_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, "b")], "doc_id long, source string")
    got = mixing.mix(docs, weights={"a": 1.0}, total=90)
    assert {r.source for r in got.collect()} == {"a"}
    assert mixing.mix(docs, weights={"z": 1.0}).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_same_seed_same_rows(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    a = mixing.mix(docs).select("doc_id", "copy").collect()
    assert sorted(a) == sorted(mixing.mix(docs.repartition(3)).select("doc_id", "copy").collect())
