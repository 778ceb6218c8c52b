"""A training corpus from raw documents: five stages, each an operator of ``chronoloom.llm``.

Every stage takes and returns documents (``doc_id, text, lang, source, n_chars``); the last
returns the packed pieces. Stages: documents that the toxicity score rejects go; of every
group of near duplicates (five-word shingles, similarity 0.8 or more) the one with the
smallest id stays; personal data is replaced by its kind; sources are mixed to weights by
Poisson replication, so a document can come several times or not at all; what is left is
tokenised and packed into sequences.

Defined results: null texts pass the first three stages as empty ones do and are packed
as their end mark; empty tables give empty tables; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import mixing, packing, pii, simhash, toxicity
from chronoloom.llm.common import bounded, dropped, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that a stage sends to Python at once: the workers of all stages live side by side in an executor.
BATCH_ROWS = 500


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = bounded(docs, BATCH_ROWS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(bounded(docs, BATCH_ROWS), words_per=5, similarity=0.8).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(bounded(docs, BATCH_ROWS))
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, temperature=0.5, seed=17).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(bounded(docs, BATCH_ROWS))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: Scores, similarities, tokens and best fit are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
