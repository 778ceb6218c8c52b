"""Source divergence audit: how far the word use of each source lies from the others' and from its language's.

Counts of kept terms become smoothed shares ``p``; two shares diverge by
``f(p, q) = floor((p - q)^2 / (p + q))``. Every pair of sources of a language starts at
``V * f`` of two zero counts. The inverted index then emits corrections only: a posting of
one source against the other's zero share, summed by different share (a histogram of a
source's postings, since equal counts correct alike), and a posting both sources have
against its two one-sided corrections. Terms that neither has cost nothing, and the sums
are exact. The terms of a group are ranked by a window.

The text is cut in Arrow columns and summed per task before anything moves; one exchange by
(language, term) then serves the counts, the document frequencies and the language's counts.

Defined results: null text, language or source counts as empty; every row is a document, so
repeated rows and ids count again; empty and very long texts are whole; a language without
kept terms has pairs of value 0 and no terms; a source that is alone in its language has no
pairs; ties go to the smaller item in UTF-8; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, checkpointed
from .terms import LETTERS, cut, per_row, slices

#: Shares are in parts of this.
UNIT = 1_000_000_000
#: Different (language, source, term) rows that a task holds before it hands them on.
HELD_ROWS = 1_000_000

_COUNTS = "lang string, source string, term string, n long, d long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (n) and documents (d) of each term of each group, summed over the task's rows."""
    keys = ["lang", "source", "term"]
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        total = pa.concat_tables(held).group_by(keys).aggregate([("n", "sum"), ("d", "sum")])
        return total.select([*keys, "n_sum", "d_sum"]).rename_columns([*keys, "n", "d"])

    for batch in batches:
        groups = pa.table({"lang": batch["lang"], "source": batch["source"]})
        for at, texts in slices(batch["text"]):
            row, names, code = cut(texts, LETTERS)
            if not len(code):
                continue
            doc, code, times = per_row(row, code, len(names))
            of = groups.take(pa.array(doc + at))
            held.append(
                of.append_column("term", names.cast(pa.string()).take(pa.array(code)))
                .append_column("n", pa.array(times.astype(np.int64)))
                .append_column("d", pa.array(np.ones(len(code), np.int64)))
            )
            if sum(map(len, held)) > HELD_ROWS:
                held = [summed()]
                if len(held[0]) > HELD_ROWS // 2:
                    yield from held.pop().combine_chunks().to_batches()
    if held:
        yield from summed().combine_chunks().to_batches()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), exact at any size."""
    whole = lambda c: c.cast("decimal(28,0)")
    over = whole(count + F.lit(2)) * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", over, whole(F.greatest(total + kept * 2, F.lit(1)))) + F.lit(1)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def postings(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """(lang, term, source, n, n_lang, leads): the kept terms of each language, where they occur.

    ``leads`` marks one row of each kept term.
    """
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    raw = bounded(docs).select(cell("lang"), cell("source"), text).mapInArrow(_counted, _COUNTS)
    groups = raw.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = Window.partitionBy("lang", "term")
    told = groups.withColumns(
        {"df": F.sum("d").over(term), "n_lang": F.sum("n").over(term), "leads": F.col("source") == F.min("source").over(term)}
    )
    return told.where(F.col("df") >= least_docs).drop("d", "df")


def divergence(docs: DataFrame, least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and each source's most overused terms."""
    index = checkpointed(postings(docs, least_docs))
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    langs = index.groupBy("lang").agg(F.count_if("leads").alias("v"), F.sum("n").alias("total_lang"))
    totals = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        docs.select(cell("lang"), cell("source")).distinct()
        .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "total_lang")])
    )
    p0 = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    groups = checkpointed(groups.withColumn("p0", p0))

    shares = index.join(groups.drop("p0"), ["lang", "source"]).select(
        "lang", "term", "source",
        _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        _share(F.lit(0).cast("long"), F.col("total"), F.col("v")).alias("p0"),
        _share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q"),
    )
    pair = _pairs(shares, groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    over = shares.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value")
    )
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = over.withColumn("rank", place).where(F.col("rank") <= top_terms)
    return pair.withColumn("rank", place).union(ranked).select("lang", "source", "part", "item", "value", "rank")


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value) both ways: baseline and corrections, summed."""
    zero = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    base = groups.join(zero, "lang").where(F.col("source") < F.col("other")).select(
        "lang", F.col("source").alias("a"), F.col("other").alias("b"),
        F.coalesce(F.col("v") * _apart(F.col("p0"), F.col("o0")), F.lit(0)).alias("value"),
    )
    # Equal shares of a source correct alike, so a source meets the others once per different share.
    alike = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    single = alike.join(zero, "lang").where(F.col("source") != F.col("other")).select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"),
        (F.col("times") * (_apart(F.col("p"), F.col("o0")) - _apart(F.col("p0"), F.col("o0")))).alias("value"),
    )
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("x"), F.col("p0").alias("x0"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("y"), F.col("p0").alias("y0"))
    x, y, x0, y0 = (F.col(c) for c in ("x", "y", "x0", "y0"))
    both = left.join(right, ["lang", "term"]).where(F.col("a") < F.col("b")).select(
        "lang", "a", "b", (_apart(x, y) - _apart(x, y0) - _apart(x0, y) + _apart(x0, y0)).alias("value")
    )
    once = lambda df: df.where("value <> 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    total = base.union(once(single)).union(once(both)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("other")), F.struct(F.col("b").alias("source"), F.col("a").alias("other")))
    return total.select("lang", F.inline(ways), "value").select("lang", "source", "other", "value")
