"""Mixing sources to target weights by Poisson replication, in native expressions only.

Every source has a mean repetition rate (target rows over rows it has). A document draws
its number of copies by inverting the Poisson distribution of that mean at a uniform
number hashed from its id and the seed, is exploded by that count, and all copies are
dealt out and ordered by another hash, which shuffles them globally.

Defined results: an empty table gives an empty table; a null source is a source of its
own; null text is kept as it is; rows that repeat an id draw the same number of copies
(the draw depends on id, seed and draw number alone), as do all rows whose id is null;
columns of the input that are named ``copy``, ``n_copies`` or ``shuffle_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_text, unit_hash

#: Poisson means above this are drawn as a sum of that many equal, smaller draws.
MAX_MEAN = 32.0
#: The per-source table is broadcast up to this many rows; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Kinds of columns that tell rows of one id apart.
_HASHED = {"string", "bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "decimal", "binary"}


def source_rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    total: int | None = None,
    source_col: str = "source",
) -> DataFrame:
    """One row per source: rows it has and its mean repetition rate.

    ``weights`` names target shares (absent sources get none, null may be a key); without
    it, shares follow rows ** temperature. ``total`` is the target number of rows, by
    default as many as there are.
    """
    counts = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count("*").alias("__rows"))
    if weights is None:
        share = F.pow(F.col("__rows").cast("double"), F.lit(temperature))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            hit = F.col("__source").isNull() if name is None else F.col("__source") == F.lit(name)
            share = F.when(hit, F.lit(float(weight))).otherwise(share)
    stats = checkpointed(counts.withColumn("__share", share))
    seen = stats.agg(F.sum("__share").alias("s"), F.sum("__rows").alias("n")).first()
    if not seen["s"]:
        return stats.withColumn("__rate", F.lit(0.0))
    rows = float(seen["n"] if total is None else total)
    return stats.withColumn(
        "__rate", F.col("__share") / F.lit(float(seen["s"])) * F.lit(rows) / F.col("__rows")
    )


def poisson_cdf(mean: Column) -> Column:
    """The cumulative distribution at 0, 1, ... far into the tail, as an array."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    first = F.exp(-mean)
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf"),
    )
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def copies(cdf: Column, draws: Column, seed: int, id_col: str) -> Column:
    """Sum of ``draws`` Poisson numbers, each the count of cdf values at or below a hash."""

    def one(j: Column) -> Column:
        u = unit_hash(F.lit(str(seed)), id_text(id_col), j.cast("string"))
        return F.size(F.filter(cdf, lambda c: c <= u))

    return F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda acc, j: acc + one(j))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    total: int | None = None,
    seed: int = 17,
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """The documents, each repeated by its draw, in a globally shuffled order.

    Adds ``copy`` (1..n_copies), ``n_copies`` and ``shuffle_key``. The shuffle deals rows
    by a hash of id, copy and content, so no source and no repeated id, however large, meets in one task.
    """
    rates = source_rates(docs, weights, temperature, total, source_col)
    draws = F.greatest(F.ceil(F.col("__rate") / F.lit(MAX_MEAN)), F.lit(1)).cast("int")
    rates = rates.select(
        "__source",
        draws.alias("__draws"),
        poisson_cdf(F.col("__rate") / draws).alias("__cdf"),
    )
    small = rates.count() <= BROADCAST_SOURCES
    known = docs.drop("copy", "n_copies", "shuffle_key").join(
        F.broadcast(rates) if small else rates,
        F.col(source_col).eqNullSafe(F.col("__source")),
        "inner",
    )
    n = copies(F.col("__cdf"), F.col("__draws"), seed, id_col)
    drawn = known.withColumn("n_copies", n).drop("__source", "__draws", "__cdf").where("n_copies > 0")
    key = F.conv(
        F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), id_text(id_col), F.col("copy").cast("string"))), 1, 15), 16, 10
    ).cast("long")
    out = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).withColumn("shuffle_key", key)
    # Rows that repeat an id have one key; what else tells them apart deals them to different tasks.
    plain = [c for c, kind in docs.dtypes if kind.split("(")[0] in _HASHED and c in out.columns]
    return out.repartition("shuffle_key", F.xxhash64(*plain)).sortWithinPartitions("shuffle_key")
