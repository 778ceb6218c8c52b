"""Document fingerprints: a homomorphic multiset hash of paragraphs, in native expressions.

A text is cut into units (lines, and sentences within lines). Every unit is hashed to a
wide vector: dense lanes, one count lane, and a sketch of levels and cells in which the
unit fills one cell of the level that its hash falls on. A document's fingerprint is the
sum of its units' vectors, lane by lane, modulo 2 ** 32. So units may come in any order,
and inserting or deleting text adds or subtracts the vectors of the units concerned.
Levels of zeros at the end of a vector are not stored, so a short text has a short one.

Equal dense and count lanes mean equal multisets. The number of units by which two texts
differ is estimated from how many cells differ at the levels that are not full, which
gives their likeness.

Defined results: null text counts as empty and has the zero vector; two empty texts are
alike (1.0); texts that hold the same units in any order have equal fingerprints; rows
that repeat an id are ordered by a hash of their text; a null id comes after all others
(as the least id there can be); extra columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: The last level has one unit in 2 ** 25, so it is not full below some 5e8 differing units.
DENSE, LEVELS, CELLS = 8, 26, 16
MODULUS = 1 << 32
#: Lanes before the sketch: the dense ones and the count.
HEAD = DENSE + 1
#: A level with this many differing cells or more counts as full.
FULL = 14
#: Documents of one window bucket. Buckets lie in at most CHUNKS chunks of at most CHUNKS
#: each, so up to 1e8 documents keep that size; 5e10 documents give buckets of 190,000.
BUCKET_ROWS, CHUNKS = 400, 512


def marked(text: Column) -> Column:
    """The text with sentence ends turned into line ends, character for character."""
    return reduce(lambda t, end: F.replace(t, F.lit(f"{end} "), F.lit(f"{end}\n")), ".!?", text)


def _unit_vectors(lines: Column) -> Column:
    """Per unit: dense lanes, then level, cell and value of its sketch entry."""
    units = F.filter(F.split(lines, "\n"), lambda u: u != "")
    digests = F.transform(units, lambda u: F.sha2(u, 256))
    word = lambda d, i: F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("long")
    lanes = F.transform(digests, lambda d: F.array(*[word(d, i) for i in range(DENSE)]))

    def entry(v: Column) -> Column:
        low = v[DENSE - 1]
        level = F.least(F.bit_count(low.bitwiseAND(-low) - 1), F.lit(LEVELS - 1))
        cell = F.shiftright(v[DENSE - 2], 28).cast("int")
        return F.struct(v.alias("dense"), level.alias("level"), cell.alias("cell"), v[0].alias("value"))

    return F.transform(lanes, entry)


def trimmed(vector: Column) -> Column:
    """The vector without the levels of zeros at its end."""
    last = F.array_max(F.transform(vector, lambda x, i: F.when(x != 0, i)))
    levels = F.greatest(F.ceil((F.coalesce(last, F.lit(0)) - DENSE) / F.lit(float(CELLS))), F.lit(0))
    return F.slice(vector, F.lit(1), (HEAD + CELLS * levels).cast("int"))


def vector_of_units(units: Column) -> Column:
    """Sum of unit vectors modulo 2 ** 32: dense lanes, count, sketch."""

    def total(of, chosen=units) -> Column:
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda s, u: s + of(u)) % MODULUS

    dense = [total(lambda u, i=i: u["dense"][i]) for i in range(DENSE)]
    zero = F.lit(0).cast("long")

    def cells(own: Column) -> Column:
        """The sums of one level's cells; units of other levels are already left out."""
        return F.transform(
            F.sequence(F.lit(0), F.lit(CELLS - 1)),
            lambda c: F.aggregate(own, zero, lambda s, u: s + F.when(u["cell"] == c, u["value"]).otherwise(zero)) % MODULUS,
        )

    top = F.array_max(F.transform(units, lambda u: u["level"]))
    by_level = F.transform(F.sequence(F.lit(0), F.coalesce(top, F.lit(0))), lambda k: F.filter(units, lambda u: u["level"] == k))
    sketch = F.flatten(F.transform(by_level, cells))
    return trimmed(F.concat(F.array(*dense, F.size(units).cast("long")), sketch))


def with_vector(df: DataFrame, lines: str, name: str) -> DataFrame:
    """Adds the vector of a column of marked text; the units are laid out once."""
    units = f"__{name}_units"
    return df.withColumn(units, _unit_vectors(F.col(lines))).withColumn(name, vector_of_units(F.col(units))).drop(units)


def _lanes(a: Column, b: Column, of) -> Column:
    """Lane by lane; lanes that one vector does not store are zero."""
    zero = F.lit(0).cast("long")
    return F.zip_with(a, b, lambda x, y: of(F.coalesce(x, zero), F.coalesce(y, zero)))


def plus(a: Column, b: Column) -> Column:
    """Insertion: the vector of both multisets together."""
    return trimmed(_lanes(a, b, lambda x, y: (x + y) % MODULUS))


def minus(a: Column, b: Column) -> Column:
    """Deletion: the vector of what is in the first and not in the second."""
    return trimmed(_lanes(a, b, lambda x, y: (x - y + MODULUS) % MODULUS))


def hex_of(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two unit multisets, 1.0 exactly for equal vectors."""
    both = (a[DENSE] + b[DENSE]).cast("double")
    apart = F.abs(a[DENSE] - b[DENSE]).cast("double")
    cells = F.lit(float(CELLS))

    def counted(differs: Column) -> Column:
        """How many cells differ, by level, as far as a vector has levels."""
        last = F.floor((F.size(differs) - HEAD) / CELLS).cast("int") - 1
        each = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda k: F.aggregate(F.slice(differs, k * CELLS + HEAD + 1, CELLS), F.lit(0), lambda s, x: s + x),
        )
        return each

    def estimate(n: Column) -> Column:
        """Differing units: those of the levels that are not full, over the share of units that fall there."""
        seen = F.aggregate(n, F.lit(0.0), lambda s, x: s + F.when(x < FULL, -cells * F.log(1 - x / cells)).otherwise(0.0))
        full = F.transform(n, lambda x, k: F.when(x >= FULL, F.pow(F.lit(0.5), F.least(k + 1, F.lit(LEVELS - 1)))).otherwise(0.0))
        share = F.aggregate(full, F.lit(1.0), lambda s, x: s - x)
        return F.when(share > 0, seen / share).otherwise(both)

    differs = _lanes(a, b, lambda x, y: (x != y).cast("int"))
    counts = F.transform(F.array(differs), counted)
    found = F.transform(counts, estimate)[0]
    change = F.transform(F.array(found), lambda d: F.least(F.greatest(d, apart), both))[0]
    alike = F.transform(F.array(change), lambda d: (both - d) / (both + d))[0]
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(1.0)).otherwise(alike)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, vector, fingerprint) of every text."""
    lines = docs.select(F.col(id_col).alias("doc_id"), marked(F.coalesce(text_col, F.lit(""))).alias("lines"))
    return with_vector(lines, "lines", "vector").select("doc_id", "vector", hex_of(F.col("vector")).alias("fingerprint"))


def _place(order: Column, share: Column, cuts: Column) -> tuple[Column, Column]:
    """Between which sorted cuts a row lies, and its share of what lies there.

    Where several cuts are equal, one id holds that many buckets' rows; its rows are dealt
    to them by their share.
    """
    below = F.size(F.filter(cuts, lambda c: c < order))
    same = F.size(F.filter(cuts, lambda c: c == order))
    step = F.floor(share * same).cast("int")
    return below + step, F.when(same > 0, share * same - step).otherwise(share)


def _bucketed(docs: DataFrame, order: Column, tie: Column) -> DataFrame:
    """Adds ``__order``, ``__tie`` and ``__bucket``; buckets ascend with both and hold like numbers of rows."""
    # Not quite 1.0 for the largest hash.
    share = F.least(tie / F.lit(2.0**64) + 0.5, F.lit(1 - 2.0**-53))
    rows = docs.withColumns({"__order": order, "__tie": tie, "__share": share})
    parts = max(1, min(CHUNKS * CHUNKS, -(-docs.count() // BUCKET_ROWS)))
    if parts == 1:
        return rows.withColumn("__bucket", F.lit(0)).drop("__share")
    outer = max(2, round(parts**0.5))
    inner = max(2, -(-parts // outer))
    cuts = lambda n: F.percentile_approx("__order", [i / n for i in range(1, n)], 20 * CHUNKS)
    outer_cuts = F.lit(list(rows.agg(cuts(outer).alias("c")).first()["c"])).cast("array<long>")
    chunk, rest = _place(F.col("__order"), F.col("__share"), outer_cuts)
    dealt = rows.withColumn("__rest", rest).withColumn("__chunk", chunk).drop("__share")
    # Written down: another run over the same rows may cut elsewhere. At most CHUNKS rows of CHUNKS ids.
    inner_cuts = checkpointed(dealt.groupBy("__chunk").agg(cuts(inner).alias("__cuts")))
    within, _ = _place(F.col("__order"), F.col("__rest"), F.col("__cuts"))
    placed = dealt.join(F.broadcast(inner_cuts), "__chunk").withColumn("__bucket", F.col("__chunk") * CHUNKS + within)
    return placed.drop("__chunk", "__rest", "__cuts")


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the row that follows by descending id (after the last: the first).

    Rows are dealt to buckets of adjacent ids; rows that repeat an id follow a hash of the
    first carried column. The first row of every bucket is also sent to the bucket before,
    the first of all to the last, so every bucket finds its rows' successors within itself.
    """
    order = F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")))
    tagged = _bucketed(docs, order, F.xxhash64(carried[0]))
    first = F.min(F.struct("__order", "__tie")).alias("f")
    every = Window.partitionBy().orderBy("hb")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = (
        tagged.groupBy(F.col("__bucket").alias("hb"))
        .agg(first)
        .withColumn("to", F.coalesce(F.lag("hb").over(every), F.max("hb").over(whole)))
        .select("hb", "to", F.col("f.__order").alias("ho"), F.col("f.__tie").alias("ht"))
    )
    key = (F.col("__bucket") == F.col("hb")) & (F.col("__order") == F.col("ho")) & (F.col("__tie") == F.col("ht"))
    # At most CHUNKS * CHUNKS short rows.
    both = tagged.join(F.broadcast(heads), key, "left").drop("hb", "ho", "ht")
    own = F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("lent"))
    lent = F.struct(F.col("to").alias("b"), F.lit(1).alias("lent"))
    dealt = both.withColumn("__at", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, lent))))
    dealt = dealt.withColumn("__bucket", F.col("__at.b")).withColumn("__lent", F.col("__at.lent")).drop("__at", "to")
    in_order = Window.partitionBy("__bucket").orderBy("__lent", "__order", "__tie")
    for c in carried:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(in_order))
    return dealt.where("__lent = 0").drop("__bucket", "__order", "__tie", "__lent")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text's last third (floor of its code points) is replaced by the start of
    the next document. Its vector is the text's own, minus the units from the last unit
    boundary before the edit on, plus the units of the new end.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    vectors = with_vector(base.withColumn("lines", marked(F.col("text"))), "lines", "vector").drop("lines")
    near = with_next(vectors, "doc_id", ["text", "vector"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    cut = (
        near.withColumn("n_chars", n.cast("long"))
        .withColumn("keep", (n - third).cast("int"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("keep")), F.substring("next_text", F.lit(1), third)))
        .drop("next_text")
    )
    # The last boundary before the edit; the units before it are the same in both texts.
    kept = marked(F.substring("text", F.lit(1), F.col("keep")))
    seam = F.col("keep") - F.instr(F.reverse(kept), "\n") + 1
    cut = cut.withColumn("seam", F.when(F.instr(kept, "\n") > 0, seam).otherwise(F.lit(0)).cast("int"))
    tail = lambda c: F.substring(marked(F.col(c)), F.col("seam") + 1, F.length(c))
    ends = cut.withColumn("old_end", tail("text")).withColumn("new_end", tail("edited"))
    ends = ends.withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "edited")
    ends = with_vector(with_vector(ends, "old_end", "old_vector"), "new_end", "new_vector").drop("old_end", "new_end")
    done = ends.withColumn("edited_vector", plus(minus(F.col("vector"), F.col("old_vector")), F.col("new_vector")))
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex_of(F.col("vector")).alias("fingerprint"),
        hex_of(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
