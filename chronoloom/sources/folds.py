"""Per-file folds as windows over line order: carried state, changed totals, last writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _so_far(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(rows: DataFrame, keys: list[str], order: list[str], states: dict[str, Column], before: bool = False, chunk: Column | None = None) -> DataFrame:
    """Adds each state's last non-null value up to the row, or before it.

    ``chunk`` numbers, in the order, parts of a key that are folded side by side: one row a
    part carries its last values on. A key without end is then as many tasks as it has parts.
    """
    if chunk is None:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
        return rows.withColumns({name: F.last(value, True).over(window) for name, value in states.items()})
    dealt = rows.withColumns({"__chunk": chunk} | {f"__v_{name}": value for name, value in states.items()})
    ends = dealt.groupBy(*keys, "__chunk").agg(
        *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.struct(*order))).alias(f"__e_{n}") for n in states]
    )
    chain = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(*keys, "__chunk", *[F.last(f"__e_{n}", True).over(chain).alias(f"__h_{n}") for n in states])
    near = carried(dealt, [*keys, "__chunk"], order, {f"__n_{n}": F.col(f"__v_{n}") for n in states}, before)
    met = near.join(handed, [*keys, "__chunk"])
    out = [c for c in rows.columns if c not in states]
    return met.select(*out, *[F.coalesce(f"__n_{n}", f"__h_{n}").alias(n) for n in states])


def changed_totals(rows: DataFrame, keys: list[str], order: list[str], total: str) -> DataFrame:
    """Rows whose cumulative total differs from the last one recorded before them."""
    held = carried(rows.where(F.col(total).isNotNull()), keys, order, {"__before": F.col(total)}, before=True)
    return held.where(~F.col(total).eqNullSafe(F.col("__before"))).drop("__before")


def last_write_first_place(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row for each key: the last values, at the place of the first."""
    last = F.max_by(F.struct(*columns), order).alias("__last")
    return rows.groupBy(*keys).agg(F.min(order).alias("place"), last).select(*keys, "place", *[F.col(f"__last.{c}").alias(c) for c in columns])


def filled_both_ways(rows: DataFrame, keys: list[str], order: list[str], name: str, chunk: Column | None = None) -> DataFrame:
    """A column's last non-null value, or the next one where there is none before."""
    if chunk is None:
        ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        value = F.coalesce(F.last(name, True).over(_so_far(keys, order)), F.first(name, True).over(ahead))
        return rows.withColumn(name, value)
    back = carried(rows, keys, order, {"__back": F.col(name)}, chunk=chunk)
    # Only rows before a key's first value look ahead, and all of them see that one.
    first = rows.groupBy(*keys).agg(F.min_by(name, F.when(F.col(name).isNotNull(), F.struct(*order))).alias("__first"))
    return back.join(first, keys).withColumn(name, F.coalesce("__back", "__first")).select(rows.columns)
