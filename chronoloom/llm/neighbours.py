"""Nearest vectors by largest inner product, by multiprobe hashing with p-stable projections.

Vectors are divided by the longest one's length and get one more component that makes all
of them unit vectors; queries become unit vectors too. Then the largest inner product is the
smallest distance. A table hashes a vector by several Gaussian (2-stable) projections, each
cut into cells of one width. A query visits cells of all tables in the order of their
estimated success: the probability that a vector of inner product ``c`` with the query lies
there. On unit vectors the projection of such a vector is normal around ``c`` times the query's
projection, so that probability is known for each cell, not only for the nearest boundaries.

Two rounds: the first visits a few cells of each table and finds how good the k-th neighbour is
at least; the second visits as many cells as a neighbour of that goodness needs to be found with
probability ``SUCCESS``. Close queries stay cheap so, lone ones visit what they need.

Cells of a table that share their first projections form a group: its vectors and the queries
that visit it meet in one task, are ranked exactly there, and only each query's best leave it.
Groups are about ``GROUP_ROWS`` vectors; fuller ones are dealt into blocks of vectors, blocks of
queries, every pair of which meets. Projections follow a seed, the number of them the row count.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take
no part; a shorter vector counts as ending in zeros; every row is a vector of its own, so rows
that repeat an id are each other's neighbours; equal scores go to the smaller id, null ids last;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SEED = 42
#: Tables, width of a cell where unit vectors project with deviation 1, and vectors of a cell in the mean.
TABLES, WIDTH, CELL_ROWS = 4, 1.0, 64
#: Cells of each table that the first round visits, and the second round's probability to find the k-th.
FIRST_CELLS, SUCCESS = 16, 0.93
#: Vectors of a group in the mean; a group of more vectors, or queries, than BLOCK_ROWS is dealt into blocks.
GROUP_ROWS, BLOCK_ROWS = 4096, 8192
#: Queries that are ranked against a cell at once.
AT_ONCE = 256
#: Cells that a unit vector's projections usually fall in: 2 to the entropy of a normal cut at WIDTH.
_SPREAD = math.sqrt(2 * math.pi * math.e) / WIDTH

_HITS = "query long, hits array<struct<minus: double, late: int, vec_id: long, row: long>>"
_PLACED = "grp long, cell long, row long, vec_id long, vec binary"
_PROBED = "grp long, row long, cells array<long>, vec binary, floor double"


class Tables:
    """The projections: ``TABLES`` times ``functions`` Gaussians, with offsets; groups share the first ``leading``."""

    def __init__(self, rows: int, width: int):
        self.functions = max(1, round(math.log(max(rows / CELL_ROWS, 1)) / math.log(_SPREAD)))
        self.leading = min(self.functions, max(0, round(math.log(max(rows / GROUP_ROWS, 1)) / math.log(_SPREAD))))
        rng = np.random.default_rng(SEED)
        self.axes = rng.standard_normal((width + 1, TABLES * self.functions))
        self.shifts = rng.uniform(0, WIDTH, TABLES * self.functions)
        self.mixers = rng.integers(1, 1 << 62, (TABLES, self.functions), dtype=np.int64) * 2 + 1
        self.salts = rng.integers(1, 1 << 62, (TABLES, 2), dtype=np.int64)

    def projected(self, unit: np.ndarray) -> np.ndarray:
        """Projections by row, table and function."""
        return (unit @ self.axes).reshape(len(unit), TABLES, self.functions)

    def cells(self, projected: np.ndarray) -> np.ndarray:
        return np.floor((projected + self.shifts.reshape(TABLES, -1)) / WIDTH).astype(np.int64)

    def names(self, table: int | np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, cell) hashes of rows of cell numbers in a table."""
        with np.errstate(over="ignore"):
            mixed = (cells + 1) * self.mixers[table]
            mixed ^= mixed >> 31
            mixed *= np.int64(-7046029254386353131)
            lead = mixed[..., : self.leading].sum(-1) + self.salts[table, 0]
            return lead ^ (lead >> 29), mixed.sum(-1) + self.salts[table, 1]

    def best_cells(self, projected: np.ndarray, likeness: float, needed: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(tables, cell numbers) of one query in the order of estimated success.

        As many as a vector of that likeness needs to be met with probability ``needed``, or,
        without it, the first ``FIRST_CELLS`` of each table.
        """
        spread = math.sqrt(max(1 - likeness * likeness, 1e-4))
        centre = likeness * projected + self.shifts.reshape(TABLES, -1)
        low = np.floor((centre - 4 * spread) / WIDTH).astype(np.int64)
        span = np.arange(math.ceil(8 * spread / WIDTH) + 2)
        edges = (low[..., None] + np.append(span, len(span))) * WIDTH
        chance = np.diff(_normal((edges - centre[..., None]) / spread), axis=-1)
        best = chance.max(-1)
        share = 0.1
        while True:
            found = [self._likely(chance[t], best[t], share) for t in range(TABLES)]
            mass = np.array([p.sum() for p, _ in found])
            met = 1 - np.prod(1 - np.minimum(mass, 1.0))
            if share < 1e-9 or (min(len(p) for p, _ in found) >= FIRST_CELLS if needed is None else met >= needed + 0.2 * (1 - needed)):
                break
            share /= 4
        table = np.repeat(np.arange(TABLES), [len(p) for p, _ in found])
        prob = np.concatenate([p for p, _ in found])
        cells = np.concatenate([c for _, c in found]) + low[table]
        if needed is None:
            keep = np.concatenate([np.sort(np.argsort(-p, kind="stable")[:FIRST_CELLS]) + at for (p, _), at in zip(found, np.cumsum([0] + [len(p) for p, _ in found[:-1]]))])
            return table[keep], cells[keep]
        order = np.argsort(-prob, kind="stable")
        by_table = np.zeros((len(order), TABLES))
        by_table[np.arange(len(order)), table[order]] = prob[order]
        missed = np.prod(1 - np.minimum(np.cumsum(by_table, 0), 1.0), axis=1)
        keep = order[: 1 + int(np.searchsorted(-missed, needed - 1, "left"))]
        return table[keep], cells[keep]

    def _likely(self, chance: np.ndarray, best: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(probability, offsets) of the cells of one table at least ``share`` as likely as the likeliest."""
        floor = share * np.prod(best)
        rest = np.append(np.cumprod(best[::-1])[::-1][1:], 1.0)
        prob, offsets = np.ones(1), np.empty((1, 0), np.int64)
        for f in range(self.functions):
            whole = prob[:, None] * chance[f][None]
            i, j = np.nonzero(whole * rest[f] >= floor)
            prob = whole[i, j]
            offsets = np.column_stack([offsets[i], j])
        return prob, offsets


_GRID = np.linspace(-8, 8, 16001)
_CDF = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in _GRID])


def _normal(x: np.ndarray) -> np.ndarray:
    return np.interp(x, _GRID, _CDF)


def _matrix(vecs: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of stored doubles, zeros after the end of a shorter one."""
    blobs = vecs.to_pylist()
    if all(len(b) == 8 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), width)
    return np.frombuffer(b"".join(b.ljust(8 * width, b"\0") for b in blobs), "<f8").reshape(len(blobs), width)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as bytes of doubles, with their lengths."""
    for batch in batches:
        blobs, norms, sizes = [], [], []
        for v in batch["vec"]:
            x = None if not v.is_valid or not len(v.values) or v.values.null_count else np.asarray(v.values, "<f8")
            fits = x is not None and np.isfinite(x).all() and x.any()
            blobs.append(x.tobytes() if fits else None)
            norms.append(math.sqrt(float((x * x).sum())) if fits else None)
            sizes.append(len(x) if fits else None)
        columns = [batch["vec_id"], batch["asks"], pa.array(blobs, pa.binary()), pa.array(norms, pa.float64()), pa.array(sizes, pa.int32())]
        rows = pa.RecordBatch.from_arrays(columns, ["vec_id", "asks", "vec", "norm", "size"])
        yield rows.filter(pc.is_valid(rows["vec"]))


def stored(vectors: DataFrame, asks: Column) -> DataFrame:
    """(row, vec_id, asks, vec, norm, size) of the vectors that take part; ``row`` names the row."""
    asked = F.coalesce(asks, F.lit(False)).alias("asks")
    rows = vectors.select(F.col("vec_id").cast("long"), asked, F.col("embedding").cast("array<double>").alias("vec"))
    kept = rows.mapInArrow(_stored, "vec_id long, asks boolean, vec binary, norm double, size int")
    return checkpointed(kept).withColumn("row", F.monotonically_increasing_id())


def _placer(tables: Tables, longest: float, width: int) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["vec"], width) / longest
            last = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
            cells = tables.cells(tables.projected(np.column_stack([x, last])))
            for t in range(TABLES):
                group, cell = tables.names(t, cells[:, t])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group), pa.array(cell), batch["row"], batch["vec_id"], batch["vec"]],
                    ["grp", "cell", "row", "vec_id", "vec"],
                )

    return place


def _prober(tables: Tables, width: int, needed: float | None) -> Callable:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["vec"], width)
            x = x / np.sqrt((x * x).sum(1))[:, None]
            projected = tables.projected(np.column_stack([x, np.zeros(len(x))]))
            likeness = np.clip(np.asarray(batch["likeness"]), -1.0, 1.0)
            at, groups, cells = [], [], []
            for i in range(len(x)):
                table, numbers = tables.best_cells(projected[i], float(likeness[i]), needed)
                group, cell = tables.names(table, numbers)
                order = np.argsort(group, kind="stable")
                starts = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
                at += [i] * len(starts)
                groups.append(group[order][starts])
                cells += np.split(cell[order], starts[1:])
            rows = pa.array(at)
            own = [batch[c].take(rows) for c in ("row", "vec", "floor")]
            columns = [pa.array(np.concatenate(groups)), own[0], pa.array(cells, pa.list_(pa.int64())), *own[1:]]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "row", "cells", "vec", "floor"])

    return probe


def _ranker(k: int, width: int) -> Callable:
    def rank(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        """Each query's k best, not below its floor, of the cells that it visits in one block of one group."""
        hits = pa.schema([("query", pa.int64()), ("hits", pa.list_(pa.struct([("minus", pa.float64()), ("late", pa.int32()), ("vec_id", pa.int64()), ("row", pa.int64())])))])
        if not members.num_rows or not queries.num_rows:
            return hits.empty_table()
        order = np.argsort(members["cell"].to_numpy(), kind="stable")
        cell = members["cell"].to_numpy()[order]
        vectors, rows = _matrix(members["vec"], width)[order], members["row"].to_numpy()[order]
        ids = pc.fill_null(members["vec_id"], np.iinfo(np.int64).max).to_numpy()[order]
        late = np.asarray(pc.is_null(members["vec_id"]))[order].astype(np.int32)
        asked, asking, floors = _matrix(queries["vec"], width), queries["row"].to_numpy(), queries["floor"].to_numpy()
        listed = queries["cells"].combine_chunks()
        who = np.asarray(pc.list_parent_indices(listed), np.int64)
        visits = pc.list_flatten(listed).to_numpy()
        first, stop = np.searchsorted(cell, visits, "left"), np.searchsorted(cell, visits, "right")
        real = stop > first
        who, first, stop = who[real], first[real], stop[real]
        order = np.argsort(first, kind="stable")
        who, first, stop = who[order], first[order], stop[order]
        cuts = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts, np.append(cuts[1:], len(first))):
            lo, hi = first[a], stop[a]
            for c in range(a, b, AT_ONCE):
                q = who[c : min(c + AT_ONCE, b)]
                near = asked[q] @ vectors[lo:hi].T
                near[asking[q][:, None] == rows[None, lo:hi]] = -np.inf
                least = floors[q]
                if hi - lo > k and np.isneginf(least).any():
                    least = np.maximum(least, np.partition(near, hi - lo - k, axis=1)[:, hi - lo - k])
                # Products of a block may differ in the last bits, so near ties stay.
                least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.finfo(float).max)
                i, j = np.nonzero(near >= least[:, None])
                pairs.append((q[i], lo + j))
        if not any(len(q) for q, _ in pairs):
            return hits.empty_table()
        q, m = (np.concatenate(x) for x in zip(*pairs))
        # One order of adding for all pairs: equal vectors get equal scores wherever they are met.
        score = np.concatenate([(asked[q[s : s + 65536]] * vectors[m[s : s + 65536]]).sum(1) for s in range(0, len(q), 65536)])
        order = np.lexsort((rows[m], ids[m], late[m], -score, q))
        q, m, score = q[order], m[order], score[order]
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        keep = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < k
        keep &= rows[m] != asking[q]
        q, m, score = q[keep], m[keep], score[keep]
        if not len(q):
            return hits.empty_table()
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        fields = [pa.array(-score), pa.array(late[m]), pa.array(ids[m], mask=late[m] == 1), pa.array(rows[m])]
        struct = pa.StructArray.from_arrays(fields, ["minus", "late", "vec_id", "row"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(q)).astype(np.int32)), struct)
        return pa.table({"query": pa.array(asking[q[begin]]), "hits": lists}, schema=hits)

    return rank


def _met(members: DataFrame, probes: DataFrame, k: int, width: int) -> DataFrame:
    """(query, hits): the k best of each query in each group it visits, fuller groups in blocks."""
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK_ROWS)).cast("int")
    held, wanted = members.groupBy("grp").agg(F.count("*").alias("ms")), probes.groupBy("grp").agg(F.count("*").alias("qs"))
    full = held.join(wanted, "grp").where((F.col("ms") > BLOCK_ROWS) | (F.col("qs") > BLOCK_ROWS))
    full = checkpointed(full.select("grp", blocks("ms").alias("mb"), blocks("qs").alias("qb")))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        told = rows.join(full, "grp", "left")
        n_own, n_other = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        return (
            told.withColumn(own, F.pmod(F.xxhash64("row"), n_own).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), n_other - 1)))
        )

    left = dealt(members, "mb", "qb").groupBy("grp", "mb", "qb")
    right = dealt(probes, "qb", "mb").groupBy("grp", "mb", "qb")
    return left.cogroup(right).applyInArrow(_ranker(k, width), _HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best different rows of each query; the lists that meet hold at most k each."""
    merged = hits.groupBy("query").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("all"))
    # A row that several tables found has one score, so its entries stand together.
    fresh = F.filter("all", lambda x, i: (i == 0) | (x["row"] != F.get(F.col("all"), i - 1)["row"]))
    return merged.select("query", F.slice(fresh, 1, k).alias("hits"))


def nearest(vectors: DataFrame, asks: Column, k: int = 20, success: float = SUCCESS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that asks, among all other rows."""
    rows = stored(vectors, asks)
    size = rows.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max("size").alias("width")).first()
    n, longest, width = size["n"], size["norm"] or 1.0, size["width"] or 1
    tables = Tables(n, width)
    members = rows.select("row", "vec_id", "vec").mapInArrow(_placer(tables, longest, width), _PLACED)
    queries = rows.where("asks").select("row", "vec_id", "vec", "norm")

    def visited(asking: DataFrame, needed: float | None) -> DataFrame:
        probes = asking.select("row", "vec", "likeness", "floor").mapInArrow(_prober(tables, width, needed), _PROBED)
        return _met(members, checkpointed(probes), k, width)

    nothing = F.lit(float("-inf"))
    first = checkpointed(_best(visited(queries.withColumns({"likeness": F.lit(0.7), "floor": nothing}), None), k))
    found = queries.join(first.withColumnRenamed("query", "row"), "row", "left")
    worst = -F.element_at("hits", -1)["minus"]
    likeness = worst / (F.col("norm") * F.lit(longest))
    # Fewer than k found so far tell nothing of the k-th: it may be at a right angle.
    full = F.size("hits") >= min(k, max(n - 1, 1))
    asking = found.select(
        "row", "vec", F.coalesce(F.when(full, likeness).otherwise(F.least(F.lit(0.0), likeness)), F.lit(0.0)).alias("likeness"),
        F.when(full, worst).otherwise(nothing).alias("floor"),
    )
    second = visited(asking, success)
    best = _best(first.union(second), k)
    named = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(named, "query").select("query_id", F.posexplode("hits").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score")
    )
