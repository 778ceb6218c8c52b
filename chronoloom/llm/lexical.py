"""Ranked lexical search with variable-sized blocks of postings and exact block skipping.

Documents are dealt to shards of bounded size. In a shard each term has a posting list in
id order with its integer scores. Dynamic programming cuts every list into blocks so that
the error of the bounds (block maximum less score, summed over postings) plus a fixed cost
a block is least. A query opens its lists in falling order of their maxima. All documents are
pivots at first; after every few lists the k-th best sum so far is the threshold, and a
document whose sum and the maxima of the blocks that span it in the lists ahead stay below it
is a pivot no more. Only blocks that hold a pivot are read, the others are skipped. Bounds
hold, so the result is exact. Pivots are tested as arrays, not one cursor step at a time.

The terms of at most ``ITEMS`` items and ``VOCABULARY`` different terms are searched at once;
more items make several passes over the documents. That bounds what is sent to the tasks.

Defined results: null and empty texts, and texts without a term, match nothing and count in no
statistic; items without a term have no rows; every row is a document of its own, so repeated
rows each take a rank; every item row is ranked by itself; equal scores go to the smaller id,
null ids last; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, checkpointed
from .terms import WORDS, cut, per_row, slices

#: Items, and different terms of items, that are searched in one pass over the documents.
ITEMS, VOCABULARY = 1000, 1_000_000
#: Rows and postings of a shard.
SHARD_ROWS, SHARD_POSTINGS = 8192, 1_000_000
#: Longest block, and its fixed cost in mean scores of the list.
LONGEST, BLOCK_COST = 64, 2
#: Lists that are read between two looks at the threshold.
ROUND = 4

_INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"
_FOUND = "item long, doc_id long, score long"
_RESULT = "item_id long, rank int, doc_id long, score long"


# Postings.


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def _indexer(vocabulary: list[str]) -> Callable:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            for at, texts in slices(batch["text"]):
                row, names, code = cut(texts, WORDS)
                n = np.bincount(row, minlength=len(texts))
                told = np.asarray(pc.fill_null(pc.index_in(names.cast(pa.string()), value_set=known), -1), np.int64)
                of = told[code] if len(code) else code
                asked = of >= 0
                doc, term, tf = per_row(row[asked], of[asked], len(vocabulary))
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
                columns = [batch["doc_id"].slice(at, len(texts)), pa.array(n), _lists(ends, term), _lists(ends, tf)]
                rows = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))

    return index


def index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: all its terms counted, those of the vocabulary listed."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return bounded(docs).select(F.col("doc_id").cast("long"), text).mapInArrow(_indexer(vocabulary), _INDEX)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


# Blocks.


def block_starts(scores: np.ndarray, offsets: np.ndarray, cost: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Which postings start a block in the partition of each list whose cost is least.

    List t is ``scores[offsets[t]:offsets[t + 1]]``; a block costs ``cost[t]`` and, for each
    posting, its maximum less the posting's score. The lists advance together, a posting a
    step; ring column ``j % longest`` holds the block that starts at posting j.
    """
    starts = np.zeros(len(scores), bool)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    order = order[: np.count_nonzero(lengths)]
    if not len(order):
        return starts
    size, base, fixed = lengths[order], offsets[:-1][order], cost[order]
    top = np.zeros((len(order), longest), np.int64)
    head = np.zeros((len(order), longest), np.int64)
    begun = np.zeros(longest, np.int64)
    best, before = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    came = np.zeros(len(scores), np.int64)
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # lists with more postings than the step's number
    every = np.arange(len(order))
    for i in range(size[0]):
        a, column, width = live[i], i % longest, min(i + 1, longest)
        at = base[:a] + i
        s = scores[at]
        begun[column] = i
        top[:a, column] = 0
        head[:a, column] = best[:a] + fixed[:a] + before[:a]
        over = np.maximum(top[:a, :width], s[:, None], out=top[:a, :width])
        total = over * (i + 1 - begun[:width]) + head[:a, :width]
        least = total.argmin(1)
        before[:a] += s
        best[:a] = total[every[:a], least] - before[:a]
        came[at] = begun[least]
    last = size - 1
    while len(last):
        first = came[base + last]
        starts[base + first] = True
        more = first > 0
        base, last = base[more], first[more] - 1
    return starts


class Shard:
    """Posting lists of some documents in id order, cut into blocks."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, scores: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((docs, terms))
        self.docs, self.scores, self.n_docs = docs[order], scores[order], n_docs
        offsets = np.searchsorted(terms[order], np.arange(n_terms + 1))
        lengths = np.diff(offsets)
        sums = np.concatenate([[0], np.cumsum(self.scores)])
        cost = BLOCK_COST * (sums[offsets[1:]] - sums[offsets[:-1]]) // np.maximum(lengths, 1)
        self.starts = np.flatnonzero(block_starts(self.scores, offsets, cost))
        self.ends = np.append(self.starts[1:], len(self.scores))
        self.top = np.maximum.reduceat(self.scores, self.starts) if len(self.starts) else self.scores
        self.first, self.last = self.docs[self.starts], self.docs[self.ends - 1]
        self.blocks = np.searchsorted(self.starts, offsets)
        self.read = 0

    def _postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posting, block's place) of every posting of the blocks."""
        starts, size = self.starts[blocks], self.ends[blocks] - self.starts[blocks]
        self.read += int(size.sum())
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(starts, size) + within, np.repeat(np.arange(len(blocks)), size)

    def search(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, equal scores in id order."""
        held = self.blocks[terms + 1] - self.blocks[terms]
        terms, times = terms[held > 0], times[held > 0]
        most = np.array([self.top[self.blocks[t] : self.blocks[t + 1]].max() for t in terms], np.int64) * times
        order = np.argsort(-most, kind="stable")
        terms, times = terms[order], times[order]
        rounds = []
        for i in range(0, len(terms), ROUND):
            own = [np.arange(self.blocks[t], self.blocks[t + 1]) for t in terms[i : i + ROUND]]
            lists, weight = np.concatenate(own), np.repeat(times[i : i + ROUND], [len(x) for x in own])
            rounds.append((lists, weight, self._spanned(lists, weight)))
        # Sums of whole numbers below 2 ** 53, so doubles hold them exactly.
        score, pivots = np.zeros(self.n_docs), np.ones(self.n_docs, bool)
        ahead = np.sum([span for _, _, span in rounds], axis=0) if rounds else score
        for lists, weight, span in rounds:
            seen = np.append(0, np.cumsum(pivots))
            hit = seen[self.last[lists] + 1] > seen[self.first[lists]]
            at, of = self._postings(lists[hit])
            score += np.bincount(self.docs[at], weights=self.scores[at] * weight[hit][of], minlength=self.n_docs)
            score[~pivots] = 0
            ahead = ahead - span
            floor = max(np.partition(score, -k)[-k] if self.n_docs > k else 0, 1)
            pivots &= score + ahead >= floor
        found = np.flatnonzero(pivots & (score > 0))
        found = found[np.lexsort((found, -score[found]))][:k]
        return found, score[found].astype(np.int64)

    def _spanned(self, blocks: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The maxima of the blocks that span each document, summed."""
        gain = self.top[blocks] * times
        edge = np.bincount(self.first[blocks], weights=gain, minlength=self.n_docs + 1)
        edge -= np.bincount(self.last[blocks] + 1, weights=gain, minlength=self.n_docs + 1)
        return np.cumsum(edge)[:-1]


# Search.


def _searcher(items: list[tuple[int, list[int], list[int]]], weight: np.ndarray, documents: int, length: int, k: int) -> Callable:
    def search(group: pa.Table) -> pa.Table:
        ids = pc.fill_null(group["doc_id"], np.iinfo(np.int64).max).to_numpy()
        absent = np.asarray(pc.is_null(group["doc_id"]))
        place = np.empty(len(ids), np.int64)
        by_id = np.lexsort((absent, ids))
        place[by_id] = np.arange(len(ids))
        n = [int(x) for x in group["n"].to_numpy()]
        m = np.array([25 + 75 * x * documents // length for x in n], np.int64)
        listed = group["terms"].combine_chunks()
        row = np.asarray(pc.list_parent_indices(listed), np.int64)
        terms = pc.list_flatten(listed).to_numpy().astype(np.int64)
        tf = pc.list_flatten(group["tfs"].combine_chunks()).to_numpy().astype(np.int64)
        scores = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        shard = Shard(place[row], terms, scores, len(ids), len(weight))
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for item, asked, times in items:
            docs, best = shard.search(np.array(asked, np.int64), np.array(times, np.int64), k)
            found.append((item, by_id[docs], best))
        rows = np.concatenate([r for _, r, _ in found]).astype(np.int64)
        return pa.table(
            {
                "item": pa.array(np.repeat([i for i, _, _ in found], [len(r) for _, r, _ in found]).astype(np.int64)),
                "doc_id": group["doc_id"].take(pa.array(rows)),
                "score": pa.array(np.concatenate([s for _, _, s in found]).astype(np.int64)),
            }
        )

    return search


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in slices(batch["text"]):
            row, names, code = cut(texts, WORDS)
            item, code, times = per_row(row, code, len(names))
            keys = batch["item"].take(pa.array(item + at))
            columns = [keys, names.cast(pa.string()).take(pa.array(code)), pa.array(times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "term", "times"])


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score of each item."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    named = checkpointed(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), text))
    asked = named.select("item", F.col("text").cast("binary").alias("text"))
    terms = checkpointed(asked.mapInArrow(_item_terms, "item long, term string, times long"))
    size = terms.agg(F.count_distinct("item").alias("items"), F.count("*").alias("terms")).first()
    passes = max(1, math.ceil(size["items"] / ITEMS), math.ceil(size["terms"] / VOCABULARY))
    result = spark.createDataFrame([], _RESULT)
    if not size["items"]:
        return result
    dealt = F.pmod(F.xxhash64("item"), F.lit(passes))
    for p in range(passes):
        found = _one_pass(docs, terms.where(dealt == p), k)
        if found is None:
            continue
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
        result = result.union(ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))
    return result


def _one_pass(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame | None:
    """(item, doc_id, score) of each shard's k best for items whose number and terms are bounded."""
    held = terms.toPandas()
    vocabulary = sorted(set(held["term"]))
    if not vocabulary:
        return None
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = checkpointed(index(docs, vocabulary))
    total = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")).first()
    if not total["rows"]:
        return None
    listed = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toPandas()
    df = np.zeros(len(vocabulary), np.int64)
    df[listed["term"].to_numpy("int64")] = listed["df"].to_numpy("int64")
    wanted = [(key, [number[t] for t in own["term"]], own["times"].tolist()) for key, own in held.groupby("item")]
    find = _searcher(wanted, weights(df, total["rows"]), total["rows"], total["terms"], k)
    shards = max(1, math.ceil(total["rows"] / SHARD_ROWS), math.ceil(total["postings"] / SHARD_POSTINGS))
    # Rows are dealt by their place in the checkpoint, so rows that repeat one id are spread too.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(find, _FOUND)
