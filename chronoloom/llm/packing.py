"""Best-fit packing of tokenised documents by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece
lengths (at most ``capacity`` rows, whatever the corpus) reaches the driver. There, an
index of single, pair and triple sums of lengths gives, for a gap, combinations that fill
it exactly; they are consumed under the counts, and what is left is placed by best fit.
Pairs and triples for long pieces can spend the short ones that others need, so two plans
are made, with and without them, and the one with fewer sequences is taken. The plan says, for
every length, which ranks of its pieces go to which sequences at which offset. On the
cluster each piece gets its rank within its length by a two-step count over salted
groups, and looks its place up in the plan.

Defined results: null text counts as empty and gives one piece of one token (the end
mark); rows that repeat an id or text are documents of their own; an empty table gives an
empty table; extra columns are ignored; a special-token string in a text becomes its own
id, as the tokenizer's default settings do.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, checkpointed

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k.json"
#: Ranks within a length are counted in salted groups of about this many pieces. From
#: RANK_GROUP * MAX_GROUPS pieces of one length on (5e8), groups grow with their number.
RANK_GROUP, MAX_GROUPS = 512, 1 << 20


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write byte b as itself if printable, else as a later code point."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """An encoder of the vocabulary file; its merges are ranked by id.

    ``tiktoken`` runs the file's own vocabulary: same ids as ``tokenizers`` (tested), five
    times faster. A bare file name is looked up among the installed public tokenizers.
    """
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    chars = _byte_of_char()
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ids_of(text: str | None, vocabulary: str = VOCABULARY) -> list[int]:
    """The token ids of a text; strings of special tokens are those tokens."""
    encoding = encoder(vocabulary)
    if any(sign in (text or "") for sign in encoding.special_tokens_set):
        return encoding.encode(text, allowed_special="all")
    return encoding.encode_ordinary(text or "")


def closed_ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """``ids_of`` and the end mark as unsigned 32-bit numbers; the tokens of a text are never Python objects."""
    encoding, text = encoder(vocabulary), text or ""
    if any(sign in text for sign in encoding.special_tokens_set):
        ids = np.array(ids_of(text, vocabulary), np.uint32)
    else:
        ids = encoding.encode_to_numpy(text, disallowed_special=())
    return np.append(ids, np.uint32(END)).astype("<u4", copy=False)


def pieces_udf(capacity: int = CAPACITY, vocabulary: str = VOCABULARY):
    @F.pandas_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long>>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            ids = closed_ids(text, vocabulary)
            data, n = memoryview(ids).cast("B"), len(ids)
            size = ids.itemsize
            stops = list(range(n % capacity or capacity, n + 1, capacity))
            out.append(
                [
                    {"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(data[a * size : b * size])}
                    for i, (a, b) in enumerate(zip([0, *stops], stops))
                ]
            )
        return pd.Series(out, dtype="object")

    return cut


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); the first piece of a long document is the short one."""
    cut = bounded(docs).select(F.col(id_col).alias("doc_id"), pieces_udf(capacity, vocabulary)(F.col(text_col)).alias("p"))
    return cut.select("doc_id", F.inline("p"))


class Sums:
    """Which lengths fill a gap exactly: singles, pairs and triples hashed by their sum.

    The larger length of every pair is indexed by the sum (built when a sum is first asked
    for); a triple is a length and a pair of the rest. Counts are checked at each use.
    """

    def __init__(self, lengths: list[int], capacity: int):
        self.there = np.zeros(capacity + 1, bool)
        self.there[lengths] = True
        self.found = np.array(sorted(lengths, reverse=True), np.int64)
        self.larger: dict[int, np.ndarray] = {}

    def _pairs(self, total: int) -> np.ndarray:
        if total not in self.larger:
            a = self.found[(self.found < total) & (2 * self.found >= total)]
            self.larger[total] = a[self.there[total - a]]
        return self.larger[total]

    def _pair(self, total: int, left: np.ndarray, besides: tuple[int, ...], most: int) -> tuple[int, int] | None:
        a = self._pairs(total)
        a = a[(a <= most) & (left[a] > 0) & (left[total - a] > 0)]
        return next(((x, total - x) for x in a.tolist() if enough(left, (*besides, x, total - x))), None)

    def of(self, gap: int, left: np.ndarray, besides: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """The first combination with this sum that the counts allow; fewest and largest first."""
        if gap == 0:
            return ()
        if enough(left, (*besides, gap)):
            return (gap,)
        if pair := self._pair(gap, left, besides, gap):
            return pair
        firsts = self.found[(self.found <= gap - 2) & (3 * self.found >= gap)]
        for a in firsts[left[firsts] > 0].tolist():
            if pair := self._pair(gap - a, left, (*besides, a), a):
                return (a, *pair)
        return None


def enough(left: np.ndarray, lengths: tuple[int, ...]) -> bool:
    return all(left[x] >= lengths.count(x) for x in set(lengths))


class Plan:
    """Slots of every length: ranks from .. to, the first sequence, and the offset.

    Every length above half of the capacity needs a sequence of its own, which a single
    fills first. With ``exact_long`` pairs and triples fill the rest of those; without it
    they serve lengths up to a third of the capacity only, when best fit has no gap for them.
    ``filled`` counts the sequences that each kind of combination filled.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, exact_long: bool = False, sums: Sums | None = None):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.sums = sums or Sums([k for k, n in counts.items() if n], capacity)
        self.used = np.zeros(capacity + 1, np.int64)
        self.slots: dict[int, list[tuple[int, int, int, int]]] = {}
        self.sequences = 0
        self.filled = {"whole": 0, "single": 0, "pair": 0, "triple": 0, "best fit": 0}
        self._exact(exact_long)
        self._best_fit()
        self.filled["best fit"] = self.sequences - sum(self.filled.values())

    def _put(self, length: int, n: int, first: int, offset: int) -> None:
        start = int(self.used[length])
        self.slots.setdefault(length, []).append((start, start + n, first, offset))
        self.used[length] += n
        self.left[length] -= n

    def _consume(self, lengths: tuple[int, ...]) -> None:
        """Open as many sequences of these lengths as their counts allow."""
        n = min(int(self.left[x]) // lengths.count(x) for x in set(lengths))
        offset = 0
        for length in lengths:
            self._put(length, n, self.sequences, offset)
            offset += length
        self.sequences += n
        self.filled[("whole", "single", "pair", "triple")[len(lengths) - 1]] += n

    def _complement(self, length: int) -> tuple[int, ...] | None:
        return self.sums.of(self.capacity - length, self.left, (length,))

    def _exact(self, long: bool) -> None:
        for length in range(self.capacity, self.capacity // 2, -1):
            gap = self.capacity - length
            fill = (gap,) if gap else ()
            while self.left[length] > 0 and enough(self.left, (length, *fill)):
                self._consume((length, *fill))
        for length in range(self.capacity - 1, self.capacity // 3, -1) if long else ():
            while self.left[length] > 0 and (more := self._complement(length)) is not None:
                self._consume((length, *more))

    def _best_fit(self) -> None:
        """Largest first into the smallest gap that takes it; equal sequences move as one.

        Where no gap takes a short length, it opens sequences that a single, pair or triple
        fills exactly, if one does.
        """
        gaps: list[int] = []
        open_: dict[int, list[tuple[int, int]]] = {}

        def add(gap: int, first: int, n: int) -> None:
            if gap and n:
                if gap not in open_:
                    insort(gaps, gap)
                open_.setdefault(gap, []).append((first, n))

        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                want = int(self.left[length])
                at = bisect_left(gaps, length)
                if at < len(gaps):
                    gap = gaps[at]
                    first, n = open_[gap].pop()
                    if not open_[gap]:
                        del open_[gap]
                        gaps.pop(at)
                    take = min(n, want)
                    self._put(length, take, first, self.capacity - gap)
                    add(gap - length, first, take)
                    add(gap, first + take, n - take)
                elif length <= self.capacity // 3 and (more := self._complement(length)) is not None:
                    self._consume((length, *more))
                else:
                    each = self.capacity // length
                    full, rest = divmod(want, each)
                    for n, per in ((full, each), (1 if rest else 0, rest)):
                        if n:
                            for i in range(per):
                                self._put(length, n, self.sequences, i * length)
                            add(self.capacity - per * length, self.sequences, n)
                            self.sequences += n


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with fewer sequences of the two orders; pairs and triples for long pieces on a tie."""
    sums = Sums([k for k, n in counts.items() if n], capacity)
    return min((Plan(counts, capacity, long, sums) for long in (True, False)), key=lambda p: p.sequences)


def placer(plan: Plan):
    """A column function (length, rank) -> (sequence_id, offset); the plan is bounded by the capacity."""
    table = {
        length: tuple(np.array(c, np.int64) for c in zip(*sorted(slots))) for length, slots in plan.slots.items()
    }

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        ranks = rank.to_numpy()
        for value, rows in length.groupby(length).indices.items():
            starts, _, firsts, offsets = table[int(value)]
            slot = np.searchsorted(starts, ranks[rows], side="right") - 1
            sequence[rows] = firsts[slot] + ranks[rows] - starts[slot]
            offset[rows] = offsets[slot]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return place


def ranked(cut: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds ``rank``, 0.. within each length, from salted groups and their running counts."""
    spark = cut.sparkSession
    groups = spark.createDataFrame(
        [(k, min(MAX_GROUPS, -(-n // RANK_GROUP))) for k, n in counts.items()], "len2 long, n_groups int"
    )
    salted = (
        cut.join(F.broadcast(groups), cut["length"] == groups["len2"])
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("n_groups")).cast("int"))
        .drop("len2", "n_groups")
    )
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(
        F.col("length").alias("len2"), F.col("salt").alias("salt2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("number", F.row_number().over(within) - 1)
    met = numbered.join(base, (F.col("length") == F.col("len2")) & (F.col("salt") == F.col("salt2")))
    return met.withColumn("rank", F.col("number") + F.col("base")).drop("len2", "salt2", "number", "base", "salt")


def pack(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every piece with its sequence and offset."""
    cut = checkpointed(pieces(docs, capacity, vocabulary, id_col, text_col))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = ranked(cut, counts).withColumn("at", placer(best_plan(counts, capacity))("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
