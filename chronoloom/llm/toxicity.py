"""Toxicity by a linear-chain conditional random field over tokens.

Labels are given per document. Word forms (whole words and word beginnings) whose document
counts differ strongly between toxic and clean labelled documents label tokens of toxic
documents; a two-state field is trained on the windows of tokens around them, over whole
texts. In a text, tokens that carry learned forms are located (each form is a feature of
its token), the tokens between them are stepped over by powers of the transition matrix,
and forward-backward gives each one's marginal. The marginals aggregate to a document
score, calibrated on the labelled rows, and to offending offsets.

Defined results: null and empty texts, and texts without a learned form, have the score of
a text without evidence; without any usable label, or with labels of one kind only, every
score is the share of toxic labels; repeated label rows count once per row; null labels
are left out; rows are judged alone; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import bounded, checkpointed, crc_of_id

#: The model is fitted on about this many labelled rows at most, drawn by a hash.
SAMPLE_ROWS = 12_000
#: Word forms kept: those with the strongest evidence, at most this many.
MAX_FORMS = 4000
#: A form needs this many toxic documents, this log-likelihood ratio and this odds factor.
LEAST_DOCS, LEAST_EVIDENCE, LEAST_FACTOR = 4, 16.0, 4.0
THRESHOLD = 0.7
#: Tokens without a form on each side of a located one in a training window, and the steps
#: at which a longer window is cut into several.
MARGIN, WINDOW = 4, 64
_PREFIXES = range(3, 9)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_of_id(id_col) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents outside the held-out fold, at most about ``rows``."""
    usable = labels.where((crc_of_id() % 3 != 1) & F.col("toxic").isNotNull()).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic")
    )
    share = min(1.0, rows / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < int(share * (1 << 30)))
    return checkpointed(docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id"))


def word_forms(sample: DataFrame, limit: int = MAX_FORMS) -> dict[str, float]:
    """Forms with their evidence. A form ending in ``$`` is a whole word, others begin one."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.length(w) >= 2)

    def forms(w: Column) -> Column:
        begin = [F.when(F.length(w) > n, F.substring(w, 1, n)) for n in _PREFIXES]
        return F.array_compact(F.array(F.concat(w, F.lit("$")), *begin))

    total = sample.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = float(total["t"] or 0), float(total["c"] or 0)
    if not toxic or not clean:
        return {}
    counted = (
        sample.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform(words, forms)))).alias("form"))
        .groupBy("form")
        .agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("c"))
        .where(F.col("t") >= LEAST_DOCS)
    )
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    n = F.col("t") + F.col("c")
    evidence = 2 * (
        part(F.col("t"), n * (toxic / (toxic + clean)))
        + part(F.col("c"), n * (clean / (toxic + clean)))
    )
    factor = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1))
    kept = counted.withColumn("e", evidence).where((F.col("e") >= LEAST_EVIDENCE) & (factor >= LEAST_FACTOR))
    rows = kept.orderBy(F.col("e").desc(), "form").limit(limit).collect()
    return {r["form"]: r["e"] for r in rows}


@lru_cache(maxsize=4)
def _automaton(forms: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    entries: dict[str, dict[bool, int]] = {}
    for i, form in enumerate(forms):
        entries.setdefault(form.removesuffix("$"), {})[form.endswith("$")] = i
    for text, ids in entries.items():
        out.add_word(text, (len(text), ids))
    out.make_automaton()
    return out


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


Located = list[tuple[int, int, tuple[int, ...]]]


def locate(text: str, forms: tuple[str, ...]) -> Located:
    """(start, end, forms) of each word with forms: the whole word's and its beginnings'."""
    if not forms or not text:
        return []
    low = _lower(text)
    found: dict[int, list[int]] = {}
    for last, (size, ids) in _automaton(forms).iter(low):
        start = last - size + 1
        if start and low[start - 1].isalpha():
            continue
        ends = last + 1 == len(low) or not low[last + 1].isalpha()
        form = ids.get(ends)
        if form is not None:
            found.setdefault(start, []).append(form)
    out = []
    for start, own in sorted(found.items()):
        end = start
        while end < len(low) and low[end].isalpha():
            end += 1
        out.append((start, end, tuple(sorted(own))))
    return out


def gaps(text: str, found: Located) -> list[int]:
    """White-space tokens before, between and after the located words."""
    marks = [0, *[x for s in found for x in s[:2]], len(text)]
    return [len(text[a:b].split()) for a, b in zip(marks[::2], marks[1::2])]


def windows(tokens: list[tuple[int, list[int]]], after: int, label: int, other: int) -> list[tuple[list[list[int]], list[int]]]:
    """Training sequences of one text: (gap before, forms) of its located tokens, and the gap at its end.

    Stretches further than MARGIN from every located token are left out, for they hold
    plain tokens alone; nothing else is.
    """
    out: list[tuple[list[list[int]], list[int]]] = []
    xs: list[list[int]] = []
    ys: list[int] = []

    def plain(n: int) -> None:
        xs.extend([[other]] * n)
        ys.extend([0] * n)

    def end() -> None:
        for at in range(0, len(xs), WINDOW):
            out.append((xs[at : at + WINDOW], ys[at : at + WINDOW]))
        xs.clear()
        ys.clear()

    for i, (gap, forms) in enumerate(tokens):
        if gap > 2 * MARGIN or not i:
            if i:
                plain(MARGIN)
            end()
            plain(min(gap, MARGIN))
        else:
            plain(gap)
        xs.append(list(forms))
        ys.append(label)
    if tokens:
        plain(min(after, MARGIN))
    end()
    return out


@dataclass
class Model:
    forms: tuple[str, ...]
    weights: np.ndarray  # log odds of the toxic state for each form, last: any other token
    moves: np.ndarray
    starts: np.ndarray
    calibration: np.ndarray
    base: float

    def __post_init__(self):
        if not self.forms:
            return
        self.odds, self.pull = np.exp(np.clip(self.weights, -50, 50)), np.exp(self.moves)
        step = self.pull * np.array([1.0, self.odds[-1]])
        self.powers = {0: np.eye(2), 1: step / np.abs(np.linalg.eigvals(step)).max()}

    def _over(self, gap: int) -> np.ndarray:
        """The scaled transition over so many plain tokens; short gaps are kept, they recur."""
        power = self.powers.get(gap)
        if power is None:
            power = np.linalg.matrix_power(self.powers[1], gap)
            if gap < 4096:
                self.powers[gap] = power
        return power

    def _emits(self, forms: tuple[int, ...]) -> np.ndarray:
        return np.array([1.0, np.prod(self.odds[list(forms)])])

    def marginals(self, found: Located, between: list[int]) -> list[float]:
        """P(toxic) of every located token, by forward-backward with powers over the gaps."""
        emits = [self._emits(forms) for _, _, forms in found]
        state, forward = np.exp(self.starts - self.starts.max()), []
        for i, own in enumerate(emits):
            if not i and between[0]:
                # The first plain token starts the chain and so has no move before it.
                state = state * np.array([1.0, self.odds[-1]])
                state = state @ self._over(between[0] - 1) @ self.pull
            elif i:
                state = state @ self._over(between[i]) @ self.pull
            state = state * own
            state = state / state.sum()
            forward.append(state)
        back, out = np.ones(2), [0.0] * len(found)
        for i in range(len(found) - 1, -1, -1):
            back = self._over(between[i + 1]) @ back
            both = forward[i] * back
            out[i] = float(both[1] / both.sum())
            back = self.pull @ (emits[i] * back)
            back = back / back.sum()
        return out

    def evidence(self, text: str | None) -> tuple[list[float], Located, list[float]]:
        found = locate(text or "", self.forms)
        if not found:
            return [1.0, 0.0, 0.0, 0.0], found, []
        ps = self.marginals(found, gaps(text, found))
        total, words = sum(ps), len(text.split())
        return [1.0, float(np.log1p(total)), max(ps), float(np.log1p(100 * total / (words + 20)))], found, ps

    def score(self, x: list[float]) -> float:
        return self.base if not self.forms else float(1 / (1 + np.exp(-np.clip(np.dot(self.calibration, x), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.02, rounds: int = 60) -> np.ndarray:
    """Newton steps of a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + l2 * np.r_[0, w[1:]] / len(y) ** 0.5
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.eye(len(w)) * (l2 / len(y) ** 0.5 + 1e-9)
        w -= np.linalg.solve(curve, slope)
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn forms, the field and the calibration from the bounded labelled sample."""
    sample = labelled_sample(bounded(docs), labels, rows)
    forms = tuple(word_forms(sample))

    def located(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = locate(text, forms)
            out.append([[g, *f] for g, f in zip(gaps(text, found), [*[f[2] for f in found], ()])])
        return pd.Series(out, dtype="object")

    seen = sample.select("toxic", F.pandas_udf(located, "array<array<int>>")("text").alias("at")).collect()
    y = np.array([r["toxic"] for r in seen], np.float64)
    base = float((y.sum() + 0.5) / (len(y) + 1))
    none = np.zeros(0)
    if not forms:
        return Model((), none, np.zeros((2, 2)), np.zeros(2), none, base)
    other = len(forms)
    sequences = []
    for r in seen:
        tokens = [(t[0], t[1:]) for t in r["at"]]
        sequences += windows(tokens[:-1], tokens[-1][0], r["toxic"], other)
        if len(tokens) == 1 and tokens[0][0]:
            sequences.append(([[other]] * MARGIN, [0] * MARGIN))
    field = crf.train(sequences, len(forms) + 1)
    weights = field.weights[:, 1] - field.weights[:, 0]
    model = Model(forms, weights, field.moves, field.starts, none, base)

    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([model.evidence(t)[0] for t in texts], dtype="object")

    points = sample.select("toxic", F.pandas_udf(evidence, "array<double>")("text").alias("x")).collect()
    x, y = np.array([p["x"] for p in points]), np.array([p["toxic"] for p in points], np.float64)
    model.calibration = _logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans): spans are start:end of offending tokens."""

    def scored(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            x, found, ps = model.evidence(text)
            spans = ",".join(f"{a}:{b}" for (a, b, _), p in zip(found, ps) if p >= 0.5)
            out.append((model.score(x), spans))
        return pd.DataFrame(out, columns=["score", "spans"])

    s = F.pandas_udf(scored, "score double, spans string")(F.col(text_col))
    return bounded(docs).select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), s.alias("s")).select(
        "doc_id", "held_out", "s.score", (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), "s.spans"
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, all columns kept."""

    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(model.evidence(t)[0]) < THRESHOLD for t in texts], dtype="bool")

    return bounded(docs).where(F.pandas_udf(keep, "boolean")(F.col(text_col)))
