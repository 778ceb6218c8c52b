"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every whole text by patterns. The hash of each candidate's value
is counted over the corpus by distinct repositories and owners: values that several
owners share, or that very many repositories of one owner hold, are copied examples;
random-looking values of one owner's few repositories are live-looking credentials.

Defined results: null text counts as empty; rows without a candidate have zero counts and
an empty ``spans``; a null repository or owner counts as one of its own; rows that repeat
an id are judged each by its own values; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpointed

BASE_KINDS = ("assign", "access", "hex")
#: Kinds in the order in which spans of one start are listed; the base kinds come first.
KINDS = (*BASE_KINDS, "github", "slack", "google", "jwt", "private_key")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_MORE = (
    ("github", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", "xox", re.compile(r"xox[abeoprs]-[A-Za-z0-9-]{10,}")),
    ("google", "AIza", re.compile(r"AIza[0-9A-Za-z_-]{35}")),
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    (
        "private_key",
        "-----BEGIN ",
        re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?"),
    ),
)
_PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0000|1234|abcd|test")


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value) of every candidate, by start, then kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    for kind, sign, pattern in _MORE:
        if sign in text:
            found += [(m.start(), KINDS.index(kind), m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(found)


def looks_random(value: str, least_bits: float = 2.8) -> bool:
    """Whether a value has the entropy per character of a key and no placeholder's words."""
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return bits >= least_bits and not _PLACEHOLDER.search(value)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


_SCHEMA = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "candidates array<struct<at: string, hash: string, random: boolean>>"
)


def scan(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        spans = find(text or "")
        base = [s for s in spans if s[1] < len(BASE_KINDS)]
        n = Counter(s[1] for s in base)
        digest = hashlib.sha256(_joined(base).encode()).hexdigest()
        values = [
            {"at": f"{KINDS[k]}:{a}:{b}", "hash": hashlib.sha256(v.encode()).hexdigest(), "random": looks_random(v)}
            for a, k, b, v in spans
        ]
        out.append((n[0], n[1], n[2], digest, _joined(spans), values))
    return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "candidates"])


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, repos, owners): in how many repositories and owners each value is.

    Rows are reduced to distinct places before they meet by value, so a value that a
    third of all documents repeat arrives as few rows.
    """
    places = candidates.distinct()
    repos = places.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("repos"))
    owners = places.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    return repos.join(owners, "hash")


def secrets(
    docs: DataFrame,
    repo: Column | None = None,
    owner: Column | None = None,
    max_owners: int = 1,
    max_repos: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: base counts and digest, all spans, and how they were judged.

    ``live`` lists random-looking values that at most ``max_owners`` owners have in at most
    ``max_repos`` repositories, ``examples`` those that more have.
    """
    repo = F.col("source") if repo is None else repo
    owner = F.col("source") if owner is None else owner
    scanned = checkpointed(
        bounded(docs).select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
            F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
            F.pandas_udf(scan, _SCHEMA)(F.col(text_col)).alias("s"),
        )
        .select("doc_id", "repo", "owner", "s.*")
        .withColumn("values", F.md5(F.array_join("candidates.hash", "")))
    )
    plain = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    hit = scanned.where(F.size("candidates") > 0)
    each = hit.select("doc_id", "spans", "repo", "owner", F.explode("candidates").alias("c"))
    counts = ownership(each.select("c.hash", "repo", "owner"))
    once = hit.dropDuplicates(["doc_id", "spans", "values"]).select("doc_id", "spans", "values", F.posexplode("candidates").alias("i", "c"))
    judged = once.join(counts, F.col("c.hash") == counts["hash"])
    listed = lambda cond: F.array_join(
        F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("i", "c.at")))), lambda x: x["at"]), ","
    )
    shared = (F.col("owners") > max_owners) | (F.col("repos") > max_repos)
    verdicts = judged.groupBy(F.col("doc_id").alias("id2"), F.col("spans").alias("spans2"), F.col("values").alias("values2")).agg(
        listed(~shared & F.col("c.random")).alias("live"),
        listed(shared).alias("examples"),
        F.max("owners").alias("most_owners"),
        F.max("repos").alias("most_repos"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("spans") == F.col("spans2")) & (F.col("values") == F.col("values2"))
    met = hit.select(*plain, "values").join(verdicts, same)
    rest = scanned.where(F.size("candidates") == 0).select(
        *plain, F.lit("").alias("live"), F.lit("").alias("examples"), F.lit(0).cast("long").alias("most_owners"), F.lit(0).cast("long").alias("most_repos")
    )
    return met.select(rest.columns).unionByName(rest)
