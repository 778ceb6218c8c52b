"""Language identification by compression with per-language zstandard dictionaries.

Each language's raw-content dictionary is text of that language. A text is compressed
with every dictionary and goes to the language whose result is smallest; where the
margin is narrow it is marked as rejected.

Defined results: null text and text without a letter give ``und`` with score 0; texts that
compress alike go to the commonest language, with score 1 / languages; without any
learnable row everything is ``und``; rows are judged alone; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, crc_of_id

#: Documents of each language that its dictionary may be drawn from, and its bytes.
SAMPLE_DOCS, DICTIONARY_BYTES = 1000, 200_000
#: Languages that a model may have; more are an error, for every one costs a compression of each text.
MAX_LANGUAGES = 1000
#: Texts are compressed in chunks of this many bytes, each by itself, so that the
#: dictionary and not the text before explains a chunk.
CHUNK_BYTES = 4096
#: Bytes saved for one e-fold of confidence, and the least share of bytes that must
#: separate the best language from the next.
SOFTNESS, LEAST_MARGIN = 8.0, 0.01

_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def words_of(text: str) -> str:
    """Lower-case letters with single spaces: case, digits and signs tell no language."""
    return _OTHER.sub(" ", text.lower())


def has_letter(text: str) -> bool:
    """Whether a character is a letter; number forms such as ½ or Ⅷ are none."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def learn(
    docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """A dictionary per language, commonest first, from a sample bounded by ``sample_docs`` for each.

    Documents are drawn by a hash of their id and give equal shares of the dictionary,
    taken from a hashed place within them.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} names more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 0.9 * sample_docs / r["n"]))])
    wanted = draw < shares[F.col(lang_col)]
    share = max(64, 2 * dictionary_bytes // sample_docs)
    place = F.pmod(F.xxhash64(F.col(text_col)), F.greatest(F.length(text_col) - share, F.lit(1))).cast("int") + 1
    sampled = rows.where(wanted).select(
        F.col(lang_col).alias("lang"),
        F.substring(F.col(text_col), place, F.lit(share)).alias("part"),
        F.xxhash64(F.col(id_col), F.lit("order")).alias("o"),
    )
    parts: dict[str, list[str]] = {}
    for r in sampled.orderBy("o").limit(2 * sample_docs * max(1, len(counts))).collect():
        parts.setdefault(r["lang"], []).append(r["part"])
    common = sorted(parts, key=lambda k: (-next(r["n"] for r in counts if r["lang"] == k), k))
    return {k: words_of(" ".join(parts[k])).encode()[-dictionary_bytes:] for k in common}


@lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...], level: int):
    out = []
    for _, content in model:
        content = content if len(content) >= 8 else content + b" " * 8
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def predictor(model: dict[str, bytes], level: int = 6):
    frozen = tuple(model.items())
    names = [k for k, _ in frozen]

    @F.pandas_udf("lang_pred string, score double, rejected boolean, margin double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        squeeze = [c.compress for c in _compressors(frozen, level)]
        out = []
        for text in texts:
            if not names or text is None or not has_letter(text):
                out.append(("und", 0.0, True, 0.0))
                continue
            data = words_of(text).encode("utf-8")
            sizes = np.zeros(len(squeeze))
            for at in range(0, len(data), CHUNK_BYTES):
                chunk = data[at : at + CHUNK_BYTES]
                sizes += [len(f(chunk)) for f in squeeze]
            best = int(sizes.argmin())
            gain = sizes - sizes[best]
            score = 1.0 / float(np.exp(-gain / SOFTNESS).sum())
            margin = float(np.sort(gain)[1] / sizes.max()) if len(gain) > 1 else 1.0
            out.append((names[best], score, margin < LEAST_MARGIN, margin))
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected", "margin"])

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """The test fold: crc32 of the id's text is divisible by five."""
    return F.coalesce(crc_of_id(id_col) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return bounded(docs).select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predictor(model)(F.col(text_col)).alias("p")
    ).select("doc_id", "held_out", "p.*")
