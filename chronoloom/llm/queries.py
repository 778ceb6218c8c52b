"""One query per operator, at production parameters over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, language, lexical, mixing, multiset, neighbours, ogg, packing, pii, secrets, simhash, toxicity, webtext
from .common import crc_of_id, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(docs, temperature=0.5, seed=17)


OP1_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT sum(pow(CAST(n AS DOUBLE), 0.5)) AS s, sum(n) AS rows_all FROM counts),
rates AS (
  SELECT source, pow(CAST(n AS DOUBLE), 0.5) / s * CAST(rows_all AS DOUBLE) / n AS rate FROM counts, total),
drawn AS (
  SELECT source, rate, greatest(ceil(rate / 32.0), 1) AS draws, rate / greatest(ceil(rate / 32.0), 1) AS mu FROM rates),
ks AS (SELECT unnest(range(0, 200)) AS k),
pmf AS (
  SELECT source, k, exp(k * ln(mu) - mu - lgamma(k + 1)) AS p FROM drawn, ks
  WHERE k <= ceil(mu + 12 * sqrt(mu) + 24)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
tries AS (
  SELECT d.doc_id, d.source, j,
    CAST('0x' || substr(md5('17:' || CAST(d.doc_id AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT)
      / 4503599627370496.0 AS u
  FROM (SELECT documents.doc_id, source, unnest(range(1, CAST(draws AS BIGINT) + 1)) AS j
        FROM documents JOIN drawn USING (source)) d),
copies AS (
  SELECT t.doc_id, CAST(count(*) AS INTEGER) AS n_copies FROM tries t JOIN cdf ON cdf.source = t.source AND cdf.c <= t.u
  GROUP BY t.doc_id)
SELECT x.doc_id, x.text, x.lang, x.source, x.n_chars, x.n_copies, CAST(x.copy AS INTEGER) AS copy,
  CAST('0x' || substr(md5('17/order:' || CAST(x.doc_id AS VARCHAR) || ':' || CAST(x.copy AS VARCHAR)), 1, 15) AS BIGINT)
    AS shuffle_key
FROM (SELECT d.*, n_copies, unnest(range(1, n_copies + 1)) AS copy FROM documents d JOIN copies USING (doc_id)) x
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.linked_components(table(spark, sf_dir, "documents"), words_per=3, max_bits=2)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def op4_webtext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.described(ogg.media_table(table(spark, sf_dir, "documents")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs, crc_of_id() % 5 != 0))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edit_report(table(spark, sf_dir, "documents"))


def _units(lines: str) -> str:
    """SQL of the hashed units of a column of marked text: eight 32-bit words, level and cell of each."""
    units = f"list_filter(string_split({lines}, chr(10)), lambda u: u <> '')"
    words = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)" for i in range(multiset.DENSE))
    level = f"CAST(least(CASE WHEN v[8] = 0 THEN 64 ELSE bit_count((v[8] & (-v[8])) - 1) END, {multiset.LEVELS - 1}) AS BIGINT)"
    vs = f"list_transform(list_transform({units}, lambda u: sha256(u)), lambda h: [{words}])"
    return f"list_transform({vs}, lambda v: list_concat(v, [{level} * {multiset.CELLS} + (v[7] >> 28)]))"


def _lanes(vs: str) -> str:
    """SQL of the lanes of a list of hashed units, up to the last level that has one."""
    total = lambda xs: f"CAST(coalesce(list_sum({xs}), 0) % {multiset.MODULUS} AS BIGINT)"
    dense = ", ".join(total(f"list_transform({vs}, lambda v: v[{i + 1}])") for i in range(multiset.DENSE))
    last = f"coalesce(list_max(list_transform({vs}, lambda v: v[9])), -1)"
    cells = (
        f"list_transform(range(0, ({last} // {multiset.CELLS} + 1) * {multiset.CELLS}), lambda c: "
        + total(f"list_transform({vs}, lambda v: CASE WHEN v[9] = c THEN v[1] ELSE 0 END)")
        + ")"
    )
    return f"list_concat([{dense}, CAST(len({vs}) AS BIGINT)], {cells})"


def _differing(a: str, b: str) -> str:
    """SQL of how many cells differ, by level."""
    at = f"{multiset.HEAD} + {multiset.CELLS} * k"
    return (
        f"list_transform(range(0, {multiset.LEVELS}), lambda k: "
        f"len(list_filter(range({at} + 1, {at} + {multiset.CELLS + 1}), lambda i: coalesce({a}[i], 0) <> coalesce({b}[i], 0))))"
    )


def _likeness(a: str, b: str, n: str) -> str:
    """SQL of the likeness of two lists of lanes of which ``n`` lists the differing cells by level."""
    size, cells = multiset.HEAD, float(multiset.CELLS)
    seen, share = [], []
    for k in range(multiset.LEVELS):
        usable = f"CASE WHEN {n}[{k + 1}] < {multiset.FULL} THEN"
        seen.append(f"{usable} -{cells} * ln(1 - {n}[{k + 1}] / {cells}) ELSE 0.0 END")
        share.append(f"{usable} CAST({2.0 ** -min(k + 1, multiset.LEVELS - 1)!r} AS DOUBLE) ELSE 0.0 END")
    s, w = "(" + " + ".join(seen) + ")", "(" + " + ".join(share) + ")"
    both, apart = f"CAST({a}[{size}] + {b}[{size}] AS DOUBLE)", f"CAST(abs({a}[{size}] - {b}[{size}]) AS DOUBLE)"
    d = f"least(greatest(CASE WHEN {w} > 0 THEN {s} / {w} ELSE {both} END, {apart}), {both})"
    return f"CASE WHEN {a}_hex = {b}_hex OR {both} = 0 THEN CAST(1.0 AS DOUBLE) ELSE ({both} - {d}) / ({both} + {d}) END"


def _hex(lanes: str) -> str:
    """SQL of the stored lanes: levels of zeros at the end are left out."""
    text = "array_to_string(list_transform({0}, lambda x: printf('%08x', x)), '')"
    head, sketch = text.format(f"{lanes}[1:{multiset.HEAD}]"), text.format(f"{lanes}[{multiset.HEAD + 1}:]")
    level = 8 * multiset.CELLS
    return f"{head} || substr({sketch}, 1, CAST(ceil(length(rtrim({sketch}, '0')) / {float(level)}) AS BIGINT) * {level})"


_MARKED = "replace(replace(replace({0}, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10))"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, length(text) AS n, length(text) // 3 AS third,
    coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (
  SELECT doc_id, n, text, next_text, substr(text, 1, n - third) || substr(next_text, 1, third) AS edited FROM n),
m AS (
  SELECT doc_id, n, edited, {_MARKED.format("text")} AS own_lines, {_MARKED.format("edited")} AS new_lines,
    {_MARKED.format("next_text")} AS next_lines FROM e),
units AS (
  SELECT doc_id, n, edited, {_units("own_lines")} AS own_units, {_units("new_lines")} AS new_units,
    {_units("next_lines")} AS next_units FROM m),
lanes AS (
  SELECT doc_id, n, edited, {_lanes("own_units")} AS own, {_lanes("new_units")} AS new, {_lanes("next_units")} AS nxt
  FROM units),
apart AS (
  SELECT *, {_differing("own", "new")} AS to_new, {_differing("own", "nxt")} AS to_next,
    {_hex("own")} AS own_hex, {_hex("new")} AS new_hex, {_hex("nxt")} AS nxt_hex FROM lanes)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, own_hex AS fingerprint, new_hex AS edited_fingerprint,
  {_likeness("own", "new", "to_new")} AS near_edited, {_likeness("own", "nxt", "to_next")} AS near_next
FROM apart
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least_docs=10, top_terms=10)


_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
tokens AS (
  SELECT r, lang, source,
    unnest(regexp_extract_all({_LOWERED.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT DISTINCT lang, source FROM d),
totals AS (
  SELECT grp.lang, grp.source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN counts USING (lang, source) GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + 1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2) // (g.total + 2 * v) AS HUGEINT) AS p
  FROM totals g JOIN kept k USING (lang) JOIN vs USING (lang) LEFT JOIN counts c USING (lang, source, term)),
lang_total AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
whole AS (
  SELECT lang, term, CAST(1 + 1000000000 * (CAST(sum(n) AS HUGEINT) + 2) // (any_value(total) + 2 * any_value(v)) AS HUGEINT) AS q
  FROM counts JOIN vs USING (lang) JOIN lang_total USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term)
    ON x.lang = a.lang AND x.source = a.source AND y.source = b.source
  GROUP BY a.lang, a.source, b.source),
terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM cells JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank
  FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)
  FROM terms QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 10)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, coalesce(text, '') AS text FROM benchmark),
tokens AS (SELECT r, unnest(regexp_extract_all({_LOWERED.format("text")}, '{_WORD}')) AS term FROM d),
asked AS (
  SELECT i, term, count(*) AS times
  FROM (SELECT i, unnest(regexp_extract_all({_LOWERED.format("text")}, '{_WORD}')) AS term FROM b) GROUP BY i, term),
sizes AS (SELECT r, count(*) AS n FROM tokens GROUP BY r),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM sizes),
tfs AS (SELECT r, term, count(*) AS tf FROM tokens SEMI JOIN asked USING (term) GROUP BY r, term),
dfs AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, whole GROUP BY term, docs),
gains AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))) AS gain
  FROM tfs JOIN dfs USING (term) JOIN sizes USING (r), whole),
scores AS (SELECT i, r, CAST(sum(times * gain) AS BIGINT) AS score FROM asked JOIN gains USING (term) GROUP BY i, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores JOIN d USING (r) JOIN b USING (i) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 10
"""


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_simhash": op2_simhash,
    "op3_secrets": op3_secrets,
    "op4_webtext": op4_webtext,
    "op5_toxicity": op5_toxicity,
    "op6_ogg": op6_ogg,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_multiset": op9_multiset,
    "op10_pii": op10_pii,
    "op11_source_divergence": op11_source_divergence,
    "op12_ranked_search": op12_ranked_search,
    "op13_nearest_vectors": op13_nearest_vectors,
}
ORACLES: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op9_multiset": OP9_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
}
