"""The query registry, and the relations of ``bindings`` once more as DuckDB SQL for the oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Parameters of the registered reports, in microseconds.
CAP, IDLE, CREDIT = 300_000_000, 3_600_000_000, 1_800_000_000

_KEY = "provider, session_id"
_ORDER = f"PARTITION BY {_KEY} ORDER BY ts, ord"


def r3(x: str) -> str:
    return f"round_even(({x}) * 1000, 0) / 1000 + 0.0"


def sec(x: str) -> str:
    return r3(f"CAST({x} AS DOUBLE) / 1000000.0")


def iso(ts: str) -> str:
    return (
        f"CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'"
    )


_TEMPLATES = [
    ("src/core/file", ".rs", "source", False), ("tests/unit/test_", ".py", "test", False), ("docs/guide", ".md", "docs", False),
    ("config/app", ".yaml", "config", False), ("assets/logo", ".png", "assets", False),
    ("node_modules/lib", "/index.js", "source", True), ("web/app", ".min.js", "source", True),
    ("pkg", "/.gitignore", "config", False), ("pkg", "/README", "docs", False), ("data/blob", ".xyz", "other", False),
    ("Arc.Core.Specs/for_Thing/when_it", ".cs", "test", False), ("src/Latest", "Test.java", "test", False),
]


def _case(value: str, i: int) -> str:
    whens = " ".join(f"WHEN {k} THEN '{t[i]}'" if i < 3 else f"WHEN {k} THEN {t[i]}" for k, t in enumerate(_TEMPLATES))
    return f"CASE {value} % 12 {whens} END"


#: Relations by name; each may use the ones above it.
RELATIONS = {
    "ev": """
SELECT CASE user_id % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'gemini' ELSE 'pi' END AS provider,
  'u' || user_id || '-' || ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 21600000000) AS session_id,
  '/work/root' || (user_id % 3) || '/repo' || (user_id % 10) AS cwd, 'repo' || (user_id % 10) AS repo,
  'root' || (user_id % 3) AS root, user_id % 5 = 0 AS is_subagent, ts,
  CASE WHEN event_type = 'view' THEN 'unknown' ELSE 'm-' || event_type END AS model, event_id AS ord,
  event_type, value, props, user_id FROM events""",
    "sess": "SELECT DISTINCT provider, session_id, cwd, repo, root, is_subagent FROM ev",
    "pts": "SELECT provider, session_id, ts, model, ord FROM ev",
    "hum": "SELECT provider, session_id, ts, model, ord FROM ev WHERE event_type = 'click' AND NOT is_subagent",
    "ex": """
SELECT provider, session_id, ts AS s, ts + to_seconds(CAST(floor(value) AS BIGINT)) AS e, model, ord
FROM ev WHERE event_type = 'purchase'""",
    "tok": """
SELECT provider, session_id, ts, model, k AS input_tokens, k * 2 AS output_tokens, k % 7 AS cache_read_tokens,
  k % 3 AS cache_creation_tokens
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ev WHERE event_type = 'error')""",
    "cf": f"""
SELECT md5(CAST(l_orderkey AS VARCHAR)) AS sha, {_case('l_partkey', 0)} || l_suppkey || {_case('l_partkey', 1)} AS path,
  CAST(l_quantity AS BIGINT) AS additions, CAST(round(l_discount * 100) AS BIGINT) AS deletions,
  {_case('l_partkey', 3)} AS is_ignored, {_case('l_partkey', 2)} AS category FROM lineitem""",
    "com0": """
SELECT md5(CAST(o_orderkey AS VARCHAR)) AS sha,
  TIMESTAMP '2024-01-01' + to_minutes(CAST((o_orderkey * 37) % 43200 AS BIGINT)) AS ts, 'repo' || (o_custkey % 10) AS repo,
  '/work/root' || (o_custkey % 3) || '/repo' || (o_custkey % 10) AS cwd, 'root' || (o_custkey % 3) AS root,
  o_orderstatus = 'P' AS agent_authored, o_orderpriority = '1-URGENT' AS agent_assisted,
  o_orderpriority = '5-LOW' AS autofix_assisted
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "stats": """
SELECT sha, CAST(sum(CASE WHEN NOT is_ignored THEN additions ELSE 0 END) AS BIGINT) AS additions,
  CAST(sum(CASE WHEN NOT is_ignored THEN deletions ELSE 0 END) AS BIGINT) AS deletions,
  CAST(sum(CASE WHEN is_ignored THEN additions ELSE 0 END) AS BIGINT) AS ignored_additions,
  CAST(sum(CASE WHEN is_ignored THEN deletions ELSE 0 END) AS BIGINT) AS ignored_deletions,
  count(*) FILTER (WHERE NOT is_ignored) AS file_count FROM cf GROUP BY sha""",
    "com": "SELECT c.*, s.* EXCLUDE (sha) FROM com0 c JOIN stats s USING (sha)",
    "mine": "SELECT * FROM com WHERE NOT agent_authored",
    "filled": f"""
SELECT *, coalesce(last_value(known IGNORE NULLS) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(known IGNORE NULLS) OVER ({_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'unknown') AS fm
FROM (SELECT *, CASE WHEN model <> 'unknown' THEN model END AS known FROM pts)""",
    "gap": f"""
SELECT {_KEY}, ts AS s, least(nxt, ts + INTERVAL 5 MINUTE) AS e, fm AS model, ord
FROM (SELECT *, lead(ts) OVER ({_ORDER}) AS nxt FROM filled) WHERE nxt > ts""",
    "ranges": f"""
SELECT {_KEY}, s, e, model, 0 AS kind, ord FROM gap
UNION ALL SELECT {_KEY}, s, e, model, 1, ord FROM ex WHERE e > s""",
    "marks": f"SELECT {_KEY}, s AS t FROM ranges UNION SELECT {_KEY}, e FROM ranges",
    "swept": f"""
SELECT {_KEY}, t AS s, n AS e, (SELECT arg_max(r.model, row(r.model <> 'unknown', r.s, r.kind, r.ord)) FROM ranges r
  WHERE r.provider = m.provider AND r.session_id = m.session_id AND r.s <= m.t AND r.e >= m.n) AS model
FROM (SELECT *, lead(t) OVER (PARTITION BY {_KEY} ORDER BY t) AS n FROM marks) m WHERE n IS NOT NULL""",
    "iv": f"""
SELECT {_KEY}, model, min(s) AS s, max(e) AS e FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY {_KEY} ORDER BY s) AS run FROM (
    SELECT *, CASE WHEN lag(e) OVER w = s AND lag(model) OVER w = model THEN 0 ELSE 1 END AS fresh
    FROM swept WHERE model IS NOT NULL WINDOW w AS (PARTITION BY {_KEY} ORDER BY s)))
GROUP BY {_KEY}, model, run""",
    "ivs": f"SELECT i.*, cwd, repo, root, is_subagent FROM iv i JOIN sess USING ({_KEY})",
    "moments": f"""
SELECT {_KEY}, ts, model, 0 AS k, ord AS o, 0 AS e FROM pts
UNION ALL SELECT {_KEY}, s, model, 1, ord, 0 FROM ex UNION ALL SELECT {_KEY}, e, model, 1, ord, 1 FROM ex
UNION ALL SELECT {_KEY}, ts, model, 2, ord, 0 FROM hum""",
    "seen": f"SELECT {_KEY}, min(ts) AS first_seen, max(ts) AS last_seen FROM moments GROUP BY {_KEY}",
    "ends": f"""
SELECT {_KEY}, min(ts) AS a, arg_min(model, row(epoch_us(ts), k, o, e)) AS am, max(ts) AS z,
  arg_min(model, row(-epoch_us(ts), k, o, e)) AS zm
FROM moments JOIN sess USING ({_KEY}) WHERE NOT is_subagent GROUP BY {_KEY}""",
    "edges": f"""
SELECT {_KEY}, a AS ts, am AS model, 0 AS ord FROM ends UNION ALL SELECT {_KEY}, z, zm, 1 FROM ends WHERE z <> a""",
    "sig": f"""
SELECT x.*, cwd, repo, root FROM (
  SELECT {_KEY}, ts, model, provider || '_prompt' AS kind, 0 AS late, 0 AS part, ord FROM hum
  UNION ALL SELECT {_KEY}, ts, model, provider || '_session_edge', 0, 1, ord FROM edges) x
JOIN sess USING ({_KEY}) WHERE NOT is_subagent
UNION ALL SELECT 'git', sha, ts, '—', 'commit', 1, 0, 0, cwd, repo, root FROM mine""",
    "once": """
SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY ts ORDER BY
  CASE WHEN kind LIKE '%\\_prompt' ESCAPE '\\' THEN 3 WHEN kind = 'commit' THEN 2 ELSE 1 END DESC,
  late, provider, session_id, part, ord) = 1""",
    "blocks": f"""
SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (ORDER BY ts) - 1 AS block FROM (
  SELECT *, coalesce(epoch_us(ts) - epoch_us(p) > {IDLE}, true) AS opens, coalesce(epoch_us(n) - epoch_us(ts) > {IDLE}, true) AS closes
  FROM (SELECT *, lag(ts) OVER (ORDER BY ts) AS p, lead(ts) OVER (ORDER BY ts) AS n FROM once))""",
    "hiv": f"""
SELECT * FROM (SELECT provider, model, 'work-block:' || CAST(block AS BIGINT) AS session_id, cwd, repo, root,
  CASE WHEN opens THEN greatest(ts - to_microseconds({CREDIT // 2}), date_trunc('day', ts))
    ELSE p + to_microseconds((epoch_us(ts) - epoch_us(p)) // 2) END AS s,
  CASE WHEN closes THEN least(ts + to_microseconds({CREDIT // 2}), date_trunc('day', ts) + INTERVAL 1 DAY)
    ELSE ts + to_microseconds((epoch_us(n) - epoch_us(ts)) // 2) END AS e FROM blocks) WHERE e > s""",
    "tokr": f"SELECT t.*, cwd, repo, root FROM tok t JOIN sess USING ({_KEY})",
    "zero": f"""
SELECT s.*, first_seen, coalesce(pm, 'unknown') AS model FROM sess s JOIN seen USING ({_KEY})
LEFT JOIN (SELECT {_KEY}, arg_min(model, ord) AS pm FROM pts GROUP BY {_KEY}) USING ({_KEY})
WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.provider = s.provider AND iv.session_id = s.session_id)""",
    "mfiles": "SELECT f.*, ts, repo, cwd, root FROM cf f JOIN mine USING (sha)",
    "shapes": """
SELECT sha, CASE WHEN top.touched < total * 0.6 OR top.category = 'other' THEN 'mixed'
  WHEN top.category <> 'source' THEN CASE top.category WHEN 'test' THEN 'tests' ELSE top.category END
  WHEN top.d > 2 * top.a THEN 'removal' WHEN 4 * top.d < top.a THEN 'new code' ELSE 'revision' END AS shape
FROM (SELECT sha, sum(a + d) AS total, arg_max({'category': category, 'a': a, 'd': d, 'touched': a + d}, row(a + d,
    list_position(['test', 'docs', 'config', 'assets', 'source', 'other'], category))) AS top
  FROM (SELECT sha, category, sum(additions) AS a, sum(deletions) AS d FROM cf WHERE NOT is_ignored GROUP BY sha, category)
  GROUP BY sha) WHERE total > 0""",
    "told": """
SELECT sha, sum(n) AS file_count, CASE WHEN sum(n) = 1 THEN '1 file · ' ELSE sum(n) || ' files · ' END ||
  array_to_string(list_transform(list_sort(list(row(-n, i, category)))[1:3], lambda x: x[3]), ', ') AS summary
FROM (SELECT sha, category, list_position(['test', 'docs', 'config', 'assets', 'source', 'other'], category) AS i, count(*) AS n
  FROM cf WHERE NOT is_ignored GROUP BY sha, category) GROUP BY sha""",
}


def split_sql(name: str, unit: str) -> str:
    """Intervals of a relation cut at day or month boundaries, with the key column."""
    fmt = "%Y-%m-%d" if unit == "day" else "%Y-%m"
    return (
        f"SELECT * EXCLUDE (s, e, d), strftime(d, '{fmt}') AS {unit}, greatest(s, d) AS s, least(e, d + INTERVAL 1 {unit}) AS e FROM ("
        f"SELECT *, unnest(generate_series(date_trunc('{unit}', s), date_trunc('{unit}', e - to_microseconds(1)), INTERVAL 1 {unit})) AS d "
        f"FROM {name} WHERE e > s)"
    )


def union_sql(name: str, keys: str = "") -> str:
    """Union length of a relation's intervals for each key, in microseconds."""
    part = f"PARTITION BY {keys} " if keys else ""
    lead, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    inner, by = (f"{keys}, run", f"{keys}, run") if keys else ("run", "run")
    return (
        f"SELECT {lead}CAST(coalesce(sum(epoch_us(z) - epoch_us(a)), 0) AS BIGINT) AS union_us FROM ("
        f"SELECT {inner}, min(s) AS a, max(e) AS z FROM (SELECT *, sum(fresh) OVER ({part}ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM ("
        f"SELECT *, CASE WHEN s <= max(e) OVER ({part}ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh "
        f"FROM {name} WHERE e > s)) GROUP BY {by}) {group}"
    )


def fuzzy_sql(labels: str, column: str, needle: str) -> str:
    """(label, score) of the labels that hold a needle of plain characters, by every path from its first character on."""
    steps = [f"SELECT {column} AS label, unnest(range(1, length({column}) + 1)) AS p1 FROM ({labels})"]
    for n, c in enumerate(needle.lower()[1:], 2):
        steps.append(f"SELECT *, CASE WHEN strpos(substr(lower(label), p{n - 1} + 1), '{c}') > 0 THEN p{n - 1} + strpos(substr(lower(label), p{n - 1} + 1), '{c}') END AS p{n} FROM ({{}})")
    paths = steps[0]
    for step in steps[1:]:
        paths = step.format(paths)
    m, at = len(needle), lambda i: f"substr(label, {i}, 1)"
    plain = lambda i: f"regexp_matches({at(i)}, '[\\p{{L}}\\p{{N}}]')"
    upper = lambda i: f"regexp_matches({at(i)}, '\\p{{Lu}}')"
    gain = lambda i: f"(CASE WHEN {i} = 1 OR NOT {plain(f'({i} - 1)')} THEN 10 WHEN {upper(i)} AND NOT {upper(f'({i} - 1)')} THEN 6 ELSE 0 END)"
    step = lambda a, b: f"(CASE WHEN {b} = {a} + 1 THEN 8 ELSE {gain(b)} - 5 - ({b} - {a} - 2) END)"
    worth = f"{16 * m} + 2 * {gain('p1')} - least(p1 - 1, 12) + " + " + ".join(step(f"p{n - 1}", f"p{n}") for n in range(2, m + 1))
    return (
        f"SELECT label, CAST(max({worth}) AS BIGINT) AS score FROM (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY p{m}) AS e, "
        f"row_number() OVER (PARTITION BY label, p{m} ORDER BY p1) AS first, row_number() OVER (PARTITION BY label, p{m} ORDER BY p1 DESC) AS last "
        f"FROM ({paths}) WHERE substr(lower(label), p1, 1) = '{needle[0].lower()}' AND p{m} IS NOT NULL) WHERE e <= 4 AND (first = 1 OR last = 1) GROUP BY label"
    )


def oracle(body: str, **more: str) -> str:
    """The body with the relations that it uses before it."""
    known = {**RELATIONS, **more}
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                need(known[name])
                if name not in wanted:
                    wanted.append(name)

    need(body)
    ctes = ",\n".join(f"{name} AS ({known[name].strip()})" for name in wanted)
    return f"WITH {ctes}\n{body.strip()}" if wanted else body.strip()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its oracle."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
