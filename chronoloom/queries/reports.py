"""Grouped reports, summaries, joins, filters, orderings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings
from ..functions.text import bounded_key
from ..functions.times import seconds
from ..operators import filters, joins, report
from ..operators import intervals as I
from .base import CAP, CREDIT, IDLE, iso, oracle, query, r3, sec, split_sql, union_sql

KEY = ["provider", "session_id"]
SINCE, UNTIL = "2024-01-05", "2024-01-20"


def _activity(spark, d, window: bool = False, tables=None):
    t = tables or bindings.tables(spark, d)
    at = lambda x: F.lit(x).cast("timestamp") if window else None
    return report.activity(t, CAP, IDLE, CREDIT, at(SINCE), at(UNTIL))


def _windowed() -> dict[str, str]:
    """Relations cut to the window: signals before blocks, everything else after."""
    from .base import RELATIONS

    inside = f"ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}'"
    cut = f"SELECT * REPLACE (greatest(s, TIMESTAMP '{SINCE}') AS s, least(e, TIMESTAMP '{UNTIL}') AS e) FROM ({{0}}) WHERE least(e, TIMESTAMP '{UNTIL}') > greatest(s, TIMESTAMP '{SINCE}')"
    return {
        "com": f"SELECT * FROM ({RELATIONS['com']}) WHERE {inside}",
        "sig": f"SELECT * FROM ({RELATIONS['sig']}) WHERE {inside}",
        "iv": cut.format(RELATIONS["iv"]),
        "hiv": cut.format(RELATIONS["hiv"]),
        "tokr": f"SELECT * FROM ({RELATIONS['tokr']}) WHERE {inside}",
        "zero": f"SELECT * FROM ({RELATIONS['zero']}) WHERE first_seen >= TIMESTAMP '{SINCE}' AND first_seen < TIMESTAMP '{UNTIL}'",
    }


def report_sql(dims: tuple[str, ...], tail: str = "", columns: str = "*", wanted: tuple[str, ...] = report.PARTS, **more: str) -> str:
    unit = next((x for x in dims if x in ("day", "month")), None)
    fmt = {"day": "%Y-%m-%d", "month": "%Y-%m"}

    def keys(ts: str | None, **own: str) -> str:
        out = []
        for x in dims:
            if x == unit and ts:
                out.append(f"strftime({ts}, '{fmt[x]}') AS {x}")
            else:
                out.append(f"{own.get(x, x)} AS {x}")
        return ", ".join(out)

    g = ", ".join(dims)
    iv = split_sql("ivs", unit) if unit else "SELECT * FROM ivs"
    hi = split_sql("hiv", unit) if unit else "SELECT * FROM hiv"
    commit = {"provider": "'git'", "model": "'—'"}
    agent = {"provider": "'git-agent'", "model": "'—'"}
    roles = (
        "count(DISTINCT row(provider0, session_id)) AS session_count, count(DISTINCT row(provider0, session_id)) FILTER (WHERE NOT is_subagent) AS foreground_session_count, "
        "count(DISTINCT row(provider0, session_id)) FILTER (WHERE is_subagent) AS subagent_session_count"
    )
    lines = ["additions", "deletions", "ignored_additions", "ignored_deletions"]
    toks = report.TOKENS
    day = "SELECT {k}, strftime({ts}, '%Y-%m-%d') AS dd FROM {t}"
    pieces_days = split_sql("riv", "day") if unit != "day" else "SELECT * FROM riv"
    days = " UNION ".join([
        f"SELECT {g}, day AS dd FROM ({pieces_days})",
        day.format(k=keys("first_seen"), ts="first_seen", t="zero"), day.format(k=keys("ts", **commit), ts="ts", t="mine"),
        day.format(k=keys("ts", **agent), ts="ts", t="agents"), day.format(k=keys("ts"), ts="ts", t="tokr"),
    ])
    parts = [
        f"SELECT {g}, sum(epoch_us(e) - epoch_us(s)) AS active_us, {roles}, min(s) AS first, max(e) AS last FROM (SELECT *, provider AS provider0 FROM riv) GROUP BY {g}",
        f"SELECT {g}, union_us AS wall_us FROM ({union_sql('riv', g)})",
        f"SELECT {g}, sum(epoch_us(e) - epoch_us(s)) AS human_us, count(DISTINCT session_id) AS work_block_count, min(s) AS first, max(e) AS last FROM rhi GROUP BY {g}",
        f"SELECT {g}, count(DISTINCT row(ts, kind, session_id)) AS human_signal_count, count(DISTINCT CAST(ts AS DATE)) AS human_active_days FROM (SELECT ts, kind, session_id, {keys('ts')} FROM sig) GROUP BY {g}",
        f"SELECT {g}, {roles}, min(first_seen) AS first, max(first_seen) AS last FROM (SELECT session_id, is_subagent, first_seen, provider AS provider0, {keys('first_seen')} FROM zero) GROUP BY {g}",
        f"SELECT {keys('ts', **commit)}, count(DISTINCT sha) AS commit_count, {', '.join(f'sum({c}) AS {c}' for c in lines)}, count(DISTINCT sha) FILTER (WHERE agent_assisted) AS ai_assisted_commit_count, count(DISTINCT sha) FILTER (WHERE autofix_assisted) AS autofix_assisted_commit_count, min(ts) AS first, max(ts) AS last FROM mine GROUP BY ALL",
        f"SELECT {keys('ts', **commit)}, count(DISTINCT path) AS file_count FROM mfiles WHERE NOT is_ignored GROUP BY ALL",
        f"SELECT {keys('ts', **agent)}, count(DISTINCT sha) AS agent_commit_count, sum(additions) AS agent_additions, sum(deletions) AS agent_deletions, min(ts) AS first, max(ts) AS last FROM agents GROUP BY ALL",
        f"SELECT {keys('ts')}, {', '.join(f'sum({c}) AS {c}' for c in toks)}, min(ts) AS first, max(ts) AS last FROM tokr GROUP BY ALL",
        f"SELECT {g}, count(DISTINCT dd) AS active_days FROM ({days}) GROUP BY {g}",
        f"SELECT {g}, array_to_string(list_sort(list(DISTINCT p)), ',') AS providers, array_to_string(list_sort(list(DISTINCT m)), ',') AS models FROM (SELECT {g}, provider AS p, model AS m FROM riv UNION SELECT {keys('first_seen')}, provider, model FROM zero) GROUP BY {g}",
    ]
    numbers = report._NUMBERS
    plain = [c for c in numbers if not c.endswith("_us")]
    every = ", ".join([*(f"NULL::BIGINT AS {c}" for c in numbers), "NULL::TIMESTAMP AS first", "NULL::TIMESTAMP AS last", "NULL::VARCHAR AS providers", "NULL::VARCHAR AS models"])
    chosen = [p for name, p in zip(report.PARTS, parts) if name in wanted]
    total = " UNION ALL BY NAME ".join([f"SELECT {every} WHERE false", *(f"SELECT * FROM ({p})" for p in chosen)])
    ratio = lambda us, n: f"CASE WHEN {n} > 0 THEN {r3(f'CAST({us} AS DOUBLE) / 1000000.0 / {n}')} ELSE 0.0 END"
    cal = "CAST(coalesce(date_diff('day', CAST(first AS DATE), CAST(last AS DATE)) + 1, 0) AS BIGINT)"
    merged = (
        f"SELECT {g}, {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in numbers)}, min(first) AS first, max(last) AS last, "
        f"coalesce(max(providers), '') AS providers, coalesce(max(models), '') AS models FROM ({total}) GROUP BY {g}"
    )
    body = (
        f"SELECT {g}, {sec('active_us')} AS active_seconds, {sec('active_us')} AS parallel_agent_seconds, {sec('wall_us')} AS ai_wall_seconds, {sec('human_us')} AS human_estimated_seconds, "
        f"{', '.join(plain)}, additions - deletions AS net_lines, {' + '.join(toks)} AS total_tokens, {cal} AS calendar_days, "
        f"{ratio('human_us', 'human_active_days')} AS average_human_seconds_per_active_day, {ratio('active_us', 'active_days')} AS average_active_seconds_per_active_day, "
        f"{ratio('active_us', cal)} AS average_active_seconds_per_calendar_day, {iso('first')} AS first_seen, {iso('last')} AS last_seen, providers, models FROM ({merged})"
    )
    if columns != "*" or tail:
        body = f"SELECT {columns} FROM ({body}) {tail}"
    return oracle(body, riv=iv, rhi=hi, agents="SELECT * FROM com WHERE agent_authored", **more)


def _report(dims, window=False, parts=report.PARTS):
    return lambda spark, d: report.grouped_report(_activity(spark, d, window), dims, parts)


query("AGG01_report_month_repo", report_sql(("month", "repo")))(_report(("month", "repo")))
query("AGG01_report_provider_model", report_sql(("provider", "model")))(_report(("provider", "model")))
query("AGG01_report_day", report_sql(("day",)))(_report(("day",)))
query("AGG01_report_window", report_sql(("root", "cwd"), **_windowed()))(_report(("root", "cwd"), True))


def _columns(name: str, columns: list[str], dims, *parts: str):
    query(name, report_sql(dims, columns=", ".join([*dims, *columns]), wanted=parts))(
        lambda spark, d: report.grouped_report(_activity(spark, d), dims, parts).select(*dims, *columns)
    )


_R, _P = ("repo",), ("provider",)
_DATED = ("intervals", "zero", "commits", "agents", "tokens", "days")
_columns("AGG02_active_seconds", ["active_seconds", "parallel_agent_seconds"], _R, "intervals")
_columns("AGG03_wall_seconds", ["ai_wall_seconds"], _P, "wall")
_columns("AGG04_human", ["human_estimated_seconds", "work_block_count", "human_signal_count", "human_active_days"], _R, "human", "signals")
_columns("AGG05_sessions", ["session_count", "foreground_session_count", "subagent_session_count"], _R, "intervals", "zero")
_columns("AGG07_commits", ["commit_count", "additions", "deletions", "ignored_additions", "ignored_deletions", "net_lines"], _R, "commits")
_columns("AGG08_files", ["file_count"], ("root",), "files")
_columns("AGG09_agent_commits", ["agent_commit_count", "agent_additions", "agent_deletions"], _R, "agents")
_columns("AGG11_tokens", [*report.TOKENS, "total_tokens"], ("model",), "tokens")
_columns("AGG12_active_days", ["active_days"], _P, "days")
_columns("AGG14_row_range", ["first_seen", "last_seen"], _P, "intervals", "human", "zero", "commits", "agents", "tokens")
_columns("AGG16_averages", ["average_human_seconds_per_active_day", "average_active_seconds_per_active_day", "average_active_seconds_per_calendar_day"], _R, *report.PARTS[:4], "days", *_DATED)
_columns("AGG18_names", ["providers", "models"], _R, "names")

query("AGG06_zero_sessions", oracle("SELECT provider, session_id, model, is_subagent FROM zero"))(
    lambda spark, d: report.zero_sessions(_activity(spark, d)).select(*KEY, "model", "is_subagent"))


def _summary_sql(**more: str) -> str:
    near = f"c.repo = s.repo AND c.ts BETWEEN s.first_seen - to_microseconds({IDLE}) AND s.last_seen + to_microseconds({IDLE})"
    toks = report.TOKENS
    one = lambda e, t: f"(SELECT {e} FROM {t})"
    n = "CAST(coalesce({0}, 0) AS BIGINT)"
    kinds = {"human_signal_count": "true", "prompt_signal_count": "kind LIKE '%prompt'", "foreground_session_edge_signal_count": "kind LIKE '%session_edge'", "commit_signal_count": "kind = 'commit'"}
    days = f"SELECT strftime(ts, '%Y-%m-%d') AS dd FROM com UNION SELECT strftime(first_seen, '%Y-%m-%d') FROM zero UNION SELECT day FROM ({split_sql('ivs', 'day')})"
    seen_all = "SELECT min(s) AS a, max(e) AS z FROM ivs UNION ALL SELECT min(s), max(e) FROM hiv UNION ALL SELECT min(ts), max(ts) FROM sig UNION ALL SELECT min(ts), max(ts) FROM com WHERE agent_authored"
    human_days = one("count(DISTINCT CAST(ts AS DATE))", "sig")
    cols = {
        "parallel_agent_seconds": one(sec("coalesce(sum(epoch_us(e) - epoch_us(s)), 0)"), "ivs"),
        "agent_wall_seconds": one(sec("union_us"), f"({union_sql('ivs')})"),
        "human_estimated_seconds": one(sec("coalesce(sum(epoch_us(e) - epoch_us(s)), 0)"), "hiv"),
        "work_block_count": one("count(DISTINCT session_id)", "hiv"),
        **{k: one(f"count(DISTINCT row(ts, kind, session_id)) FILTER (WHERE {v})", "sig") for k, v in kinds.items()},
        "human_active_days": human_days,
        "session_count": one("count(*)", "elig"), "foreground_session_count": one("count(*) FILTER (WHERE NOT is_subagent)", "elig"),
        "subagent_session_count": one("count(*) FILTER (WHERE is_subagent)", "elig"),
        "foreground_sessions_with_commits": one("count(*)", f"elig s WHERE NOT is_subagent AND EXISTS (SELECT 1 FROM mine c WHERE {near})"),
        "foreground_sessions_without_commits": one("count(*)", f"elig s WHERE NOT is_subagent AND repo IN (SELECT repo FROM mine) AND NOT EXISTS (SELECT 1 FROM mine c WHERE {near})"),
        "commit_count": one("count(DISTINCT sha)", "mine"),
        **{c: one(n.format(f"sum({c})"), "mine") for c in ("additions", "deletions", "ignored_additions", "ignored_deletions")},
        "ai_assisted_commit_count": one("count(DISTINCT sha) FILTER (WHERE agent_assisted)", "mine"), "autofix_assisted_commit_count": one("count(DISTINCT sha) FILTER (WHERE autofix_assisted)", "mine"),
        "agent_commit_count": one("count(DISTINCT sha)", "com WHERE agent_authored"),
        **{f"agent_{c}": one(n.format(f"sum({c})"), "com WHERE agent_authored") for c in ("additions", "deletions")},
        **{c: one(n.format(f"sum({c})"), "tokr") for c in toks}, "total_tokens": one(n.format(f"sum({' + '.join(toks)})"), "tokr"),
        "active_days": one("count(DISTINCT dd)", f"({days})"),
        "average_human_seconds_per_active_day": f"CASE WHEN {human_days} > 0 THEN " + r3(f"CAST((SELECT sum(epoch_us(e) - epoch_us(s)) FROM hiv) AS DOUBLE) / 1000000.0 / {human_days}") + " ELSE 0.0 END",
        "first_seen": one(iso("min(a)"), f"({seen_all})"), "last_seen": one(iso("max(z)"), f"({seen_all})"),
    }
    elig = more.pop("elig", "SELECT s.*, first_seen, last_seen FROM sess s JOIN seen USING (provider, session_id)")
    return oracle("SELECT " + ", ".join(f"{v} AS {k}" for k, v in cols.items()), elig=elig, **more)


query("AGG21_summary", _summary_sql())(lambda spark, d: report.summary(_activity(spark, d)))
query("AGG21_summary_window", _summary_sql(
    elig=f"SELECT s.*, first_seen, last_seen FROM sess s JOIN seen USING (provider, session_id) WHERE (first_seen >= TIMESTAMP '{SINCE}' AND first_seen < TIMESTAMP '{UNTIL}') OR (s.provider, s.session_id) IN (SELECT provider, session_id FROM iv)", **_windowed()))(
    lambda spark, d: report.summary(_activity(spark, d, True)))
for _id, _cols, _of in [
    ("AGG13_summary_active_days", ["active_days"], ("days",)), ("AGG15_observed", ["first_seen", "last_seen"], ("active", "human", "signals", "commits")),
    ("AGG22_signal_kinds", ["human_signal_count", "prompt_signal_count", "foreground_session_edge_signal_count", "commit_signal_count"], ("signals",)),
]:
    query(_id, f"SELECT {', '.join(_cols)} FROM ({_summary_sql()})")(
        lambda spark, d, c=_cols, of=_of: report.summary(_activity(spark, d), of).select(*c))
for _k in ("provider", "model"):
    query(f"AGG17_seconds_by_{_k}", oracle(f"SELECT {_k}, {sec('sum(epoch_us(e) - epoch_us(s))')} AS seconds FROM ivs GROUP BY {_k}"))(
        lambda spark, d, k=_k: report.seconds_by(_activity(spark, d).intervals, k))
    query(f"AGG17_tokens_by_{_k}", oracle(f"SELECT {_k}, CAST(sum({' + '.join(report.TOKENS)}) AS BIGINT) AS tokens FROM tokr GROUP BY {_k}"))(
        lambda spark, d, k=_k: report.tokens_by(_activity(spark, d).tokens, k))

query("AGG25_diagnostics", "SELECT CAST(sum(o_custkey % 3) AS BIGINT) AS malformed_lines, CAST(sum(o_custkey % 2) AS BIGINT) AS unreadable_files, CAST(sum(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS warning_count, "
    "(SELECT array_to_string(list('line ' || o_orderkey ORDER BY o_orderkey), '|') FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 ORDER BY o_orderkey LIMIT 100)) AS messages FROM orders")(
    lambda spark, d: report.merged_diagnostics(
        bindings.load(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 3).alias("malformed_lines"), (F.col("o_custkey") % 2).alias("unreadable_files"),
            F.when(F.col("o_orderkey") % 10 == 0, F.array(F.concat(F.lit("line "), "o_orderkey"))).otherwise(F.array().cast("array<string>")).alias("messages")),
        ["malformed_lines", "unreadable_files"]).withColumn("messages", F.array_join("messages", "|")))

_MR = ("month", "repo")
_TOP = "ORDER BY {0}human_estimated_seconds DESC, ai_wall_seconds DESC, commit_count DESC, {1} LIMIT {2}"
query("ORD01_calendar_order", report_sql(("day", "repo"), _TOP.format("day DESC, ", "day, repo", 30), "day, repo, human_estimated_seconds, ai_wall_seconds, commit_count"))(
    lambda spark, d: report.ranked_report(_report(("day", "repo"), parts=report.ORDER_PARTS)(spark, d), ("day", "repo")).select("day", "repo", "human_estimated_seconds", "ai_wall_seconds", "commit_count"))
query("ORD02_top_rows", report_sql(("cwd",), _TOP.format("", "cwd", 5), "cwd, human_estimated_seconds, ai_wall_seconds, commit_count"))(
    lambda spark, d: report.ranked_report(_report(("cwd",), parts=report.ORDER_PARTS)(spark, d), ("cwd",), 5).select("cwd", "human_estimated_seconds", "ai_wall_seconds", "commit_count"))
query("AGG26_trend", f"SELECT day, {r3('sum(human_estimated_seconds)')} AS human_estimated_seconds FROM (" + report_sql(("day", "repo"), _TOP.format("day DESC, ", "day, repo", 30), "day, human_estimated_seconds") + ") GROUP BY day")(
    lambda spark, d: report.trend(report.ranked_report(_report(("day", "repo"), parts=report.ORDER_PARTS)(spark, d), ("day", "repo")), "day"))
query("AGG27_ranked_models", oracle("SELECT CASE WHEN model IN ('', 'unknown', '<synthetic>', '—') THEN '(no model)' ELSE model END AS model, CAST(sum(epoch_us(e) - epoch_us(s)) AS BIGINT) AS us, CAST(row_number() OVER (ORDER BY sum(epoch_us(e) - epoch_us(s)) DESC, 1) AS INTEGER) AS rank, greatest(count(*) OVER () - 3, 0) AS omitted FROM ivs GROUP BY 1 QUALIFY row_number() OVER (ORDER BY sum(epoch_us(e) - epoch_us(s)) DESC, 1) <= 3"))(
    lambda spark, d: report.ranked_models(_activity(spark, d).intervals.groupBy("model").agg(I.sum_micros().alias("us")), "us", 3))
query("AGG29_concurrency", f"SELECT provider, CASE WHEN ai_wall_seconds > 0 THEN {r3('active_seconds / ai_wall_seconds')} ELSE 0.0 END AS concurrency FROM (" + report_sql(("provider",), wanted=("intervals", "wall")) + ")")(
    lambda spark, d: report.concurrency(report.grouped_report(_activity(spark, d), ("provider",), ("intervals", "wall"))).select("provider", "concurrency"))

# Joins.

_SEEN = "SELECT s.*, first_seen, last_seen FROM sess s JOIN seen USING (provider, session_id) WHERE NOT is_subagent"
_NEAR = f"c.repo = f.repo AND c.ts BETWEEN f.first_seen - to_microseconds({IDLE}) AND f.last_seen + to_microseconds({IDLE})"


def _fg(spark, d):
    act = _activity(spark, d)
    return act.seen.where(~F.col("is_subagent")), act.commits


query("JON01_sessions_with_output", oracle(f"SELECT provider, session_id FROM fgs f WHERE EXISTS (SELECT 1 FROM mine c WHERE {_NEAR})", fgs=_SEEN))(
    lambda spark, d: joins.with_output(*_fg(spark, d), IDLE).select(*KEY))
query("JON02_sessions_without_output", oracle(f"SELECT provider, session_id FROM fgs f WHERE repo IN (SELECT repo FROM mine) AND NOT EXISTS (SELECT 1 FROM mine c WHERE {_NEAR})", fgs=_SEEN))(
    lambda spark, d: joins.without_output(*_fg(spark, d), IDLE).select(*KEY))
query("JON03_interval_role", oracle(f"SELECT is_subagent, count(*) AS n, {sec('sum(epoch_us(e) - epoch_us(s))')} AS seconds FROM ivs GROUP BY is_subagent"))(
    lambda spark, d: _activity(spark, d).intervals.groupBy("is_subagent").agg(F.count("*").alias("n"), seconds(I.sum_micros()).alias("seconds")))
query("JON04_token_records", oracle("SELECT provider, session_id, repo, root, cwd, model, epoch_us(ts) AS ts_us, input_tokens, output_tokens FROM tokr"))(
    lambda spark, d: _activity(spark, d).tokens.select(*KEY, "repo", "root", "cwd", "model", F.unix_micros("ts").alias("ts_us"), "input_tokens", "output_tokens"))
query("JON05_seconds_by_label", f"SELECT cwd, c.repo, coalesce(round(active_seconds, 3), 0.0) AS active_seconds FROM ({oracle('SELECT DISTINCT cwd, repo FROM com')}) c LEFT JOIN (SELECT repo, sum(active_seconds) AS active_seconds FROM ({report_sql(('repo', 'root'), wanted=('intervals',))}) GROUP BY repo) r ON r.repo = c.repo")(
    lambda spark, d: joins.seconds_by_label(bindings.commit_table(spark, d).select("cwd", "repo").distinct(), report.grouped_report(_activity(spark, d), ("repo", "root"), ("active",)), ["active_seconds"]).withColumn("active_seconds", F.round("active_seconds", 3)))
query("JON06_two_key_lookup", "SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS name FROM orders LEFT JOIN customer a ON a.c_custkey = CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END LEFT JOIN customer b ON b.c_custkey = o_orderkey")(
    lambda spark, d: joins.first_match(bindings.load(spark, d, "orders").withColumn("k1", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey"))), bindings.load(spark, d, "customer"), [("k1", "c_custkey"), ("o_orderkey", "c_custkey")], ["c_name"]).select("o_orderkey", F.col("c_name").alias("name")))
query("JON08_legacy_unless_new", oracle("SELECT session_id, ord FROM ev WHERE event_type = 'view' AND session_id NOT IN (SELECT session_id FROM ev WHERE event_type = 'signup')"))(
    lambda spark, d: (lambda ev: joins.legacy_unless_new(ev.where("event_type = 'view'"), ev.where("event_type = 'signup'")).select("session_id", "ord"))(bindings.events(spark, d)))
query("JON09_stabbing_join", oracle("SELECT r.provider, r.session_id, r.ord AS range_ord, p.ord AS point_ord FROM ranges r JOIN pts p ON p.provider = r.provider AND p.session_id = r.session_id AND p.ts >= r.s AND p.ts < r.e WHERE r.kind = 1"))(
    lambda spark, d: (lambda t: I.stabbed(t.exact, t.points))(bindings.tables(spark, d)))
query("JON11_model_at", oracle("SELECT h.provider, h.session_id, h.ord, f.fm AS model FROM hum h JOIN (SELECT provider, session_id, ts, arg_max(fm, ord) AS fm FROM filled GROUP BY ALL) f USING (provider, session_id, ts)"))(
    lambda spark, d: (lambda t: I.model_at(t.human, t.points).select(*KEY, "ord", "model"))(bindings.tables(spark, d)))
query("PRJ02_nearest_repo", oracle("SELECT path, (SELECT arg_max(r, length(r)) FROM (VALUES ('src'), ('src/core'), ('tests'), ('pkg1'), ('Arc.Core.Specs/for_Thing')) v(r) WHERE starts_with(p.path, r || '/')) AS root_path FROM (SELECT DISTINCT path FROM cf) p"))(
    lambda spark, d: joins.longest_prefix(bindings.raw_files(spark, d).select("path").distinct(), spark.createDataFrame([(x,) for x in ("src", "src/core", "tests", "pkg1", "Arc.Core.Specs/for_Thing")], "root_path string"), "path"))

# Filters, dimensions and sets.

query("FLT01_window", oracle(f"SELECT provider, session_id, ord FROM ev WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}'"))(
    lambda spark, d: filters.in_window(bindings.events(spark, d), F.lit(SINCE).cast("timestamp"), F.lit(UNTIL).cast("timestamp")).select(*KEY, "ord"))
query("FLT02_providers", oracle("SELECT ord FROM ev WHERE provider IN ('claude', 'pi') AND provider <> 'pi'"))(
    lambda spark, d: filters.by_provider(bindings.events(spark, d), ["Claude_Code", "pi-agent"], ["PI"]).select("ord"))
query("FLT03_repo_text", oracle("SELECT ord FROM ev WHERE contains(lower(repo), 'oot1/re') OR contains(lower(cwd), 'oot1/re') OR contains(lower(root), 'oot1/re')"))(
    lambda spark, d: filters.by_repo_text(bindings.events(spark, d), "OOT1/Re").select("ord"))
query("FLT04_exact_repo", oracle("SELECT ord FROM ev WHERE lower(repo) = 'repo3'"))(lambda spark, d: filters.by_exact_repo(bindings.events(spark, d), "REPO3").select("ord"))
query("FLT11_clip", oracle("SELECT provider, session_id, model, epoch_us(s) AS start_us, epoch_us(e) AS end_us FROM iv", iv=_windowed()["iv"]))(
    lambda spark, d: _activity(spark, d, True).intervals.select(*KEY, "model", I.us("start").alias("start_us"), I.us("end").alias("end_us")))
query("FLT14_eligible_sessions", oracle(
    f"SELECT provider, session_id FROM sess JOIN seen USING (provider, session_id) WHERE (first_seen >= TIMESTAMP '{SINCE}' AND first_seen < TIMESTAMP '{UNTIL}') OR (provider, session_id) IN (SELECT provider, session_id FROM iv)", iv=_windowed()["iv"]))(
    lambda spark, d: report.eligible_sessions(_activity(spark, d, True)).select(*KEY))
query("PRJ06_dimensions", oracle("SELECT repo, root, cwd, CASE WHEN agent_authored THEN 'git-agent' ELSE 'git' END AS provider, '—' AS model, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM com GROUP BY ALL"))(
    lambda spark, d: (lambda c: report.keyed_commits(c, ("repo", "root", "cwd", "provider", "model", "day")).groupBy(*[F.col(f"d_{x}").alias(x) for x in ("repo", "root", "cwd", "provider", "model", "day")]).agg(F.count("*").alias("n")))(report.commit_stats(*(lambda t: (t.commits, t.files))(bindings.tables(spark, d)))))
query("PRJ07_bounded_key", "SELECT doc_id, left(text, 4096) AS key FROM documents")(lambda spark, d: bindings.load(spark, d, "documents").select("doc_id", bounded_key(F.col("text")).alias("key")))
query("SET01_union_all", oracle("SELECT kind, count(*) AS n FROM sig GROUP BY kind"))(lambda spark, d: _activity(spark, d).signals.groupBy("kind").agg(F.count("*").alias("n")))
query("SET02_distinct", oracle("SELECT DISTINCT cwd, root FROM com"))(lambda spark, d: bindings.commit_table(spark, d).select("cwd", "root").distinct())
query("SET03_except", oracle("SELECT provider, session_id FROM sess EXCEPT SELECT provider, session_id FROM iv"))(
    lambda spark, d: (lambda act: act.sessions.select(*KEY).subtract(act.intervals.select(*KEY)))(_activity(spark, d)))
query("SET04_partition", oracle("SELECT agent_authored, count(*) AS n FROM com GROUP BY agent_authored"))(
    lambda spark, d: (lambda act: act.commits.groupBy("agent_authored").agg(F.count("*").alias("n")).union(act.agent_commits.groupBy("agent_authored").agg(F.count("*").alias("n"))))(_activity(spark, d)))
