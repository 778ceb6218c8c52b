"""Scalar functions over the driver's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings
from ..functions import fuzzy, json, names, paths, text, times
from ..operators import report
from .base import fuzzy_sql, oracle, query, r3

load = bindings.load


def _select(table: str, columns):
    """A query of named columns; ``columns`` is called when there is a session."""
    return lambda spark, d: load(spark, d, table).select(*[c.alias(k) for k, c in columns().items()])


def _stamps():
    ts = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey") % 4
    return F.when(k == 0, F.concat(ts, F.lit("Z"))).when(k == 1, F.concat(ts, F.lit(".250+02:00"))).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")


query("FN01_rfc3339", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch_us(o_orderdate) WHEN 1 THEN epoch_us(o_orderdate) + 250000 - 7200000000 END AS us FROM orders")(
    lambda spark, d: load(spark, d, "orders").select("o_orderkey", F.unix_micros(times.rfc3339(_stamps())).alias("us")))
query("FN02_epoch_ms", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(round(value * 1000000) AS BIGINT) END AS us FROM events")(
    lambda spark, d: load(spark, d, "events").select("event_id", F.unix_micros(times.epoch_ms(F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value") * 1000))).alias("us")))
query("FN04_bounds", "SELECT o_orderkey, epoch_us(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) AS month_end, epoch_us(date_trunc('day', o_orderdate) + INTERVAL 1 DAY) AS day_end, epoch_us(date_trunc('day', o_orderdate)) AS day_start FROM orders")(
    lambda spark, d: load(spark, d, "orders").select("o_orderkey", *[F.unix_micros(times.bound(F.date_format("o_orderdate", f), u)).alias(n) for n, f, u in (("month_end", "yyyy-MM", True), ("day_end", "yyyy-MM-dd", True), ("day_start", "yyyy-MM-dd", False))]))
query("FN05_spans", "SELECT o_orderkey, epoch_us(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH) AS last_month, epoch_us(date_trunc('month', o_orderdate)) AS this_month, epoch_us(date_trunc('year', o_orderdate)) AS this_year, epoch_us(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR) AS year_end FROM orders")(
    lambda spark, d: load(spark, d, "orders").select("o_orderkey", *[F.unix_micros(c).alias(n) for n, c in (("last_month", times.span("month", F.col("o_orderdate"), 1)[0]), ("this_month", times.span("month", F.col("o_orderdate"))[0]), ("this_year", times.span("year", F.col("o_orderdate"))[0]), ("year_end", times.span("year", F.col("o_orderdate"))[1]))]))
query("FN06_local_keys", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month FROM events")(_select("events", lambda: dict(event_id=F.col("event_id"), day=times.local_day(F.col("ts")), month=times.local_month(F.col("ts")))))
query("FN07_local_midnight", "SELECT event_id, epoch_us(date_trunc('day', ts)) AS us FROM events")(_select("events", lambda: dict(event_id=F.col("event_id"), us=F.unix_micros(times.local_midnight(F.to_date("ts"))))))
query("FN09_round3", f"SELECT l_orderkey, l_linenumber, {r3('l_extendedprice / 7 - 5000')} AS x FROM lineitem")(
    _select("lineitem", lambda: dict(l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), x=times.round3(F.col("l_extendedprice") / 7 - 5000))))
query("FN10_iso", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS iso FROM events")(
    _select("events", lambda: dict(event_id=F.col("event_id"), iso=times.iso(F.when(F.col("event_id") % 2 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts"))))))

_PROVIDERS = ["Claude_Code ", "openai-codex", "GEMINI_CLI", "vs_code_copilot", "pi-agent", "Other_Tool", "all", "bad name", "-x", "open_code"]
_NORMAL = ["claude", "codex", "gemini", "copilot-vscode", "pi", "other-tool", "all", "bad name", "-x", "opencode"]
_pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % len(xs)).cast("int"))
_sql_pick = lambda xs: "([" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + f"])[o_orderkey % {len(xs)} + 1]"
query("FN11_provider_names", f"SELECT o_orderkey, {_sql_pick(_NORMAL)} AS provider FROM orders")(_select("orders", lambda: dict(o_orderkey=F.col("o_orderkey"), provider=names.provider_name(_pick(_PROVIDERS)))))
_MODELS = ["gpt-5", "<synthetic>", "a b", "anthropic/claude-x:1", "", "-lead", "x" * 129, "ok_1+2"]
_SAFE = ["gpt-5", "<synthetic>", "unknown", "anthropic/claude-x:1", "unknown", "unknown", "unknown", "ok_1+2"]
query("FN12_sanitised", f"SELECT o_orderkey, {_sql_pick(_SAFE)} AS model, {_sql_pick([n if n not in ('all', 'bad name', '-x') else 'unknown' for n in _NORMAL])} AS provider FROM orders")(
    _select("orders", lambda: dict(o_orderkey=F.col("o_orderkey"), model=names.safe_model(_pick(_MODELS)), provider=names.safe_provider(_pick(_PROVIDERS)))))
query("FLT10_valid_names", f"SELECT o_orderkey FROM orders WHERE {_sql_pick(_SAFE)} <> 'unknown'")(
    lambda spark, d: load(spark, d, "orders").where(names.is_model(_pick(_MODELS))).select("o_orderkey"))
_URLS = ["file:///home/me/a%20b+c", "file:///c%3A/Users/x", "file:///bad%zz/%41", "https://x.org/a", "file://host/share", "file:///plain"]
_FILES = ["/home/me/a b+c", "c:/Users/x", "/bad%zz/A", None, None, "/plain"]
query("FN19_file_urls", "SELECT o_orderkey, ([" + ", ".join("NULL" if x is None else f"'{x}'" for x in _FILES) + "])[o_orderkey % 6 + 1] AS path FROM orders")(
    _select("orders", lambda: dict(o_orderkey=F.col("o_orderkey"), path=paths.file_url_path(_pick(_URLS)))))
query("FN19_percent_decode", "SELECT page_id, url FROM pages")(
    lambda spark, d: load(spark, d, "pages").select("page_id", paths.percent_decoded(F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20"))).alias("url")))
_DIRS = ["-home-me-proj", "C--Users-me", "x-y", "--home-me--", "--D--w-z--"]
query("FN20_dashed_paths", f"SELECT o_orderkey, {_sql_pick(['/home/me/proj', 'C:/Users/me', '/x/y', '//home/me//', '//D//w/z//'])} AS plain, {_sql_pick(['//home/me/proj', 'C:/Users/me', '/x/y', '/home/me', 'D:/w/z'])} AS wrapped FROM orders")(
    _select("orders", lambda: dict(o_orderkey=F.col("o_orderkey"), plain=paths.dashed_path(_pick(_DIRS)), wrapped=paths.wrapped_dashed_path(_pick(_DIRS)))))
_JSON = ['{"providerID":"p","modelID":"m"}', '{"provider_id":"q","model":"n"}', '{"id":"only"}', '{"x":1}', "plain-model", '{"modelID":"a b"}']
query("FN21_json_model", f"SELECT o_orderkey, {_sql_pick(['p/m', 'q/n', 'only', 'unknown', 'plain-model', 'unknown'])} AS model FROM orders")(
    _select("orders", lambda: dict(o_orderkey=F.col("o_orderkey"), model=json.json_model(_pick(_JSON)))))
_BODIES = ['{"c":"hi"}', '{"c":[{"type":"text"}]}', '{"c":[{"type":"tool_result"}]}', '{"c":null}', '{"c":{"type":"text"}}', '{"c":[1,{"type":"image"}]}', "{}"]
query("FN22_content_kinds", "SELECT o_orderkey, o_orderkey % 7 IN (0, 1, 5) AS human, o_orderkey % 7 = 4 AS is_object FROM orders")(
    _select("orders", lambda: dict(o_orderkey=F.col("o_orderkey"), human=json.human_content(_pick(_BODIES), "$.c"), is_object=json.is_object(_pick(_BODIES), "$.c"))))
query("FN23_fuzzy_score", f"SELECT p_partkey, h.score FROM part LEFT JOIN ({fuzzy_sql('SELECT DISTINCT p_name AS label FROM part', 'label', 'pae')}) h ON h.label = p_name")(
    lambda spark, d: load(spark, d, "part").select("p_partkey", fuzzy.fuzzy_score(F.col("p_name"), "pae").alias("score")))
query("FN23_subsequence", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)r.*d.*g')")(
    lambda spark, d: load(spark, d, "part").where(fuzzy.fuzzy_score(F.col("p_name"), "RdG").isNotNull()).select("p_partkey"))
query("FLT13_fuzzy_filter", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '(?i)c.*r.*7')")(
    lambda spark, d: load(spark, d, "customer").where(fuzzy.subsequence(F.col("c_name"), "cR7")).select("c_custkey"))
query("FN24_safe_text", "SELECT doc_id, regexp_replace(text, '[\\x00-\\x1F\\x7F-\\x{9F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]', '·', 'g') AS text FROM documents")(
    _select("documents", lambda: dict(doc_id=F.col("doc_id"), text=text.safe_text(F.col("text")))))
_CELLS = ["=1+1", "+5", "-1.5", "@x", "-1d", "plain", "-1e3", "+", "-inf", "=cmd"]
query("FN25_neutral_cells", f"SELECT o_orderkey, {_sql_pick([chr(39) + c if c in ('=1+1', '@x', '-1d', '+', '=cmd') else c for c in _CELLS])} AS cell FROM orders")(
    _select("orders", lambda: dict(o_orderkey=F.col("o_orderkey"), cell=text.neutral_cell(_pick(_CELLS)))))
query("FN26_hours", "SELECT o_orderkey, (CAST(round(o_totalprice) AS BIGINT) // 3600) || 'h ' || lpad(CAST(CAST(round(o_totalprice) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || 'm' AS shown FROM orders")(
    _select("orders", lambda: dict(o_orderkey=F.col("o_orderkey"), shown=text.hours(F.col("o_totalprice")))))
query("FN26_compact", "SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN format('{:.1f}k', round_even(n / 1000.0::DOUBLE * 10, 0) / 10) ELSE format('{:.1f}M', round_even(n / 1000000.0::DOUBLE * 10, 0) / 10) END AS shown FROM (SELECT o_orderkey, o_orderkey * o_orderkey // 7 AS n FROM orders)")(
    _select("orders", lambda: dict(o_orderkey=F.col("o_orderkey"), shown=text.compact_count(F.expr("o_orderkey * o_orderkey div 7"), "M"))))
query("FN26_separated", "SELECT o_orderkey, format('{:,}', o_orderkey * 7919) || CASE WHEN o_orderkey * 7919 = 1 THEN ' commit' ELSE ' commits' END AS shown FROM orders")(
    _select("orders", lambda: dict(o_orderkey=F.col("o_orderkey"), shown=text.counted(F.col("o_orderkey") * 7919, "commit", "commits"))))
query("FN26_percent", "SELECT l_orderkey, l_linenumber, CASE WHEN x > 0 AND x < 0.005 THEN '<1%' ELSE CAST(CAST(round_even(x * 100, 0) AS BIGINT) AS VARCHAR) || '%' END AS shown FROM (SELECT l_orderkey, l_linenumber, l_discount / 3 AS x FROM lineitem)")(
    _select("lineitem", lambda: dict(l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), shown=text.percent(F.col("l_discount") / 3))))
query("FN26_labels", "SELECT o_orderkey, strftime(o_orderdate, '%B %Y') || ' · ' || CASE WHEN o_orderkey % 2 = 0 THEN '(no model)' ELSE 'm1' END AS label FROM orders")(
    _select("orders", lambda: dict(o_orderkey=F.col("o_orderkey"), label=text.label(month=F.date_format("o_orderdate", "yyyy-MM"), model=F.when(F.col("o_orderkey") % 2 == 0, "unknown").otherwise("m1")))))
query("FN26_left_clipped", "SELECT page_id, CASE WHEN length(url) <= 20 THEN url ELSE '…' || right(url, 19) END AS shown FROM pages")(_select("pages", lambda: dict(page_id=F.col("page_id"), shown=text.left_clipped(F.col("url"), 20))))
query("FN26_spark_line", "SELECT o_custkey, array_to_string(list_transform(v, lambda x: substr('▁▂▃▄▅▆▇█', CAST(CASE WHEN list_max(v) > 0 THEN least(floor(x / list_max(v) * 7), 7) ELSE 0 END AS BIGINT) + 1, 1)), '') AS line FROM (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey)")(
    lambda spark, d: load(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("v")).select("o_custkey", text.spark_line(F.col("v")).alias("line")))
query("FN27_safe_message", "SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE left(t, 119) || '…' || right(t, 80) END AS message FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x1F\\x7F-\\x{9F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]', '·', 'g') AS t FROM documents)")(
    _select("documents", lambda: dict(doc_id=F.col("doc_id"), message=text.safe_message(F.col("text")))))
query("FN29_commit_period", oracle("SELECT sha, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day FROM com"))(
    lambda spark, d: bindings.commit_table(spark, d).select("sha", times.local_month(F.col("ts")).alias("month"), times.local_day(F.col("ts")).alias("day")))
_PATCH = ["+added", "-gone", "@@ -1 +1 @@", "+++ b/x", "--- a/x", "diff --git a b", " same", "index 12..34", "\\ No newline at end of file", "rename from x", ""]
_KINDS = ["added", "removed", "hunk", "meta", "meta", "meta", "context", "meta", "meta", "meta", "context"]
query("FN30_diff_lines", f"SELECT o_orderkey, {_sql_pick(_KINDS)} AS kind FROM orders")(_select("orders", lambda: dict(o_orderkey=F.col("o_orderkey"), kind=text.diff_line_kind(_pick(_PATCH)))))
query("PRJ03_source_root", "SELECT page_id, CASE k WHEN 0 THEN 'tmp/scratch' WHEN 1 THEN '~/work' WHEN 2 THEN '~' WHEN 3 THEN 'srv' ELSE 'filesystem' END AS root FROM (SELECT page_id, page_id % 5 AS k FROM pages)")(
    _select("pages", lambda: dict(page_id=F.col("page_id"), root=paths.source_root(F.get(F.array(*map(F.lit, ["/tmp/x/y", "/root/work/a/b", "/root", "/srv/app", "/app"])), (F.col("page_id") % 5).cast("int"))))))
query("PRJ04_repo_label", "SELECT DISTINCT url, list_last(string_split(regexp_replace(url, '/+$', ''), '/')) AS label FROM pages")(
    lambda spark, d: load(spark, d, "pages").select("url", paths.repo_label(F.col("url"), "/root").alias("label")).distinct())
query("PRJ05_root_rule", "SELECT page_id, regexp_replace(url, '^https?://([a-z.]+)/(..)/', '\\2@\\1:') AS root FROM pages WHERE regexp_matches(url, '^https?://([a-z.]+)/(..)/')")(
    lambda spark, d: load(spark, d, "pages").select("page_id", paths.RootRule(r"^https?://([a-z.]+)/(..)/", r"\2@\1:").apply(F.col("url")).alias("root")).where("root IS NOT NULL"))
query("PRJ10_event_defaults", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'unknown' ELSE 'm1' END AS model, CASE WHEN event_id % 3 = 0 THEN 'activity' ELSE 'prompt' END AS event, CASE WHEN event_id % 5 = 0 THEN 'foreground' ELSE 'subagent' END AS role FROM events")(
    lambda spark, d: _defaults(spark, d))


def _defaults(spark, d):
    from ..sources.events import with_defaults

    k = F.col("event_id")
    r = F.struct(F.when(k % 2 != 0, "m1").alias("model"), F.when(k % 3 != 0, "prompt").alias("event"), F.when(k % 5 != 0, "subagent").alias("role"))
    return load(spark, d, "events").select("event_id", r.alias("r")).select("event_id", *[c.alias(n) for n, c in with_defaults().items()])


query("SNK03_category_pivot", oracle("SELECT repo, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN category = '{c}' THEN {m} END), 0) AS BIGINT) AS {c}_{m}" for c in ("test", "docs", "config", "assets", "source", "other") for m in ("additions", "deletions")) + " FROM mfiles WHERE NOT is_ignored GROUP BY repo"))(
    lambda spark, d: _pivot(spark, d))


def _pivot(spark, d):
    from ..sinks import category_pivot

    t = bindings.tables(spark, d)
    mine = report.commit_stats(t.commits, t.files).where("NOT agent_authored")
    wide = category_pivot(t.files.join(mine.select("sha", "repo"), "sha"), ["repo"])
    return wide.select("repo", *[c for c in wide.columns if c.endswith(("_additions", "_deletions"))])
