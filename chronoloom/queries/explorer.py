"""Drill-down queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import bindings
from ..operators import explore, report
from ..session import kept
from .base import CAP, CREDIT, IDLE, fuzzy_sql, oracle, query, r3, sec

REPO, PERIOD, DAY = "/work/root1/repo3", "2024-01", "2024-01-10"


def _both(spark, d):
    t = bindings.tables(spark, d)
    return report.commit_stats(t.commits, t.files).where("NOT agent_authored"), t.files


def _at(f):
    return lambda spark, d: f(*_both(spark, d))


def _targets(spark, d):
    """Search targets of one's own commits, whose summaries are kept."""
    t = bindings.tables(spark, d)
    return explore.search_targets(kept(explore.told(t.commits.where("NOT agent_authored"), t.files)), t.files, None)


_OVER = "SELECT c.cwd, repo, root, commits, additions, deletions, coalesce(files, 0) AS files, additions - deletions AS net_lines{more} FROM (SELECT cwd, min(repo) AS repo, min(root) AS root, count(*) AS commits, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM mine GROUP BY cwd) c LEFT JOIN (SELECT cwd, count(DISTINCT path) AS files FROM mfiles WHERE NOT is_ignored GROUP BY cwd) f ON f.cwd = c.cwd"
query("EXP01_overview", oracle(_OVER.format(more=", 0.0::DOUBLE AS active_seconds, 0.0::DOUBLE AS human_estimated_seconds")))(_at(lambda c, f: explore.overview(c, f).select("cwd", "repo", "root", "commits", "additions", "deletions", "files", "net_lines", "active_seconds", "human_estimated_seconds")))


def _period_sql(grain: str) -> str:
    key = f"strftime(ts, '{'%Y-%m' if grain == 'month' else '%Y-%m-%d'}')"
    return oracle(
        f"SELECT c.period, commits, additions, deletions, coalesce(files, 0) AS files, additions - deletions AS net_lines FROM (SELECT {key} AS period, count(*) AS commits, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM mine WHERE cwd = '{REPO}' GROUP BY 1) c "
        f"LEFT JOIN (SELECT {key} AS period, count(DISTINCT path) AS files FROM mfiles WHERE NOT is_ignored AND cwd = '{REPO}' GROUP BY 1) f ON f.period = c.period")


for _g in ("month", "day"):
    query(f"EXP02_periods_{_g}", _period_sql(_g))(_at(lambda c, f, g=_g: explore.periods(c, f, REPO, g).select("period", "commits", "additions", "deletions", "files", "net_lines")))
_IN = f"cwd = '{REPO}' AND strftime(ts, '%Y-%m') = '{PERIOD}'"
query("EXP03_categories", oracle(f"SELECT category, files, additions, deletions, {r3('CAST(additions + deletions AS DOUBLE) / sum(additions + deletions) OVER ()')} AS share, additions - deletions AS net_lines FROM (SELECT category, count(DISTINCT path) AS files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM mfiles WHERE NOT is_ignored AND {_IN} GROUP BY category) WHERE additions + deletions > 0"))(
    _at(lambda c, f: explore.categories(c, f, REPO, PERIOD)))
_TOLD = "c.sha, epoch_us(ts) AS ts_us, left(c.sha, 9) AS short_sha, coalesce(t.summary, 'no counted files') AS summary"
query("EXP04_commits_of_category", oracle(f"SELECT {_TOLD}, CAST(coalesce(t.file_count, 0) AS BIGINT) AS file_count, c.additions, c.deletions FROM mine c LEFT JOIN told t USING (sha) WHERE {_IN} AND c.sha IN (SELECT sha FROM cf WHERE NOT is_ignored AND category = 'docs' GROUP BY sha HAVING sum(additions + deletions) > 0)"))(
    _at(lambda c, f: explore.commits_touching(c, f, "docs", REPO, PERIOD).withColumn("ts_us", F.unix_micros("ts")).withColumn("file_count", F.col("file_count").cast("long")).drop("ts")))
query("EXP05_files_of_commit", "SELECT * FROM (" + oracle("SELECT path, category FROM cf WHERE NOT is_ignored AND sha = md5('1')") + ")")(
    lambda spark, d: explore.files_of(bindings.commit_files(spark, d), "c4ca4238a0b923820dcc509a6f75849b"))
query("EXP06_file_history", oracle(f"SELECT {_TOLD}, strftime(ts, '%Y-%m') AS period FROM mine c LEFT JOIN told t USING (sha) WHERE cwd = '{REPO}' AND c.sha IN (SELECT sha FROM cf WHERE NOT is_ignored AND path = 'src/core/file5.rs')"))(
    _at(lambda c, f: explore.history(c, f, "src/core/file5.rs", REPO).withColumn("ts_us", F.unix_micros("ts")).drop("ts")))
query("EXP08_scope", oracle(f"SELECT sha FROM mine WHERE cwd = '{REPO}' AND strftime(ts, '%Y-%m-%d') = '{DAY}'"))(_at(lambda c, f: explore.scope(c, REPO, DAY, "day").select("sha")))
_TARGETS = (
    "SELECT 'repo' AS kind, min(repo) || ' (' || min(root) || ')' AS label, cwd AS key FROM mine GROUP BY cwd "
    "UNION ALL SELECT 'commit', left(c.sha, 9) || ' ' || coalesce(t.summary, 'no counted files'), c.sha FROM mine c LEFT JOIN told t USING (sha) "
    "UNION ALL SELECT 'file', path, arg_max(sha, row(ts, sha)) FROM mfiles WHERE NOT is_ignored GROUP BY cwd, path"
)
query("EXP09_search_targets", oracle(_TARGETS))(lambda spark, d: _targets(spark, d).select("kind", "label", "key"))
query("EXP10_dominant_category", oracle("SELECT sha, CASE WHEN sum(n) > 0 THEN arg_max(category, row(n, list_position(['test', 'docs', 'config', 'assets', 'source', 'other'], category))) ELSE 'other' END AS category FROM (SELECT sha, category, sum(additions + deletions) AS n FROM cf WHERE NOT is_ignored GROUP BY sha, category) GROUP BY sha"))(
    lambda spark, d: explore.dominant_category(bindings.commit_files(spark, d)))
query("EXP13_headline", oracle(f"SELECT (SELECT count(DISTINCT sha) FROM mine) AS commits, (SELECT count(*) FROM sess) AS sessions, (SELECT CAST(sum(additions) AS BIGINT) FROM mine) AS additions, (SELECT {sec('sum(epoch_us(e) - epoch_us(s))')} FROM hiv) AS human_seconds, (SELECT {sec('sum(epoch_us(e) - epoch_us(s))')} FROM ivs) AS ai_seconds"))(
    lambda spark, d: report.summary(report.activity(bindings.tables(spark, d), CAP, IDLE, CREDIT), ("active", "human", "sessions", "commits")).select(F.col("commit_count").alias("commits"), F.col("session_count").alias("sessions"), "additions", F.col("human_estimated_seconds").alias("human_seconds"), F.col("parallel_agent_seconds").alias("ai_seconds")))
query("ORD03_explorer_sort", oracle("SELECT cwd, CAST(row_number() OVER (ORDER BY lower(repo) DESC, cwd) AS BIGINT) AS place FROM (SELECT DISTINCT cwd, repo FROM mine)"))(
    _at(lambda c, f: _placed(c)))


def _placed(commits):
    """Places from each sorted partition's own numbers and the sizes of those before it."""
    rows = explore.sorted_rows(commits.select("cwd", "repo").distinct(), "repo", True)
    numbered = rows.select("cwd", F.monotonically_increasing_id().alias("id")).persist()
    part = F.shiftright("id", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("part", ahead.alias("ahead")))
    place = F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("ahead") + 1
    return numbered.join(offsets, part == F.col("part")).select("cwd", place.cast("long").alias("place"))


_TOLD = (
    "SELECT 'repo' AS kind, min(repo) || ' (' || min(root) || ')' AS label, cwd AS key, NULL AS ts FROM mine GROUP BY cwd "
    "UNION ALL SELECT 'commit', left(c.sha, 9) || ' ' || coalesce(t.summary, 'no counted files'), c.sha, c.ts FROM mine c LEFT JOIN told t USING (sha) "
    "UNION ALL SELECT 'file', path, arg_max(sha, row(ts, sha)), max(ts) FROM mfiles WHERE NOT is_ignored GROUP BY cwd, path"
)
query("ORD04_search_top", oracle(
    f"SELECT kind, label, key, ts, score FROM targets JOIN hits USING (label) ORDER BY score DESC, length(label), label, key, kind LIMIT {explore.MAX_HITS}",
    targets=_TOLD, hits=fuzzy_sql("SELECT DISTINCT label FROM targets", "label", "srcfile1"),
))(lambda spark, d: explore.search(explore.search_index(_targets(spark, d)), "srcfile1"))
