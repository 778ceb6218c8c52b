"""Registered queries against their SQL on the driver's smallest tables, and the driver contract."""

import math
import os

import duckdb
import pytest
from chronoloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: A representative part; the driver compares all of them.
COMPARED = [
    "MIN_slice_month_provider", "INT01_nearest_models", "INT03_priority_sweep", "INT04_union_by_session", "INT06_split_month", "INT08_one_per_instant",
    "INT09_work_blocks", "INT11_edge_credit", "AGG01_report_month_repo", "AGG01_report_window", "AGG19_composition_by_repo", "AGG21_summary", "JON01_sessions_with_output",
    "JON02_sessions_without_output", "JON06_two_key_lookup", "PRJ02_nearest_repo", "FN14_explain_urls", "FN16_change_shape", "EXP03_categories", "EXP09_search_targets",
    "SRC09_bounded_lines", "SRC19_open_event_sessions", "WIN07_change_detection", "SNK03_category_pivot",
]


def _norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_same_as_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = sql.execute(ORACLES[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == columns
    want = sorted((tuple(_norm(row[order.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    assert got == want
    spark.catalog.clearCache()


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["month", "provider", "active_seconds", "ai_wall_seconds"]


def test_blocks_are_more_than_one(spark):
    assert QUERIES["INT12_block_ids"](spark, SF).count() > 1


def test_search_takes_every_target(spark, sql, monkeypatch):
    from chronoloom.operators import explore

    monkeypatch.setattr(explore.search_targets, "__defaults__", (5,))
    want = sql.execute(f"SELECT count(*) FROM ({ORACLES['EXP09_search_targets']})").fetchone()[0]
    assert QUERIES["EXP09_search_targets"](spark, SF).count() == want > 5
    assert QUERIES["ORD04_search_top"](spark, SF).count() == min(explore.MAX_HITS, _hits(spark, explore)) > 5


def _hits(spark, explore):
    from chronoloom.functions.fuzzy import fuzzy_score
    from pyspark.sql import functions as F

    return QUERIES["EXP09_search_targets"](spark, SF).where(fuzzy_score(F.col("label"), "srcfile1").isNotNull()).count()


def test_explorer_sort_gathers_no_list(spark, sql):
    df = QUERIES["ORD03_explorer_sort"](spark, SF)
    assert "collect_list" not in df._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in df.collect()) == sorted(sql.execute(ORACLES["ORD03_explorer_sort"]).fetchall())


def test_compact_counts_beyond_a_billion(spark, sql, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CAST(unnest([0, 83, 2645, 83667, 149999, 8999999]) AS BIGINT) AS o_orderkey) TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = sorted(tuple(r) for r in QUERIES["FN26_compact"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLES["FN26_compact"]).fetchall())
    assert dict(got)[149999] == "3214.2M"


def test_commits_of_category_work_out_rules_once(spark, sql):
    df = QUERIES["EXP04_commits_of_category"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") < 20
    order = [c[0] for c in sql.execute(ORACLES["EXP04_commits_of_category"]).description]
    assert sorted(tuple(r) for r in df.select(*order).collect()) == sorted(sql.execute(ORACLES["EXP04_commits_of_category"]).fetchall())


def test_summary_reads_what_its_parts_ask_for(spark):
    from chronoloom.operators import report
    from chronoloom.queries.reports import _activity

    act = _activity(spark, SF)
    part, whole = report.summary(act, ("signals",)).first(), report.summary(_activity(spark, SF)).first()
    of = ["human_signal_count", "prompt_signal_count", "foreground_session_edge_signal_count", "commit_signal_count", "human_active_days"]
    assert [part[c] for c in of] == [whole[c] for c in of] and part.human_signal_count > 0 == part.session_count
    assert not {"intervals", "quiet"} & set(act.__dict__)
    # Commits' signals are a projection of the commits, so they are not kept once more.
    assert len(act._held) == 3 and act.spoken.where("kind = 'commit'").isEmpty()
    act.release()


def test_plain_ignores_are_no_regular_expressions(spark):
    from chronoloom.functions.globs import is_ignored
    from pyspark.sql import functions as F

    paths = ["a/dist/b", "dist/b", "dist", "adist/b", "x.lock", "x.lock.y", "go.sum", "/go.sum", "a/go.sum", "bin/x\ny", "s.map\n"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("i", is_ignored(F.col("path")))
    assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.i for r in df.collect()] == [True, True, False, False, True, False, True, True, False, True, False]


def _same_columns(spark, dims, parts, columns):
    """A report's columns from some parts, and what they kept; whole rows of the full report must have them too."""
    from chronoloom.operators import report
    from chronoloom.queries.reports import _activity

    part, whole = _activity(spark, SF), _activity(spark, SF)
    rows = lambda act, of: sorted(tuple(r) for r in report.grouped_report(act, dims, of).select(*dims, *columns).collect())
    got, want = rows(part, parts), rows(whole, report.PARTS)
    relations = set(part.__dict__)
    part.release(), whole.release()
    return got, want, relations


def test_days_need_no_models_and_no_lines(spark):
    got, want, relations = _same_columns(spark, ("provider",), ("days",), ["active_days"])
    assert got == want and got and not {"intervals", "all_commits", "spoken"} & relations


def test_shared_steps_sort_once(spark):
    """A union is one window over its cut intervals, and commits are not sorted before their join."""
    from chronoloom import bindings
    from chronoloom.operators import report
    from chronoloom.operators.intervals import gap_intervals, union_micros

    t = bindings.tables(spark, SF)
    rows = t.exact.select("provider", "start", "end")
    assert union_micros(rows, ["provider"])._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert union_micros(gap_intervals(t.points, 300_000_000).limit(0)).first().union_us == 0
    twice = spark.sql("SELECT 'a' sha, TIMESTAMP '2024-01-01' ts, 'r' repo, 'c' cwd, 'o' root, x agent_authored FROM VALUES (true), (false) AS v(x)")
    lines = spark.sql("SELECT 'a' sha, false is_ignored, 3L additions, 1L deletions FROM range(2)")
    one = report.one_row_per_commit(report.commit_stats(twice, lines)).first()
    assert (one.agent_authored, one.additions, one.file_count) == (True, 6, 2)


def test_spans_cover_what_intervals_do(spark):
    from chronoloom.operators import intervals as I

    points = spark.sql(
        "SELECT 'p' provider, 's' session_id, CAST(t AS TIMESTAMP) ts, 'm' model, o ord FROM VALUES "
        "('2024-01-01 23:59:00', 1L), ('2024-01-01 23:59:00', 2L), ('2024-01-02 00:01:00', 3L), ('2024-01-05 00:00:00', 4L) AS v(t, o)"
    )
    exact = spark.sql(
        "SELECT 'p' provider, 's' session_id, CAST(a AS TIMESTAMP) start, CAST(b AS TIMESTAMP) end, 'x' model, 1L ord FROM VALUES "
        "('2024-01-02 00:00:30', '2024-01-02 00:09:00'), ('2024-01-03', '2024-01-03') AS v(a, b)"
    )
    cap = 300_000_000
    spans, whole = I.session_spans(points, exact, cap), I.session_intervals(points, exact, cap)
    assert I.union_micros(spans, I.KEY).first().union_us == whole.agg(I.sum_micros().alias("u")).first().u == 600_000_000
    assert spans.where("start = end").isEmpty()


def test_window_is_cut_before_the_sweep_and_before_lines_are_met(spark, monkeypatch):
    """Ranges beyond the window are not swept, and winners stay those of the whole sweep; lines meet chosen commits."""
    from chronoloom import bindings
    from chronoloom.operators import intervals as I
    from chronoloom.operators import report
    from chronoloom.queries.reports import SINCE, UNTIL, _activity
    from pyspark.sql import functions as F

    given, met = [], []
    sweep, stats = I.priority_sweep, report.commit_stats
    monkeypatch.setattr(report, "priority_sweep", lambda ranges, exact: given.append((ranges, exact)) or sweep(ranges, exact), raising=False)
    monkeypatch.setattr(report, "commit_stats", lambda commits, files: met.append(commits) or stats(commits, files))
    t = bindings.tables(spark, SF)
    edges = spark.sql(
        f"SELECT 'p' provider, 's' session_id, TIMESTAMP '{SINCE}' + make_interval(0, 0, 0, 0, 0, a) start, TIMESTAMP '{SINCE}' + make_interval(0, 0, 0, 0, 0, b) end, "
        "m model, n ord FROM VALUES (-90, 30, 'old', 1L), (-30, 10, 'new', 2L), (-80, 0, 'gone', 3L), (5, 6, 'unknown', 4L) AS v(a, b, m, n)"
    )
    t.exact = t.exact.unionByName(edges)
    act = _activity(spark, SF, True, t)
    since, until = (F.lit(x).cast("timestamp") for x in (SINCE, UNTIL))
    rows = lambda df: sorted(tuple(r) for r in df.select(*I.KEY, "start", "end", "model").collect())
    assert rows(act.intervals) == rows(I.clipped(I.session_intervals(t.points, t.exact, act.cap_us), since, until))
    assert [r[4] for r in rows(act.intervals.where("session_id = 's'"))] == ["new", "old"]
    beyond = (F.col("end") <= since) | (F.col("start") >= until)
    assert given and all(df.where(beyond).isEmpty() and not df.isEmpty() for df in given[0])
    assert not act.commits.isEmpty() and not met[0].isEmpty() and met[0].where((F.col("ts") < since) | (F.col("ts") >= until)).isEmpty()
    act.release()


def test_told_commits_are_described_in_one_pass(spark):
    """Commits with a file get what ``described`` gives them, without a second gathering, from code that can be compiled."""
    import contextlib
    import io
    import re

    from chronoloom import bindings
    from chronoloom.operators import explore, report

    commits = spark.sql("SELECT sha, TIMESTAMP '2024-01-01' ts FROM VALUES ('a'), ('b'), ('c'), ('none') AS v(sha)")
    files = spark.sql(
        "SELECT sha, path, i is_ignored, category, 1L additions, 0L deletions FROM VALUES ('a', 'p', false, 'docs'), ('a', 'q', false, 'test'), ('a', 'r', false, 'source'), "
        "('a', 's', false, 'source'), ('a', 't', false, 'other'), ('b', 'u', true, 'docs'), ('c', 'v', false, 'docs'), ('c', 'w', true, 'test') AS v(sha, path, i, category)"
    )
    got = {r.sha: (r.summary, r.file_count, r.short_sha) for r in explore.told(commits, files).collect()}
    assert got == {"a": ("5 files · source, test, docs", 5, "a"), "b": ("no counted files", 0, "b"), "c": ("1 file · docs", 1, "c")}
    t = bindings.tables(spark, SF)
    columns, told = ["sha", "summary", "file_count", "short_sha"], explore.told(t.commits, t.files)
    of = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    assert of(told) == of(explore.described(report.commit_stats(t.commits, t.files), t.files))
    assert "ObjectHashAggregate" not in told._jdf.queryExecution().executedPlan().toString()
    # Adaptive plans have no code before they run.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    t = bindings.tables(spark, SF)
    with contextlib.redirect_stdout(io.StringIO()) as code:
        explore.told(t.commits, t.files).explain("codegen")
        t.files.explain("codegen")
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code.getvalue()))) < 8000


def test_path_rules_hold_to_the_last_byte(spark):
    from chronoloom.operators.classify import with_category

    paths = {
        "a/x_test": "test", "a/x_test\n": "other", "a/xTest\n": "other", "a/x.test.q": "test", "a//./Docs/../b": "docs", "a\\docs\\b": "docs",
        "./docs": "other", "a/.ci/b": "other", ".github/b": "config", "a.specs/b": "test", "given_a/b": "test", "img//b": "assets", "": "other", "..": "other",
    }
    got = with_category(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {r.path: r.category for r in got} == paths


@pytest.mark.parametrize("dims", [("day", "repo"), ("cwd",)])
def test_row_order_needs_no_models_and_no_lines(spark, dims):
    from chronoloom.operators import report

    got, want, relations = _same_columns(spark, dims, report.ORDER_PARTS, ["human_estimated_seconds", "ai_wall_seconds", "commit_count"])
    assert got == want and got and not {"intervals", "all_commits", "files"} & relations


def test_trend_counts_rows_without_time_too(spark, sql, monkeypatch):
    from chronoloom.operators import report

    seen = []
    monkeypatch.setattr(report.Activity, "_keep", lambda act, df, old=report.Activity._keep: seen.append(df.columns) or old(act, df))
    got = sorted(tuple(r) for r in QUERIES["AGG26_trend"](spark, SF).collect())
    assert got == sorted(sql.execute(ORACLES["AGG26_trend"]).fetchall())
    assert not [c for c in seen if "additions" in c or {"start", "model"} <= set(c)]


def test_seconds_by_label_keep_no_commits(spark, sql, monkeypatch):
    from chronoloom.operators import report

    seen = []
    monkeypatch.setattr(report.Activity, "_keep", lambda act, df, old=report.Activity._keep: seen.append(df.columns) or old(act, df))
    got = QUERIES["JON05_seconds_by_label"](spark, SF)
    want = sql.execute(ORACLES["JON05_seconds_by_label"]).fetchall()
    assert sorted((r.cwd, r.repo, round(r.active_seconds, 3)) for r in got.collect()) == sorted((a, b, round(c, 3)) for a, b, c in want)
    assert not [c for c in seen if "sha" in c]
