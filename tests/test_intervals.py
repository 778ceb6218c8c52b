"""Interval algebra on hand-made timelines, and invariants on random ones."""

import random
from datetime import datetime, timedelta

import pytest
from chronoloom.operators import intervals as I
from chronoloom.operators import report
from pyspark.sql import functions as F

DAY = datetime(2026, 1, 1)
KEY = ("p", "s")
POINT = "provider string, session_id string, ts timestamp, model string, ord long"
EXACT = "provider string, session_id string, start timestamp, end timestamp, model string, ord long"
MINUTE = 60_000_000


def at(text: str) -> datetime:
    h, m = text.split(":")
    return DAY + timedelta(hours=int(h), minutes=int(m))


def points(spark, *rows, session="s"):
    return spark.createDataFrame([("p", session, at(t), m, i) for i, (t, m) in enumerate(rows)], POINT)


def exact(spark, *rows, session="s"):
    return spark.createDataFrame([("p", session, at(a), at(b), m, i) for i, (a, b, m) in enumerate(rows)], EXACT)


def segments(df):
    return [(r.model, (r.end - r.start).total_seconds()) for r in df.orderBy("start").collect()]


def test_gap_cap_and_union(spark):
    got = I.gap_intervals(points(spark, ("10:00", "m"), ("10:02", "m"), ("10:20", "m")), 5 * MINUTE)
    assert sum(s for _, s in segments(got)) == 420
    assert I.union_micros(got).first().union_us == 420_000_000


@pytest.mark.parametrize(
    ("rows", "ranges", "cap", "want"),
    [
        ([("10:00", "unknown"), ("10:10", "unknown")], [("10:02", "10:06", "gpt")], 30, [("unknown", 120), ("gpt", 240), ("unknown", 240)]),
        ([], [("10:00", "10:10", "a"), ("10:10", "10:20", "a")], 30, [("a", 1200)]),
        ([("10:00", "m"), ("10:20", "m")], [("10:05", "10:10", "n")], 30, [("m", 300), ("n", 300), ("m", 600)]),
        ([], [("10:00", "10:00", "a")], 30, []),
        ([], [("23:30", "26:10", "a"), ("24:00", "25:00", "unknown")], 30, [("a", 9600)]),
    ],
)
def test_sweep(spark, rows, ranges, cap, want):
    got = I.session_intervals(points(spark, *rows), exact(spark, *ranges), cap * MINUTE)
    assert segments(got) == want


def test_nearest_models_and_ties(spark):
    rows = points(spark, ("10:00", "unknown"), ("10:01", "a"), ("10:02", "unknown"), ("10:03", "unknown"), ("10:03", "b"))
    assert [r.model for r in I.nearest_models(rows).orderBy("ord").collect()] == ["a", "a", "a", "a", "b"]
    assert [r.model for r in I.nearest_models(points(spark, ("10:00", "unknown"))).collect()] == ["unknown"]


def test_nested_union(spark):
    got = exact(spark, ("10:00", "11:00", "a"), ("10:10", "10:20", "a"), ("12:00", "12:00", "a"))
    assert I.union_micros(got).first().union_us == 3_600_000_000


def test_month_split_and_skipped_midnight(spark):
    edge = datetime(2026, 2, 1)
    df = spark.createDataFrame([("p", "s", edge - timedelta(seconds=60), edge + timedelta(seconds=60), "m", 0)], EXACT)
    got = {r.month: (r.end - r.start).total_seconds() for r in I.calendar_split(df, "month").collect()}
    assert got == {"2026-01": 60, "2026-02": 60}
    whole = spark.createDataFrame([("p", "s", DAY, DAY + timedelta(days=1), "m", 0)], EXACT)
    assert I.calendar_split(whole, "day").count() == 1


def signals(spark, rows, repo="r"):
    """rows: (time, kind, repo)."""
    data = [(at(t), "p", f"s{i}", "/c", r or repo, "root", k, "m", i) for i, (t, k, r) in enumerate(rows)]
    df = spark.createDataFrame(data, "ts timestamp, provider string, session_id string, cwd string, repo string, root string, kind string, model string, n int")
    return df.withColumn("load", F.struct("n")).drop("n")


@pytest.mark.parametrize("unit", ["hour", "day", "minute"])
def test_blocks_and_attribution(spark, unit):
    rows = [("10:00", "p_prompt", "a"), ("10:20", "p_prompt", "b"), ("12:00", "commit", "c")]
    got = I.human_intervals(signals(spark, rows), 30 * MINUTE, 10 * MINUTE, unit).collect()
    assert sum((r.end - r.start).total_seconds() for r in got) == 2400
    assert {r.repo for r in got} == {"a", "b", "c"} and {r.session_id for r in got} == {"work-block:0", "work-block:1"}


def test_midnight_clamp_and_priority(spark):
    got = I.human_intervals(signals(spark, [("23:58", "commit", None), ("23:58", "p_prompt", "won"), ("23:58", "p_session_edge", None)]), 30 * MINUTE, 10 * MINUTE).collect()
    assert len(got) == 1 and got[0].repo == "won"
    assert got[0].end == datetime(2026, 1, 2) and got[0].start == at("23:53")


def test_idle_gap_is_inclusive(spark):
    rows = [("10:00", "p_prompt", None), ("11:00", "p_prompt", None), ("12:01", "p_prompt", None)]
    assert I.work_blocks(signals(spark, rows), 60 * MINUTE).agg(F.max("block")).first()[0] == 1


SESSION = "provider string, session_id string, cwd string, repo string, root string, is_subagent boolean"


def test_edges_of_foreground_sessions(spark):
    sessions = spark.createDataFrame([("p", "s", "/c", "r", "x", False), ("p", "sub", "/c", "r", "x", True)], SESSION)
    both = points(spark, ("10:00", "m"), ("10:30", "m")).union(points(spark, ("12:00", "m"), ("13:00", "m"), session="sub"))
    none = exact(spark, ("9:00", "9:00", "m")).limit(0)
    commits = spark.createDataFrame([], "sha string, ts timestamp, repo string, cwd string, root string, agent_authored boolean")
    sig = I.human_signals(sessions, both, none, both.limit(0), commits)
    assert sig.count() == 2
    got = I.human_intervals(sig, 60 * MINUTE, 30 * MINUTE).collect()
    assert sum((r.end - r.start).total_seconds() for r in got) == 3600
    one = I.session_edges(sessions, points(spark, ("10:00", "m")), none, both.limit(0))
    assert one.count() == 1


class Tables:
    def __init__(self, **k):
        self.__dict__.update(k)


def _random_tables(spark, rng):
    keys = [(rng.choice("pq"), f"s{i}") for i in range(6)]
    when = lambda: DAY + timedelta(seconds=rng.randint(0, 3 * 86400))
    pts = [(*k, when(), rng.choice(["unknown", "a", "b"]), i) for i, k in enumerate(keys * 8)]
    ex = []
    for i, k in enumerate(keys * 2):
        s = when()
        ex.append((*k, s, s + timedelta(seconds=rng.randint(0, 9000)), rng.choice(["unknown", "a"]), i))
    sess = [(*k, f"/c{i % 3}", f"r{i % 2}", "x", i % 4 == 3) for i, k in enumerate(keys)]
    commits = [(f"c{i}", when(), f"r{i % 2}", f"/c{i % 3}", "x", i % 3 == 0, i % 2 == 0, False) for i in range(12)]
    files = [(f"c{i % 12}", f"src/f{i % 5}.py", i, 1, i % 7 == 0, "source") for i in range(30)]
    return Tables(
        sessions=spark.createDataFrame(sess, SESSION),
        points=spark.createDataFrame(pts, POINT),
        human=spark.createDataFrame([p for p in pts if p[4] % 3 == 0], POINT),
        exact=spark.createDataFrame(ex, EXACT),
        tokens=spark.createDataFrame([(*k, when(), "a", 1, 2, 3, 4) for k in keys], "provider string, session_id string, ts timestamp, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long"),
        commits=spark.createDataFrame(commits, "sha string, ts timestamp, repo string, cwd string, root string, agent_authored boolean, agent_assisted boolean, autofix_assisted boolean"),
        files=spark.createDataFrame(files, "sha string, path string, additions long, deletions long, is_ignored boolean, category string"),
    )


def test_report_invariants(spark):
    t = _random_tables(spark, random.Random(4))
    act = report.activity(t, 5 * MINUTE, 60 * MINUTE, 30 * MINUTE)
    total = report.summary(act).first()
    for dims in (("repo",), ("day", "provider"), ("cwd", "model")):
        rows = report.grouped_report(act, dims).collect()
        assert abs(sum(r.human_estimated_seconds for r in rows) - total.human_estimated_seconds) < 0.01
        assert abs(sum(r.active_seconds for r in rows) - total.parallel_agent_seconds) < 0.01
        assert all(r.ai_wall_seconds <= r.active_seconds + 0.001 for r in rows)
    assert total.agent_wall_seconds <= total.parallel_agent_seconds
    # Agent commits never move human metrics.
    t.commits = t.commits.where("NOT agent_authored")
    again = report.summary(report.activity(t, 5 * MINUTE, 60 * MINUTE, 30 * MINUTE)).first()
    assert again.human_estimated_seconds == total.human_estimated_seconds and again.human_signal_count == total.human_signal_count
    act.release()


def test_empty_report(spark):
    t = _random_tables(spark, random.Random(5))
    for name, df in vars(t).items():
        setattr(t, name, df.limit(0))
    act = report.activity(t, 5 * MINUTE, 60 * MINUTE, 30 * MINUTE)
    assert report.grouped_report(act, ("repo",)).count() == 0
    row = report.summary(act).first()
    assert row.session_count == 0 and row.human_estimated_seconds == 0 and row.first_seen is None
