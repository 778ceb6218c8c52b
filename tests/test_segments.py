"""Folds in chunks and ranges as cells of several widths, against whole windows and plain Python."""

import math
import random
from datetime import datetime, timedelta

from chronoloom.operators import intervals, joins
from chronoloom.sources import folds
from pyspark.sql import functions as F

START = datetime(2026, 1, 1)
POINTS = "provider string, session_id string, ts timestamp, model string, ord long"


def _points(spark, n=600, sessions=3):
    rng = random.Random(9)
    at = lambda: START + timedelta(minutes=rng.choice([rng.randrange(60), rng.randrange(20_000)]))
    rows = [("p", f"s{rng.randrange(sessions)}", at(), rng.choice(["unknown"] * 6 + ["a", "b"]), i) for i in range(n)]
    rows += [("p", "none", at(), "unknown", i) for i in range(5)] + [("p", "one", START, "c", 0)]
    return spark.createDataFrame(rows, POINTS), rows


def test_chunks_hand_on_what_a_whole_window_sees(spark):
    df, rows = _points(spark)
    want = {}
    for session in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == session), key=lambda r: (r[2], r[4]))
        for i, r in enumerate(own):
            back = [x[3] for x in own[: i + 1] if x[3] != "unknown"]
            ahead = [x[3] for x in own[i:] if x[3] != "unknown"]
            want[session, r[4]] = back[-1] if back else ahead[0] if ahead else "unknown"
    cap = 5 * 60 * 10**6
    spans = [sorted(map(tuple, intervals.gap_intervals(df, cap, unit).collect())) for unit in ("year", "day", "hour", "minute")]
    for unit in ("minute", "day"):
        got = {(r.session_id, r.ord): r.model for r in intervals.nearest_models(df, unit).collect()}
        assert got == want
    assert spans[0] == spans[1] == spans[2] == spans[3] and len(spans[0]) > 300


def test_one_session_is_many_tasks(spark):
    rows = [("p", "endless", START + timedelta(hours=i), "unknown" if i else "m", i) for i in range(24 * 60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        told = intervals.nearest_models(spark.createDataFrame(rows, POINTS))
        sizes = told.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and sum(r["count"] for r in sizes) == len(rows)
    assert told.where("model <> 'm'").count() == 0


def test_carried_in_chunks(spark):
    df, _ = _points(spark)
    rows = df.select("session_id", "ord", F.when(F.col("model") != "unknown", F.col("model")).alias("m"), F.lit(1).alias("more"))
    states = {"m2": F.col("m"), "n": F.when(F.col("ord") % 50 == 0, F.col("ord"))}
    show = lambda d: sorted(map(repr, d.select("session_id", "ord", "m", "more", "m2", "n").collect()))
    for before in (False, True):
        whole = folds.carried(rows, ["session_id"], ["ord"], states, before)
        assert show(whole) == show(folds.carried(rows, ["session_id"], ["ord"], states, before, F.floor(F.col("ord") / 7)))
    both = [folds.filled_both_ways(rows, ["session_id"], ["ord"], "m", chunk) for chunk in (None, F.floor(F.col("ord") / 7))]
    assert sorted(map(repr, both[0].collect())) == sorted(map(repr, both[1].collect()))


def test_cells_are_the_range(spark):
    rng = random.Random(2)
    ranges = [(0, 0), (5, 5), (7, 3), (-9, 9), (0, 1 << 22), (3, (1 << 22) + 1)] + [(a, a + rng.randrange(1 << rng.randrange(1, 18))) for a in (rng.randrange(-1000, 1 << 20) for _ in range(200))]
    df = spark.createDataFrame(ranges, "a long, z long").select("a", "z", intervals.dyadic_cells(F.col("a"), F.col("z")).alias("cells"))
    for r in df.collect():
        spans = sorted((c.cell << c.level, (c.cell + 1) << c.level) for c in r.cells)
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert (spans[0][0], spans[-1][1]) == (r.a, r.z) if r.z > r.a else not spans
        if 0 < r.z - r.a < 1 << 18:
            assert len(spans) <= 2 * math.ceil(math.log2(r.z - r.a + 1))


def test_with_output(spark):
    rng, idle = random.Random(6), 3600 * 10**6
    second = lambda n: START + timedelta(seconds=rng.randrange(n))
    sessions = []
    for i in range(150):
        a = second(30 * 86400)
        sessions.append(("p", f"s{i}", f"r{i % 4}", a, a + timedelta(seconds=rng.choice([0, 600, 90_000, 40 * 86400]))))
    commits = [(f"c{i}", f"r{rng.randrange(3)}", second(90 * 86400)) for i in range(120)]
    edge = sessions[0]
    commits += [("e1", "r0", edge[3] - timedelta(hours=1)), ("e2", "r3", sessions[3][4] + timedelta(hours=1)), ("e3", "r3", sessions[7][4] + timedelta(hours=1, microseconds=1))]
    ext = spark.createDataFrame(sessions, "provider string, session_id string, repo string, first_seen timestamp, last_seen timestamp")
    got = {r.session_id for r in joins.with_output(ext, spark.createDataFrame(commits, "sha string, repo string, ts timestamp"), idle).collect()}
    hour = timedelta(hours=1)
    assert got == {s[1] for s in sessions if any(c[1] == s[2] and s[3] - hour <= c[2] <= s[4] + hour for c in commits)}
    assert 20 < len(got) < 150
