"""Interval algebra and window-style operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import bindings
from ..functions.times import calendar_days, iso, seconds
from ..operators import intervals as I
from ..operators.report import keyed_intervals
from .base import CAP, CREDIT, IDLE, RELATIONS, iso as iso_sql, oracle, query, sec, split_sql, union_sql

KEY = ["provider", "session_id"]


def _in_us(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, I.us("start").alias("start_us"), I.us("end").alias("end_us"))


def _sessions(spark, d):
    t = bindings.tables(spark, d)
    return t, I.session_intervals(t.points, t.exact, CAP)


@query("INT01_nearest_models", oracle(
    "SELECT provider, session_id, epoch_us(ts) AS ts_us, ord, fm AS model FROM filled"))
def int01(spark, d):
    t = bindings.tables(spark, d)
    return I.nearest_models(t.points).select(*KEY, I.us("ts").alias("ts_us"), "ord", "model")


@query("INT02_gap_capped", oracle(
    "SELECT provider, session_id, model, epoch_us(s) AS start_us, epoch_us(e) AS end_us FROM gap"))
def int02(spark, d):
    return _in_us(I.gap_intervals(bindings.tables(spark, d).points, CAP), *KEY, "model")


@query("INT03_priority_sweep", oracle(
    "SELECT provider, session_id, model, epoch_us(s) AS start_us, epoch_us(e) AS end_us FROM iv"))
def int03(spark, d):
    return _in_us(_sessions(spark, d)[1], *KEY, "model")


@query("INT04_union_global", oracle(union_sql("gap")))
def int04(spark, d):
    return I.union_micros(I.gap_intervals(bindings.tables(spark, d).points, CAP))


@query("INT04_union_by_session", oracle(union_sql("ranges", "provider, session_id")))
def int04b(spark, d):
    t = bindings.tables(spark, d)
    ranges = I.gap_intervals(t.points, CAP).select(*KEY, "start", "end").union(t.exact.select(*KEY, "start", "end"))
    return I.union_micros(ranges, KEY)


@query("INT05_parallel_work", oracle(
    f"SELECT provider, {sec('sum(epoch_us(e) - epoch_us(s))')} AS parallel_seconds FROM iv GROUP BY provider"))
def int05(spark, d):
    return _sessions(spark, d)[1].groupBy("provider").agg(seconds(I.sum_micros()).alias("parallel_seconds"))


def _split(unit: str):
    def run(spark, d):
        t = bindings.tables(spark, d)
        exact = t.exact.withColumn("end", F.timestamp_micros(I.us("end") + 40 * 86_400_000_000))
        return I.calendar_split(exact, unit).groupBy(unit).agg(F.count("*").alias("pieces"), I.sum_micros().alias("us"))

    return run


for _unit in ("day", "month"):
    query(f"INT06_split_{_unit}", oracle(
        f"SELECT {_unit}, count(*) AS pieces, CAST(sum(epoch_us(e) - epoch_us(s)) AS BIGINT) AS us FROM ({split_sql('longer', _unit)}) GROUP BY {_unit}",
        longer="SELECT provider, s, e + INTERVAL 40 DAY AS e FROM ex"))(_split(_unit))


def _signals(spark, d):
    t = bindings.tables(spark, d)
    from ..operators.report import commit_stats

    return I.human_signals(t.sessions, t.points, t.exact, t.human, commit_stats(t.commits, t.files))


@query("INT07_human_signals", oracle(
    "SELECT epoch_us(ts) AS ts_us, provider, session_id, kind, model, repo, root, cwd FROM sig"))
def int07(spark, d):
    return _signals(spark, d).select(I.us("ts").alias("ts_us"), *KEY, "kind", "model", "repo", "root", "cwd")


@query("INT08_one_per_instant", oracle(
    "SELECT epoch_us(ts) AS ts_us, provider, session_id, kind, model FROM once"))
def int08(spark, d):
    return I.one_per_instant(_signals(spark, d)).select(I.us("ts").alias("ts_us"), *KEY, "kind", "model")


#: An idle time that the tables' dense signals do exceed, so that there are many blocks.
SHORT = 60_000_000
_SHORT = {name: RELATIONS[name].replace(str(IDLE), str(SHORT)) for name in ("blocks", "hiv")}


@query("INT09_work_blocks", oracle(
    "SELECT CAST(block AS BIGINT) AS block, count(*) AS signals, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM blocks GROUP BY block", **_SHORT))
def int09(spark, d):
    return I.work_blocks(_signals(spark, d), SHORT).groupBy("block").agg(
        F.count("*").alias("signals"), I.us(F.min("ts")).alias("first_us"), I.us(F.max("ts")).alias("last_us")
    )


def _human(spark, d, idle=IDLE):
    return I.human_intervals(_signals(spark, d), idle, CREDIT)


@query("INT10_midpoint_attribution", oracle(
    "SELECT session_id, repo, provider, epoch_us(s) AS start_us, epoch_us(e) AS end_us FROM hiv"))
def int10(spark, d):
    return _in_us(_human(spark, d), "session_id", "repo", "provider")


@query("INT11_edge_credit", oracle(
    "SELECT session_id, epoch_us(min(s)) AS start_us, epoch_us(max(e)) AS end_us FROM hiv GROUP BY session_id", **_SHORT))
def int11(spark, d):
    """Where each block begins and ends with its credit."""
    return _in_us(_human(spark, d, SHORT).groupBy("session_id").agg(F.min("start").alias("start"), F.max("end").alias("end")), "session_id")


@query("INT12_block_ids", oracle("SELECT DISTINCT session_id AS work_block FROM hiv", **_SHORT))
def int12(spark, d):
    return _human(spark, d, SHORT).select(F.col("session_id").alias("work_block")).distinct()


@query("INT13_session_extent", oracle(
    f"SELECT provider, session_id, {iso_sql('first_seen')} AS first_seen, {iso_sql('last_seen')} AS last_seen FROM seen"))
def int13(spark, d):
    t = bindings.tables(spark, d)
    return I.extents(t.points, t.exact, t.human).select(*KEY, iso(F.col("first_seen")).alias("first_seen"), iso(F.col("last_seen")).alias("last_seen"))


@query("INT14_file_range", oracle(
    "SELECT provider, session_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM ("
    "SELECT provider, session_id, ts FROM moments UNION ALL SELECT provider, session_id, ts FROM tok) GROUP BY provider, session_id"))
def int14(spark, d):
    t = bindings.tables(spark, d)
    return I.file_range(t.points, t.exact, t.human, t.tokens).select(*KEY, I.us("first_seen").alias("first_us"), I.us("last_seen").alias("last_us"))


@query("INT15_calendar_days", oracle(
    "SELECT repo, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS BIGINT) AS days FROM ev GROUP BY repo"))
def int15(spark, d):
    return bindings.events(spark, d).groupBy("repo").agg(calendar_days(F.min("ts"), F.max("ts")).alias("days"))


@query("MIN_slice_month_provider", oracle(
    f"SELECT month, provider, {sec('sum(epoch_us(e) - epoch_us(s))')} AS active_seconds, {sec('max(union_us)')} AS ai_wall_seconds "
    f"FROM pieces JOIN (SELECT month AS m2, provider AS p2, union_us FROM ({union_sql('pieces', 'month, provider')})) ON month = m2 AND provider = p2 GROUP BY month, provider",
    pieces=split_sql("gap", "month")))
def minimum(spark, d):
    """Fill, gap cap, calendar split, sum and union by month and provider."""
    raw = I.gap_intervals(bindings.tables(spark, d).points, CAP)
    keyed = keyed_intervals(raw, ("month", "provider"))
    keys = ["d_month", "d_provider"]
    wall = I.union_micros(keyed, keys)
    both = keyed.groupBy(*keys).agg(I.sum_micros().alias("us")).join(wall, keys)
    return both.select(
        F.col("d_month").alias("month"), F.col("d_provider").alias("provider"), seconds(F.col("us")).alias("active_seconds"), seconds(F.col("union_us")).alias("ai_wall_seconds")
    )


# Window-style operators.

_W = "PARTITION BY provider, session_id ORDER BY ts, ord"


def _points(spark, d):
    return bindings.tables(spark, d).points


def _order():
    return Window.partitionBy(*KEY).orderBy("ts", "ord")


query("WIN01_fill", oracle("SELECT fm AS model, count(*) AS n FROM filled GROUP BY fm"))(
    lambda spark, d: I.nearest_models(_points(spark, d)).groupBy("model").agg(F.count("*").alias("n")))
query("WIN02_lead_with_cap", oracle(
    "SELECT count(*) AS n, CAST(sum(CASE WHEN epoch_us(e) - epoch_us(s) = 300000000 THEN 1 ELSE 0 END) AS BIGINT) AS capped FROM gap"))(
    lambda spark, d: I.gap_intervals(_points(spark, d), CAP).agg(F.count("*").alias("n"), F.count_if(I.us("end") - I.us("start") == CAP).alias("capped")))
query("WIN03_running_max_islands", oracle(
    "SELECT provider, session_id, sum(CASE WHEN s <= m THEN 0 ELSE 1 END)::BIGINT AS islands FROM ("
    "SELECT *, max(e) OVER (PARTITION BY provider, session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ranges) GROUP BY provider, session_id"))(
    lambda spark, d: _islands(spark, d))


def _islands(spark, d):
    t = bindings.tables(spark, d)
    ranges = I.gap_intervals(t.points, CAP).select(*KEY, "start", "end").union(t.exact.where("end > start").select(*KEY, "start", "end"))
    order = Window.partitionBy(*KEY).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("n", F.coalesce((F.col("start") > reach).cast("long"), F.lit(1))).groupBy(*KEY).agg(F.sum("n").cast("long").alias("islands"))


query("WIN04_sessionise", oracle(
    "SELECT user_id, count(*) AS blocks FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, ord) AS p FROM ev) "
    f"WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > {IDLE} GROUP BY user_id"))(
    lambda spark, d: bindings.events(spark, d).groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("blocks")))
query("WIN05_first_by_priority", oracle(
    "SELECT provider, session_id, event_type, ord FROM ev QUALIFY row_number() OVER (PARTITION BY provider, session_id ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END DESC, ord) = 1"))(
    lambda spark, d: bindings.events(spark, d).groupBy(*KEY).agg(
        F.min_by(F.struct("event_type", "ord"), F.struct(-F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1), "ord")).alias("x")
    ).select(*KEY, "x.event_type", "x.ord"))
query("WIN06_share_of_total", oracle(
    "SELECT repo, model, round_even(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY repo) * 1000, 0) / 1000 + 0.0 AS share FROM (SELECT repo, model, count(*) AS n FROM ev GROUP BY repo, model)"))(
    lambda spark, d: _share(spark, d))


def _share(spark, d):
    from ..functions.times import round3

    n = bindings.events(spark, d).groupBy("repo", "model").agg(F.count("*").alias("n"))
    return n.select("repo", "model", round3(F.col("n") / F.sum("n").over(Window.partitionBy("repo"))).alias("share"))


query("WIN07_change_detection", oracle(
    "SELECT user_id, count(*) AS changes FROM (SELECT user_id, total, last_value(total IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p "
    "FROM (SELECT *, CASE WHEN event_type <> 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) // 25 END AS total FROM ev)) WHERE total IS NOT NULL AND total IS DISTINCT FROM p GROUP BY user_id"))(
    lambda spark, d: _changes(spark, d))


def _changes(spark, d):
    from ..sources.folds import changed_totals

    total = F.when(F.col("event_type") != "view", F.expr("CAST(get_json_object(props, '$.k') AS BIGINT) div 25"))
    rows = bindings.events(spark, d).withColumn("total", total)
    return changed_totals(rows, ["user_id"], ["ts", "ord"], "total").groupBy("user_id").agg(F.count("*").alias("changes"))


query("WIN08_last_write_first_place", oracle(
    "SELECT provider, session_id, event_type, min(ord) AS place, arg_max(value, ord) AS value FROM ev GROUP BY provider, session_id, event_type"))(
    lambda spark, d: _last_write(spark, d))


def _last_write(spark, d):
    from ..sources.folds import last_write_first_place

    rows = bindings.events(spark, d)
    return last_write_first_place(rows, [*KEY, "event_type"], "ord", ["value"]).select(*KEY, "event_type", "place", "value")


query("WIN09_carry_forward", oracle(
    f"SELECT provider, session_id, ord, last_value(CASE WHEN event_type = 'purchase' THEN model END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM ev"))(
    lambda spark, d: _carry(spark, d))


def _carry(spark, d):
    from ..sources.folds import carried

    rows = bindings.events(spark, d).withColumn("m", F.when(F.col("event_type") == "purchase", F.col("model")))
    return carried(rows, KEY, ["ts", "ord"], {"carried": F.col("m")}, chunk=F.date_trunc("day", "ts")).select(*KEY, "ord", "carried")
