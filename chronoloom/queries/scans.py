"""Line scans: JSON records made from events, with every kind of bad line among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings
from ..sources import events
from .base import oracle, query


def _lines(spark, d):
    """One line for each event: good records, and by the id's remainder empty, broken, mistyped and content-bearing ones."""
    k = F.col("ord") % 20
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    done = F.date_format(F.timestamp_micros(F.unix_micros("ts") + F.floor("value").cast("long") * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    record = F.struct(
        ts.alias("timestamp"), F.when(F.col("provider") == "claude", "Claude_Code").otherwise(F.col("provider")).alias("provider"), F.concat(F.lit("u"), "user_id").alias("session_id"), "cwd",
        F.col("model").alias("model"), F.when(F.col("event_type") == "click", "prompt").alias("event"), F.when(F.col("is_subagent"), "subagent").alias("role"),
        F.when(F.col("event_type") == "purchase", ts).alias("started_at"), F.when(F.col("event_type") == "purchase", done).alias("completed_at"),
        F.when(k == 3, "secret words").alias("content"),
    )
    # Made once, by a generator of one row, for several kinds of lines are made of it.
    rows = bindings.events(spark, d).select("user_id", "ord", F.explode(F.array(F.to_json(record))).alias("good"))
    good = F.col("good")
    value = (
        F.when(k == 0, "").when(k == 1, F.lit("{broken")).when(k == 2, F.regexp_replace(good, '"session_id":"[^"]*"', '"session_id":5'))
        .when(k == 4, F.regexp_replace(good, '^\\{', '{"api_key":null,')).when(k == 5, F.regexp_replace(good, '"cwd":"[^"]*"', '"cwd":"  "')).otherwise(good)
    )
    return bindings.spread(rows.select(F.concat(F.lit("file"), F.col("user_id") % 4).alias("file"), "ord", value.alias("value")))


query("SRC09_bounded_lines", oracle("SELECT 'file' || (user_id % 4) AS source_file, count(*) FILTER (WHERE ord % 20 IN (0, 1, 2)) AS malformed_lines, count(*) FILTER (WHERE ord % 20 IN (3, 4)) AS content_rejections FROM ev GROUP BY 1"))(
    lambda spark, d: events.from_lines(_lines(spark, d)).diagnostics.select("source_file", "malformed_lines", "content_rejections"))
query("FLT09_privacy", oracle("SELECT ord FROM ev WHERE ord % 20 IN (3, 4)"))(lambda spark, d: events.scanned(_lines(spark, d)).where("ok AND sensitive").select("ord"))
_GOOD = {"good": "SELECT *, 'u' || user_id || ':' || cwd || CASE WHEN is_subagent THEN ':subagent' ELSE '' END AS sid FROM ev WHERE ord % 20 > 5"}
query("SRC19_open_event_sessions", oracle("SELECT provider, sid AS session_id, cwd, is_subagent, count(*) AS points, count(*) FILTER (WHERE event_type = 'click' AND NOT is_subagent) AS prompts, count(*) FILTER (WHERE event_type = 'purchase' AND floor(value) > 0) AS intervals FROM good GROUP BY ALL", **_GOOD))(
    lambda spark, d: _sessions(spark, d))


def _sessions(spark, d):
    h = events.from_lines(_lines(spark, d))
    n = lambda df, name: df.groupBy("provider", "session_id").agg(F.count("*").alias(name))
    out = h.sessions
    for df, name in ((h.points, "points"), (h.human, "prompts"), (h.exact, "intervals")):
        out = out.join(n(df, name), ["provider", "session_id"], "left")
    return out.fillna(0, ["prompts", "intervals"]).select("provider", "session_id", "cwd", "is_subagent", "points", "prompts", "intervals")
