"""Streams give what the batch gives, once their input is there."""

import json
from datetime import datetime, timedelta

from chronoloom.operators import intervals as I
from chronoloom.sources import events
from chronoloom.streaming import activity
from pyspark.sql import functions as F


def _log(folder, name, records):
    with open(f"{folder}/{name}.jsonl", "w") as file:
        for r in records:
            file.write((r if isinstance(r, str) else json.dumps(r)) + "\n")


def test_streamed_blocks_and_days(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    base = {"provider": "claude", "session_id": "s", "cwd": "/w", "event": "prompt"}
    times = ["09:00", "09:40", "10:40", "12:00", "23:59"]
    _log(log, "a", [base | {"timestamp": f"2026-01-01T{t}:00Z"} for t in times] + ["broken", base | {"timestamp": "2026-01-01T09:10:00Z", "content": "x"}])
    _log(log, "b", [base | {"timestamp": "2026-01-05T00:00:00Z", "event": "activity"}, base | {"timestamp": "2026-01-05T00:00:01Z"}])
    stream = activity.event_stream(spark, str(log))
    for name, frame, mode in (("blocks", activity.work_blocks(stream), "append"), ("days", activity.daily_activity(stream), "append")):
        activity.start(frame, str(tmp_path / name), str(tmp_path / f"{name}-state"), mode, once=True).awaitTermination(120)
    got = sorted((r["first"], r.signals) for r in spark.read.parquet(str(tmp_path / "blocks")).collect())
    batch = events.read(spark, str(log)).human.withColumn("kind", F.lit("p_prompt")).withColumn("load", F.struct("ord"))
    want = I.work_blocks(batch.select("ts", "kind", "load"), 3_600_000_000).groupBy("block").agg(F.min("ts").alias("a"), F.count("*").alias("n")).collect()
    assert got == sorted((r.a, r.n) for r in want if r.a < datetime(2026, 1, 4))
    day = spark.read.parquet(str(tmp_path / "days")).collect()
    assert [(r.day, r.records, r.prompts) for r in day] == [("2026-01-01", 5, 5)]


def test_token_deltas_keep_state(spark, tmp_path):
    source = tmp_path / "in"
    start = datetime(2026, 1, 1)
    schema = "provider string, session_id string, ts timestamp, total long"
    for part, totals in enumerate(([100, 100, 130], [130, 200])):
        rows = [("p", "s", start + timedelta(minutes=10 * part + i), n) for i, n in enumerate(totals)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    activity.start(activity.token_deltas(stream), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("delta")).first()[0] == 200
