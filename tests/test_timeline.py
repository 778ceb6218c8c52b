"""The streamed timeline equals the batch after every micro-batch, whatever the order of its input."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from chronoloom.streaming import activity, timeline
from pyspark.sql import functions as F

START, IDLE = datetime(2026, 1, 1), 10 * 60 * 10**6
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def us(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


@pytest.fixture
def stores(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


def test_every_batch_equals_the_whole(spark, tmp_path, stores):
    rng = random.Random(8)
    times = [START + timedelta(minutes=rng.randrange(0, 900, 7), seconds=rng.randrange(60)) for _ in range(120)]
    rng.shuffle(times)
    source, seen = tmp_path / "in", []
    changes: list = []
    source.mkdir()
    stream = timeline.timeline(spark.readStream.schema("ts timestamp").json(str(source)), IDLE, "2 days")
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: changes.extend(df.collect())).start()
    try:
        for part in range(4):
            some = times[30 * part : 30 * part + 30]
            seen += some
            with open(source / f"{part}.json", "w") as file:
                file.writelines(json.dumps({"ts": t.isoformat()}) + "\n" for t in some)
            query.processAllAvailable()
            held = timeline.current(spark.createDataFrame(changes, timeline.BLOCK)).collect()
            got = sorted((r.first_us, r.last_us, r.signals) for r in held)
            assert got == timeline.joined([(us(t), us(t), 1) for t in seen], IDLE) and len(got) > 5
    finally:
        query.stop()


def test_timers_close_blocks(spark, tmp_path, stores):
    source = tmp_path / "in"
    source.mkdir()
    minutes = [[0, 5], [30, 33], [300], [600], [900]]  # a watermark moves after its batch
    for part, some in enumerate(minutes):
        with open(source / f"{part}.json", "w") as file:
            file.writelines(json.dumps({"ts": (START + timedelta(minutes=m)).isoformat()}) + "\n" for m in some)
        os.utime(source / f"{part}.json", (1_700_000_000 + 60 * part,) * 2)  # files are taken by their age
    stream = timeline.timeline(spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).json(str(source)), IDLE, "20 minutes")
    changes: list = []
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _: changes.extend(df.collect())).start()
    query.awaitTermination(200)
    held = timeline.current(spark.createDataFrame(changes, timeline.BLOCK)).orderBy("first_us").collect()
    assert [(r.signals, r.closed) for r in held][:3] == [(2, True), (2, True), (1, True)] and len(held) == 5


def test_sliding_windows(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    base = {"provider": "claude", "session_id": "s", "cwd": "/w", "event": "prompt"}
    with open(log / "a.jsonl", "w") as file:
        file.writelines(json.dumps(base | {"timestamp": f"2026-01-01T{t}:00Z"}) + "\n" for t in ("09:05", "09:20", "09:50", "23:00"))
    frame = activity.sliding_activity(activity.event_stream(spark, str(log)), "1 hour", "30 minutes")
    activity.start(frame, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).select(F.date_format("start", "HH:mm").alias("at"), "records", "prompts").collect()
    assert sorted(map(tuple, rows)) == [("08:30", 2, 2), ("09:00", 3, 3), ("09:30", 1, 1)]
