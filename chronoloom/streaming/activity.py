"""Structured Streaming over open event logs: the log is append-only, so each line is read once.

``late`` is how long a record may be behind the newest one before it is left out; every
windowed frame here drops its state by that watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.events import scanned, valid

LATE = "1 hour"


def event_stream(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Valid records as they are appended; bad lines are left out as in a batch."""
    lines = spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    named = lines.select(F.lit("stream").alias("file"), F.lit(0).cast("long").alias("ord"), "value")
    return valid(scanned(named)).drop("file", "ord", "sid")


def daily_activity(events: DataFrame, late: str = LATE) -> DataFrame:
    """Records and prompts of each day, provider and directory: a tumbling window."""
    day = F.window("ts", "1 day")
    counted = events.withWatermark("ts", late).groupBy(day.alias("day"), "provider", "cwd")
    prompts = F.count_if(F.col("prompt") & ~F.col("is_subagent"))
    return counted.agg(F.count("*").alias("records"), prompts.alias("prompts")).select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "provider", "cwd", "records", "prompts")


def work_blocks(events: DataFrame, idle: str = "1 hour", late: str = LATE, by: tuple[str, ...] = ("provider",)) -> DataFrame:
    """Blocks of prompts of each ``by``: a session window that closes after ``idle`` without one, as in the batch.

    Streaming session windows need a key; ``timeline`` makes blocks over all of them.
    """
    prompts = events.where(F.col("prompt") & ~F.col("is_subagent")).withWatermark("ts", late)
    return prompts.groupBy(*by, F.session_window("ts", idle).alias("block")).agg(F.count("*").alias("signals"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("block")


def sliding_activity(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Records and prompts of each provider in overlapping windows."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "provider")
    prompts = F.count_if(F.col("prompt") & ~F.col("is_subagent"))
    return counted.agg(F.count("*").alias("records"), prompts.alias("prompts")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "provider", "records", "prompts")


_TOTALS = "provider string, session_id string, ts timestamp, total long, delta long"


def token_deltas(totals: DataFrame) -> DataFrame:
    """Changes of cumulative totals (provider, session_id, ts, total), with the last total as state.

    Within a batch rows are put in time order; a total that did not move gives nothing.
    State is one number for each session and goes after a day without records.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, total in zip(rows["ts"], rows["total"]):
            if total != last:
                out.append((*key, ts, total, total - last))
                last = total
        state.update((int(last),))
        state.setTimeoutDuration(24 * 3600 * 1000)
        yield pd.DataFrame(out, columns=["provider", "session_id", "ts", "total", "delta"])

    return totals.groupBy("provider", "session_id").applyInPandasWithState(step, _TOTALS, "last long", "append", "ProcessingTimeTimeout")


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = False):
    """Write a stream as Parquet with its checkpoint; ``once`` reads what is there and stops."""
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
