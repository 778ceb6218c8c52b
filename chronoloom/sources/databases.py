"""Small read-only SQLite side tables and histories, as DataFrames.

SQLite files are single-machine databases of one user; each is read by one task, and many
are read in parallel. Absent columns read as null.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import json_model
from ..functions.names import UNKNOWN
from ..functions.times import epoch_ms
from .lines import History, history
from .transcripts import METADATA, STORE


def _text(value) -> str | None:
    return value if isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else None if value is None else str(value)


def _rows(path: str, table: str, columns: list[str]) -> pd.DataFrame:
    """All rows as text; nothing if file or table cannot be read, null for absent columns."""
    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            have = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
            if not have:
                return pd.DataFrame(columns=columns, dtype="object")
            picked = ", ".join(f'"{c}"' if c in have else f'NULL AS "{c}"' for c in columns)
            rows = [tuple(map(_text, r)) for r in db.execute(f'SELECT {picked} FROM "{table}"')]
    except sqlite3.Error:
        rows = []
    return pd.DataFrame(rows, columns=columns, dtype="object")


def sqlite_table(spark: SparkSession, paths: str | list[str], table: str, columns: list[str]) -> DataFrame:
    """A table of one or many files; adds ``file``. One task reads one file."""
    files = [paths] if isinstance(paths, str) else list(paths)
    listed = spark.createDataFrame([(p,) for p in files], "file string").repartition(max(1, len(files)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["file"]:
                yield _rows(path, table, columns).assign(file=path)

    schema = ", ".join(f"`{c}` string" for c in columns) + ", file string"
    return listed.mapInPandas(read, schema)


def codex_metadata(spark: SparkSession, path: str) -> DataFrame:
    return sqlite_table(spark, path, "threads", [c.split()[0] for c in METADATA.split(", ")]).drop("file")


def copilot_store(spark: SparkSession, path: str) -> DataFrame:
    return sqlite_table(spark, path, "sessions", [c.split()[0] for c in STORE.split(", ")]).where("id <> ''").drop("file")


def opencode(spark: SparkSession, path: str) -> History:
    """Sessions with their new-style messages, or old-style ones where a session has none of those."""
    read = lambda table, *columns: sqlite_table(spark, path, table, list(columns))
    return opencode_tables(
        read("session", "id", "directory", "parent_id", "version", "model"),
        read("session_message", "session_id", "type", "time_created", "data"),
        read("message", "session_id", "time_created", "data"),
    )


def opencode_tables(sessions: DataFrame, messages: DataFrame, legacy: DataFrame) -> History:
    from ..operators.joins import legacy_unless_new

    known = sessions.where("id <> '' AND directory <> ''").select(
        F.lit("opencode").alias("provider"), F.col("id").alias("session_id"), F.col("directory").alias("cwd"), F.col("parent_id").isNotNull().alias("is_subagent"),
        F.lit(False).alias("approximate_cwd"), F.col("file").alias("source_file"), F.coalesce(json_model(F.col("model")), F.lit(UNKNOWN)).alias("own"),
    )
    number = F.expr("try_cast(time_created AS DOUBLE)")
    new = messages.where("session_id IS NOT NULL AND type IS NOT NULL").withColumn("ms", number).where("ms IS NOT NULL").withColumn("kind", F.col("type"))
    new = new.withColumn("ts", epoch_ms(F.col("ms"))).where("ts IS NOT NULL").join(known.select("session_id"), "session_id", "left_semi")
    old = legacy.withColumn("ms", number).where("session_id IS NOT NULL AND ms IS NOT NULL AND data IS NOT NULL").withColumn(
        "kind", F.coalesce(F.get_json_object("data", "$.role"), F.get_json_object("data", "$.type"))
    )
    old = legacy_unless_new(old.withColumn("ts", epoch_ms(F.col("ms"))).where("ts IS NOT NULL"), new)
    whole = new.select("session_id", "kind", "ts", "data").unionByName(old.select("session_id", "kind", "ts", "data"))
    told = F.when(F.col("data").isNotNull(), json_model(F.col("data")))
    points = whole.join(known.select("provider", "session_id", "own", "is_subagent"), "session_id").withColumn(
        "model", F.coalesce(F.when(told != UNKNOWN, told), F.col("own"))
    ).withColumn("ord", F.unix_micros("ts"))
    used = known.join(points.select("session_id").distinct(), "session_id", "left_semi")
    skipped = (
        sessions.where("id IS NULL OR directory IS NULL").select("file")
        .unionAll(messages.where(F.col("session_id").isNull() | F.col("type").isNull() | number.isNull()).select("file"))
        .unionAll(legacy_unless_new(legacy.where(F.col("session_id").isNotNull() & (number.isNull() | F.col("data").isNull())), new).select("file"))
        .unionAll(legacy.where("session_id IS NULL").select("file"))
    )
    bad = skipped.groupBy(F.col("file").alias("source_file")).agg(F.count("*").alias("malformed_lines"))
    return history(used, points, points.where((F.col("kind") == "user") & ~F.col("is_subagent")), bad.withColumns({"content_rejections": F.lit(0), "unreadable_files": F.lit(0)}))
