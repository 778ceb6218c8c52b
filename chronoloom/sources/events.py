"""Open event logs: one JSON record a line, privacy-checked, grouped to sessions by plain DataFrame code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import holds_content
from ..functions.names import UNKNOWN, safe_model, safe_provider
from ..functions.times import rfc3339
from ..session import kept
from .lines import LINE_CAP, History, diagnostics, history, literal_paths, parsed, read_lines

SCHEMA = "timestamp string, provider string, session_id string, cwd string, model string, event string, role string, started_at string, completed_at string"
KINDS = {f"$.{k}": "required string" for k in ("timestamp", "provider", "session_id", "cwd")} | {
    f"$.{k}": "string" for k in ("model", "event", "role", "started_at", "completed_at")
}


def with_defaults(r: str = "r") -> dict[str, Column]:
    """The record's optional fields with their defaults."""
    at = lambda name, default: F.coalesce(F.col(f"{r}.{name}"), F.lit(default))
    return {"model": at("model", UNKNOWN), "event": at("event", "activity"), "role": at("role", "foreground")}


def scanned(lines: DataFrame, cap: int = LINE_CAP) -> DataFrame:
    """(file, ord, ok, r, sensitive): every line with what is wrong about it."""
    return parsed(lines, SCHEMA, KINDS, cap, sensitive=holds_content(F.col("value")))


def valid(scanned_: DataFrame) -> DataFrame:
    """Usable records: parsed, without content, with a time, a provider, a session and a directory."""
    more = with_defaults()
    sub = F.lower(more["role"]) == "subagent"
    rows = scanned_.where(F.col("ok") & ~F.col("sensitive")).select(
        "file",
        "ord",
        rfc3339(F.col("r.timestamp")).alias("ts"),
        safe_provider(F.col("r.provider")).alias("provider"),
        F.col("r.session_id").alias("sid"),
        F.col("r.cwd").alias("cwd"),
        safe_model(more["model"]).alias("model"),
        (F.lower(more["event"]) == "prompt").alias("prompt"),
        sub.alias("is_subagent"),
        rfc3339(F.col("r.started_at")).alias("start"),
        rfc3339(F.col("r.completed_at")).alias("end"),
    )
    usable = F.col("ts").isNotNull() & (F.col("provider") != UNKNOWN) & (F.trim("sid") != "") & (F.trim("cwd") != "")
    # The directory and role are part of the id whatever a file holds, so split logs agree.
    sid = F.concat("sid", F.lit(":"), "cwd", F.when(F.col("is_subagent"), ":subagent").otherwise(""))
    return rows.where(usable).withColumn("session_id", sid)


def from_lines(lines: DataFrame, cap: int = LINE_CAP) -> History:
    """The relations of event lines; usable records are parsed once and kept, they are few columns of each line."""
    seen = scanned(lines, cap)
    good = kept(valid(seen))
    sessions = good.groupBy("provider", "session_id", "cwd", "is_subagent").agg(F.min("file").alias("source_file")).withColumn("approximate_cwd", F.lit(False))
    owners = good.select("provider", "session_id", F.col("file").alias("source_file")).distinct()
    return history(
        sessions, good, good.where(F.col("prompt") & ~F.col("is_subagent")), diagnostics(seen, F.col("sensitive")), good.where(F.col("end") > F.col("start")), owners=owners
    )


def read(spark: SparkSession, path: str | list[str], cap: int = LINE_CAP, files: list[str] | None = None) -> History:
    """A file is taken as it is, a directory's ``*.jsonl`` files are read; of them only ``files``, if given."""
    if files is not None:
        return from_lines(read_lines(spark, literal_paths(files), None), cap)
    is_file = isinstance(path, str) and path.endswith((".jsonl", ".json", ".log", ".txt"))
    return from_lines(read_lines(spark, path, None if is_file else "*.jsonl"), cap)
