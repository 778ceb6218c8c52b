"""A materialised parse cache: Parquet by source and run, with file stamps, owners and time ranges.

A parsed file is valid as long as its size, modification time, parser version and context
match. ``materialised`` parses only what is not: files that changed, came or went, and the
files that share a session with one of those, for a session is folded from all its files.
That closure is taken over the kept owners before parsing and over the found ones after it.

A run appends relations, owners and, last, the entries of its files; the newest entry of a
file wins and rows count only where their run is that of their session's files. A lost or
repeated run so never leaves a half-written file in use. Files are stamped before they are
read: one that changes meanwhile has a newer stamp at the next run and is read again.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import kept
from .lines import DIAGNOSTIC, EXACT, KEY, POINT, SESSION, TOKEN, History, literal_paths, local_path, parent

PARSER_VERSION = 2
#: Changed files up to which files are named one by one; beyond, a source is read whole.
MOST_NAMED = 5000
#: Runs after which the rows in use are written anew and older ones deleted.
MOST_RUNS = 16
#: The size of a file that is no more.
GONE = -1
OWNERS = "provider string, session_id string, source_file string"
FILES = "source_file string, size long, modified long, first_seen timestamp, last_seen timestamp, parser int, context string"
RELATIONS = {"sessions": SESSION, "points": POINT, "human": POINT, "exact": EXACT, "tokens": TOKEN, "diagnostics": DIAGNOSTIC, "owners": OWNERS}


def stamps(spark: SparkSession, root: str | list[str], glob: str = "*") -> DataFrame:
    """(source_file, size, modified) of files below a root, by listing only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(local_path(F.col("path")).alias("source_file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def _path(spark: SparkSession, path: str) -> tuple:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = _path(spark, path)
    return system.exists(hadoop)


def _plain(file: Column) -> Column:
    return F.when(file.rlike("^[a-z]+:/"), local_path(file)).otherwise(file)


def owners_of(history: History) -> DataFrame:
    """(provider, session_id, source_file): every file that a session was folded from."""
    rows = history.owners if history.owners is not None else history.sessions
    return rows.select(*KEY, _plain(F.col("source_file")).alias("source_file")).distinct()


def _kept(spark: SparkSession, cache: str, name: str, store: str) -> DataFrame:
    schema = FILES if name == "files" else RELATIONS[name]
    return spark.read.schema(f"{schema}, store string, run string").parquet(f"{cache}/{name}").where(F.col("store") == store).drop("store")


def known_files(spark: SparkSession, cache: str, store: str) -> DataFrame | None:
    """The newest entry of each file, or nothing before the first write."""
    if not _exists(spark, f"{cache}/files"):
        return None
    newest = Window.partitionBy("source_file").orderBy(F.col("run").desc())
    return _kept(spark, cache, "files", store).withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def _valid(now: DataFrame, known: DataFrame, context: str) -> DataFrame:
    """Entries that hold. ``now`` may bring a context of each file; else ``context`` is that of all."""
    own = F.col("now_context") if "context" in now.columns else F.lit(context)
    told = now.withColumnRenamed("context", "now_context")
    return known.join(told, ["source_file", "size", "modified"]).where((F.col("parser") == PARSER_VERSION) & (F.col("context") == own)).select(known.columns)


def misses(now: DataFrame, known: DataFrame | None, context: str = "") -> DataFrame:
    """Files without a valid entry."""
    return now if known is None else now.join(_valid(now, known, context).select("source_file"), "source_file", "left_anti")


def put(history: History, parsed: DataFrame, cache: str, store: str, run: str, context: str = "") -> None:
    """Append a run's relations, then its file entries; unreadable files get no entry."""
    owners = owners_of(history)
    times = (
        history.points.select(*KEY, "ts")
        .union(history.human.select(*KEY, "ts"))
        .union(history.tokens.select(*KEY, "ts"))
        .union(history.exact.select(*KEY, "start"))
        .union(history.exact.select(*KEY, "end"))
    )
    told = times.groupBy(*KEY).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    seen = owners.join(told, KEY).groupBy("source_file").agg(F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))
    for name in RELATIONS:
        rows = owners if name == "owners" else getattr(history, name)
        _appended(rows, cache, name, store, run)
    lost = history.diagnostics.where("unreadable_files > 0").select(_plain(F.col("source_file")).alias("source_file"))
    own = F.col("context") if "context" in parsed.columns else F.lit(context)
    entries = parsed.join(lost, "source_file", "left_anti").join(seen, "source_file", "left").select(
        "source_file", "size", "modified", "first_seen", "last_seen", F.lit(PARSER_VERSION).alias("parser"), own.alias("context")
    )
    _appended(entries, cache, "files", store, run)


def _appended(rows: DataFrame, cache: str, name: str, store: str, run: str) -> None:
    rows.withColumns({"store": F.lit(store), "run": F.lit(run)}).write.mode("append").partitionBy("store", "run").parquet(f"{cache}/{name}")


def lookup(spark: SparkSession, cache: str, store: str, now: DataFrame, since: Column | None = None, until: Column | None = None, context: str = "") -> dict[str, DataFrame]:
    """Relations of validly cached files; with a window, rows only of sessions with a file that overlaps it.

    Sessions always come back whole: their roles matter to other files' sessions.
    """
    known = known_files(spark, cache, store)
    if known is None:
        return {}
    valid = _valid(now, known, context)
    near = valid
    if since is not None:
        near = near.where(F.col("last_seen") >= since)
    if until is not None:
        near = near.where(F.col("first_seen") < until)
    owners = _kept(spark, cache, "owners", store)
    of = lambda files: owners.join(files.select("source_file", "run"), ["source_file", "run"], "left_semi").select(*KEY, "run").distinct()
    whole, part = of(valid), of(near)
    out = {}
    for name in RELATIONS:
        rows = _kept(spark, cache, name, store)
        if name == "diagnostics":
            rows = rows.withColumn("__f", _plain(F.col("source_file"))).join(valid.select(F.col("source_file").alias("__f"), "run"), ["__f", "run"], "left_semi").drop("__f")
        else:
            rows = rows.join(whole if name in ("sessions", "owners") else part, [*KEY, "run"], "left_semi")
        out[name] = rows.drop("run")
    return out


@dataclass
class Counts:
    """What a cached read did: files taken as kept, files without a valid entry, files parsed."""

    hits: int = 0
    misses: int = 0
    parsed: int = 0


def _together(owners: DataFrame, files: Iterable[str]) -> set[str]:
    """The files and all that share sessions with them, directly or through others."""
    spark, found, size = owners.sparkSession, set(files), -1
    while found and len(found) != size and len(found) <= MOST_NAMED:
        size = len(found)
        here = spark.createDataFrame([(f,) for f in sorted(found)], "source_file string")
        met = owners.join(here, "source_file", "left_semi").select(*KEY).distinct()
        found |= {r[0] for r in owners.join(met, KEY, "left_semi").select("source_file").distinct().limit(MOST_NAMED + 1).collect()}
    return found


def materialised(
    spark: SparkSession, cache: str, store: str, root: str, read: Callable[[list[str] | None], History],
    context: str = "", now: DataFrame | None = None, unlisted: Column | None = None, counts: Counts | None = None,
) -> History:
    """The relations of a source's root, parsed only as far as files changed.

    ``read`` takes the files to parse, or nothing for all of the root. ``now`` are the stamps
    of the files that the source reads, with a ``context`` column where each file has its own
    (a file beside it that decides its directory, say). ``unlisted`` says of a path that it was
    not looked for, so its absence means nothing.
    """
    at = f"{cache.rstrip('/')}/whole/{store}/{hashlib.sha256(repr((PARSER_VERSION, root, context)).encode()).hexdigest()[:32]}"
    now = kept(now if now is not None else stamps(spark, root))
    return _refreshed(spark, at, store, now, read, context, unlisted, counts if counts is not None else Counts())


def _refreshed(
    spark: SparkSession, at: str, store: str, now: DataFrame, read: Callable, context: str, unlisted: Column | None, counts: Counts
) -> History:
    files, known = now.count(), known_files(spark, at, store)
    if known is None:
        counts.misses, counts.parsed = counts.misses + files, counts.parsed + files
        return _stored(spark, at, store, read(None), now, now, context)
    changed = misses(now, known, context).select("source_file")
    gone = known.where(F.col("size") != GONE).join(now, "source_file", "left_anti").select("source_file")
    gone = gone if unlisted is None else gone.where(~unlisted)
    some = lambda df: {r[0] for r in df.limit(MOST_NAMED + 1).collect()}
    new, left = some(changed), some(gone)
    missed = len(new) if len(new) <= MOST_NAMED else changed.count()
    counts.misses, counts.hits = counts.misses + missed, counts.hits + files - missed
    owners = _kept(spark, at, "owners", store).join(known.select("source_file", "run"), ["source_file", "run"], "left_semi")
    asked = _together(owners, new | left)
    while names := sorted(asked - left):
        whole = len(asked) > MOST_NAMED
        # Stamped before they are read; files that were not listed are among them if they share a session.
        here = now if whole else _named_stamps(spark, now, names)
        found = read(None if whole else names)
        if not whole:
            # Sessions that the new parse found may have other files that are still as kept.
            more = _together(owners.select(*KEY, "source_file").union(owners_of(found)), names) - left
            if more - set(names):
                asked = more
                continue
        counts.parsed += files if whole else len(names)
        return _stored(spark, at, store, found, here, now, context, gone)
    return _current(spark, at, store, now, context)


def _named_stamps(spark: SparkSession, now: DataFrame, names: list[str]) -> DataFrame:
    listed = now.join(spark.createDataFrame([(f,) for f in names], "source_file string"), "source_file", "left_semi")
    other = sorted(set(names) - {r[0] for r in listed.select("source_file").collect()})
    if not other:
        return listed
    more = kept(stamps(spark, literal_paths(other)))
    return listed.unionByName(more, allowMissingColumns=True).select(*[F.coalesce(c, F.lit("")).alias(c) if c == "context" else c for c in now.columns])


def _stored(
    spark: SparkSession, at: str, store: str, found: History, parsed: DataFrame, now: DataFrame, context: str, gone: DataFrame | None = None
) -> History:
    run = _run_name()
    left = kept(gone) if gone is not None else None
    put(found, parsed, at, store, run, context)
    if left is not None:  # their sessions are folded without them now
        _appended(left.select("source_file", F.lit(GONE).cast("long").alias("size"), F.lit(PARSER_VERSION).alias("parser")), at, "files", store, run)
    if known_files(spark, at, store).select("run").distinct().count() > MOST_RUNS:
        _compacted(spark, at, store, now, context)
    return _current(spark, at, store, now, context)


def _run_name() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _current(spark: SparkSession, at: str, store: str, now: DataFrame, context: str) -> History:
    return History(**lookup(spark, at, store, now, context=context))


def _compacted(spark: SparkSession, at: str, store: str, now: DataFrame, context: str) -> None:
    """The rows in use as one run; older runs are deleted once it is complete."""
    old = {r[0] for r in _kept(spark, at, "files", store).select("run").distinct().collect()}
    run = _run_name()
    rows = lookup(spark, at, store, now, context=context)
    for name, df in rows.items():
        _appended(df, at, name, store, run)
    known = known_files(spark, at, store)
    _appended(_valid(now, known, context).select(*[f.split()[0] for f in FILES.split(", ")]), at, "files", store, run)
    for name in ("files", *RELATIONS):
        for r in old:
            system, path = _path(spark, f"{at}/{name}/store={store}/run={r}")
            system.delete(path, True)


# The files that each source reads, by the path.
READ = {
    "claude": r"\.jsonl$", "pi": r"(?i)\.jsonl$", "codex": r"/rollout-[^/]*\.jsonl$", "gemini": r"(?i:(^|/)chats/.*)\.jsonl?$",
    "copilot": r"(?i)/events\.jsonl$", "copilot-vscode": r"/chatSessions/[^/]+\.json$", "events": r"",
}


def source_stamps(spark: SparkSession, store: str, root: str, places: list[str] | None = None) -> DataFrame:
    """Stamps of the files that a source reads below its root (or ``places`` there), with what beside each decides its directory."""
    listed = stamps(spark, root if places is None else places)
    rows = listed.where(F.col("source_file").rlike(READ[store]))
    beside = F.lit("").alias("context")
    if store == "events":
        return rows.where(F.col("source_file").endswith(".jsonl") | (F.col("source_file") == root.rstrip("/"))).select("*", beside)
    if store == "copilot-vscode":
        marks = listed.where(F.col("source_file").endswith("/workspace.json")).select(
            parent(F.col("source_file")).alias("__at"), F.concat_ws(":", "size", "modified").alias("context")
        )
        return _beside(rows, marks, 2)
    if store == "gemini":
        from .transcripts import project_markers

        folders = rows.select(parent(F.col("source_file")).alias("directory")).distinct()
        return _beside(rows, project_markers(folders).select(F.col("directory").alias("__at"), F.col("marked").alias("context")), 1)
    return rows.select("*", beside)


def _beside(rows: DataFrame, marks: DataFrame, up: int) -> DataFrame:
    met = rows.withColumn("__at", parent(F.col("source_file"), up)).join(marks, "__at", "left").drop("__at")
    return met.withColumn("context", F.coalesce("context", F.lit("")))
