"""Assistant transcripts kept as line records: state is carried over line order by windows."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json import human_content, is_object
from ..functions.names import UNKNOWN, safe_model
from ..functions.paths import dashed_path, wrapped_dashed_path
from ..functions.times import epoch_ms, plus_micros, rfc3339
from ..operators.intervals import model_at, nearest_models
from .documents import SMALL, large, scanned
from .folds import carried, changed_totals, last_write_first_place
from .lines import (
    KEY,
    LINE_CAP,
    History,
    diagnostics,
    history,
    last_name,
    literal_paths,
    local_path,
    minus_cached,
    nonzero,
    parent,
    parsed,
    read_lines,
    relative_to,
    stem,
    usage,
)

MAX_EXACT_MS = 7 * 24 * 3600 * 1000
# Beginnings of user messages that a harness writes.
INJECTED = ("[SYSTEM]", "<background-task-notification", "<subagent-notification", "<system-reminder", "<web-search-results")
FILE = ["file"]
ORDER = ["ord"]


def _first(rows: DataFrame, **columns: Column) -> DataFrame:
    """Each file's first non-null values."""
    return rows.groupBy("file").agg(*[F.min_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col("ord"))).alias(k) for k, c in columns.items()])


def _last(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.groupBy("file").agg(*[F.max_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col("ord"))).alias(k) for k, c in columns.items()])


def _named(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows with their session's key; ``file`` (and ``cwd_key`` where sessions are split) joins them."""
    on = [c for c in ("file", "cwd_key") if c in rows.columns and c in sessions.columns]
    keyed = sessions.select(*on, *KEY).distinct()
    condition = None
    for c in on:
        this = rows[c].eqNullSafe(keyed[c])
        condition = this if condition is None else condition & this
    return rows.join(keyed, condition).drop(*[keyed[c] for c in on])


def _one_session(rows: DataFrame, heads: DataFrame, provider: str, root: str, decoded) -> DataFrame:
    """One session for each file with activity; its id carries the file's path below the root."""
    path = local_path(F.col("file"))
    cwd = F.coalesce(F.col("cwd"), decoded(path))
    sid = F.concat(F.coalesce(F.col("sid"), stem(path)), F.lit(":"), relative_to(path, root))
    return rows.select("file").distinct().join(heads, "file").select(
        "file", F.lit(provider).alias("provider"), sid.alias("session_id"), cwd.alias("cwd"), F.col("is_subagent"), F.col("cwd").isNull().alias("approximate_cwd"), path.alias("source_file")
    )


# Transcripts with message usage, one session a file.

_CLAUDE = (
    "type string, timestamp string, cwd string, sessionId string, requestId string, version string, isMeta boolean, isSidechain boolean, "
    "isCompactSummary boolean, isVisibleInTranscriptOnly boolean, message struct<id: string, model: string, usage: struct<input_tokens: long, "
    "output_tokens: long, cache_creation_input_tokens: long, cache_read_input_tokens: long>>"
)
_CLAUDE_KINDS = {f"$.{k}": "string" for k in ("type", "timestamp", "cwd", "sessionId", "requestId", "version")} | {f"$.{k}": "boolean" for k in ("isMeta", "isSidechain", "isCompactSummary", "isVisibleInTranscriptOnly")}


def _lines_of(spark: SparkSession, root: str, glob: str, files: list[str] | None) -> DataFrame:
    """Lines below the root, or of the files given."""
    return read_lines(spark, root, glob) if files is None else read_lines(spark, literal_paths(files), None)


def claude(spark: SparkSession, root: str, cap: int = LINE_CAP, files: list[str] | None = None) -> History:
    return claude_lines(_lines_of(spark, root, "*.jsonl", files), root, cap)


def claude_lines(lines: DataFrame, root: str, cap: int = LINE_CAP) -> History:
    """User and assistant records; a response's repeated usage counts once, at its last record."""
    value = F.col("value")
    from .lines import kind_at

    tool = F.coalesce(kind_at(value, "$.sourceToolUseID"), F.lit("VOID")) != "VOID"
    seen = parsed(lines, _CLAUDE, _CLAUDE_KINDS, cap, human=human_content(value, "$.message.content"), tool=tool)
    turns = seen.where(F.col("ok") & F.col("r.type").isin("user", "assistant"))
    named = F.when((F.col("r.type") == "assistant") & F.col("r.message.model").isNotNull(), safe_model(F.col("r.message.model")))
    state = carried(turns, FILE, ORDER, {"model": named}).withColumn("model", F.coalesce("model", F.lit(UNKNOWN))).withColumn("ts", rfc3339(F.col("r.timestamp")))
    points = state.where("ts IS NOT NULL")
    path = local_path(F.col("file"))
    heads = _first(turns, cwd=F.col("r.cwd"), sid=F.col("r.sessionId")).withColumn("is_subagent", F.array_contains(F.split(path, "/"), "subagents"))
    sessions = _one_session(points, heads, "claude", root, lambda p: dashed_path(last_name(parent(p))))
    u = "r.message.usage"
    used = points.where((F.col("r.type") == "assistant") & F.col(u).isNotNull()).select(
        "file", "ord", "ts", "model", F.col("r.message.id").alias("mid"), F.col("r.requestId").alias("rid"),
        *[c.alias(k) for k, c in usage(F.col(f"{u}.input_tokens"), F.col(f"{u}.output_tokens"), F.col(f"{u}.cache_read_input_tokens"), F.col(f"{u}.cache_creation_input_tokens")).items()],
    )
    used = nonzero(used)
    with_id = used.where("mid IS NOT NULL OR rid IS NOT NULL").withColumn("mid", F.coalesce("mid", F.lit(""))).withColumn("rid", F.coalesce("rid", F.lit("")))
    counters = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]
    once = last_write_first_place(with_id, ["file", "mid", "rid"], "ord", ["ts", "model", *counters]).withColumnRenamed("place", "ord")
    tokens = once.select("file", "ord", "ts", "model", *counters).unionByName(used.where("mid IS NULL AND rid IS NULL").select("file", "ord", "ts", "model", *counters))
    off = F.lit(False)
    for flag in ("isMeta", "isSidechain", "isCompactSummary", "isVisibleInTranscriptOnly"):
        off = off | F.coalesce(F.col(f"r.{flag}"), F.lit(False))
    human = points.where((F.col("r.type") == "user") & F.col("human") & ~off & ~F.col("tool"))
    at = lambda df: _named(df.select("file", "ord", "ts", "model"), sessions)
    named_points = at(points)
    return history(sessions, named_points, model_at(at(human), named_points), diagnostics(seen), tokens=_named(tokens, sessions))


# Transcripts with a header, injected prompts and forks.

_PI_USAGE = "struct<input: long, output: long, cacheRead: long, cacheWrite: long>"
_PI = (
    f"type string, timestamp string, cwd string, id string, version int, parentSession string, modelId string, usage {_PI_USAGE}, "
    f"message struct<role: string, model: string, timestamp: double, usage: {_PI_USAGE}>"
)
_PI_KINDS = {f"$.{k}": "string" for k in ("type", "timestamp", "cwd", "id", "parentSession", "modelId")} | {"$.version": "number"}


def _message_start(value: Column) -> Column:
    """The first 64 characters of a message, text or first text item; no more of it is kept."""
    content = F.get_json_object(value, "$.message.content")
    first = F.filter(F.from_json(content, "array<struct<type: string, text: string>>"), lambda c: c["type"] == "text")[0]["text"]
    return F.substring(F.coalesce(first, content), 1, 64)


def pi(spark: SparkSession, root: str, cap: int = LINE_CAP, files: list[str] | None = None) -> History:
    return pi_lines(_lines_of(spark, root, "*.[jJ][sS][oO][nN][lL]", files), root, cap)


def pi_lines(lines: DataFrame, root: str, cap: int = LINE_CAP) -> History:
    """Messages, typed commands and summaries; entries a fork inherited are left to their own session."""
    value = F.col("value")
    start = F.ltrim(_message_start(value))
    injected = F.lit(False)
    for mark in INJECTED:
        injected = injected | F.coalesce(start.startswith(mark), F.lit(False))
    seen = parsed(lines, _PI, _PI_KINDS, cap, human=human_content(value, "$.message.content") & ~injected)
    rows = seen.where("ok")
    blank = lambda c: F.when(c != "", c)
    head = F.struct(F.col("r.id").alias("sid"), blank(F.col("r.cwd")).alias("cwd"), blank(F.col("r.parentSession")).alias("parent"), rfc3339(F.col("r.timestamp")).alias("started"))
    heads = rows.where("r.type = 'session'").groupBy("file").agg(F.min_by(head, "ord").alias("h")).select("file", "h.*")
    kind, role = F.col("r.type"), F.col("r.message.role")
    said = F.coalesce((kind == "message") & role.isin("user", "assistant", "bashExecution"), F.lit(False))
    model = F.when((kind == "model_change") & F.col("r.modelId").isNotNull(), safe_model(F.col("r.modelId"))).when(
        said & (role == "assistant") & F.col("r.message.model").isNotNull(), safe_model(F.col("r.message.model"))
    )
    entry, own = rfc3339(F.col("r.timestamp")), epoch_ms(F.col("r.message.timestamp"))
    state = (
        carried(rows, FILE, ORDER, {"model": model})
        .withColumn("model", F.coalesce("model", F.lit(UNKNOWN)))
        .withColumn("ts", F.when(said, F.coalesce(own, entry)).when(kind.isin("compaction", "branch_summary"), entry))
        .withColumn("written", F.when(said, F.coalesce(entry, own)).otherwise(entry))
    )
    # A header rules only what stands after it.
    known = carried(
        state.withColumn("__h", F.when(kind == "session", head)), FILE, ORDER, {"own": F.col("__h")}
    ).join(heads.select("file", F.col("parent").alias("fork"), "started"), "file", "left")
    inherited = F.coalesce(F.col("fork").isNotNull() & F.col("own").isNotNull() & (F.col("written") < F.col("started")), F.lit(False))
    points = known.where(F.col("ts").isNotNull() & ~inherited)
    all_heads = points.select("file").distinct().join(heads, "file", "left").withColumn("is_subagent", F.col("parent").isNotNull())
    sessions = _one_session(points, all_heads, "pi", root, lambda p: wrapped_dashed_path(last_name(parent(p))))
    u = lambda k: F.when(kind == "message", F.when(role == "assistant", F.col(f"r.message.usage.{k}"))).otherwise(F.col(f"r.usage.{k}"))
    tokens = nonzero(points.select("file", "ord", "ts", "model", *[c.alias(k) for k, c in usage(u("input"), u("output"), u("cacheRead"), u("cacheWrite")).items()]))
    human = points.where(F.col("fork").isNull() & said & (((role == "user") & F.col("human")) | (role == "bashExecution")))
    at = lambda df: _named(df.select("file", "ord", "ts", "model"), sessions)
    named_points = at(points)
    return history(sessions, named_points, model_at(at(human), named_points), diagnostics(seen), tokens=_named(tokens, sessions))


# Rollouts split by directory, with cumulative token totals and an optional metadata table.

_SPAN = "struct<started_at_ms: double, completed_at_ms: double>"
_CODEX_USAGE = "struct<input_tokens: long, cached_input_tokens: long, cache_write_input_tokens: long, output_tokens: long>"
_CODEX = (
    "type string, timestamp string, payload struct<id: string, session_id: string, parent_thread_id: string, cwd: string, model: string, type: string, "
    f"role: string, started_at_ms: double, completed_at_ms: double, item: {_SPAN}, result: {_SPAN}, task: {_SPAN}, "
    f"info: struct<total_token_usage: {_CODEX_USAGE}, last_token_usage: {_CODEX_USAGE}>>"
)
_CODEX_KINDS = {"$.type": "string", "$.timestamp": "string"} | {f"$.payload.{k}": "string" for k in ("id", "session_id", "parent_thread_id", "cwd", "model", "type", "role")}
METADATA = "id string, rollout_path string, cwd string, model string"


def codex(
    spark: SparkSession, root: str, metadata: DataFrame | None = None, until: str | None = None, cap: int = LINE_CAP, files: list[str] | None = None
) -> History:
    """``until`` (a date) prunes date directories from it on before they are listed."""
    from .discover import dated_places

    if files is None and until:
        places = dated_places(spark, root, until).places
        lines = read_lines(spark, literal_paths(places), "rollout-*.jsonl") if places else read_lines(spark, root, "rollout-*.jsonl").limit(0)
    else:
        lines = _lines_of(spark, root, "rollout-*.jsonl", files)
    return codex_lines(lines, metadata, cap)


def _codex_interval() -> Column:
    """The first valid span of payload, item, result and task."""
    tries = []
    for at in ("", ".item", ".result", ".task"):
        a, b = (epoch_ms(F.col(f"r.payload{at}.{k}_at_ms")) for k in ("started", "completed"))
        tries.append(F.when(b > a, F.struct(a.alias("start"), b.alias("end"))))
    return F.coalesce(*tries)


def codex_lines(lines: DataFrame, metadata: DataFrame | None = None, cap: int = LINE_CAP) -> History:
    spark = lines.sparkSession
    seen = parsed(lines, _CODEX, _CODEX_KINDS, cap, source=is_object(F.col("value"), "$.payload.source"))
    kind, p = F.col("r.type"), "r.payload"
    meta, context = kind == "session_meta", kind.isin("session_meta", "turn_context")
    sub = meta & (F.col(f"{p}.parent_thread_id").isNotNull() | F.col("source"))
    state = carried(
        seen.where("ok"), FILE, ORDER,
        {
            "cwd_key": F.when(context, F.col(f"{p}.cwd")),
            "model": F.when(context & F.col(f"{p}.model").isNotNull(), safe_model(F.col(f"{p}.model"))),
            "sub_so_far": F.when(sub, F.lit(True)),
        },
    ).withColumn("model", F.coalesce("model", F.lit(UNKNOWN))).withColumn("ts", rfc3339(F.col("r.timestamp")))
    event = kind == "event_msg"
    points = state.where(kind.isin("response_item", "event_msg") & F.col("ts").isNotNull())
    human = points.where((kind == "response_item") & (F.col(f"{p}.type") == "message") & (F.col(f"{p}.role") == "user") & F.col("sub_so_far").isNull())
    exact = state.where(event).withColumn("x", _codex_interval()).where("x IS NOT NULL").select("file", "ord", "cwd_key", "model", "x.start", "x.end")
    counts = points.where(event & (F.col(f"{p}.type") == "token_count") & F.col(f"{p}.info").isNotNull())
    total = F.col(f"{p}.info.total_token_usage")
    # A cumulative total that did not move repeats a turn; records without a total stand for themselves.
    moved = changed_totals(counts.withColumn("total", total), FILE, ORDER, "total").drop("total")
    last = f"{p}.info.last_token_usage"
    tokens = moved.unionByName(counts.where(total.isNull())).where(F.col(last).isNotNull()).select(
        "file", "ord", "ts", "cwd_key", "model",
        *[c.alias(k) for k, c in usage(minus_cached(F.col(f"{last}.input_tokens"), F.col(f"{last}.cached_input_tokens")), F.col(f"{last}.output_tokens"), F.col(f"{last}.cached_input_tokens"), F.col(f"{last}.cache_write_input_tokens")).items()],
    )
    tokens = nonzero(tokens)
    ids = F.coalesce(F.col(f"{p}.id"), F.col(f"{p}.session_id"))
    told = _last(state.where(meta), sid=ids, meta_cwd=F.col(f"{p}.cwd"), flagged=F.when(sub, F.lit(True)))
    keys = points.select("file", "cwd_key").union(exact.select("file", "cwd_key")).union(tokens.select("file", "cwd_key")).distinct()
    path = local_path(F.col("file"))
    each = keys.join(told, "file", "left").withColumn("path", path)
    side = metadata if metadata is not None else spark.createDataFrame([], METADATA)
    from ..operators.joins import first_match

    looked = first_match(each, side.select(F.col("id").alias("meta_id"), F.col("rollout_path").alias("meta_path"), F.col("cwd").alias("side_cwd"), F.col("model").alias("side_model")),
                         [("path", "meta_path"), ("sid", "meta_id")], ["meta_id", "side_cwd", "side_model"])
    base = F.coalesce("sid", "meta_id", F.regexp_replace(stem(F.col("path")), "^(rollout-)+", ""))
    n = F.count("*").over(Window.partitionBy("file"))
    cwd = F.coalesce("cwd_key", "meta_cwd", "side_cwd")
    sessions = looked.select(
        "file", "cwd_key", F.lit("codex").alias("provider"), F.when(n > 1, F.concat(base, F.lit(":"), F.coalesce(cwd, parent(F.col("path"))))).otherwise(base).alias("session_id"),
        F.coalesce(cwd, parent(F.col("path"))).alias("cwd"), F.coalesce("flagged", F.lit(False)).alias("is_subagent"), cwd.isNull().alias("approximate_cwd"),
        F.col("path").alias("source_file"), safe_model(F.coalesce("side_model", F.lit(UNKNOWN))).alias("fallback"),
    )

    def at(df: DataFrame, fill: bool = True) -> DataFrame:
        out = _named(df, sessions)
        if not fill:
            return out
        known = sessions.select(*KEY, "fallback").distinct()
        return out.join(known, KEY).withColumn("model", F.when(F.col("model") == UNKNOWN, F.col("fallback")).otherwise(F.col("model"))).drop("fallback")

    slim = ["file", "ord", "cwd_key", "ts", "model"]
    return history(sessions, at(points.select(slim)), at(human.select(slim), False), diagnostics(seen), at(exact), at(tokens))


# Chat sessions as line records or as one document.

_GEMINI_TOKENS = "struct<input: long, output: long, cached: long>"
_GEMINI = f"type string, timestamp string, model string, sessionId string, startTime string, lastUpdated string, kind string, tokens {_GEMINI_TOKENS}"
_GEMINI_DOC = f"sessionId string, kind string, startTime string, lastUpdated string, messages array<struct<type: string, timestamp: string, model: string, tokens: {_GEMINI_TOKENS}>>"
MAX_DOCUMENT = 128 << 20
_GEMINI_KINDS = {f"$.{k}": "string" for k in ("type", "timestamp", "model", "sessionId", "kind")}


def documents(spark: SparkSession, path: str | list[str], glob: str, most: int) -> DataFrame:
    """(file, ord, value): whole small files, and larger ones than ``most``, which are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    small = F.col("length") <= SMALL
    return files.where(small | (F.col("length") > most)).select(F.col("path").alias("file"), F.lit(0).cast("long").alias("ord"), F.when(small, F.decode("content", "UTF-8")).alias("value"))


def project_markers(directories: DataFrame, most: int = 32 * 1024) -> DataFrame:
    """(directory, marked) of the nearest ``.project_root`` at or above each directory.

    Hidden files are left out of Spark's listings, so tasks open them where the history
    lies; each directory is looked at once.
    """

    def nearest(directory: str) -> str | None:
        while True:
            marker = os.path.join(directory, ".project_root")
            if os.path.isfile(marker):
                with open(marker, "rb") as file:
                    data = file.read(most + 1)
                try:
                    return data.decode("utf-8").strip() or None if len(data) <= most else None
                except UnicodeDecodeError:
                    return None
            up = os.path.dirname(directory)
            if up == directory:
                return None
            directory = up

    @F.pandas_udf("string")
    def marked(names: pd.Series) -> pd.Series:
        return names.map(nearest)

    return directories.select("directory", marked("directory").alias("marked")).where("marked IS NOT NULL")


def gemini(spark: SparkSession, root: str, cap: int = LINE_CAP, roots: DataFrame | None = None, files: list[str] | None = None) -> History:
    """Files below a ``chats`` directory. ``roots`` (directory, cwd) are the project markers, read if not given."""
    chats = lambda df: df.where(F.lower(local_path(F.col("file"))).rlike("(^|/)chats/"))
    of = lambda end: root if files is None else literal_paths([f for f in files if f.endswith(end)])
    none = lambda end: files is not None and not of(end)
    lines = read_lines(spark, root if none(".jsonl") else of(".jsonl"), "*.jsonl")
    docs = documents(spark, root if none(".json") else of(".json"), "*.json", MAX_DOCUMENT)
    big = large(spark, root if none(".json") else of(".json"), "*.json", MAX_DOCUMENT)
    lines, docs, big = (chats(df).limit(0) if none(end) else chats(df) for df, end in ((lines, ".jsonl"), (docs, ".json"), (big, ".json")))
    if roots is None:
        here = lines.select("file").union(docs.select("file")).union(big.select("file")).distinct().select(parent(local_path(F.col("file"))).alias("directory")).distinct()
        roots = project_markers(here)
    return gemini_records(lines, docs, root, roots, cap, big)


def gemini_records(
    lines: DataFrame, docs: DataFrame, root: str, roots: DataFrame | None = None, cap: int = LINE_CAP, big: DataFrame | None = None
) -> History:
    """``docs`` hold small documents' texts, ``big`` names those that are scanned where they lie."""
    seen = parsed(lines, _GEMINI, _GEMINI_KINDS, cap)
    whole = docs.select("file", F.try_parse_json("value").isNotNull().alias("ok"), F.from_json("value", _GEMINI_DOC).alias("d"))
    each = whole.where("ok").select("file", F.posexplode("d.messages").alias("ord", "m")).withColumn("ord", F.col("ord").cast("long"))
    if big is not None:
        heads, items = scanned(big, _GEMINI_DOC, "messages")
        whole, each = whole.unionByName(heads), each.unionByName(items.withColumnRenamed("item", "m"))
    a = seen.where("ok").select("file", "ord", "r.type", "r.timestamp", "r.model", "r.tokens")
    b = each.select("file", "ord", "m.type", "m.timestamp", "m.model", "m.tokens")
    heads = _first(seen.where("ok"), sid=F.col("r.sessionId"), kind=F.col("r.kind")).unionByName(whole.where("ok").select("file", F.col("d.sessionId").alias("sid"), F.col("d.kind").alias("kind")))
    turns = a.unionByName(b).where(F.col("type").isin("user", "gemini"))
    state = carried(turns.withColumn("said", F.when(F.col("model").isNotNull(), safe_model(F.col("model")))), FILE, ORDER, {"model": F.col("said")})
    points = state.withColumn("model", F.coalesce("model", F.lit(UNKNOWN))).withColumn("ts", rfc3339(F.col("timestamp"))).where("ts IS NOT NULL")
    path = local_path(F.col("file"))
    sub = F.coalesce(F.col("kind") == "subagent", F.lit(False)) | ~last_name(path).startswith("session-")
    known = heads.withColumn("is_subagent", sub).withColumn("directory", parent(path))
    if roots is None:
        roots = lines.sparkSession.createDataFrame([], "directory string, marked string")
    named = known.join(roots.withColumnRenamed("marked", "cwd"), "directory", "left")
    sessions = _one_session(points, named, "gemini", root, lambda p: parent(p))
    t = "tokens"
    tokens = nonzero(points.select("file", "ord", "ts", "model", *[c.alias(k) for k, c in usage(minus_cached(F.col(f"{t}.input"), F.col(f"{t}.cached")), F.col(f"{t}.output"), F.col(f"{t}.cached"), F.lit(0)).items()]))
    at = lambda df: _named(df.select("file", "ord", "ts", "model"), sessions)
    filled = nearest_models(at(points))
    human = at(points.where("type = 'user'").join(known.where(~F.col("is_subagent")).select("file"), "file"))
    bad = whole.where(~F.col("ok")).select(F.col("file").alias("source_file"), F.lit(0).cast("long").alias("malformed_lines"), F.lit(0).cast("long").alias("content_rejections"), F.lit(1).cast("long").alias("unreadable_files"))
    return history(sessions, filled, model_at(human, filled), diagnostics(seen).unionByName(bad), tokens=_named(tokens, sessions))


# Command-line sessions as event records, with an optional session store.

_COPILOT_USAGE = "struct<inputTokens: long, outputTokens: long, cacheReadTokens: long, cacheWriteTokens: long>"
_COPILOT = (
    "type string, timestamp string, agentId string, data struct<sessionId: string, cwd: string, selectedModel: string, newModel: string, model: string, "
    "toolCallId: string, parentAgentTaskId: string, copilotVersion: string, durationMs: double, context: struct<cwd: string>, "
    f"modelMetrics: map<string, struct<usage: {_COPILOT_USAGE}>>>"
)
_COPILOT_KINDS = {"$.type": "string", "$.timestamp": "string", "$.agentId": "string", "$.data": "object"}
STORE = "id string, cwd string, repository string, branch string, host_type string"
_TURNS = ("user.message", "assistant.message", "assistant.turn_start", "assistant.turn_end", "tool.execution_start", "tool.execution_complete")


def copilot(spark: SparkSession, root: str, store: DataFrame | None = None, cap: int = LINE_CAP, files: list[str] | None = None) -> History:
    return copilot_lines(_lines_of(spark, root, "[eE][vV][eE][nN][tT][sS].[jJ][sS][oO][nN][lL]", files), store, cap)


def copilot_lines(lines: DataFrame, store: DataFrame | None = None, cap: int = LINE_CAP) -> History:
    """Sessions by directory; a finished subagent is a session of its own; shutdown records carry the tokens."""
    spark = lines.sparkSession
    seen = parsed(lines, _COPILOT, _COPILOT_KINDS, cap)
    kind, d = F.col("r.type"), "r.data"
    ts = rfc3339(F.col("r.timestamp"))
    begins = kind == "session.start"
    ms = F.col(f"{d}.durationMs")
    done = F.coalesce((kind == "subagent.completed") & ts.isNotNull() & ~F.isnan(ms) & (ms > 0) & (ms <= MAX_EXACT_MS), F.lit(False))
    by_agent = F.col("r.agentId").isNotNull() | F.col(f"{d}.parentAgentTaskId").isNotNull()
    plain = ts.isNotNull() & ~begins & (kind != "session.shutdown") & ~done & ~by_agent
    model = (
        F.when(begins & F.col(f"{d}.selectedModel").isNotNull(), safe_model(F.col(f"{d}.selectedModel")))
        .when(plain & F.col(f"{d}.model").isNotNull(), safe_model(F.col(f"{d}.model")))
        .when((kind == "session.model_change") & F.col(f"{d}.newModel").isNotNull(), safe_model(F.col(f"{d}.newModel")))
    )
    place = F.when(begins, F.col(f"{d}.context.cwd")).when(kind == "session.context_changed", F.col(f"{d}.cwd"))
    state = carried(seen.where(F.col("ok") & kind.isNotNull()), FILE, ORDER, {"model": model, "cwd_key": place})
    state = state.withColumn("model", F.coalesce("model", F.lit(UNKNOWN))).withColumn("ts", ts).where("ts IS NOT NULL")
    points = state.where(plain & kind.isin(*_TURNS))
    metrics = state.where((kind == "session.shutdown")).select("file", "ord", "ts", "cwd_key", F.explode(f"{d}.modelMetrics").alias("name", "entry"))
    u = "entry.usage"
    tokens = nonzero(metrics.select(
        "file", "ord", "ts", "cwd_key", safe_model(F.col("name")).alias("model"),
        *[c.alias(k) for k, c in usage(minus_cached(F.col(f"{u}.inputTokens"), F.col(f"{u}.cacheReadTokens")), F.col(f"{u}.outputTokens"), F.col(f"{u}.cacheReadTokens"), F.col(f"{u}.cacheWriteTokens")).items()],
    ))
    path = local_path(F.col("file"))
    told = _last(seen.where(F.col("ok") & begins), sid=F.col(f"{d}.sessionId"))
    side = store if store is not None else spark.createDataFrame([], STORE)
    directory = last_name(parent(path))
    files = state.select("file").distinct().join(told, "file", "left").withColumn("path", path).withColumn("directory", directory)
    looked = files.join(side.select(F.col("id").alias("directory"), F.when(F.trim("cwd") != "", F.trim("cwd")).alias("store_cwd")), "directory", "left")
    base = F.coalesce("sid", F.when(F.col("directory") != "", F.col("directory")), stem(F.col("path")))
    keys = points.select("file", "cwd_key").union(tokens.select("file", "cwd_key")).distinct()
    n = F.count("*").over(Window.partitionBy("file"))
    cwd = F.coalesce("cwd_key", "store_cwd")
    shown = F.coalesce(cwd, parent(F.col("path")))
    main = keys.join(looked, "file").select(
        "file", "cwd_key", F.lit("copilot").alias("provider"), F.when(n > 1, F.concat(base, F.lit(":"), shown)).otherwise(base).alias("session_id"), shown.alias("cwd"),
        F.lit(False).alias("is_subagent"), cwd.isNull().alias("approximate_cwd"), F.col("path").alias("source_file"),
    )
    took = F.round(ms).cast("long") * 1000
    agents = state.where(done).join(looked, "file").select(
        "file", F.lit("copilot").alias("provider"),
        F.concat(base, F.lit(":subagent:"), F.coalesce(F.col(f"{d}.toolCallId"), F.concat(F.lit("subagent-"), F.unix_micros("ts")))).alias("session_id"),
        F.coalesce(F.when(F.col("cwd_key") != "", F.col("cwd_key")), "store_cwd", parent(F.col("path"))).alias("cwd"), F.lit(True).alias("is_subagent"),
        F.coalesce(F.when(F.col("cwd_key") != "", F.col("cwd_key")), "store_cwd").isNull().alias("approximate_cwd"), F.col("path").alias("source_file"),
        plus_micros(F.col("ts"), -took).alias("start"), F.col("ts").alias("end"), F.coalesce(F.when(F.col(f"{d}.model").isNotNull(), safe_model(F.col(f"{d}.model"))), "model").alias("model"), "ord",
    )
    sessions = main.drop("cwd_key").unionByName(agents.select(*[c for c in main.columns if c != "cwd_key"]))
    at = lambda df: _named(df, main)
    slim = ["file", "ord", "cwd_key", "ts", "model"]
    return history(sessions, at(points.select(slim)), at(points.where(kind == "user.message").select(slim)), diagnostics(seen), agents, at(tokens))


def repository_conflicts(sessions: DataFrame, store: DataFrame) -> DataFrame:
    """Stored repositories that differ from the directory a session ran in; the directory decides."""
    hosted = store.where((F.lower(F.coalesce("host_type", F.lit("github"))) == "github") & (F.trim("repository") != ""))
    met = sessions.where(~F.col("approximate_cwd")).withColumn("id", last_name(parent(F.col("source_file")))).join(hosted.select("id", "repository", "branch"), "id")
    return met.where(F.lower(last_name(F.col("cwd"))) != F.lower(last_name(F.trim("repository"))))


# Editor chats: one document a session.

_VSCODE = "version double, sessionId string, requests array<struct<timestamp: double, modelId: string, result: struct<timings: struct<totalElapsed: double>>>>"
MAX_CHAT, NEWEST_CHAT = 64 << 20, 3


def vscode(spark: SparkSession, root: str, files: list[str] | None = None) -> History:
    """``<root>/<workspace>/chatSessions/*.json``, with the workspace's folder beside it."""
    base = root.rstrip("/")
    chats = f"{base}/*/chatSessions/*.json" if files is None else literal_paths(files)
    docs, big = documents(spark, chats, "*.json", MAX_CHAT), large(spark, chats, "*.json", MAX_CHAT)
    try:
        marks = spark.read.format("binaryFile").load(f"{base}/*/workspace.json").where("length <= 65536").select("path", F.decode("content", "UTF-8").alias("value"))
    except Exception as missing:  # no workspace file at all
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        marks = spark.createDataFrame([], "path string, value string")
    return vscode_documents(docs, marks, big)


def vscode_documents(docs: DataFrame, marks: DataFrame, big: DataFrame | None = None) -> History:
    from ..functions.paths import file_url_path

    space = F.from_json("value", "folder string, folders array<struct<uri: string, path: string>>")
    named = F.filter(F.transform(space["folders"], lambda f: F.coalesce(f["uri"], f["path"])), lambda f: f.isNotNull())
    folders = marks.select(parent(local_path(F.col("path"))).alias("space"), file_url_path(F.coalesce(space["folder"], F.get(named, F.lit(0)))).alias("folder"))
    whole = docs.select("file", F.try_parse_json("value").isNotNull().alias("ok"), F.from_json("value", _VSCODE).alias("d"))
    each = whole.select("file", F.posexplode("d.requests").alias("ord", "q")).withColumn("ord", F.col("ord").cast("long"))
    if big is not None:
        heads, items = scanned(big, _VSCODE, "requests")
        whole, each = whole.unionByName(heads), each.unionByName(items.withColumnRenamed("item", "q"))
    newer = F.coalesce(F.col("d.version") > NEWEST_CHAT, F.lit(False))
    read = whole.where(F.col("ok") & ~newer)
    each = each.join(read.select("file"), "file", "left_semi")
    model = F.when(F.col("q.modelId").isNotNull(), safe_model(F.regexp_replace("q.modelId", "^copilot/", "")))
    state = carried(each, FILE, ORDER, {"model": model}).withColumn("model", F.coalesce("model", F.lit(UNKNOWN))).withColumn("ts", epoch_ms(F.col("q.timestamp"))).where("ts IS NOT NULL")
    ms = F.col("q.result.timings.totalElapsed")
    timed = F.coalesce(~F.isnan(ms) & (ms > 0) & (ms <= MAX_EXACT_MS), F.lit(False))
    path = local_path(F.col("file"))
    space_dir = parent(path, 2)
    keyed = state.select("file").distinct().join(read.select("file", F.when(F.trim("d.sessionId") != "", F.col("d.sessionId")).alias("sid")), "file").withColumn("space", space_dir).join(folders, "space", "left")
    sid = F.coalesce("sid", stem(path))
    key = last_name(space_dir)
    sessions = keyed.select(
        "file", F.lit("copilot-vscode").alias("provider"), F.when(key == "", sid).otherwise(F.concat(sid, F.lit(":"), key)).alias("session_id"),
        F.coalesce("folder", parent(path)).alias("cwd"), F.lit(False).alias("is_subagent"), F.col("folder").isNull().alias("approximate_cwd"), path.alias("source_file"),
    )
    at = lambda df: _named(df.select("file", "ord", "ts", "model", "q"), sessions)
    exact = at(state.where(timed)).withColumn("start", F.col("ts")).withColumn("end", plus_micros(F.col("ts"), F.round(ms).cast("long") * 1000))
    bad = whole.where(~F.col("ok")).select(F.col("file").alias("source_file"), F.lit(1).cast("long").alias("unreadable_files")).withColumns({"malformed_lines": F.lit(0), "content_rejections": F.lit(0)})
    return history(sessions, at(state.where(~timed)), at(state), bad, exact)
