"""Commit history as a Spark data source: partitions are ranges of a repository's commits.

``spark.read.format("gitlog").option("repositories", json list).load()`` gives one row for
each changed file. Only hashes, dates, authors, paths, line counts and co-author trailers are
asked for; messages and contents are not read.

A plan pins each repository's head and counts the commits that the options select, which
reads no trees. Tasks then walk from that head to their own range and take the differences,
the dear part, of that range alone; a repeated task finds the same commits. Bounds on ``ts``
reach ``git log`` where the session pushes filters to Python sources.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.globs import is_ignored, is_included
from ..functions.names import assistance
from ..operators.classify import BUILTIN, Category, with_category

SCHEMA = "repo_path string, sha string, ts timestamp, author string, trailers string, path string, additions long, deletions long, error string"
FORMAT = "W%x09%H%x09%cI%x09%(trailers:key=Co-authored-by,valueonly,separator=%x02)%x03%aN <%aE>"
#: Commits of a partition, and repositories that are planned at once.
SPLIT_COMMITS, PLANNERS = 5000, 16
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def numstat_rows(fields: Iterator[bytes]) -> Iterator[tuple]:
    """(sha, time, trailers, path, added, removed) from NUL-separated log fields.

    A change is ``added TAB removed TAB path``; where the path is empty the next two
    fields are a rename's source and target. A header is a field that begins with ``W
    TAB`` and a hash; it may be glued to its first change by a line end.
    """
    head: tuple | None = None
    change: tuple[int, int] | None = None
    waiting = 0
    for raw in fields:
        if waiting:
            waiting -= 1
            if not waiting and head and change:
                yield (*head, raw.decode("utf-8", "replace"), *change)
            continue
        text = raw.lstrip(b"\n")
        while text.startswith(b"W\t"):
            line, _, text = text.partition(b"\n")
            parts = line.decode("utf-8", "replace").split("\t", 3)
            head = None
            if len(parts) >= 3 and len(parts[1]) >= 40:
                try:
                    head = (parts[1], datetime.fromisoformat(parts[2].strip()).astimezone(timezone.utc), parts[3].strip() if len(parts) > 3 else "")
                except ValueError:
                    head = None
            text = text.lstrip(b"\n")
        bits = text.split(b"\t", 2)
        if len(bits) < 3:
            continue
        added, removed, path = bits
        try:
            change = tuple(0 if n == b"-" else int(n) for n in (added, removed))
        except ValueError:
            continue
        if not path:
            waiting = 2
        elif head:
            yield (*head, path.decode("utf-8", "replace"), *change)


def _fields(stream, size: int = 1 << 16) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\0")
        yield from whole
    if rest:
        yield rest


@dataclass
class _Span(InputPartition):
    """``count`` commits of a repository after the first ``skip``; all, where the head is not known."""

    repo: str
    head: str | None = None
    skip: int = 0
    count: int = 0


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repositories = json.loads(options.get("repositories", "[]"))
        self.authors = json.loads(options.get("authors", "[]"))
        self.since, self.until = options.get("since"), options.get("until")
        self.split = int(options.get("split_commits", SPLIT_COMMITS))
        self.bounds: list[str] = []

    def _chosen(self) -> list[str]:
        """Options of the commits that are wanted."""
        chosen = ["--no-merges", "--regexp-ignore-case", *[f"--author={a}" for a in self.authors], *self.bounds]
        chosen += [f"--since={self.since}"] if self.since else []
        return chosen + ([f"--until={self.until}"] if self.until else [])

    def _spans(self, repo: str) -> list[_Span]:
        asked = lambda *args: subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)
        head = asked("rev-parse", "--verify", "-q", "HEAD").stdout.strip()
        told = asked("rev-list", "--count", *self._chosen(), head).stdout.strip() if head else ""
        if not told.isdigit():
            return [_Span(repo)]
        return [_Span(repo, head, at, self.split) for at in range(0, int(told), self.split)]

    def partitions(self):
        with ThreadPoolExecutor(PLANNERS) as pool:
            return [span for spans in pool.map(self._spans, self.repositories) for span in spans]

    def read(self, partition):
        if partition is None:  # no commit is wanted anywhere
            return
        repo = partition.repo
        command = ["git", "-C", repo, "-c", "core.quotepath=off", "log", "--numstat", "-z", f"--format={FORMAT}", *self._chosen()]
        if partition.head:
            command += [f"--skip={partition.skip}", f"--max-count={partition.count}", partition.head]
        child = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
        for sha, ts, told, path, added, removed in numstat_rows(_fields(child.stdout)):
            trailers, _, author = told.partition("\x03")
            yield (repo, sha, ts, author, trailers.strip(), path, added, removed, None)
        said = child.stderr.read(4096).decode("utf-8", "replace")
        if child.wait() and "does not have any commits yet" not in said:
            yield (repo, None, None, None, None, None, None, None, said.strip() or "git log failed")


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        """Bounds on ``ts`` narrow the log; Spark tests them again, for the log's are of whole seconds."""
        for f in filters:
            at = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("ts",) and isinstance(at, datetime) and at.tzinfo:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.bounds.append(f"--since-as-filter={at.replace(microsecond=0).isoformat()}")
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.bounds.append(f"--until={(at.replace(microsecond=0) + timedelta(seconds=1)).isoformat()}")
            yield f


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return (_PushingReader if self.options.get("push") == "true" else _Reader)(self.options)


def read_log(spark: SparkSession, repositories: list[str], authors: list[str] | tuple = (), since: str | None = None, until: str | None = None, split_commits: int = SPLIT_COMMITS) -> DataFrame:
    spark.dataSource.register(GitLog)
    push = spark.conf.get(PUSHDOWN, "false")
    reader = spark.read.format("gitlog").option("push", push).option("repositories", json.dumps(list(repositories))).option("authors", json.dumps(list(authors)))
    reader = reader.option("split_commits", str(split_commits))
    if since:
        reader = reader.option("since", since)
    if until:
        reader = reader.option("until", until)
    return reader.load()


def changed_files(log: DataFrame, includes: list[str] | tuple = (), ignores: list[str] | tuple = (), categories: tuple[Category, ...] = BUILTIN) -> DataFrame:
    """(sha, repo_path, path, additions, deletions, is_ignored, category): included files only."""
    kept = log.where(F.col("path").isNotNull() & is_included(F.col("path"), includes))
    return with_category(kept.withColumn("is_ignored", is_ignored(F.col("path"), ignores)), categories=categories)


def commit_rows(log: DataFrame, agent_authored: bool, includes: list[str] | tuple = ()) -> DataFrame:
    """One row for each commit with an included file; a hash in several checkouts counts once, in the first."""
    kept = log.where(F.col("path").isNotNull() & is_included(F.col("path"), includes))
    agent, autofix = assistance(F.col("trailers"))
    first = F.min_by(F.struct("repo_path", "ts", "trailers"), "repo_path").alias("c")
    return kept.groupBy("sha").agg(first).select("sha", "c.*").select(
        "sha", "ts", "repo_path", F.lit(agent_authored).alias("agent_authored"), agent.alias("agent_assisted"), autofix.alias("autofix_assisted")
    )


def failures(log: DataFrame) -> DataFrame:
    return log.where("error IS NOT NULL").select("repo_path", "error")


def patch(repo: str, sha: str, path: str = "", most_lines: int = 20_000, most_bytes: int = 2 << 20) -> tuple[list[str], bool]:
    """A commit's patch on demand, and whether it was cut; nothing of it is stored."""
    if not sha or any(c not in "0123456789abcdef" for c in sha.lower()):
        raise ValueError("not an object name")
    command = ["git", "-C", repo, "show", "--no-ext-diff", "--no-textconv", "--no-color", "--patch", "--format=%H%n%an%n%aI%n%s", sha]
    command += ["--", path] if path else []
    child = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    lines, size = [], 0
    for raw in child.stdout:
        if len(lines) >= most_lines or size >= most_bytes:
            child.kill()
            child.wait()
            return lines, True
        size += len(raw)
        lines.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
    child.wait()
    return lines, False
