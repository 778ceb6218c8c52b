"""File and repository discovery where order or pruning matters; links are not followed."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from datetime import date
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import repo_label, source_root
from .lines import literal_paths

# Directories that hold no repositories of their own.
SKIPPED = (".git", "node_modules", "bin", "obj", "dist", "build", "vendor", ".cache")


def files_below(root: str, wanted) -> list[str]:
    """Sorted paths of regular files below a root for which ``wanted(path)`` holds."""
    out = []
    for folder, names, found in os.walk(root, followlinks=False):
        names.sort()
        out += [p for f in found if os.path.isfile(p := os.path.join(folder, f)) and not os.path.islink(p) and wanted(p)]
    return sorted(out)


def gemini_files(root: str) -> list[str]:
    inside = lambda p: "chats" in [x.lower() for x in p.split(os.sep)]
    return files_below(root, lambda p: p.endswith((".json", ".jsonl")) and inside(p))


def copilot_files(root: str) -> list[str]:
    return files_below(root, lambda p: os.path.basename(p).lower() == "events.jsonl")


def claude_files(root: str) -> list[str]:
    return files_below(root, lambda p: p.endswith(".jsonl"))


def pi_files(root: str) -> list[str]:
    return files_below(root, lambda p: p.lower().endswith(".jsonl"))


def event_files(path: str) -> list[str]:
    return [path] if os.path.isfile(path) else files_below(path, lambda p: p.endswith(".jsonl"))


def vscode_files(root: str) -> list[str]:
    """Only ``<root>/<workspace>/chatSessions/*.json``."""
    out = []
    for space in sorted(os.listdir(root)) if os.path.isdir(root) else []:
        chats = os.path.join(root, space, "chatSessions")
        if os.path.isdir(chats):
            out += [p for f in sorted(os.listdir(chats)) if f.endswith(".json") and os.path.isfile(p := os.path.join(chats, f))]
    return out


def dated(path: str, root: str) -> date | None:
    """The date of a directory ``<root>/YYYY/MM/DD``."""
    return _date_of(tuple(os.path.relpath(path, root).split(os.sep)))


def _date_of(parts: tuple[str, ...]) -> date | None:
    if len(parts) != 3 or not all(p.isdigit() for p in parts):
        return None
    try:
        return date(*map(int, parts))
    except ValueError:
        return None


@dataclass
class Places:
    """Where rollouts may be: directories to list whole, files by name, and how many directories were opened to tell."""

    directories: list[str]
    files: list[str]
    opened: int

    @property
    def places(self) -> list[str]:
        return self.directories + self.files


def dated_places(spark: SparkSession, root: str, until: str | date | None = None) -> Places:
    """What below a root is to be listed when days from ``until`` on are of no interest.

    Only the root, its years and its months are opened here, through Spark's file system,
    so it also works on remote storage. Day directories are told by their names: those from
    ``until`` on are never opened, the others are left to Spark's parallel listing. There is no
    lower bound: a session may have begun on any day before.
    """
    end = date.fromisoformat(until) if isinstance(until, str) else until
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found, level = Places([], [], 0), [(top, ())]
    while level:
        deeper = []
        for folder, parts in level:
            found.opened += 1
            for entry in system.listStatus(folder):
                name = entry.getPath().getName()
                if name.startswith((".", "_")):
                    continue
                if not entry.isDirectory():
                    if fnmatch(name, "rollout-*.jsonl"):
                        found.files.append(entry.getPath().toString())
                elif len(parts) < 2:
                    deeper.append((entry.getPath(), (*parts, name)))
                elif end is None or (day := _date_of((*parts, name))) is None or day < end:
                    found.directories.append(entry.getPath().toString())
        level = deeper
    return Places(sorted(found.directories), sorted(found.files), found.opened)


def from_day_on(path: Column, root: str, until: date) -> Column:
    """Whether a path lies in a date directory that ``dated_places`` does not open."""
    day = F.regexp_extract(path, "^" + re.escape(root.rstrip("/")) + r"/(\d+/\d+/\d+)/", 1)
    return F.coalesce(F.try_to_date(day, "y/M/d") >= F.lit(until), F.lit(False))


def dated_files(spark: SparkSession, root: str, until: str | date | None = None) -> list[str]:
    """Rollouts whose date directory is before ``until``; other directories are not pruned."""
    places = dated_places(spark, root, until).places
    if not places:
        return []
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "rollout-*.jsonl").load(literal_paths(places))
    return sorted(r["path"] for r in listed.select("path").collect())


def repositories(base: str, depth: int = 4) -> list[str]:
    """Directories with a ``.git``, canonical and once each; nothing below one is searched."""
    found: set[str] = set()

    def visit(folder: str, left: int) -> None:
        if os.path.exists(os.path.join(folder, ".git")):
            found.add(os.path.realpath(folder))
            return
        if left <= 0:
            return
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            if e.is_dir(follow_symlinks=False) and e.name not in SKIPPED:
                visit(e.path, left - 1)

    visit(os.path.abspath(base), depth)
    return sorted(found)


def nearest_repository(cwd: str) -> str:
    """The enclosing directory with a ``.git``, else the directory itself."""
    at = os.path.realpath(os.path.expanduser(cwd))
    here = at if os.path.isdir(at) else os.path.dirname(at)
    while True:
        if os.path.exists(os.path.join(here, ".git")):
            return here
        up = os.path.dirname(here)
        if up == here:
            return at
        here = up


def placed(sessions: DataFrame, rules: tuple = (), home: str | None = None) -> DataFrame:
    """Sessions with canonical ``cwd``, ``repo`` label and ``root``.

    Directories are resolved on the machine that holds them, once each and in tasks; what
    comes back is joined by equality.
    """
    base = os.path.realpath(home or os.path.expanduser("~"))

    @F.pandas_udf("cwd2 string, repo_path string")
    def resolve(cwds: pd.Series) -> pd.DataFrame:
        real = [os.path.realpath(os.path.expanduser(c)) for c in cwds]
        return pd.DataFrame({"cwd2": real, "repo_path": [nearest_repository(c) for c in real]})

    known = sessions.select("cwd").distinct().select("cwd", resolve("cwd").alias("x")).select(
        "cwd", "x.cwd2", repo_label(F.col("x.repo_path"), base).alias("repo"), source_root(F.col("x.repo_path"), rules, base).alias("root")
    )
    return sessions.join(known, "cwd").drop("cwd").withColumnRenamed("cwd2", "cwd")


def checkouts(sessions: DataFrame) -> list[str]:
    """Repositories that sessions ran in, found in tasks; each is one partition of the log's scan."""

    @F.pandas_udf("string")
    def enclosing(cwds: pd.Series) -> pd.Series:
        roots = cwds.map(lambda c: nearest_repository(c) if os.path.isdir(c) else None)
        return roots.map(lambda r: r if r and os.path.exists(os.path.join(r, ".git")) else None)

    found = sessions.where("NOT approximate_cwd").select("cwd").distinct().select(enclosing("cwd").alias("root"))
    return sorted(r[0] for r in found.where("root IS NOT NULL").distinct().collect())
