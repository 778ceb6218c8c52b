"""Drill-down over commits: repositories, periods, categories, commits, files, history, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import fuzzy_score, may_hold, presence_mask
from ..functions.times import local_day, local_month, round3
from . import joins
from .classify import BUILTIN, Category, category_lines

MAX_TARGETS, MAX_HITS = 200_000, 200


def with_period(commits: DataFrame, grain: str = "month") -> DataFrame:
    return commits.withColumn("period", (local_month if grain == "month" else local_day)(F.col("ts")))


def scope(commits: DataFrame, repo: str = "", period: str = "", grain: str = "month") -> DataFrame:
    """Commits of a repository's directory (all for an empty one) and period."""
    out = with_period(commits, grain)
    if repo:
        out = out.where(F.col("cwd") == repo)
    return out.where(F.col("period") == period) if period else out


def _lines() -> list:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("additions", "deletions")]


def _net(df: DataFrame) -> DataFrame:
    return df.withColumn("net_lines", F.col("additions") - F.col("deletions"))


def _counted(files: DataFrame) -> DataFrame:
    return files.where(~F.col("is_ignored"))


def overview(commits: DataFrame, files: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """One row for each directory, with the report's seconds of its label."""
    paths = _counted(files).join(commits.select("sha", "cwd"), "sha").groupBy("cwd").agg(F.count_distinct("path").alias("files"))
    rows = commits.groupBy("cwd").agg(F.min("repo").alias("repo"), F.min("root").alias("root"), F.count("*").alias("commits"), *_lines())
    out = _net(rows.join(paths, "cwd", "left").fillna(0, ["files"]))
    if report is None:
        return out.withColumns({"active_seconds": F.lit(0.0), "human_estimated_seconds": F.lit(0.0)})
    return joins.seconds_by_label(out, report, ["active_seconds", "human_estimated_seconds"])


def periods(commits: DataFrame, files: DataFrame, repo: str = "", grain: str = "month") -> DataFrame:
    inside = scope(commits, repo, "", grain)
    paths = _counted(files).join(inside.select("sha", "period"), "sha").groupBy("period").agg(F.count_distinct("path").alias("files"))
    rows = inside.groupBy("period").agg(F.count("*").alias("commits"), *_lines())
    return _net(rows.join(paths, "period", "left").fillna(0, ["files"]))


def categories(commits: DataFrame, files: DataFrame, repo: str = "", period: str = "", grain: str = "month") -> DataFrame:
    """Categories with changed lines."""
    inside = _counted(files).join(scope(commits, repo, period, grain).select("sha"), "sha", "left_semi")
    rows = inside.groupBy("category").agg(F.count_distinct("path").alias("files"), *_lines())
    touched = F.col("additions") + F.col("deletions")
    total = F.sum(touched).over(Window.partitionBy(F.lit(1)))
    return _net(rows.where(touched > 0).withColumn("share", round3(touched / total)))


def summaries(files: DataFrame, registry: tuple[Category, ...] = BUILTIN, category: str | None = None) -> DataFrame:
    """(sha, summary): number of files and the three commonest categories, ties in registry order.

    ``touched`` is the changed lines in ``category``. They come out of the same sums: Spark would move a
    filter on a category to the rows and there work out a path's rules once for each of their uses.
    """
    order = F.create_map(*[x for i, c in enumerate(registry) for x in (F.lit(c.name), F.lit(i))])
    lines = [F.sum(F.when(F.col("category") == category, F.col("additions") + F.col("deletions"))).alias("t")] if category else []
    n = _counted(files).groupBy("sha", "category").agg(F.count("*").alias("n"), *lines)
    entry = F.struct((-F.col("n")).alias("n"), F.element_at(order, F.col("category")).alias("i"), "category")
    touched = [F.coalesce(F.sum("t"), F.lit(0)).alias("touched")] if category else []
    best = n.groupBy("sha").agg(F.sum("n").alias("files"), F.sort_array(F.collect_list(entry)).alias("top"), *touched)
    names = F.array_join(F.transform(F.slice("top", 1, 3), lambda t: t["category"]), ", ")
    head = F.when(F.col("files") == 1, "1 file · ").otherwise(F.concat(F.col("files").cast("string"), F.lit(" files · ")))
    return best.select("sha", F.concat(head, names).alias("summary"), F.col("files").alias("file_count"), *(["touched"] if category else []))


def described(commits: DataFrame, files: DataFrame, category: str | None = None) -> DataFrame:
    told = commits.drop("file_count").join(summaries(files, category=category), "sha", "left")
    return told.withColumns(
        {"summary": F.coalesce("summary", F.lit("no counted files")), "file_count": F.coalesce("file_count", F.lit(0)), "short_sha": F.substring("sha", 1, 9)}
    )


def told(commits: DataFrame, files: DataFrame, registry: tuple[Category, ...] = BUILTIN) -> DataFrame:
    """Commits with a file, with what ``described`` adds: both come out of one pass over the files.

    The files' categories must all be the registry's: each is one count, and a commit's counts are one row,
    where ``summaries`` takes any names and gathers them in a second step.
    """
    # A generator of one row: else Spark would work out a path's rules once for each count.
    lines = files.select("sha", F.explode(F.array(F.when(~F.col("is_ignored"), F.col("category")))).alias("category"))
    counts = [F.count_if(F.col("category") == c.name).alias(f"__{i}") for i, c in enumerate(registry)]
    met = commits.drop("file_count").join(lines.groupBy("sha").agg(*counts), "sha")
    files_of = reduce(lambda a, b: a + b, [F.col(f"__{i}") for i in range(len(registry))])
    entry = lambda i, c: F.when(F.col(f"__{i}") > 0, F.struct((-F.col(f"__{i}")).alias("n"), F.lit(i).alias("i"), F.lit(c.name).alias("category")))
    top = F.slice(F.sort_array(F.array_compact(F.array(*[entry(i, c) for i, c in enumerate(registry)]))), 1, 3)
    n = F.col("file_count")
    head = F.when(n == 0, "no counted files").when(n == 1, "1 file · ").otherwise(F.concat(n.cast("string"), F.lit(" files · ")))
    named = met.withColumn("file_count", files_of).withColumn("summary", F.concat(head, F.array_join(F.transform(top, lambda t: t["category"]), ", ")))
    return named.withColumn("short_sha", F.substring("sha", 1, 9)).drop(*[f"__{i}" for i in range(len(registry))])


def commits_touching(commits: DataFrame, files: DataFrame, category: str, repo: str = "", period: str = "", grain: str = "month") -> DataFrame:
    """Commits with changed lines in a category, with whole-commit counts."""
    told = described(scope(commits, repo, period, grain), files, category).where("touched > 0")
    return told.select("sha", "ts", "short_sha", "summary", "file_count", "additions", "deletions")


def files_of(files: DataFrame, sha: str) -> DataFrame:
    return _counted(files).where(F.col("sha") == sha).select("path", "category")


def history(commits: DataFrame, files: DataFrame, path: str, repo: str = "", grain: str = "month") -> DataFrame:
    """Every commit of a file in a repository, whatever the period."""
    touching = _counted(files).where(F.col("path") == path).select("sha")
    inside = scope(commits, repo, "", grain).join(touching, "sha", "left_semi")
    return described(inside, files).select("sha", "ts", "short_sha", "summary", "period")


def dominant_category(files: DataFrame, registry: tuple[Category, ...] = BUILTIN) -> DataFrame:
    """(sha, category) with the most changed lines; ties go to the last in registry order.

    Where no line changed every category ties.
    """
    order = F.create_map(*[x for i, c in enumerate(registry) for x in (F.lit(c.name), F.lit(i))])
    touched = F.col("additions") + F.col("deletions")
    by = category_lines(files).groupBy("sha").agg(
        F.max_by("category", F.struct(touched, F.element_at(order, F.col("category")))).alias("category"), F.sum(touched).alias("n")
    )
    return by.select("sha", F.when(F.col("n") > 0, F.col("category")).otherwise(registry[-1].name).alias("category"))


def search_targets(commits: DataFrame, files: DataFrame, limit: int | None = MAX_TARGETS) -> DataFrame:
    """(kind, label, key, ord): repositories, then commits newest first, each path once with its newest commit.

    Without a limit all of them, in no order. Commits may be ``told`` already; they are read three times.
    """
    known = commits if "summary" in commits.columns else described(commits, files)
    repos = commits.groupBy("cwd").agg(F.min("repo").alias("repo"), F.min("root").alias("root"))
    a = repos.select(F.lit("repo").alias("kind"), F.concat("repo", F.lit(" ("), "root", F.lit(")")).alias("label"), F.col("cwd").alias("key"), F.lit(None).cast("timestamp").alias("ts"))
    b = known.select(F.lit("commit").alias("kind"), F.concat_ws(" ", "short_sha", "summary").alias("label"), F.col("sha").alias("key"), "ts")
    # Few commits of a task share a path, so rows are dealt by it and sorted once, not summed up before too.
    touched = _counted(files).join(commits.select("sha", "cwd", "ts"), "sha").select("cwd", "path", "ts", "sha").repartition("cwd", "path")
    newest = touched.groupBy("cwd", "path").agg(F.max(F.struct("ts", "sha")).alias("last"))
    c = newest.select(F.lit("file").alias("kind"), F.col("path").alias("label"), F.col("last.sha").alias("key"), F.col("last.ts").alias("ts"))
    rank = F.when(F.col("kind") == "repo", 0).otherwise(1)
    whole = a.unionByName(b).unionByName(c)
    if limit is None:
        return whole
    return whole.orderBy(rank, F.col("ts").desc_nulls_last(), "key", "kind", "label").limit(limit)


def search_index(targets: DataFrame) -> DataFrame:
    """Targets with the mask of their labels' characters; written as a table, it serves every later search."""
    return targets.withColumn("mask", presence_mask(F.col("label")))


def search(targets: DataFrame, needle: str, limit: int = MAX_HITS) -> DataFrame:
    """The best matches: score, then the shorter label, then the label itself.

    Labels of an index are sorted out by their kept masks before any is scored.
    """
    index = targets if "mask" in targets.columns else search_index(targets)
    near = index.where(may_hold(F.col("mask"), needle))
    scored = near.withColumn("score", fuzzy_score(F.col("label"), needle, F.col("mask"))).where("score IS NOT NULL").drop("mask")
    return scored.orderBy(F.col("score").desc(), F.length("label"), "label", "key", "kind").limit(limit if needle else 0)


def sorted_rows(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Any column: numbers by value, text without case; all columns break ties."""
    text = dict(df.dtypes)[column] == "string"
    key = F.lower(column) if text else F.col(column)
    return df.orderBy(key.desc() if descending else key.asc(), *[c for c in df.columns])
