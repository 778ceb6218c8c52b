"""Joins between sessions, commits and their attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import plus_micros
from .intervals import KEY, LEVELS, dyadic_cells


_HOUR_US = 3_600_000_000


def with_output(extended: DataFrame, commits: DataFrame, idle_us: int) -> DataFrame:
    """Sessions with a commit in their repository from ``idle_us`` before to ``idle_us`` after them.

    ``extended`` has ``repo, first_seen, last_seen``. The whole hours of a session's reach are
    a few cells of several widths, where any commit will do; in the two hours that it takes
    in part (level -1) commits are met by their instants. Commits are known to each width by
    the distinct cells of their repository, so neither a session of years nor a repository
    that holds most commits is met row by row.
    """
    hour = lambda c: F.floor(F.unix_micros(c) / F.lit(_HOUR_US)).cast("long")
    reach = extended.withColumns({"__a": plus_micros(F.col("first_seen"), -idle_us), "__z": plus_micros(F.col("last_seen"), idle_us)})
    first, last = hour(F.col("__a")), hour(F.col("__z"))
    part = lambda c: F.struct(F.lit(-1).alias("level"), c.alias("cell"))
    cells = F.concat(F.array_distinct(F.array(part(first), part(last))), dyadic_cells(first + 1, last))
    asked = reach.select(*KEY, F.col("repo").alias("__repo"), "__a", "__z", F.inline(cells))
    when = commits.select("repo", "ts", hour(F.col("ts")).alias("h")).distinct()
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    wide = when.select("repo", "h").distinct().select("repo", "h", level.alias("level"))
    wide = wide.select("repo", "level", F.call_function("shiftright", F.col("h"), F.col("level")).alias("cell"), F.lit(None).cast("timestamp").alias("ts"))
    held = wide.distinct().unionByName(when.select("repo", F.lit(-1).alias("level"), F.col("h").alias("cell"), "ts"))
    held = held.toDF("__r", "__l", "__c", "__ts")
    on = (F.col("__repo") == F.col("__r")) & (F.col("level") == F.col("__l")) & (F.col("cell") == F.col("__c"))
    hit = asked.join(held, on & ((F.col("level") >= 0) | F.col("__ts").between(F.col("__a"), F.col("__z"))), "left_semi").select(*KEY).distinct()
    return extended.join(hit, KEY, "left_semi")


def comparable(extended: DataFrame, commits: DataFrame) -> DataFrame:
    """Sessions whose repository has any commit."""
    return extended.join(commits.select("repo").distinct(), "repo", "left_semi").select(extended.columns)


def without_output(extended: DataFrame, commits: DataFrame, idle_us: int) -> DataFrame:
    return comparable(extended, commits).join(with_output(extended, commits, idle_us).select(*KEY), KEY, "left_anti")


def with_role(intervals: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds ``is_subagent`` and the session's place; an unknown session counts as foreground.

    Of sessions that share a key the one with the highest ``ord`` gives the role.
    """
    have = [c for c in ("cwd", "repo", "root") if c not in intervals.columns]
    kept = ["is_subagent", *have]
    last = F.max_by(F.struct(*kept), "ord") if "ord" in sessions.columns else F.first(F.struct(*kept))
    # Dealt by the join's key first, so that one sort serves the choice and the join.
    roles = sessions.select(*KEY, *kept, *(["ord"] if "ord" in sessions.columns else [])).repartition(*KEY).groupBy(*KEY).agg(last.alias("__s")).select(*KEY, *[F.col(f"__s.{c}") for c in kept])
    met = intervals.join(roles, KEY, "left")
    return met.withColumn("is_subagent", F.coalesce("is_subagent", F.lit(False)))


def token_records(tokens: DataFrame, sessions: DataFrame) -> DataFrame:
    return tokens.join(sessions.select(*KEY, "cwd", "repo", "root").repartition(*KEY).dropDuplicates(KEY), KEY)


def seconds_by_label(repos: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Report seconds summed by repository label, 0 where the report has none."""
    sums = rows.groupBy("repo").agg(*[F.sum(c).alias(c) for c in columns])
    met = repos.join(sums, "repo", "left")
    return met.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def first_match(df: DataFrame, side: DataFrame, keys: list[tuple[str, str]], columns: list[str]) -> DataFrame:
    """Columns of the first of several keys that finds a row: ``(own column, side column)`` in order."""
    out = df
    for i, (own, other) in enumerate(keys):
        one = side.where(F.col(other).isNotNull()).groupBy(F.col(other).alias(f"__k{i}")).agg(*[F.first(c).alias(f"__{i}_{c}") for c in columns])
        out = out.join(one, F.col(own) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    merged = {c: F.coalesce(*[F.col(f"__{i}_{c}") for i in range(len(keys))]) for c in columns}
    return out.withColumns(merged).drop(*[f"__{i}_{c}" for i in range(len(keys)) for c in columns])


def legacy_unless_new(legacy: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """Old-style rows only of sessions without new-style ones."""
    return legacy.join(new.select(key).distinct(), key, "left_anti")


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "cwd", root: str = "root_path") -> DataFrame:
    """The deepest root that a path is in. Each path is spread to its ancestors, so it is an equi-join."""
    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    spread = paths.select(path).distinct().select(path, F.posexplode(up).alias("__depth", "__at"))
    best = spread.join(roots.select(root).distinct(), F.col("__at") == F.col(root)).groupBy(path).agg(F.max_by(root, "__depth").alias(root))
    return paths.join(best, path, "left")
