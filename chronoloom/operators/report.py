"""The grouped report and its summary.

Every relation is aggregated by the dimensions on its own; the small aggregates are
united and summed. Raw rows of different relations never meet, so nothing fans out, and
every exchange carries partial sums. Distinct counts are exact.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bounded_key, display_model
from ..functions.times import calendar_days, iso, local_day, local_month, round3, seconds
from ..session import kept, released
from . import filters, joins
from .intervals import (
    KEY,
    calendar_split,
    clipped,
    commit_signals,
    edges_of,
    extents,
    gap_intervals,
    human_intervals,
    one_per_instant,
    priority_sweep,
    reaching,
    session_ends,
    session_signals,
    session_spans,
    sum_micros,
    union_micros,
    us,
)

TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]


def commit_stats(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Commits with their counted and ignored lines; commits without a file are dropped.

    All rows of a sha get the same lines, so rows can be chosen before they are met.
    """
    counted = ~F.col("is_ignored")
    sums = files.groupBy("sha").agg(
        *[F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(f"{name}{c}") for name, cond in (("", counted), ("ignored_", ~counted)) for c in ("additions", "deletions")],
        F.sum(counted.cast("long")).alias("file_count"),
    )
    return commits.join(sums, "sha")


def one_row_per_commit(commits: DataFrame) -> DataFrame:
    """One row for each sha; the agent's side wins over the human one."""
    best = Window.partitionBy("sha").orderBy(*[F.col(c).desc() for c in ("agent_authored", "cwd", "repo", "root", "ts") if c in commits.columns])
    # Dealt by the key that sums are met by, so that one sort serves the choice and the join.
    return commits.repartition("sha").withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


class Activity:
    """A report's relations after window and filters, each planned when it is first asked for.

    ``spans`` and ``dated_commits`` are intervals without models and commits without lines, for what
    needs no more; where ``intervals`` or ``all_commits`` are there already, they are those.
    Sessions with their ends, intervals, commits, sessions' signals and quiet sessions are read by several exchanges each and so
    computed once and kept; all others stay plans, commits' signals too, which are a projection.
    Signals are cut to the window before blocks are built. ``release`` frees what is kept.
    """

    def __init__(self, tables, cap_us: int, idle_us: int, credit_us: int, since: Column | None = None, until: Column | None = None):
        self.tables, self.points = tables, tables.points
        self.cap_us, self.idle_us, self.credit_us = cap_us, idle_us, credit_us
        self.since, self.until = since, until
        self._held: list[DataFrame] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        self._held.append(kept(df))
        return self._held[-1]

    def prepared(self, *names: str) -> None:
        """Compute relations that are kept side by side: none of them fills a cluster to its end."""
        with ThreadPoolExecutor(max(len(names), 1)) as pool:
            list(pool.map(lambda name: getattr(self, name), names))

    def release(self) -> None:
        for df in self._held:
            released(df)

    def _inside(self, df: DataFrame, ts: str = "ts") -> DataFrame:
        return filters.in_window(df, self.since, self.until, ts)

    @cached_property
    def sessions(self) -> DataFrame:
        return self.tables.sessions.select(*KEY, "cwd", "repo", "root", "is_subagent")

    @property
    def _of_sessions(self) -> DataFrame:
        """The sessions from where they are kept, if they are."""
        return self.placed.select(self.sessions.columns) if "placed" in self.__dict__ else self.sessions

    @cached_property
    def seen(self) -> DataFrame:
        return self.sessions.join(extents(self.points, self.tables.exact, self.tables.human), KEY)

    @cached_property
    def placed(self) -> DataFrame:
        """Sessions with what their moments say, those without any too."""
        return self._keep(self.sessions.join(session_ends(self.points, self.tables.exact, self.tables.human), KEY, "left"))

    @cached_property
    def known(self) -> DataFrame:
        """``seen``, for what reads it several times."""
        return self.placed.where("first_seen IS NOT NULL").drop("first_model", "last_model", "own_model")

    @cached_property
    def intervals(self) -> DataFrame:
        # The sweep reads ranges several times; what does not reach into the window has no part in it.
        ranges = self._keep(reaching(gap_intervals(self.points, self.cap_us), self.since, self.until))
        raw = clipped(priority_sweep(ranges, reaching(self.tables.exact, self.since, self.until)), self.since, self.until)
        return self._keep(joins.with_role(raw, self._of_sessions))

    @cached_property
    def spans(self) -> DataFrame:
        if "intervals" in self.__dict__:
            return self.intervals
        raw = clipped(session_spans(self.points, self.tables.exact, self.cap_us), self.since, self.until)
        return self._keep(joins.with_role(raw, self._of_sessions))

    @cached_property
    def all_commits(self) -> DataFrame:
        # Chosen and cut to the window before lines are met.
        return self._keep(commit_stats(one_row_per_commit(self.tables.commits).transform(self._inside), self.tables.files))

    @cached_property
    def dated_commits(self) -> DataFrame:
        if "all_commits" in self.__dict__:
            return self.all_commits
        with_files = self.tables.commits.join(self.tables.files.select("sha").distinct(), "sha", "left_semi")
        return self._keep(self._inside(one_row_per_commit(with_files)))

    @property
    def own_commits(self) -> DataFrame:
        """``commits``, their lines perhaps left out."""
        return self.dated_commits.where(~F.col("agent_authored"))

    @cached_property
    def commits(self) -> DataFrame:
        return self.all_commits.where(~F.col("agent_authored"))

    @cached_property
    def agent_commits(self) -> DataFrame:
        return self.all_commits.where("agent_authored")

    @cached_property
    def files(self) -> DataFrame:
        return self.tables.files.join(self.own_commits.select("sha", "ts", "repo", "cwd", "root"), "sha")

    @cached_property
    def spoken(self) -> DataFrame:
        # Of sessions that share a key each has its place, but the key has one pair of edges.
        edges = edges_of(self.placed.where("NOT is_subagent AND first_seen IS NOT NULL").dropDuplicates(KEY))
        return self._keep(self._inside(session_signals(self.placed, self.tables.human, edges)))

    @cached_property
    def signals(self) -> DataFrame:
        return self.spoken.unionByName(commit_signals(self.own_commits))

    @cached_property
    def human(self) -> DataFrame:
        # Of commits at one instant one alone can be its signal; it is chosen before any of them moves.
        signals = self.spoken.unionByName(one_per_instant(commit_signals(self.own_commits)).select(self.spoken.columns))
        return clipped(human_intervals(signals, self.idle_us, self.credit_us), self.since, self.until)

    @cached_property
    def tokens(self) -> DataFrame:
        return self._inside(joins.token_records(self.tables.tokens, self._of_sessions))

    @cached_property
    def quiet(self) -> DataFrame:
        """Sessions first seen in the window that have no interval in it, with their first point's own model."""
        seen = self._inside(self.placed.where("first_seen IS NOT NULL"), "first_seen")
        without = seen.join(self.spans.select(*KEY).distinct(), KEY, "left_anti")
        return self._keep(without.withColumn("model", F.coalesce("own_model", F.lit("unknown"))).drop("first_model", "last_model", "own_model"))


def activity(
    tables, cap_us: int, idle_us: int, credit_us: int, since: Column | None = None, until: Column | None = None
) -> Activity:
    return Activity(tables, cap_us, idle_us, credit_us, since, until)


def _keyed(df: DataFrame, dims, **values: Column) -> DataFrame:
    """Adds ``d_<dimension>`` columns; ``values`` overrides where a column of that name is not the value."""
    return df.withColumns({f"d_{d}": bounded_key(values[d] if d in values else F.col(d)) for d in dims})


def _at(ts: str) -> dict[str, Column]:
    return {"day": local_day(F.col(ts)), "month": local_month(F.col(ts))}


def keyed_intervals(df: DataFrame, dims) -> DataFrame:
    unit = next((d for d in dims if d in ("day", "month")), None)
    return _keyed(calendar_split(df, unit) if unit else df, dims)


def keyed_commits(df: DataFrame, dims) -> DataFrame:
    """Commits name no model; their provider says whose they are, if the relation knows."""
    own = F.when(F.col("agent_authored"), "git-agent").otherwise("git") if "agent_authored" in df.columns else F.lit("git")
    return _keyed(df, dims, provider=own, model=F.lit("—"), **_at("ts"))


def keyed_moments(df: DataFrame, dims, ts: str = "ts") -> DataFrame:
    return _keyed(df, dims, **_at(ts))


def zero_sessions(act: Activity) -> DataFrame:
    return act.quiet


def eligible_sessions(act: Activity) -> DataFrame:
    """Sessions with an interval in the window, or first seen in it."""
    inside = filters.in_window(act.known, act.since, act.until, "first_seen").select(*KEY)
    keys = act.spans.select(*KEY).union(inside).distinct()
    return act.known.join(keys, KEY, "left_semi")


def _count(*cols: str) -> Column:
    parts = [F.col(c) for c in cols]
    return F.count_distinct(parts[0] if len(parts) == 1 else F.struct(*parts))


_NUMBERS = [
    "active_us", "wall_us", "human_us", "human_signal_count", "work_block_count", "session_count",
    "foreground_session_count", "subagent_session_count", "commit_count", "file_count", "additions", "deletions",
    "ignored_additions", "ignored_deletions", "agent_commit_count", "agent_additions", "agent_deletions",
    "ai_assisted_commit_count", "autofix_assisted_commit_count", *TOKENS, "active_days", "human_active_days",
]


#: Parts of a report: each has metrics of its own, and its relations are read only where it is asked for.
PARTS = ("intervals", "wall", "human", "signals", "zero", "commits", "files", "agents", "tokens", "days", "names")
#: Parts that only make up the columns of a row order: human and wall time, number of commits, and the rows of all other parts.
ORDER_PARTS = ("wall", "human", "made", "rows")


def _session_days(act: Activity, dims, keys: list[str], wanted: tuple[str, ...]) -> DataFrame:
    """(keys, KEY, is_subagent, model, day, quiet, us, start, end): each session's days, those of quiet sessions too.

    One exchange of partial sums, which sessions, days and names are all taken from.
    """
    at = [*keys, *KEY, "is_subagent", "model"]
    pieces = []
    if not {"intervals", "days", "names"}.isdisjoint(wanted):
        split = calendar_split(keyed_intervals(act.intervals, dims), "day", "__day")
        pieces.append(split.select(*at, "__day", F.lit(False).alias("quiet"), (us("end") - us("start")).alias("us"), "start", "end"))
    if not {"zero", "days", "names"}.isdisjoint(wanted):
        seen = keyed_moments(zero_sessions(act), dims, "first_seen")
        day = local_day(F.col("first_seen")).alias("__day")
        pieces.append(seen.select(*at, day, F.lit(True).alias("quiet"), F.lit(0).cast("long").alias("us"), F.col("first_seen").alias("start"), F.col("first_seen").alias("end")))
    rows = reduce(DataFrame.unionByName, pieces)
    return rows.groupBy(*at, "__day", "quiet").agg(F.sum("us").alias("us"), F.min("start").alias("start"), F.max("end").alias("end"))


_LINES = ("additions", "deletions", "ignored_additions", "ignored_deletions")


def _commit_sums(own: Column, agents: Column) -> list[Column]:
    """Counts and lines of commits, one's own and agents' apart."""
    of = lambda c, who: F.sum(F.when(who, F.col(c)))
    return [
        F.count_if(own).alias("commit_count"), *[of(c, own).alias(c) for c in _LINES],
        F.count_if(own & F.col("agent_assisted")).alias("ai_assisted_commit_count"),
        F.count_if(own & F.col("autofix_assisted")).alias("autofix_assisted_commit_count"),
        F.count_if(agents).alias("agent_commit_count"), *[of(c, agents).alias(f"agent_{c}") for c in ("additions", "deletions")],
    ]


def _parts(act: Activity, dims, wanted: tuple[str, ...] = PARTS) -> list[DataFrame]:
    """Aggregates of each relation by the dimensions, over disjoint metrics.

    Parts that read one relation share one exchange of partial sums by day, which Spark finds
    and reuses.
    """
    keys = [f"d_{d}" for d in dims]
    reads = lambda *of: not {*of}.isdisjoint(wanted)
    range_of = lambda a, b: [F.min(a).alias("first_seen"), F.max(b).alias("last_seen")]
    spans = "intervals" if "model" in dims or reads("intervals", "names") else "spans"
    commits = "all_commits" if reads("commits", "agents") else "dated_commits"
    needs = {
        spans: ("intervals", "active", "wall", "zero", "days", "names", "rows"), commits: ("commits", "agents", "days", "files", "signals", "human", "made"),
        "spoken": ("signals", "human", "rows"), "quiet": ("zero", "days", "names", "rows"), "placed": ("signals", "human", "zero", "days", "names", "rows"),
    }
    for level in (("placed", commits), (spans, "spoken"), ("quiet",)):
        act.prepared(*[name for name in level if reads(*needs[name])])
    sub, out, days = F.col("is_subagent"), [], []
    if "active" in wanted:
        each = union_micros(keyed_intervals(act.spans, dims), [*keys, *KEY])
        out.append(each.groupBy(*keys).agg(F.sum("union_us").alias("active_us")))
    if reads("intervals", "zero", "names"):
        by_day = _session_days(act, dims, keys, wanted)
        shown = [quiet for part, quiet in (("intervals", False), ("zero", True)) if part in wanted]
        if shown:
            each = by_day.where(F.col("quiet").isin(shown)).groupBy(*keys, *KEY, "is_subagent").agg(
                F.sum("us").alias("us"), F.min("start").alias("start"), F.max("end").alias("end")
            )
            roles = [F.count("*").alias("session_count"), F.count_if(~sub).alias("foreground_session_count"), F.count_if(sub).alias("subagent_session_count")]
            active = [F.sum("us").alias("active_us")] if "intervals" in wanted else []
            out.append(each.groupBy(*keys).agg(*active, *roles, *range_of("start", "end")))
        if "names" in wanted:
            named = by_day.groupBy(*keys, "provider", "model").agg(F.lit(1).alias("one"))
            set_of = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
            out.append(named.groupBy(*keys).agg(set_of("provider").alias("providers"), set_of("model").alias("models")))
        days.append(by_day.select(*keys, "__day"))
    elif "days" in wanted:
        pieces = keyed_intervals(act.spans, dims).transform(calendar_split, "day", "__day")
        first = keyed_moments(zero_sessions(act), dims, "first_seen").select(*keys, local_day(F.col("first_seen")).alias("__day"))
        days += [x.select(*keys, "__day").distinct() for x in (pieces, first)]
    if "wall" in wanted:
        out.append(union_micros(keyed_intervals(act.spans, dims), keys).withColumnRenamed("union_us", "wall_us"))
    if "human" in wanted:
        human = keyed_intervals(act.human, dims)
        out.append(human.groupBy(*keys).agg(sum_micros().alias("human_us"), _count("session_id").alias("work_block_count"), *range_of("start", "end")))
    if "signals" in wanted:
        # Distinct signals by day first, so that no aggregate has several distinct counts. Commits have one row each.
        at = [*keys, local_day(F.col("ts")).alias("__day")]
        spoken = keyed_moments(act.spoken, dims).groupBy(*at).agg(_count("ts", "kind", "session_id").alias("n"))
        told = keyed_moments(commit_signals(act.own_commits), dims).groupBy(*at).agg(F.count("*").alias("n"))
        out.append(spoken.unionByName(told).groupBy(*keys).agg(F.sum("n").alias("human_signal_count"), F.count_distinct("__day").alias("human_active_days")))
    if "made" in wanted:
        made = keyed_commits(act.dated_commits, dims).groupBy(*keys)
        out.append(made.agg(F.count_if(~F.col("agent_authored")).alias("commit_count")))
    if "rows" in wanted:
        others = [keyed_moments(act.spoken, dims), keyed_moments(zero_sessions(act), dims, "first_seen"), keyed_moments(act.tokens, dims)]
        out += [x.select(*keys).distinct() for x in others]
    if "days" in wanted and not reads("commits", "agents"):
        days.append(keyed_commits(act.dated_commits, dims).select(*keys, local_day(F.col("ts")).alias("__day")).distinct())
    if reads("commits", "agents"):
        agent = F.col("agent_authored")
        both = keyed_commits(act.all_commits, dims).withColumn("__day", local_day(F.col("ts")))
        own, theirs = (who & F.lit(part in wanted) for who, part in ((~agent, "commits"), (agent, "agents")))
        by_day = both.groupBy(*keys, "agent_authored", "__day").agg(*_commit_sums(own, theirs), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        shown = [who for part, who in (("commits", False), ("agents", True)) if part in wanted]
        if shown:
            sums = [c.name for c in by_day.schema.fields if c.name in _NUMBERS]
            of_shown = by_day.where(F.col("agent_authored").isin(shown))
            out.append(of_shown.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *range_of("first_seen", "last_seen")))
        days.append(by_day.select(*keys, "__day"))
    if "files" in wanted:
        files = keyed_commits(act.files, dims).where(~F.col("is_ignored"))
        out.append(files.groupBy(*keys).agg(_count("path").alias("file_count")))
    if reads("tokens", "days"):
        tokens = keyed_moments(act.tokens, dims).groupBy(*keys, local_day(F.col("ts")).alias("__day"))
        by_day = tokens.agg(*[F.sum(c).alias(c) for c in TOKENS], F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        if "tokens" in wanted:
            out.append(by_day.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in TOKENS], *range_of("first_seen", "last_seen")))
        days.append(by_day.select(*keys, "__day"))
    if "days" in wanted:
        out.append(reduce(DataFrame.union, days).groupBy(*keys).agg(F.count_distinct("__day").alias("active_days")))
    return out


def _ratio(total: Column, n: Column) -> Column:
    return F.when(n > 0, round3(total / F.lit(1_000_000.0) / n)).otherwise(F.lit(0.0))


def grouped_report(act: Activity, dims: tuple[str, ...], parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row for each combination of dimension values with anything in it.

    With some ``parts`` only, metrics of the others are 0 and their rows are not there.
    """
    keys = [f"d_{d}" for d in dims]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _parts(act, dims, parts))
    kinds = {"first_seen": "timestamp", "last_seen": "timestamp", "providers": "string", "models": "string"}
    absent = [c for c in (*_NUMBERS, *kinds) if c not in whole.columns]
    whole = whole.withColumns({c: F.lit(None).cast(kinds.get(c, "long")) for c in absent}) if absent else whole
    n = whole.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _NUMBERS],
        F.min("first_seen").alias("first"),
        F.max("last_seen").alias("last"),
        F.coalesce(F.max("providers"), F.lit("")).alias("providers"),
        F.coalesce(F.max("models"), F.lit("")).alias("models"),
    )
    days = calendar_days(F.col("first"), F.col("last"))
    plain = [c for c in _NUMBERS if not c.endswith("_us")]
    return n.select(
        *[F.col(f"d_{d}").alias(d) for d in dims],
        seconds(F.col("active_us")).alias("active_seconds"),
        seconds(F.col("active_us")).alias("parallel_agent_seconds"),
        seconds(F.col("wall_us")).alias("ai_wall_seconds"),
        seconds(F.col("human_us")).alias("human_estimated_seconds"),
        *plain,
        (F.col("additions") - F.col("deletions")).alias("net_lines"),
        reduce(lambda a, b: a + b, map(F.col, TOKENS)).alias("total_tokens"),
        days.alias("calendar_days"),
        _ratio(F.col("human_us"), F.col("human_active_days")).alias("average_human_seconds_per_active_day"),
        _ratio(F.col("active_us"), F.col("active_days")).alias("average_active_seconds_per_active_day"),
        _ratio(F.col("active_us"), days).alias("average_active_seconds_per_calendar_day"),
        iso(F.col("first")).alias("first_seen"),
        iso(F.col("last")).alias("last_seen"),
        "providers",
        "models",
    )


def row_order(dims: tuple[str, ...]) -> list[Column]:
    """Calendar, human time, wall time, commits, all descending; dimensions break ties."""
    unit = [d for d in ("month", "day") if d in dims]
    by = [*unit, "human_estimated_seconds", "ai_wall_seconds", "commit_count"]
    return [F.col(c).desc() for c in by] + [F.col(d).asc() for d in dims]


def ranked_report(report: DataFrame, dims: tuple[str, ...], top: int = 30) -> DataFrame:
    """The first rows of a report, all of them for 0."""
    ordered = report.orderBy(*row_order(dims))
    return ordered.limit(top) if top else ordered


_SUMMED = [
    "active_us", "wall_us", "human_us", "work_block_count", "human_signal_count", "prompt_signal_count", "foreground_session_edge_signal_count",
    "commit_signal_count", "human_active_days", "session_count", "foreground_session_count", "subagent_session_count",
    "foreground_sessions_with_commits", "commit_count", *_LINES, "ai_assisted_commit_count", "autofix_assisted_commit_count",
    "agent_commit_count", "agent_additions", "agent_deletions", *TOKENS, "active_days",
]
#: Parts of a summary; as in a report, relations are read only where they are asked for.
SUMMARY = ("active", "wall", "human", "signals", "sessions", "output", "commits", "tokens", "days")


def summary(act: Activity, wanted: tuple[str, ...] = SUMMARY) -> DataFrame:
    """The same metrics over everything, in one row. Active days leave token days out here.

    With some parts only, metrics of the others are 0 and the first and last instants are of those parts.
    """
    sub, reads = F.col("is_subagent"), lambda *of: not {*of}.isdisjoint(wanted)
    spans, made = "intervals" if "active" in wanted else "spans", "all_commits" if "commits" in wanted else "dated_commits"
    needs = {
        spans: ("active", "wall", "sessions", "output", "days"), made: ("human", "signals", "output", "commits", "days"),
        "placed": ("human", "signals", "sessions", "output", "days"), "spoken": ("human", "signals"), "quiet": ("days",),
    }
    for level in (("placed", made), (spans, "spoken"), ("quiet",)):
        act.prepared(*[name for name in level if reads(*needs[name])])
    kind, agent = F.col("kind"), F.col("agent_authored")
    ends = lambda what=None: [F.min("a" if what is None else F.when(what, F.col("a"))).alias("first"), F.max("b" if what is None else F.when(what, F.col("b"))).alias("last")]
    parts, days = [], []
    if reads("active", "days"):
        by_day = act.spans.transform(calendar_split, "day", "day").groupBy("day").agg(sum_micros().alias("us"), F.min("start").alias("a"), F.max("end").alias("b"))
        days.append(by_day.select("day"))
        if "active" in wanted:
            parts.append(by_day.agg(F.coalesce(F.sum("us"), F.lit(0)).cast("long").alias("active_us"), *ends()))
    if "wall" in wanted:
        parts.append(union_micros(act.spans).withColumnRenamed("union_us", "wall_us"))
    if "human" in wanted:
        parts.append(act.human.agg(sum_micros().alias("human_us"), _count("session_id").alias("work_block_count"), F.min("start").alias("first"), F.max("end").alias("last")))
    if "signals" in wanted:
        at = [local_day(F.col("ts")).alias("day"), "kind"]
        range_of = [F.min("ts").alias("a"), F.max("ts").alias("b")]
        spoken = act.spoken.groupBy(*at).agg(_count("ts", "session_id").alias("n"), *range_of)
        signals = spoken.unionByName(commit_signals(act.own_commits).groupBy(*at).agg(F.count("*").alias("n"), *range_of))
        parts.append(signals.agg(
            F.sum("n").alias("human_signal_count"),
            F.sum(F.when(kind.endswith("_prompt"), F.col("n"))).alias("prompt_signal_count"),
            F.sum(F.when(kind.endswith("_session_edge"), F.col("n"))).alias("foreground_session_edge_signal_count"),
            F.sum(F.when(kind == "commit", F.col("n"))).alias("commit_signal_count"),
            F.count_distinct("day").alias("human_active_days"),
            *ends(),
        ))
    if "sessions" in wanted:
        parts.append(eligible_sessions(act).select(*KEY, "is_subagent").distinct().agg(
            F.count_distinct(F.struct(*KEY)).alias("session_count"), F.count_if(~sub).alias("foreground_session_count"), F.count_if(sub).alias("subagent_session_count")
        ))
    if "output" in wanted:
        foreground = eligible_sessions(act).where(~sub)
        parts.append(joins.with_output(foreground, act.own_commits, act.idle_us).agg(_count(*KEY).alias("foreground_sessions_with_commits")))
        parts.append(joins.comparable(foreground, act.own_commits).agg(_count(*KEY).alias("comparable")))
    if "days" in wanted and "commits" not in wanted:
        days.append(act.dated_commits.select(local_day(F.col("ts")).alias("day")).distinct())
    if "commits" in wanted:
        commits = act.all_commits.groupBy("agent_authored", local_day(F.col("ts")).alias("day")).agg(
            *_commit_sums(~agent, agent), F.min("ts").alias("a"), F.max("ts").alias("b")
        )
        days.append(commits.select("day"))
        # Commits of one's own are seen through their signals; agents' are not.
        sums = [c.name for c in commits.schema.fields if c.name in _NUMBERS]
        parts.append(commits.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums], *ends(agent)))
    if "tokens" in wanted:
        parts.append(act.tokens.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS]))
    if "days" in wanted:
        days.append(zero_sessions(act).select(local_day(F.col("first_seen")).alias("day")).distinct())
        parts.append(reduce(DataFrame.union, days).agg(F.count_distinct("day").alias("active_days")))
    # Every part is one row; they are laid side by side through one union and one aggregate.
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    absent = [c for c in (*_SUMMED, "comparable", "first", "last") if c not in whole.columns]
    whole = whole.withColumns({c: F.lit(None).cast("timestamp" if c in ("first", "last") else "long") for c in absent}) if absent else whole
    n = whole.agg(*[(F.min if c == "first" else F.max)(c).alias(c) for c in whole.columns])
    plain = [c for c in _SUMMED if not c.endswith("_us")]
    return n.select(
        seconds(F.coalesce("active_us", F.lit(0))).alias("parallel_agent_seconds"),
        seconds(F.coalesce("wall_us", F.lit(0))).alias("agent_wall_seconds"),
        seconds(F.coalesce("human_us", F.lit(0))).alias("human_estimated_seconds"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in plain],
        (F.col("comparable") - F.col("foreground_sessions_with_commits")).alias("foreground_sessions_without_commits"),
        reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in TOKENS]).alias("total_tokens"),
        _ratio(F.coalesce("human_us", F.lit(0)), F.col("human_active_days")).alias("average_human_seconds_per_active_day"),
        iso(F.col("first")).alias("first_seen"),
        iso(F.col("last")).alias("last_seen"),
    )


def seconds_by(intervals: DataFrame, key: str) -> DataFrame:
    return intervals.groupBy(key).agg(seconds(sum_micros()).alias("seconds"))


def tokens_by(tokens: DataFrame, key: str) -> DataFrame:
    return tokens.groupBy(key).agg(F.sum(reduce(lambda a, b: a + b, map(F.col, TOKENS))).alias("tokens"))


def test_to_source(files: DataFrame, keys: list[str]) -> DataFrame:
    """Changed test lines for every changed source line; null where no source line changed."""
    touched = F.col("additions") + F.col("deletions")
    of = lambda name: F.sum(F.when(F.col("category") == name, touched).otherwise(0))
    source = of("source")
    return files.where(~F.col("is_ignored")).groupBy(*keys).agg(round3(F.when(source != 0, of("test") / source)).alias("ratio"))


def trend(printed: DataFrame, period: str) -> DataFrame:
    """Human seconds for each period over the printed rows only."""
    return printed.groupBy(period).agg(round3(F.sum("human_estimated_seconds")).alias("human_estimated_seconds"))


def ranked_models(totals: DataFrame, value: str, most: int = 12) -> DataFrame:
    """Models by total, those without a name as one; the first ``most`` and how many were left out."""
    merged = totals.groupBy(display_model(F.col("model")).alias("model")).agg(F.sum(value).alias(value))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col(value).desc(), "model")
    ranked = merged.withColumn("rank", F.row_number().over(order)).withColumn("omitted", F.greatest(F.count("*").over(Window.partitionBy(F.lit(1))) - most, F.lit(0)))
    return ranked.where(F.col("rank") <= most)


def concurrency(rows: DataFrame) -> DataFrame:
    """Parallel seconds over wall seconds, 0 without wall time."""
    ratio = F.when(F.col("ai_wall_seconds") > 0, round3(F.col("active_seconds") / F.col("ai_wall_seconds"))).otherwise(F.lit(0.0))
    return rows.withColumn("concurrency", ratio)


def merged_diagnostics(diagnostics: DataFrame, counters: list[str], most: int = 100) -> DataFrame:
    """Counters added up; the first messages with their true number. Input: ``ord, <counters>, messages``."""
    sums = diagnostics.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters], F.coalesce(F.sum(F.size("messages")), F.lit(0)).cast("long").alias("warning_count"))
    first = diagnostics.select("ord", F.posexplode("messages").alias("at", "message")).orderBy("ord", "at").limit(most)
    kept = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "at", "message"))), lambda m: m["message"]).alias("messages"))
    tagged = sums.withColumn("messages", F.lit(None).cast("array<string>")).unionByName(kept, allowMissingColumns=True)
    return tagged.agg(*[F.max(c).alias(c) for c in (*counters, "warning_count")], F.first("messages", True).alias("messages"))
