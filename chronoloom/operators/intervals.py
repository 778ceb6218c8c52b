"""The temporal algebra: fills, gap-capped intervals, priority sweep, unions, splits, work blocks.

Relations carry ``provider, session_id`` as the session key. Intervals have ``start`` and
``end`` timestamps, half-open. Global timelines (work blocks, unions) are never sorted in
one task: rows are dealt to calendar buckets, each bucket is ordered by itself, and only
one row per bucket (its first and last instants) meets in a single window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import UNKNOWN
from ..functions.times import local_midnight, plus_micros

KEY = ["provider", "session_id"]
BUCKET = "hour"


def us(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


# Sessions: models and gap-capped intervals.


#: Calendar unit of the chunks of a session that are folded side by side.
CHUNK = "day"


def _told(points: DataFrame, unit: str) -> DataFrame:
    """Points with their filled model and ``__next``, the instant of the point after.

    A session is folded in calendar chunks, each by itself; one row a chunk (its first instant,
    its first and last known model) carries what the chunks hand to each other. So a session
    that never ends is as many tasks as it has days.
    """
    known = F.when(F.col("model") != UNKNOWN, F.col("model"))
    # One exchange serves the order within chunks and what they hand on.
    dealt = points.withColumn("__b", F.date_trunc(unit, "ts")).repartition(*KEY, "__b")
    order = Window.partitionBy(*KEY, "__b").orderBy("ts", "ord")
    near = dealt.withColumns(
        {
            "__before": F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "__after": F.first(known, True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "__next": F.lead("ts").over(order),
        }
    )
    place = F.when(known.isNotNull(), F.struct("ts", "ord"))
    chunks = dealt.groupBy(*KEY, "__b").agg(
        F.min("ts").alias("lo"), F.min_by("model", place).alias("first_known"), F.max_by("model", place).alias("last_known")
    )
    chain = Window.partitionBy(*KEY).orderBy("__b")
    handed = chunks.select(
        *KEY, "__b",
        F.last("last_known", True).over(chain.rowsBetween(Window.unboundedPreceding, -1)).alias("__from"),
        F.first("first_known", True).over(chain.rowsBetween(1, Window.unboundedFollowing)).alias("__to"),
        F.lead("lo").over(chain).alias("__ahead"),
    )
    met = near.join(handed, [*KEY, "__b"])
    filled = met.withColumns({"model": F.coalesce("__before", "__from", "__after", "__to", F.lit(UNKNOWN)), "__next": F.coalesce("__next", "__ahead")})
    return filled.drop("__b", "__before", "__from", "__after", "__to", "__ahead")


def nearest_models(points: DataFrame, unit: str = CHUNK) -> DataFrame:
    """Each point's model: the last known at or before it, else the next known, else unknown."""
    return _told(points, unit).drop("__next").select(points.columns)


def model_at(human: DataFrame, points: DataFrame) -> DataFrame:
    """Human points take the filled model of the last activity point at their own timestamp."""
    filled = nearest_models(points).groupBy(*KEY, "ts").agg(F.max_by("model", "ord").alias("__model"))
    met = human.join(filled, [*KEY, "ts"], "left")
    return met.withColumn("model", F.coalesce("__model", "model")).drop("__model")


def gap_intervals(points: DataFrame, cap_us: int, unit: str = CHUNK) -> DataFrame:
    """From each point to the next, at most ``cap_us`` long, with the point's filled model.

    Of points at one instant only the last opens an interval. ``idx`` ranks the ranges.
    """
    ranged = _told(points, unit).where(F.col("__next") > F.col("ts"))
    return ranged.select(
        *KEY,
        F.col("ts").alias("start"),
        F.least("__next", plus_micros(F.col("ts"), cap_us)).alias("end"),
        "model",
        F.col("ord").alias("idx"),
    )


def session_spans(points: DataFrame, exact: DataFrame, cap_us: int, unit: str = CHUNK) -> DataFrame:
    """What ``session_intervals`` covers, without models and not made disjoint: capped ranges and exact intervals.

    Within a chunk the next instant is a row's lead; from a chunk's last instant on it is the next chunk's first.
    """
    dealt = points.select(*KEY, "ts", F.date_trunc(unit, "ts").alias("__b")).repartition(*KEY, "__b")
    inside = dealt.select(*KEY, "ts", F.lead("ts").over(Window.partitionBy(*KEY, "__b").orderBy("ts")).alias("__next"))
    chunks = dealt.groupBy(*KEY, "__b").agg(F.min("ts").alias("lo"), F.max("ts").alias("ts"))
    across = chunks.select(*KEY, "ts", F.lead("lo").over(Window.partitionBy(*KEY).orderBy("__b")).alias("__next"))
    ranges = inside.unionByName(across).where(F.col("__next") > F.col("ts"))
    capped = ranges.select(*KEY, F.col("ts").alias("start"), F.least("__next", plus_micros(F.col("ts"), cap_us)).alias("end"))
    return capped.unionByName(exact.where(F.col("end") > F.col("start")).select(*KEY, "start", "end"))


def coalesced(intervals: DataFrame) -> DataFrame:
    """Touching intervals of one model in one session become one (input: disjoint in a session)."""
    order = Window.partitionBy(*KEY).orderBy("start")
    new = F.coalesce((F.lag("end").over(order) != F.col("start")) | (F.lag("model").over(order) != F.col("model")), F.lit(True))
    run = F.sum(new.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = intervals.withColumn("__run", run).groupBy(*KEY, "__run", "model")
    return runs.agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run").select(*KEY, "start", "end", "model")


def _pieces(df: DataFrame, unit: str = BUCKET) -> DataFrame:
    """Intervals cut at bucket boundaries; adds ``bucket``."""
    last = F.date_trunc(unit, plus_micros(F.col("end"), -1))
    step = F.expr(f"INTERVAL 1 {unit}")
    each = df.withColumn("bucket", F.explode(F.sequence(F.date_trunc(unit, "start"), last, step)))
    return each.withColumn("start", F.greatest("start", "bucket")).withColumn("end", F.least(F.col("end"), F.col("bucket") + step))


def priority_sweep(ranges: DataFrame, exact: DataFrame) -> DataFrame:
    """Disjoint segments of a session's point ranges and exact intervals.

    Where several cover a moment the winner has a known model, then the later start, then
    the higher place (exact intervals come after ranges). Point ranges alone are disjoint,
    so sessions without exact intervals skip the sweep. The stabbing join is on session
    and calendar bucket, so a long session does not meet itself whole.
    """
    exact = exact.where(F.col("end") > F.col("start"))
    busy = exact.select(*KEY).distinct()
    quiet = ranges.join(busy, KEY, "left_anti").select(*KEY, "start", "end", "model")
    both = ranges.join(busy, KEY, "left_semi").select(*KEY, "start", "end", "model", F.lit(0).alias("kind"), "idx").unionByName(
        exact.select(*KEY, "start", "end", "model", F.lit(1).alias("kind"), F.col("ord").alias("idx"))
    )
    rank = F.struct(F.col("model") != UNKNOWN, F.col("start"), F.col("kind"), F.col("idx")).alias("rank")
    cut = _pieces(both.select(*KEY, "start", "end", "model", rank))
    marks = cut.select(*KEY, "bucket", F.explode(F.array("start", "end")).alias("t")).distinct()
    lead = F.lead("t").over(Window.partitionBy(*KEY, "bucket").orderBy("t"))
    segments = marks.withColumn("until", lead).where("until IS NOT NULL")
    met = segments.join(cut, [*KEY, "bucket"]).where((F.col("start") <= F.col("t")) & (F.col("end") >= F.col("until")))
    won = met.groupBy(*KEY, "bucket", "t", "until").agg(F.max_by("model", "rank").alias("model"))
    swept = won.select(*KEY, F.col("t").alias("start"), F.col("until").alias("end"), "model")
    return coalesced(quiet.unionByName(swept))


def stabbed(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """(KEY, range_ord, point_ord): which points lie in which half-open ranges of their session.

    Ranges are cut at bucket boundaries and met by the point's bucket, so neither a long
    session nor a long range meets a session's points whole.
    """
    cut = _pieces(ranges.where(F.col("end") > F.col("start")).select(*KEY, "start", "end", F.col("ord").alias("range_ord")))
    marks = points.select(*KEY, "ts", F.col("ord").alias("point_ord"), F.date_trunc(BUCKET, "ts").alias("bucket"))
    met = cut.join(marks, [*KEY, "bucket"]).where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    return met.select(*KEY, "range_ord", "point_ord")


def session_intervals(points: DataFrame, exact: DataFrame, cap_us: int) -> DataFrame:
    return priority_sweep(gap_intervals(points, cap_us), exact)


# Windows, unions and calendars.


def reaching(intervals: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Intervals with any part in [since, until), whole: who wins a moment depends on their own starts."""
    if since is not None:
        intervals = intervals.where(F.col("end") > since)
    return intervals if until is None else intervals.where(F.col("start") < until)


def clipped(intervals: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Intervals within [since, until); empty ones go."""
    if since is not None:
        intervals = intervals.withColumn("start", F.greatest(F.col("start"), since))
    if until is not None:
        intervals = intervals.withColumn("end", F.least(F.col("end"), until))
    return intervals.where(F.col("end") > F.col("start"))


def union_islands(intervals: DataFrame, keys: list[str] | tuple[str, ...] = (), unit: str = BUCKET) -> DataFrame:
    """Islands (bucket, start, end) of each key's union, cut at bucket boundaries."""
    cut = _pieces(intervals.where(F.col("end") > F.col("start")).select(*keys, "start", "end"), unit)
    order = Window.partitionBy(*keys, "bucket").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > reach, F.lit(True)).cast("long")
    marked = cut.withColumn("__new", new)
    run = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = marked.withColumn("__run", run).groupBy(*keys, "bucket", "__run")
    return runs.agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")


def union_micros(intervals: DataFrame, keys: list[str] | tuple[str, ...] = (), unit: str = BUCKET) -> DataFrame:
    """Length of each key's union. Buckets are disjoint, so their lengths add up exactly.

    In order of starts each interval adds what reaches beyond all before it, so no islands are numbered.
    """
    cut = _pieces(intervals.where(F.col("end") > F.col("start")).select(*keys, "start", "end"), unit)
    order = Window.partitionBy(*keys, "bucket").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    added = us("end") - us(F.greatest("start", "__reach"))
    each = cut.withColumn("__reach", reach).select(*keys, F.greatest(added, F.lit(0)).alias("__us"))
    return each.groupBy(*keys).agg(F.coalesce(F.sum("__us"), F.lit(0)).cast("long").alias("union_us"))


def sum_micros() -> Column:
    return F.coalesce(F.sum(us("end") - us("start")), F.lit(0)).cast("long")


def calendar_split(intervals: DataFrame, unit: str, name: str | None = None) -> DataFrame:
    """Intervals cut at local day or month boundaries; the key column is named ``name``."""
    name = name or unit
    date = lambda ts: F.to_date(F.date_trunc(unit, ts))
    last = date(plus_micros(F.col("end"), -1))
    step = F.expr("INTERVAL 1 DAY" if unit == "day" else "INTERVAL 1 MONTH")
    each = intervals.where(F.col("end") > F.col("start")).withColumn("__d", F.explode(F.sequence(date(F.col("start")), last, step)))
    after = F.date_add("__d", 1) if unit == "day" else F.add_months("__d", 1)
    cut = each.withColumn("start", F.greatest(F.col("start"), local_midnight(F.col("__d")))).withColumn(
        "end", F.least(F.col("end"), local_midnight(after))
    )
    pattern = "yyyy-MM-dd" if unit == "day" else "yyyy-MM"
    return cut.withColumn(name, F.date_format("__d", pattern)).drop("__d")


#: Widths of the cells of ``dyadic_cells``: the widest is 2 ** (LEVELS - 1).
LEVELS = 20


def dyadic_cells(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """The range [low, high) of whole numbers as (level, cell)s; a cell is ``cell << level`` and as wide as ``1 << level``.

    At most two cells a width, so a range has about twice the logarithm of its length.
    """
    up = lambda k: F.negate(F.call_function("shiftright", F.negate(low), k))
    down = lambda k: F.call_function("shiftright", high, k)
    odd = lambda c: F.pmod(c, F.lit(2)) == 1
    cell = lambda k, c: F.struct(k.cast("int").alias("level"), c.cast("long").alias("cell"))

    def at(k: Column) -> Column:
        left, right = F.when(odd(up(k)), cell(k, up(k))), F.when(odd(down(k)), cell(k, down(k) - 1))
        return F.when(up(k) < down(k), F.array_compact(F.array(left, right))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))

    last = F.lit(levels - 1)
    rest = F.when(up(last) < down(last), F.transform(F.sequence(up(last), down(last) - 1), lambda c: cell(last, c)))
    most = F.coalesce(rest, F.array().cast("array<struct<level:int,cell:bigint>>"))
    return F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 2)), at)), most)


# Sessions' extents and edges.


def moments(points: DataFrame, exact: DataFrame, human: DataFrame) -> DataFrame:
    """All instants of sessions; ``rank`` orders those of one instant: points, interval ends, human points."""
    a = points.select(*KEY, "ts", "model", F.struct(F.lit(0).alias("k"), F.col("ord").alias("o"), F.lit(0).alias("e")).alias("rank"))
    b = exact.select(
        *KEY, F.posexplode(F.array("start", "end")).alias("e", "ts"), "model", "ord"
    ).select(*KEY, "ts", "model", F.struct(F.lit(1).alias("k"), F.col("ord").alias("o"), F.col("e")).alias("rank"))
    c = human.select(*KEY, "ts", "model", F.struct(F.lit(2).alias("k"), F.col("ord").alias("o"), F.lit(0).alias("e")).alias("rank"))
    return a.unionByName(b).unionByName(c)


def extents(points: DataFrame, exact: DataFrame, human: DataFrame) -> DataFrame:
    """first_seen and last_seen of every session."""
    return moments(points, exact, human).groupBy(*KEY).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def file_range(points: DataFrame, exact: DataFrame, human: DataFrame, tokens: DataFrame) -> DataFrame:
    """The same with token events, as a source file's time range is kept."""
    all_ = moments(points, exact, human).select(*KEY, "ts").unionByName(tokens.select(*KEY, "ts"))
    return all_.groupBy(*KEY).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def _end_models() -> list[Column]:
    least = F.struct(us("ts").alias("t"), F.col("rank").alias("r"))
    latest = F.struct((-us("ts")).alias("t"), F.col("rank").alias("r"))
    return [F.min_by("model", least).alias("first_model"), F.min_by("model", latest).alias("last_model")]


def session_ends(points: DataFrame, exact: DataFrame, human: DataFrame) -> DataFrame:
    """Every session's extent, the models at its ends and ``own_model``, that of its first point in the order of points.

    Moments are dealt by session before they are summed up: most sessions have few of them in a task.
    """
    of_point = F.col("rank.k") == 0
    dealt = moments(points, exact, human).repartition(*KEY)
    return dealt.groupBy(*KEY).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), *_end_models(),
        F.min_by(F.when(of_point, F.col("model")), F.when(of_point, F.col("rank.o"))).alias("own_model"),
    )


def session_edges(sessions: DataFrame, points: DataFrame, exact: DataFrame, human: DataFrame) -> DataFrame:
    """First and, if another instant, last moment of each foreground session, as signals."""
    foreground = sessions.where(~F.col("is_subagent"))
    ends = (
        moments(points, exact, human)
        .join(foreground.select(*KEY), KEY, "left_semi")
        .groupBy(*KEY)
        .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), *_end_models())
    )
    return edges_of(ends)


def edges_of(ends: DataFrame) -> DataFrame:
    """The edges of sessions whose extents and models are known."""
    ends = ends.withColumnsRenamed({"first_seen": "first", "last_seen": "last"})
    edge = lambda place, ts, model: F.struct(F.lit(place).alias("place"), F.col(ts).alias("ts"), F.col(model).alias("model"))
    both = F.when(F.col("first") == F.col("last"), F.array(edge(0, "first", "first_model"))).otherwise(
        F.array(edge(0, "first", "first_model"), edge(1, "last", "last_model"))
    )
    rows = ends.select(*KEY, F.inline(both))
    return rows.withColumn("kind", F.concat("provider", F.lit("_session_edge"))).withColumn("ord", F.col("place").cast("long")).drop("place")


SIGNAL = ["ts", *KEY, "cwd", "repo", "root", "kind", "model", "load"]


def _load(late: int, *cols: str | Column) -> Column:
    return F.struct(F.lit(late).alias("late"), *[F.col(c) if isinstance(c, str) else c for c in cols]).alias("load")


def session_signals(sessions: DataFrame, human: DataFrame, edges: DataFrame) -> DataFrame:
    """Prompts and edges of foreground sessions."""
    where = sessions.where(~F.col("is_subagent")).select(*KEY, "cwd", "repo", "root")
    prompts = human.select(*KEY, "ts", "model", F.concat("provider", F.lit("_prompt")).alias("kind"), "ord", F.lit(0).alias("part"))
    edges = edges.withColumn("part", F.lit(1))
    spoken = prompts.unionByName(edges.select(prompts.columns)).join(where, KEY)
    return spoken.select("ts", *KEY, "cwd", "repo", "root", "kind", "model", _load(0, *KEY, "part", "ord"))


def commit_signals(commits: DataFrame) -> DataFrame:
    """Human commits; a projection of them, which needs no keeping where they are kept."""
    return commits.where(~F.col("agent_authored")).select(
        "ts", F.lit("git").alias("provider"), F.col("sha").alias("session_id"), "cwd", "repo", "root",
        F.lit("commit").alias("kind"), F.lit("—").alias("model"),
        _load(1, F.lit("git").alias("provider"), F.col("sha").alias("session_id"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord")),
    )


def human_signals(sessions: DataFrame, points: DataFrame, exact: DataFrame, human: DataFrame, commits: DataFrame) -> DataFrame:
    """Prompts and edges of foreground sessions, and human commits.

    ``load`` orders signals as they are loaded: by session, its prompts, its edges, then commits.
    """
    return session_signals(sessions, human, session_edges(sessions, points, exact, human)).unionByName(commit_signals(commits))


# Work blocks.


def signal_priority(kind: Column) -> Column:
    return F.when(kind.endswith("_prompt"), 3).when(kind == "commit", 2).otherwise(1)


def one_per_instant(signals: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The strongest signal of each instant; the one loaded first of equals. ``by`` is a function of the instant."""
    names = [c for c in signals.columns if c not in ("ts", *by)]
    best = F.min_by(F.struct(*names), F.struct((-signal_priority(F.col("kind"))).alias("p"), F.col("load").alias("l")))
    return signals.groupBy(*by, "ts").agg(best.alias("s")).select(*by, "ts", *[F.col(f"s.{c}").alias(c) for c in names])


def work_blocks(signals: DataFrame, idle_us: int, unit: str = BUCKET) -> DataFrame:
    """One row per instant with its block's number, in time order, and the instants beside it.

    A block ends where the next signal comes more than ``idle_us`` later. Instants are
    ordered within calendar buckets; a table of one row per bucket (its ends and the blocks
    that open within it) links the buckets and carries the numbers on. The exchange by bucket
    serves the choice of each instant's signal too.
    """
    dealt = one_per_instant(signals.withColumn("__b", F.date_trunc(unit, "ts")).repartition("__b"), ("__b",))
    order = Window.partitionBy("__b").orderBy("ts")
    near = dealt.withColumn("prev_ts", F.lag("ts").over(order)).withColumn("next_ts", F.lead("ts").over(order))
    opens = F.coalesce(us("ts") - us("prev_ts") > idle_us, F.lit(False))
    run = F.sum(opens.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = near.withColumn("__run", run)
    buckets = near.groupBy("__b").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.max("__run").alias("n"))
    chain = Window.orderBy("__b")
    linked = buckets.withColumn("__before", F.lag("hi").over(chain)).withColumn("__after", F.lead("lo").over(chain))
    # A bucket's first instant goes on with the block of the last one before it, or opens one.
    first = F.coalesce((us("lo") - us("__before") > idle_us).cast("long"), F.lit(1))
    opened = linked.withColumn("__first", first)
    through = F.sum(F.col("__first") + F.col("n")).over(chain.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bases = opened.select("__b", "__before", "__after", (through - F.col("n") - 1).alias("__base"))
    met = near.join(bases, "__b").withColumn("block", F.col("__base") + F.col("__run"))
    met = met.withColumn("prev_ts", F.coalesce("prev_ts", "__before")).withColumn("next_ts", F.coalesce("next_ts", "__after"))
    return (
        met.withColumn("opens", F.coalesce(us("ts") - us("prev_ts") > idle_us, F.lit(True)))
        .withColumn("closes", F.coalesce(us("next_ts") - us("ts") > idle_us, F.lit(True)))
        .drop("__before", "__after", "__base", "__run", "__b")
    )


def human_intervals(signals: DataFrame, idle_us: int, credit_us: int, unit: str = BUCKET) -> DataFrame:
    """Each signal's share of its block: from midpoint to midpoint, with credit at the block's ends.

    Credit stops at the local midnights around the block's first and last day.
    """
    blocks = work_blocks(signals, idle_us, unit)
    half = credit_us // 2
    day = F.to_date("ts")
    first = F.greatest(plus_micros(F.col("ts"), -half), local_midnight(day))
    last = F.least(plus_micros(F.col("ts"), half), local_midnight(F.date_add(day, 1)))
    middle = lambda a, b: F.timestamp_micros(us(a) + F.expr(f"(unix_micros({b}) - unix_micros({a})) div 2"))
    out = blocks.withColumn("start", F.when(F.col("opens"), first).otherwise(middle("prev_ts", "ts"))).withColumn(
        "end", F.when(F.col("closes"), last).otherwise(middle("ts", "next_ts"))
    )
    return out.where(F.col("end") > F.col("start")).select(
        "start", "end", "provider", "model", F.concat(F.lit("work-block:"), F.col("block")).alias("session_id"), "cwd", "repo", "root", "block"
    )
