"""Command line: report, classify, sources, record."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions.names import AGENT_AUTHORS, author_matches, basic_regex_literal
from .functions.paths import MAX_RULES, RootRule
from .functions.times import iso
from .operators import classify
from .operators.report import trend
from .plans.build import build, filtered_sessions, relations
from .plans.spec import ReportSpec, bound_date, grouping, month_span, year_span
from .session import kept, scratch, session
from .sources import databases, discover, events, git, inventory, manifest, records, transcripts
from .sources.lines import DIAGNOSTIC, EXACT, POINT, SESSION, TOKEN, History, empty, literal_paths, union

_READERS = {
    "claude": transcripts.claude, "pi": transcripts.pi, "gemini": transcripts.gemini, "copilot": transcripts.copilot,
    "copilot-vscode": transcripts.vscode, "codex": transcripts.codex, "opencode": databases.opencode, "events": events.read,
}


def load_config(path: str | None) -> dict:
    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def read_histories(
    spark: SparkSession, places: dict[str, list[str]], cache: str | None = None, until: date | None = None, counts: manifest.Counts | None = None
) -> History:
    """Every named place that exists, read and united.

    With a cache only files that changed, and those that share a session with one, are parsed;
    a database is always read, for its journal can change alone. Directories of rollouts dated
    past the window are not opened.
    """

    def one(name: str, path: str) -> History:
        late = {"until": until.isoformat()} if until and name == "codex" else {}
        if not cache or name == "opencode":
            return _READERS[name](spark, path, **late)
        read = lambda files: _READERS[name](spark, path, **late) if files is None else _READERS[name](spark, path, files=files)
        if not late:
            return manifest.materialised(spark, cache, name, path, read, now=manifest.source_stamps(spark, name, path), counts=counts)
        some = discover.dated_places(spark, path, until).places
        now = manifest.source_stamps(spark, name, path, literal_paths(some) if some else None)
        skipped = discover.from_day_on(F.col("source_file"), path, until)
        return manifest.materialised(spark, cache, name, path, read, now=now.where(~skipped), unlisted=skipped, counts=counts)

    found = [one(name, p) for name, paths in places.items() for p in paths if os.path.exists(p)]
    if not found:
        return History(*[empty(spark, s) for s in (SESSION, POINT, POINT, EXACT, TOKEN, DIAGNOSTIC)])
    return union(found)


def git_relations(
    spark: SparkSession, roots: list[str], authors: list[str], agents: list[str], categories,
    window: tuple[str | None, str | None] = (None, None), includes: list[str] | tuple = (), ignores: list[str] | tuple = (), rules: tuple = (),
) -> tuple[DataFrame, DataFrame]:
    """Commits of one's own and of agents within the window, placed, and their files; repositories are read once.

    Without authors all commits are one's own, and agents' commits are agents' all the same.
    """
    log = kept(git.read_log(spark, roots, [*authors, *agents] if authors else [], *window))
    mine, theirs = (log.where(author_matches(F.col("author"), who)) if who else log for who in (authors, agents))
    commits = git.commit_rows(mine, False, includes).unionByName(git.commit_rows(theirs, True, includes))
    placed = discover.placed(commits.withColumnRenamed("repo_path", "cwd"), rules)
    files = git.changed_files(log, includes, ignores, categories=categories).dropDuplicates(["sha", "path"])
    return placed, files.select("sha", "path", "additions", "deletions", "is_ignored", "category")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chronoloom")
    sub = out.add_subparsers(dest="command", required=True)
    rep = sub.add_parser("report")
    rep.add_argument("--history", action="append", default=[], help="PROVIDER=PATH")
    rep.add_argument("--git", action="append", default=[], help="a directory to look for repositories in")
    rep.add_argument("--depth", type=int, default=4, help="how deep to look for repositories")
    rep.add_argument("--no-git", action="store_true", help="read no commits")
    rep.add_argument("--no-ai", action="store_true", help="read no histories")
    rep.add_argument("--author", action="append", default=[])
    rep.add_argument("--agent-author", action="append", default=[])
    rep.add_argument("--group-by", default="repo")
    rep.add_argument("--since")
    rep.add_argument("--until")
    rep.add_argument("--month")
    rep.add_argument("--year")
    rep.add_argument("--provider", action="append", default=[])
    rep.add_argument("--exclude-provider", action="append", default=[])
    rep.add_argument("--repo")
    rep.add_argument("--exact-repo")
    rep.add_argument("--include", action="append", default=[], help="count only changed files that match a glob")
    rep.add_argument("--ignore", action="append", default=[], help="also ignore changed files that match a glob")
    rep.add_argument("--source-rule", action="append", default=[], help="REGEX=NAME, the root of the paths that match")
    rep.add_argument("--cache", help="folder of parsed histories")
    rep.add_argument("--cache-counts", action="store_true", help="add the cache's counts to a JSON report")
    rep.add_argument("--gap-cap", default="5m")
    rep.add_argument("--human-idle", default="1h")
    rep.add_argument("--review-credit", default="30m")
    rep.add_argument("--top", type=int, default=30)
    rep.add_argument("--config")
    rep.add_argument("--format", choices=["table", "json", "csv"], default="table")
    rep.add_argument("--output", help="folder for csv")
    cls = sub.add_parser("classify")
    cls.add_argument("paths", nargs="+")
    cls.add_argument("--config")
    src = sub.add_parser("sources")
    for listing in (cls, src):
        listing.add_argument("--format", choices=["table", "json", "csv"], default="table")
    rec = sub.add_parser("record")
    for name in ("provider", "session", "cwd"):
        rec.add_argument(f"--{name}", required=True)
    for name in ("model", "timestamp", "started-at", "completed-at", "file"):
        rec.add_argument(f"--{name}")
    rec.add_argument("--event", default="activity")
    rec.add_argument("--role", default="foreground")
    return out


def report_spec(a: argparse.Namespace, today: date) -> ReportSpec:
    if sum(map(bool, (a.month, a.year, a.since or a.until))) > 1:
        raise ValueError("give one of --month, --year, or --since and --until")
    since = bound_date(a.since) if a.since else None
    until = bound_date(a.until, True) if a.until else None
    if a.month:
        since, until = month_span(a.month, today)
    if a.year:
        since, until = year_span(a.year, today)
    return ReportSpec(
        grouping(a.group_by.split(",")), since, until, a.gap_cap, a.human_idle, a.review_credit,
        tuple(a.provider), tuple(a.exclude_provider), a.repo, a.exact_repo, a.top,
    )


def git_window(spark: SparkSession, spec: ReportSpec) -> tuple[str | None, str | None]:
    """The window as ``git log`` takes it: instants of local midnights with their offset."""
    bounds = [b for b in spec.window]
    told = [iso(b).alias(f"b{i}") if b is not None else F.lit(None).cast("string").alias(f"b{i}") for i, b in enumerate(bounds)]
    return tuple(spark.range(1).select(*told).first())


def run(argv: list[str], spark: SparkSession | None = None, today: date | None = None) -> str:
    a = parser().parse_args(argv)
    if a.command == "record":
        r = records.event_record(a.provider, a.session, a.cwd, a.model, a.event, a.role, a.timestamp, a.started_at, a.completed_at)
        if a.file:
            records.append(r, a.file)
        return json.dumps(r, ensure_ascii=False)
    spark = spark or session()
    if a.command == "sources":
        return sinks.listing(inventory.inventory(spark), a.format)
    config = load_config(a.config)
    categories = classify.registry(config.get("categories"), config.get("category_mode", "extend"))
    if a.command == "classify":
        rows = classify.explain(spark.createDataFrame([(i, p) for i, p in enumerate(a.paths)], "n int, path string"), categories=categories)
        return sinks.listing(rows.orderBy("n").select("path", "category", "rule", "pattern"), a.format)
    spec = report_spec(a, today or date.today())
    with scratch():
        return _report(spark, a, spec, config, categories)


def source_rules(config: dict, given: list[str]) -> tuple[RootRule, ...]:
    """Rules of the command line, then of the configuration's ``source_roots``."""
    told = [RootRule(r["pattern"], r["replacement"]) for r in config.get("source_roots") or []]
    rules = (*map(RootRule.parse, given), *told)
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} source rules")
    return rules


def scan_roots(a: argparse.Namespace, spec: ReportSpec, sessions: DataFrame) -> list[str]:
    """Repositories below the directories given; under a repository filter also checkouts of the sessions that match it."""
    if a.no_git:
        return []
    roots = {r for base in a.git for r in discover.repositories(base, a.depth)}
    if spec.repo_text or spec.exact_repo:  # a session's checkout may lie elsewhere
        roots |= set(discover.checkouts(filtered_sessions(sessions, spec)))
    return sorted(roots)


def _report(spark: SparkSession, a: argparse.Namespace, spec: ReportSpec, config: dict, categories) -> str:
    rules, counts = source_rules(config, a.source_rule), manifest.Counts()
    places = {} if a.no_ai else inventory.overrides(a.history) if a.history else inventory.history_paths()
    history = read_histories(spark, places, a.cache, spec.until, counts)
    sessions = discover.placed(history.sessions, rules)
    roots = scan_roots(a, spec, sessions)
    agents = a.agent_author or [basic_regex_literal(x) for x in AGENT_AUTHORS]
    commits, files = git_relations(spark, roots, a.author, agents, categories, git_window(spark, spec), a.include, a.ignore, rules)
    rep = build(relations(history, sessions, commits, files), spec)
    if a.format == "json":
        more = {"composition": rep.composition, "change_shapes": rep.shapes, "diagnostics": history.diagnostics.where("malformed_lines + content_rejections + unreadable_files > 0")}
        if a.cache_counts:
            more["cache"] = vars(counts)
        if spec.calendar:
            more["trend"] = trend(rep.printed, spec.calendar).orderBy(spec.calendar)
        return sinks.report_document(rep.printed, rep.summary, spec.dims, **more)
    if a.format == "csv":
        sinks.write_csv(rep.rows, a.output or "report.csv", spec.dims)
        return a.output or "report.csv"
    return sinks.dashboard(rep.printed, rep.summary, spec.dims, rep.composition)


def main() -> int:
    try:
        print(run(sys.argv[1:]))
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
