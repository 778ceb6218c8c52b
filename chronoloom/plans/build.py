"""A whole report from histories and repositories: the batch lifecycle as lazily composed frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, filters, joins, report
from ..operators.intervals import KEY
from ..sources.lines import History
from .spec import ReportSpec, duration_us


@dataclass
class Relations:
    """Normalised inputs of a report."""

    sessions: DataFrame
    points: DataFrame
    human: DataFrame
    exact: DataFrame
    tokens: DataFrame
    commits: DataFrame
    files: DataFrame


def relations(history: History, placed: DataFrame, commits: DataFrame, files: DataFrame) -> Relations:
    """Histories with placed sessions (``repo, root`` added), commits, and their files."""
    return Relations(placed, history.points, history.human, history.exact, history.tokens, commits, files)


def filtered_sessions(sessions: DataFrame, spec: ReportSpec) -> DataFrame:
    """Sessions by provider and repository."""
    sessions = filters.by_provider(sessions, spec.providers, spec.without_providers)
    if spec.repo_text:
        sessions = filters.by_repo_text(sessions, spec.repo_text)
    return filters.by_exact_repo(sessions, spec.exact_repo) if spec.exact_repo else sessions


def filtered(r: Relations, spec: ReportSpec) -> Relations:
    """Sessions by provider and repository, their records, and commits by repository.

    A repository filter may match only a directory within a checkout: commits of checkouts
    that the remaining sessions ran in stay, whatever their repository is called.
    """
    sessions, commits = filtered_sessions(r.sessions, spec), r.commits
    if spec.repo_text:
        commits = filters.by_repo_text(commits, spec.repo_text)
    if spec.exact_repo:
        commits = filters.by_exact_repo(commits, spec.exact_repo)
    if sessions is r.sessions and commits is r.commits:
        return r
    if commits is not r.commits:
        commits = r.commits.join(commits.select("sha").union(_of_checkouts(sessions, r.commits)).distinct(), "sha", "left_semi")
    keys = sessions.select(*KEY).distinct()
    of = lambda df: df.join(keys, KEY, "left_semi")
    return Relations(sessions, of(r.points), of(r.human), of(r.exact), of(r.tokens), commits, r.files)


def _of_checkouts(sessions: DataFrame, commits: DataFrame) -> DataFrame:
    """Hashes of the commits whose checkout encloses the directory of a session."""
    sure = sessions.where("NOT approximate_cwd") if "approximate_cwd" in sessions.columns else sessions
    roots = commits.select(F.col("cwd").alias("root_path")).distinct()
    met = joins.longest_prefix(sure.select("cwd").distinct(), roots).select(F.col("root_path").alias("cwd")).where("cwd IS NOT NULL").distinct()
    return commits.join(met, "cwd", "left_semi").select("sha")


@dataclass
class Report:
    spec: ReportSpec
    activity: report.Activity
    rows: DataFrame
    summary: DataFrame
    composition: DataFrame
    shapes: DataFrame

    @property
    def printed(self) -> DataFrame:
        return report.ranked_report(self.rows, self.spec.dims, self.spec.top)


def build(r: Relations, spec: ReportSpec) -> Report:
    since, until = spec.window
    kept = filtered(r, spec)
    act = report.activity(kept, duration_us(spec.gap_cap), duration_us(spec.idle), duration_us(spec.credit), since, until)
    mine = kept.files.join(act.commits.select("sha"), "sha", "left_semi")
    return Report(
        spec,
        act,
        report.grouped_report(act, spec.dims),
        report.summary(act),
        classify.ordered_composition(classify.composition(mine)),
        classify.ordered_shapes(classify.shape_histogram(act.commits, classify.change_shapes(mine))),
    )


def overview_with_report(rep: Report) -> DataFrame:
    """The explorer's overview; seconds are joined where the report was grouped by repository."""
    from ..operators.explore import overview

    rows = rep.rows if "repo" in rep.spec.dims else None
    return overview(rep.activity.commits, rep.activity.files, rows)


def headline(rep: Report) -> DataFrame:
    s = rep.summary
    return s.select(
        F.concat_ws(" – ", "first_seen", "last_seen").alias("observed"), "commit_count", "session_count", "additions", "deletions",
        F.round(F.col("human_estimated_seconds") / 3600, 1).alias("human_hours"), F.round(F.col("parallel_agent_seconds") / 3600, 1).alias("ai_hours"), "total_tokens",
    )


def conflicts(history: History, store: DataFrame) -> DataFrame:
    from ..sources.transcripts import repository_conflicts

    return repository_conflicts(history.sessions, store)


__all__ = ["Relations", "Report", "build", "conflicts", "filtered", "headline", "overview_with_report", "relations"]
