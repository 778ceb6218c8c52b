"""Result frames to files and to text: JSON, CSV, wide category columns, a dashboard."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import compact_count, hours, label, left_clipped, neutral_cell, percent, safe_text, separated
from .operators.classify import BUILTIN, Category, composition

#: Columns of the delimited form, between the dimensions and the category columns, and after them.
CSV_METRICS = [
    "active_seconds", "parallel_agent_seconds", "ai_wall_seconds", "human_estimated_seconds", "human_signal_count", "work_block_count",
    "session_count", "foreground_session_count", "subagent_session_count", "commit_count", "file_count", "additions", "deletions",
    "ignored_additions", "ignored_deletions", "net_lines", "agent_commit_count", "agent_additions", "agent_deletions",
    "ai_assisted_commit_count", "autofix_assisted_commit_count", "input_tokens", "output_tokens",
]
CSV_TAIL = [
    "cache_read_tokens", "cache_creation_tokens", "total_tokens", "active_days", "human_active_days", "calendar_days",
    "average_human_seconds_per_active_day", "average_active_seconds_per_active_day", "average_active_seconds_per_calendar_day",
    "first_seen", "last_seen", "providers", "models",
]


def category_pivot(files: DataFrame, keys: list[str], categories: tuple[Category, ...] = BUILTIN) -> DataFrame:
    """``<category>_files``, ``_additions``, ``_deletions`` columns; 0 where a category is untouched.

    Conditional sums over one aggregate of the categories, so the columns are the
    registry's whatever the data holds.
    """
    by = composition(files, keys)
    columns = [
        F.coalesce(F.sum(F.when(F.col("category") == c.name, F.col(m))), F.lit(0)).cast("long").alias(f"{c.name}_{m}")
        for c in categories
        for m in ("files", "additions", "deletions")
    ]
    return by.groupBy(*keys).agg(*columns)


def csv_frame(report: DataFrame, dims: tuple[str, ...], pivot: DataFrame | None = None) -> DataFrame:
    """All columns in order, text made safe and neutral for spreadsheets."""
    wide = report
    extra: list[str] = []
    if pivot is not None:
        extra = [c for c in pivot.columns if c not in dims]
        on = [F.col(f"r.{d}").eqNullSafe(F.col(f"p.{d}")) for d in dims]
        met = report.alias("r").join(pivot.alias("p"), on, "left")
        wide = met.select("r.*", *[F.coalesce(F.col(f"p.{c}"), F.lit(0)).alias(c) for c in extra])
    text = {c for c, kind in wide.dtypes if kind == "string"}
    ordered = [*dims, *CSV_METRICS, *extra, *CSV_TAIL]
    return wide.select(*[neutral_cell(safe_text(F.col(c))).alias(c) if c in text else F.col(c) for c in ordered])


def write_csv(report: DataFrame, path: str, dims: tuple[str, ...], pivot: DataFrame | None = None) -> None:
    csv_frame(report, dims, pivot).write.mode("error").option("header", "true").option("quoteAll", "false").csv(path)


def write_json(report: DataFrame, path: str) -> None:
    """Row documents with names as they are."""
    report.write.mode("error").json(path)


def listing(df: DataFrame, form: str = "table") -> str:
    """A short table as tab-separated lines, as JSON, or as CSV with a head and neutral cells."""
    rows = df.collect()
    if form == "json":
        return json.dumps([r.asDict() for r in rows], ensure_ascii=False, indent=2)
    if form == "csv":
        text = {c for c, kind in df.dtypes if kind == "string"}
        safe = df.select(*[neutral_cell(safe_text(F.col(c))).alias(c) if c in text else F.col(c) for c in df.columns]).collect()
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([df.columns, *safe])
        return out.getvalue().rstrip("\n")
    return "\n".join("\t".join(str(x) for x in r) for r in rows)


def report_document(rows: DataFrame, summary: DataFrame, dims: tuple[str, ...], top: int = 0, **more: DataFrame | dict) -> str:
    """One pretty document of a report that was already cut to a printable number of rows.

    ``more`` are short tables that follow, each under its name.
    """
    shown = rows.limit(top) if top else rows
    row = lambda r: {"key": {d: r[d] for d in dims}} | {k: v for k, v in r.asDict().items() if k not in dims}
    head = summary.first()
    return json.dumps(
        {"group_by": list(dims), "summary": head.asDict() if head else {}, "rows": [row(r) for r in shown.collect()]}
        | {name: df if isinstance(df, dict) else [r.asDict() for r in df.collect()] for name, df in more.items()},
        ensure_ascii=False,
        indent=2,
    )


def dashboard_rows(report: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """A report's rows as text cells; ``report`` is ordered and cut already."""
    return report.select(
        left_clipped(label(**{d: F.col(d) for d in dims})).alias("label"),
        hours(F.col("human_estimated_seconds")).alias("human"),
        hours(F.col("ai_wall_seconds")).alias("ai_wall"),
        separated(F.col("commit_count")).alias("commits"),
        F.concat(F.lit("+"), separated(F.col("additions")), F.lit(" -"), separated(F.col("deletions"))).alias("lines"),
        compact_count(F.col("total_tokens")).alias("tokens"),
    )


def dashboard(report: DataFrame, summary: DataFrame, dims: tuple[str, ...], shares: DataFrame | None = None) -> str:
    """The text dashboard: headline, composition, rows."""
    s = summary.first()
    lines = []
    if s:
        lines += [f"Human {s['human_estimated_seconds'] / 3600:.1f} h · AI wall {s['agent_wall_seconds'] / 3600:.1f} h · parallel {s['parallel_agent_seconds'] / 3600:.1f} h"]
        lines += [f"Sessions {s['session_count']:,} · commits {s['commit_count']:,} · +{s['additions']:,} -{s['deletions']:,} · tokens {s['total_tokens']:,}"]
    if shares is not None:
        shown = shares.select("category", percent(F.col("share")).alias("p")).collect()
        lines.append("Composition " + ", ".join(f"{r['category']} {r['p']}" for r in shown))
    for r in dashboard_rows(report, dims).collect():
        lines.append(f"{r['label']:<38} {r['human']:>10} {r['ai_wall']:>10} {r['commits']:>8} {r['lines']:>18} {r['tokens']:>8}")
    return "\n".join(lines)
