"""Row filters shared by all relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import plain_provider_name


def in_window(df: DataFrame, since: Column | None = None, until: Column | None = None, ts: str = "ts") -> DataFrame:
    if since is not None:
        df = df.where(F.col(ts) >= since)
    if until is not None:
        df = df.where(F.col(ts) < until)
    return df


def by_provider(df: DataFrame, include: list[str] | tuple[str, ...] = (), exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Included and not excluded providers; ``all`` includes, or excludes, every one."""
    wanted, unwanted = [*map(plain_provider_name, include)], [*map(plain_provider_name, exclude)]
    if "all" in unwanted:
        return df.where(F.lit(False))
    if wanted and "all" not in wanted:
        df = df.where(F.col("provider").isin(wanted))
    return df.where(~F.col("provider").isin(unwanted)) if unwanted else df


def by_repo_text(df: DataFrame, text: str) -> DataFrame:
    """Text within repository, directory or root, in either case."""
    low = text.lower()
    hit = F.lit(False)
    for name in ("repo", "cwd", "root"):
        hit = hit | F.lower(name).contains(low)
    return df.where(hit)


def by_exact_repo(df: DataFrame, label: str) -> DataFrame:
    """The repository's label, or the directory's last component, in either case."""
    low = label.lower()
    return df.where((F.lower("repo") == low) | (F.lower(F.element_at(F.split("cwd", "/"), -1)) == low))


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    return df.where(condition), df.where(~condition)
