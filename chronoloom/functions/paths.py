"""Directories, repositories, roots, URLs and encoded paths."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RULES, MAX_REWRITE = 32, 4096
_UNSAFE_REGEX = re.compile(r"\\[1-9kK]|\(\?|\||[+*}]\)?[+*{]|\.\*(?!\$?$)")


def last_part(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def repo_label(repo: Column, home: str) -> Column:
    """The last component; ``~`` for the home directory; the path itself if it has none."""
    name = last_part(repo)
    return F.when(repo == home, "~").when(F.length(name) > 0, name).otherwise(repo)


@dataclass(frozen=True)
class RootRule:
    """A safe regex rewrite of a path: its first match is replaced, the rest is kept."""

    pattern: str
    replacement: str

    def __post_init__(self) -> None:
        if _UNSAFE_REGEX.search(self.pattern):
            raise ValueError(f"pattern is outside the safe subset: {self.pattern!r}")
        re.compile(self.pattern)

    @classmethod
    def parse(cls, text: str) -> RootRule:
        pattern, sign, replacement = text.partition("=")
        if not sign:
            raise ValueError("a source rule must be REGEX=REPLACEMENT")
        return cls(pattern, replacement)

    def apply(self, path: Column) -> Column:
        """Null where the pattern is not found."""
        shown = re.sub(r"\\([1-9])", r"$\1", self.replacement)
        found = F.regexp_substr(path, F.lit(self.pattern))
        at = F.instr(path, found)
        new = F.regexp_replace(found, self.pattern, shown)
        whole = F.concat(F.substring(path, F.lit(1), at - 1), new, F.substring(path, at + F.length(found), F.length(path)))
        return F.when(path.rlike(self.pattern), F.substring(whole, 1, MAX_REWRITE))


def source_root(path: Column, rules: list[RootRule] | tuple[RootRule, ...] = (), home: str = "/root", temp: str = "/tmp") -> Column:
    """The first rule's rewrite, else scratch, else below home, else the parent's name."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} source rules")
    scratch = F.lit(False)
    for base in dict.fromkeys((temp.rstrip("/"), "/tmp", "/private/tmp")):
        scratch = scratch | path.startswith(f"{base}/") | (path == (base if base != "/private/tmp" else "/tmp"))
    below = F.element_at(F.split(F.substring(path, F.lit(len(home) + 2), F.length(path)), "/"), 1)
    parent = F.element_at(F.split(path, "/"), -2)
    plain = (
        F.when(scratch, "tmp/scratch")
        .when(path == home, "~")
        .when(path.startswith(f"{home}/"), F.concat(F.lit("~/"), below))
        .when(F.length(parent) > 0, parent)
        .otherwise("filesystem")
    )
    return F.coalesce(*[r.apply(path) for r in rules], plain)


def path_parts(path: Column) -> dict[str, Column]:
    """What path rules look at: folders, name, stem, extension, and the stem as written.

    ``folders`` is the directories' text with a slash before and after each, so rules on
    directories are plain regular expressions. Empty, ``.`` and ``..`` parts are dropped.
    """
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    lowered = F.concat(F.lit("/"), F.lower(slashed), F.lit("/"))
    # Few paths have parts to drop; bytes tell which.
    loose = lowered.contains("//") | lowered.contains("/./") | lowered.contains("/../")
    whole = F.when(loose, F.regexp_replace(lowered, r"/(?:\.{0,2}/)+", "/")).otherwise(lowered)
    name = F.substring_index(F.substring_index(whole, "/", -2), "/", 1)
    folders = F.left(whole, F.length(whole) - F.length(name) - F.when(name == "", 0).otherwise(1))
    written = F.substring_index(slashed, "/", -1)
    extension = lambda n: F.when(n.contains("."), F.substring_index(n, ".", -1)).otherwise("")
    stem = lambda n: F.when(n.contains("."), F.left(n, F.length(n) - F.length(extension(n)) - 1)).otherwise(n)
    return {"folders": folders, "name": name, "stem": stem(name), "extension": extension(name), "cased_stem": stem(written)}


def directories(folders: Column) -> Column:
    return F.filter(F.split(folders, "/"), lambda p: p != "")


def percent_decoded(c: Column) -> Column:
    """``%XX`` decoded as UTF-8 bytes; bad escapes stay as they are."""
    kept = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B"))), c)


def file_url_path(url: Column) -> Column:
    """The local path of a ``file:///`` URL; null for other URLs. A drive loses the slash before it."""
    path = percent_decoded(F.substring(url, F.lit(8), F.length(url)))
    drive = path.rlike(r"^/[A-Za-z]:")
    return F.when(url.startswith("file:///"), F.when(drive, F.substring(path, F.lit(2), F.length(path))).otherwise(path))


def _drive_path(encoded: Column) -> Column:
    rest = F.translate(F.substring(encoded, F.lit(4), F.length(encoded)), "-", "/")
    return F.concat(F.upper(F.substring(encoded, 1, 1)), F.lit(":/"), rest)


def dashed_path(name: Column) -> Column:
    """A directory name in which dashes stand for separators, as an absolute path."""
    plain = F.translate(name, "-", "/")
    rooted = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit("/"), plain))
    return F.when(name.rlike("^[A-Za-z]--"), _drive_path(name)).otherwise(rooted)


def wrapped_dashed_path(name: Column) -> Column:
    """The same where the whole name is wrapped in ``--``."""
    inner = F.when(name.rlike("^--.*--$") & (F.length(name) >= 4), F.substring(name, F.lit(3), F.length(name) - 4)).otherwise(name)
    plain = F.concat(F.lit("/"), F.translate(inner, "-", "/"))
    return F.when(inner.rlike("^[A-Za-z]--"), _drive_path(inner)).otherwise(plain)
