"""Path globs as regular expressions: ``*`` and ``?`` cross slashes, ``**``, classes and braces work."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generated and vendored paths that are left out of line counts.
DEFAULT_IGNORES = (
    "*/node_modules/*", "*/dist/*", "*/build/*", "*/out/*", "*/obj/*", "*/bin/*", "*/vendor/*", "*/coverage/*",
    "*/.next/*", "*/.nuxt/*", "*/.svelte-kit/*", "*/__snapshots__/*", "*/Pods/*", "*.min.js", "*.min.css", "*.map",
    "*.snap", "*.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "composer.lock", "Cargo.lock",
    "poetry.lock", "Gemfile.lock", "go.sum",
)


def glob_regex(glob: str) -> str:
    """A whole-path regular expression that both Java and RE2 read."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
            continue
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 2 :]:
            stop = glob.index("]", i + 2)
            inside = glob[i + 1 : stop]
            negated = inside[0] in "!^"
            body = re.sub(r"[\\\[\]&~|]", lambda m: "\\" + m[0], inside[negated:])
            out.append(f"[{'^' if negated else ''}{body}]")
            i = stop
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed brace in glob {glob!r}")
    return "".join(out)


def any_glob(globs: list[str] | tuple[str, ...]) -> str:
    return f"(?s)^(?:{'|'.join(map(glob_regex, globs))})$"


_PLAIN = r"[^*?\[\]{}\\]+"


def _forms(globs: list[str] | tuple[str, ...]) -> tuple[list[str], list[str], list[str], list[str]]:
    """Plain texts of the common forms (folders, ends, whole paths) and all other globs."""
    folders, ends, names, rest = [], [], [], []
    for g in globs:
        if m := re.fullmatch(rf"\*/({_PLAIN})/\*", g):
            folders.append(m[1])
        elif m := re.fullmatch(rf"\*({_PLAIN})", g):
            ends.append(m[1])
            rest += [g[2:]] if g.startswith("*/") else []
        elif re.fullmatch(_PLAIN, g) and not g.startswith("/"):
            names.append(g)
        else:
            rest += [g] + ([] if g.startswith("/") else [f"/{g}"]) + ([g[2:]] if g.startswith("*/") else [])
    return folders, ends, names, rest


def path_globs(globs: list[str] | tuple[str, ...]) -> str:
    """For repository paths: a glob also holds with a slash before it, and ``*/x`` at the root.

    Globs of the common forms are gathered, so that a path is scanned once for each form
    and not once for each glob.
    """
    *plain, rest = _forms(globs)
    folders, ends, names = ([re.escape(x) for x in xs] for xs in plain)
    forms = [f"(?:.*/)?(?:{'|'.join(folders)})/.*"] if folders else []
    forms += [f".*(?:{'|'.join(ends)})"] if ends else []
    forms += [f"/?(?:{'|'.join(names)})"] if names else []
    return f"(?s)^(?:{'|'.join([*forms, *map(glob_regex, rest)])})$"


#: Plain globs beyond this number are one regular expression: generated code must stay small to be compiled.
MOST_PLAIN = 64


def matches(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    """Whether ``path_globs`` holds; the common forms are compared as bytes, without a regular expression."""
    if not globs or len(globs) > MOST_PLAIN:
        return path.rlike(path_globs(globs)) if globs else F.lit(False)
    folders, ends, names, rest = _forms(globs)
    rooted = F.concat(F.lit("/"), path)
    hits = [rooted.contains(f"/{x}/") for x in folders] + [path.endswith(x) for x in ends]
    hits += [path.isin([*names, *(f"/{x}" for x in names)])] if names else []
    hits += [path.rlike(f"(?s)^(?:{'|'.join(map(glob_regex, rest))})$")] if rest else []
    return reduce(lambda a, b: a | b, hits)


def is_ignored(path: Column, more: list[str] | tuple[str, ...] = ()) -> Column:
    return matches(path, (*DEFAULT_IGNORES, *more))


def is_included(path: Column, includes: list[str] | tuple[str, ...]) -> Column:
    """Without includes every path is included."""
    return matches(path, includes) if includes else F.lit(True)
