"""Paths to categories by generated CASE expressions, and commits to change shapes.

A registry is plain data. ``category`` and ``explain`` turn it into column expressions over
the parts of a path, so classification stays in generated code.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import any_glob
from ..functions.paths import path_parts
from ..functions.times import round3

#: Rule kinds in the order in which they are tried, with the name that ``explain`` gives.
RULES = {
    "globs": "glob", "directories": "directory", "directory_prefixes": "directory_prefix",
    "directory_suffixes": "directory_suffix", "names": "name", "name_prefixes": "name_prefix",
    "name_suffixes": "name_suffix", "name_contains": "name_contains", "stems": "stem",
    "stem_suffixes": "stem_suffix", "cased_stem_suffixes": "cased_stem_suffix", "extensions": "extension",
}
MAX_CATEGORIES, MAX_RULES, MAX_RULE_BYTES, MAX_GLOB_BYTES, MAX_NAME_BYTES = 32, 128, 128, 256, 32
RESERVED = ("ignored",)
DOMINANT_SHARE = 0.6


@dataclass(frozen=True)
class Category:
    name: str
    shape: str = ""
    code_like: bool = False
    rules: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


# The built-in categories, first match wins.
BUILTIN = (
    Category("test", "tests", False, {
        "directories": (
            "test", "tests", "spec", "specs", "testing", "__tests__", "__mocks__", "testdata", "test_data", "fixtures", "e2e",
            "benches", "benchmarks", "given",
        ),
        "directory_prefixes": ("for_", "when_", "given_"),
        "directory_suffixes": (".specs", ".tests", ".test", "-tests", "-specs"),
        "name_prefixes": ("test_", "test-", "when_", "given_"),
        "name_contains": (".test.", ".spec."),
        "stems": ("test", "tests", "spec", "specs", "conftest", "given"),
        "stem_suffixes": ("_test", "_tests", "-test", "-tests", "_spec", "_specs", "-spec", "-specs"),
        "cased_stem_suffixes": ("Test", "Tests", "TestCase", "Spec", "Specs"),
    }),
    Category("docs", "docs", False, {
        "directories": ("doc", "docs", "documentation", "man"),
        "stems": (
            "readme", "license", "licence", "copying", "notice", "authors", "contributors", "contributing", "changelog",
            "changes", "history", "code_of_conduct",
        ),
        "extensions": ("md", "markdown", "mdx", "rst", "adoc", "asciidoc", "org", "texi", "pod"),
    }),
    Category("config", "config", False, {
        "directories": (".github", ".gitlab", ".circleci", ".azure", ".vscode", ".idea", ".husky", ".devcontainer", "ci"),
        "names": (
            "dockerfile", "containerfile", "makefile", "gnumakefile", "cmakelists.txt", "build", "workspace", "procfile",
            "vagrantfile", "rakefile", "gemfile", "pipfile", "justfile", "brewfile", "codeowners", "go.mod", "requirements.txt",
            "constraints.txt",
        ),
        "extensions": (
            "json", "jsonc", "json5", "yaml", "yml", "toml", "ini", "cfg", "conf", "properties", "plist", "xml", "env",
            "editorconfig", "gitignore", "gitattributes", "gitmodules", "dockerignore", "npmrc", "nvmrc", "tf", "tfvars", "hcl",
            "gradle", "bazel", "bzl", "cmake", "mk", "csproj", "fsproj", "vbproj", "vcxproj", "sln", "props", "targets",
            "nuspec", "podspec", "gemspec",
        ),
    }),
    Category("assets", "assets", False, {
        "directories": ("assets", "images", "img", "fonts", "media"),
        "extensions": (
            "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "icns", "bmp", "tiff", "avif", "mp3", "mp4", "wav", "ogg",
            "webm", "mov", "woff", "woff2", "ttf", "otf", "eot", "pdf", "psd", "sketch", "fig", "zip", "tar", "gz", "bz2", "xz",
            "7z", "jar", "wasm", "bin", "dat", "db", "sqlite", "sqlite3",
        ),
    }),
    Category("source", "source", True, {
        "extensions": (
            "rs", "go", "py", "pyi", "js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts", "java", "kt", "kts", "scala",
            "swift", "m", "mm", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "cs", "fs", "fsx", "vb", "rb", "php", "pl", "pm",
            "sh", "bash", "zsh", "fish", "ps1", "psm1", "lua", "r", "jl", "dart", "ex", "exs", "erl", "hrl", "hs", "elm", "clj",
            "cljs", "cljc", "nim", "zig", "v", "sql", "graphql", "gql", "proto", "vue", "svelte", "astro", "css", "scss",
            "sass", "less", "styl", "html", "htm", "hbs", "ejs", "pug", "erb", "haml", "slim", "jinja", "j2", "tmpl", "tpl",
            "razor", "cshtml", "vim", "el", "asm", "s", "bat", "cmd",
        ),
    }),
    Category("other", "other"),
)


def _normalised(kind: str, name: str, values) -> tuple[str, ...]:
    out = []
    most = MAX_GLOB_BYTES if kind == "globs" else MAX_RULE_BYTES
    for value in values:
        if not isinstance(value, str) or not value or len(value.encode()) > most or re.search(r"[\x00-\x1f\x7f-\x9f]", value):
            raise ValueError(f"category {name!r} has an empty, oversized or control-character rule")
        if kind == "directories":
            value = value.strip("/\\")
        if kind == "extensions":
            value = value.lstrip(".")
        if kind not in ("globs", "cased_stem_suffixes"):
            value = re.sub("[A-Z]", lambda m: m[0].lower(), value)
        if not value:
            raise ValueError(f"category {name!r} has a rule that normalises to nothing")
        out.append(value)
    return tuple(out)


def registry(config: Mapping[str, Mapping] | None = None, mode: str = "extend") -> tuple[Category, ...]:
    """The built-in categories with configured ones: new names come first, in name order.

    A configured namesake extends a built-in category's rules, or replaces them.
    """
    if mode not in ("extend", "replace"):
        raise ValueError(f"category_mode must be 'extend' or 'replace', not {mode!r}")
    config = config or {}
    if len(config) > MAX_CATEGORIES:
        raise ValueError(f"at most {MAX_CATEGORIES} configured categories")
    known, added = {c.name: c for c in BUILTIN}, []
    for name in sorted(config):
        if not re.fullmatch(r"[a-z][a-z0-9_-]*", name) or len(name) > MAX_NAME_BYTES or name in RESERVED:
            raise ValueError(f"invalid or reserved category name {name!r}")
        given = dict(config[name])
        code_like = given.pop("code_like", None)
        if unknown := set(given) - set(RULES):
            raise ValueError(f"unknown rules of category {name!r}: {sorted(unknown)}")
        if sum(map(len, given.values())) > MAX_RULES:
            raise ValueError(f"category {name!r} has more than {MAX_RULES} rules")
        rules = {kind: _normalised(kind, name, values) for kind, values in given.items()}
        for glob in rules.get("globs", ()):
            any_glob([glob])
        old = known.get(name)
        if old is None:
            added.append(Category(name, name, bool(code_like), rules))
        elif mode == "extend":
            merged = {k: (*old.rules.get(k, ()), *rules.get(k, ())) for k in RULES if k in old.rules or k in rules}
            known[name] = replace(old, rules=merged, code_like=old.code_like or bool(code_like))
        else:
            known[name] = replace(old, rules=rules, code_like=old.code_like if code_like is None else code_like)
    out = (*added, *known.values())
    if len(out) > MAX_CATEGORIES:
        raise ValueError(f"at most {MAX_CATEGORIES} categories")
    return out


def _hit(kind: str, rule: str, path: Column, parts: dict[str, Column]) -> Column:
    """Whether one rule holds."""
    folders = parts["folders"]
    return {
        "globs": lambda: path.rlike(any_glob([rule])),
        "directories": lambda: folders.contains(f"/{rule}/"),
        "directory_prefixes": lambda: folders.contains(f"/{rule}"),
        "directory_suffixes": lambda: folders.contains(f"{rule}/"),
        "names": lambda: parts["name"] == rule,
        "name_prefixes": lambda: parts["name"].startswith(rule),
        "name_suffixes": lambda: parts["name"].endswith(rule),
        "name_contains": lambda: parts["name"].contains(rule),
        "stems": lambda: parts["stem"] == rule,
        "stem_suffixes": lambda: parts["stem"].endswith(rule),
        "cased_stem_suffixes": lambda: parts["cased_stem"].endswith(rule),
        "extensions": lambda: parts["extension"] == rule,
    }[kind]()


#: Kinds for which a regular expression tries every place of a name, though a rule holds at one or is rare.
_PLAIN = ("name_suffixes", "name_contains", "stem_suffixes", "cased_stem_suffixes")
#: More rules of such a kind are one regular expression: methods of 8,000 bytes and more are never compiled.
MOST_PLAIN = 8


def _any_hit(kind: str, rules: tuple[str, ...], path: Column, parts: dict[str, Column]) -> Column:
    """Whether any rule of a kind holds, as one expression; a few plain texts are compared as bytes."""
    if kind in _PLAIN and len(rules) <= MOST_PLAIN:
        return reduce(lambda a, b: a | b, [_hit(kind, r, path, parts) for r in rules])
    folders, text = parts["folders"], "|".join(map(re.escape, rules))
    return {
        "globs": lambda: path.rlike(any_glob(rules)),
        "directories": lambda: folders.rlike(f"/(?:{text})/"),
        "directory_prefixes": lambda: folders.rlike(f"/(?:{text})"),
        "directory_suffixes": lambda: folders.rlike(f"(?:{text})/"),
        "names": lambda: parts["name"].isin(*rules),
        "name_prefixes": lambda: parts["name"].rlike(f"^(?:{text})"),
        "name_suffixes": lambda: parts["name"].rlike(f"(?:{text})$"),
        "name_contains": lambda: parts["name"].rlike(text),
        "stems": lambda: parts["stem"].isin(*rules),
        "stem_suffixes": lambda: parts["stem"].rlike(f"(?:{text})$"),
        "cased_stem_suffixes": lambda: parts["cased_stem"].rlike(f"(?:{text})$"),
        "extensions": lambda: parts["extension"].isin(*rules),
    }[kind]()


def _with_parts(df: DataFrame, path: str) -> tuple[DataFrame, dict[str, Column]]:
    """The path's parts as columns of their own, so that they are computed once."""
    parts = path_parts(F.col(path))
    named = df.withColumns({f"__{k}": v for k, v in parts.items()})
    return named, {k: F.col(f"__{k}") for k in parts}


def _fallback(categories: tuple[Category, ...]) -> str:
    return "other" if any(c.name == "other" for c in categories) else categories[-1].name


def with_category(df: DataFrame, path: str = "path", categories: tuple[Category, ...] = BUILTIN, name: str = "category") -> DataFrame:
    named, parts = _with_parts(df, path)
    # Most paths are in no folder that any category names, which one look tells.
    every = tuple(dict.fromkeys(r for c in categories for r in c.rules.get("directories", ())))
    if every:
        named = named.withColumn("__placed", _any_hit("directories", every, F.col(path), parts))
    case = F
    for c in categories:
        hits = [_any_hit(kind, c.rules[kind], F.col(path), parts) for kind in RULES if c.rules.get(kind)]
        if c.rules.get("directories"):
            at = [kind for kind in RULES if c.rules.get(kind)].index("directories")
            hits[at] = F.col("__placed") & hits[at]
        if hits:
            condition = hits[0]
            for h in hits[1:]:
                condition = condition | h
            case = case.when(F.coalesce(condition, F.lit(False)), c.name)
    out = F.lit(_fallback(categories)) if case is F else case.otherwise(_fallback(categories))
    return named.withColumn(name, out).drop("__placed", *[f"__{k}" for k in parts])


def explain(df: DataFrame, path: str = "path", categories: tuple[Category, ...] = BUILTIN) -> DataFrame:
    """Adds ``category, rule, pattern``: the first category with a match and its first matching rule."""
    named, parts = _with_parts(df, path)
    case = F
    for c in categories:
        for kind in RULES:
            rules = c.rules.get(kind, ())
            if rules:
                first = F.coalesce(*[F.when(_hit(kind, r, F.col(path), parts), F.lit(r)) for r in rules])
                why = F.struct(F.lit(c.name).alias("category"), F.lit(RULES[kind]).alias("rule"), first.alias("pattern"))
                case = case.when(F.coalesce(_any_hit(kind, rules, F.col(path), parts), F.lit(False)), why)
    none = F.struct(F.lit(_fallback(categories)).alias("category"), F.lit("fallback").alias("rule"), F.lit("").alias("pattern"))
    out = none if case is F else case.otherwise(none)
    return named.withColumn("__why", out).drop(*[f"__{k}" for k in parts]).select("*", "__why.*").drop("__why")


# Commits.


def category_lines(files: DataFrame, keys: list[str] | tuple[str, ...] = ("sha",)) -> DataFrame:
    """Counted lines of each category; ignored files have none."""
    kept = files.where(~F.col("is_ignored"))
    return kept.groupBy(*keys, "category").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def change_shapes(files: DataFrame, categories: tuple[Category, ...] = BUILTIN) -> DataFrame:
    """(sha, shape) of every commit with changed lines."""
    order = F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(c.name), F.lit(i))])
    shapes = F.create_map(*[x for c in categories for x in (F.lit(c.name), F.lit(c.shape or c.name))])
    touched = F.col("additions") + F.col("deletions")
    row = F.struct("category", "additions", "deletions", touched.alias("touched"))
    by = category_lines(files).groupBy("sha").agg(
        F.sum(touched).alias("total"), F.max_by(row, F.struct(touched, F.element_at(order, F.col("category")))).alias("top")
    )
    code = [c.name for c in categories if c.code_like]
    a, d = F.col("top.additions"), F.col("top.deletions")
    mixed = (F.col("top.touched") < F.col("total") * DOMINANT_SHARE) | (F.col("top.category") == _fallback(categories))
    shape = (
        F.when(mixed, "mixed")
        .when(~F.col("top.category").isin(*code), F.element_at(shapes, F.col("top.category")))
        .when(d > 2 * a, "removal")
        .when(4 * d < a, "new code")
        .otherwise("revision")
    )
    return by.where("total > 0").select("sha", shape.alias("shape"))


def composition(files: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Per category: distinct paths, lines and their share; categories with nothing are left out."""
    by_path = files.where(~F.col("is_ignored")).groupBy(*keys, "category", "path").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    both = by_path.groupBy(*keys, "category").agg(F.count("path").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    touched = F.col("additions") + F.col("deletions")
    total = F.sum(touched).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    share = F.when(total == 0, F.lit(0.0)).otherwise(round3(touched / total))
    return both.withColumn("share", share)


def shape_histogram(commits: DataFrame, shapes: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Commits of each shape and their share of the classified ones."""
    counts = commits.join(shapes, "sha").groupBy(*keys, "shape").agg(F.count("*").alias("commits"))
    total = F.sum("commits").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", round3(F.col("commits") / total))


def ordered_composition(df: DataFrame) -> DataFrame:
    return df.orderBy((F.col("additions") + F.col("deletions")).desc(), F.col("files").desc(), "category")


def ordered_shapes(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("commits").desc(), "shape")
