"""Scalar functions, globs, classification, parameters, fuzzy scores."""

from datetime import date, datetime

import pytest
from chronoloom.functions import fuzzy, globs, names, paths, text, times
from chronoloom.operators import classify, joins, report
from chronoloom.plans import spec
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def values(spark, column, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_rounding(spark):
    assert values(spark, times.round3, 0.0625, -0.0625, -0.0001, 2.0, kind="double") == [0.062, -0.062, 0.0, 2.0]
    assert str(values(spark, times.round3, -0.0, kind="double")[0]) == "0.0"


def test_timestamps(spark):
    got = values(spark, times.rfc3339, "2026-01-01T10:00:00Z", "2026-01-01t10:00:00.5+02:00", "2026-01-01", "x", None)
    assert got[:2] == [datetime(2026, 1, 1, 10), datetime(2026, 1, 1, 8, 0, 0, 500_000)] and got[2:] == [None] * 3
    assert values(spark, times.epoch_ms, 1500.5, float("nan"), float("inf"), kind="double")[1:] == [None, None]
    assert values(spark, lambda c: times.iso(times.rfc3339(c)), "2026-01-01T10:00:00Z", "2026-01-01T10:00:00.25Z") == ["2026-01-01T10:00:00+00:00", "2026-01-01T10:00:00.250000+00:00"]
    far = values(spark, lambda c: times.plus_micros(times.rfc3339(c), 1 << 62), "2026-01-01T10:00:00Z")
    assert far[0].year == 9999


def test_skipped_midnight(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        day = spark.sql("SELECT DATE '2018-11-04' AS d")
        plain, noon = day.select(F.unix_micros(times.local_midnight(F.col("d"))), F.unix_micros(times.local_midnight(F.col("d"), True))).first()
        assert plain == 1541300400_000_000 and noon == plain + 11 * 3600 * 1_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_durations_and_bounds():
    assert spec.duration_us("30s") == 30_000_000 and spec.duration_us(" 1.5H ") == 5_400_000_000
    for bad in ("0s", "5", "5d", "-1m", "9999h", ""):
        with pytest.raises(ValueError):
            spec.duration_us(bad)
    assert spec.bound_date("2026-12", True) == date(2027, 1, 1) and spec.bound_date("2026-02-28", True) == date(2026, 3, 1)
    assert spec.month_span("last", date(2026, 1, 15)) == (date(2025, 12, 1), date(2026, 1, 1))
    assert spec.year_span("this", date(2026, 5, 1)) == (date(2026, 1, 1), date(2027, 1, 1))
    for bad in (["repo", "repo"], [], ["day", "month"], ["who"]):
        with pytest.raises(ValueError):
            spec.grouping(bad)
    with pytest.raises(ValueError):
        spec.ReportSpec(since=date(2026, 1, 2), until=date(2026, 1, 1))


def test_names(spark):
    assert values(spark, names.provider_name, " Claude_Code ", "PI-CLI", "new_one") == ["claude", "pi", "new-one"]
    assert values(spark, names.safe_model, "a/b:1", "<synthetic>", "-x", "a b", None) == ["a/b:1", "<synthetic>", "unknown", "unknown", "unknown"]
    assert names.basic_to_java(r"+x\.y\+z") == r"\+x\.y+z"
    agent = values(spark, names.is_agent_author, "Copilot <1+Copilot@users.noreply.github.com>", "Ann <ann@x.org>")
    assert agent == [True, False]


def test_paths(spark):
    root = lambda *rules: lambda c: paths.source_root(c, rules, "/home/me")
    assert values(spark, root(), "/tmp/a", "/home/me", "/home/me/w/x", "/srv/app", "/x") == ["tmp/scratch", "~", "~/w", "srv", "filesystem"]
    rule = paths.RootRule(r"^/srv/([a-z]+)", r"S-\1")
    assert values(spark, root(rule), "/srv/app/srv/app", "/else/y") == ["S-app/srv/app", "else"]
    for bad in ("(a+)+", "a|b", "(?=x)", r"(a)\1"):
        with pytest.raises(ValueError):
            paths.RootRule(bad, "x")
    assert values(spark, paths.percent_decoded, "a%20b+c", "%zz%41", "%C3%A9") == ["a b+c", "%zzA", "é"]


def test_display(spark):
    assert values(spark, text.hours, 0.0, 3661.0, 360000.0, kind="double") == ["0h 00m", "1h 01m", "100h 00m"]
    assert values(spark, text.compact_count, 5, 1250, 2_000_000, 3_000_000_000, kind="long") == ["5", "1.2k", "2.0M", "3.0B"]
    assert values(spark, text.percent, 0.001, 0.0, 0.125, 1.0, kind="double") == ["<1%", "0%", "12%", "100%"]
    assert values(spark, text.safe_text, "a\x1bb‮c") == ["a·b·c"]
    assert values(spark, text.neutral_cell, "=1", "-1.5", "-1f", "x") == ["'=1", "-1.5", "'-1f", "x"]
    assert values(spark, text.named_month, "2024-03", "x") == ["March 2024", "x"]


def test_ignored_paths(spark):
    cases = {"node_modules/a.js": True, "x/node_modules/a.js": True, "my_node_modules/a.js": False, "a/b.min.js": True, "Cargo.lock": True, "src/main.rs": False, "dist/x": True, "go.sum": True, "sub/go.sum": False}
    assert dict(zip(cases, values(spark, globs.is_ignored, *cases))) == cases


def test_categories(spark):
    cases = {
        "src/lib.rs": "source", "tests/lib.rs": "test", "src/Latest.rs": "source", "src/FooTest.java": "test", "README.md": "docs", "LICENSE": "docs",
        ".gitignore": "config", "Dockerfile": "config", ".github/workflows/x.sh": "config", "a.png": "assets", "x.unknown": "other", "for_A/when_b.cs": "test",
        "Arc.Core.Specs/a.cs": "test", "x/../y/z.PY": "source", "": "other", "fixtures/a.json": "test",
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.category for r in classify.with_category(df).collect()} == cases
    why = {r.path: (r.category, r.rule, r.pattern) for r in classify.explain(df).collect()}
    assert why["src/FooTest.java"] == ("test", "cased_stem_suffix", "Test") and why["x.unknown"] == ("other", "fallback", "")
    assert {p: w[0] for p, w in why.items()} == cases


def test_configured_categories(spark):
    reg = classify.registry({"infra": {"directories": ["/deploy/"], "globs": ["*.tf"]}, "docs": {"extensions": [".txt"]}})
    df = spark.createDataFrame([("deploy/a.rs",), ("m/a.tf",), ("a.txt",), ("a.md",)], "path string")
    assert [r.category for r in classify.with_category(df, categories=reg).collect()] == ["infra", "infra", "docs", "docs"]
    only = classify.registry({"docs": {"extensions": ["txt"]}}, "replace")
    assert [r.category for r in classify.with_category(df, categories=only).collect()][2:] == ["docs", "other"]
    for bad in ({"Bad": {}}, {"ignored": {}}, {"x": {"nope": ["a"]}}, {"x": {"names": [""]}}, {"x": {"directories": ["/"]}}, {"x": {"globs": ["{a"]}}):
        with pytest.raises(ValueError):
            classify.registry(bad)


def test_shapes(spark):
    rows = [("a", "source", 200, 10), ("b", "source", 100, 80), ("c", "source", 10, 300), ("d", "other", 40, 2), ("e", "source", 25, 25), ("e", "test", 25, 25), ("f", "test", 9, 0), ("g", "docs", 0, 0)]
    files = spark.createDataFrame([(s, f"{c}.x", c, a, d, False) for s, c, a, d in rows], "sha string, path string, category string, additions long, deletions long, is_ignored boolean")
    got = {r.sha: r["shape"] for r in classify.change_shapes(files).collect()}
    assert got == {"a": "new code", "b": "revision", "c": "removal", "d": "mixed", "e": "mixed", "f": "tests"}
    shares = {r.category: (r.files, r.share) for r in classify.composition(files).collect()}
    assert shares["docs"] == (1, 0.0) and abs(sum(s for _, s in shares.values()) - 1) < 0.01


def test_fuzzy_order():
    s = fuzzy.score
    assert s("lib", "src/lib.rs") > s("lib", "calibrate.rs") and s("abc", "xyz") is None and s("", "x") == 0 and s("a", None) is None
    assert s("tc", "myTestCase") > s("tc", "mytestcase") and s("rs", "src/main.rs") >= 16 * 2 + 8


@settings(max_examples=200, deadline=None)
@given(st.text("abAB_/", max_size=4), st.text("abAB_/", max_size=12))
def test_fuzzy_finds_every_subsequence(needle, label):
    rest = iter(label.lower())
    assert (fuzzy.score(needle, label) is not None) == all(c in rest for c in needle.lower())


def test_two_key_lookup_and_prefix(spark):
    df = spark.createDataFrame([(1, "a", "z"), (2, None, "b"), (3, None, None)], "i int, k string, l string")
    side = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, v string")
    assert [r.v for r in joins.first_match(df, side, [("k", "key"), ("l", "key")], ["v"]).orderBy("i").collect()] == ["A", "B", None]
    paths_ = spark.createDataFrame([("/a/b/c",), ("/ab",)], "cwd string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root_path string")
    assert {r.cwd: r.root_path for r in joins.longest_prefix(paths_, roots).collect()} == {"/a/b/c": "/a/b", "/ab": None}


def test_diagnostics_and_models(spark):
    rows = spark.createDataFrame([(1, 2, ["a", "b"]), (2, 3, ["c"])], "ord long, bad long, messages array<string>")
    got = report.merged_diagnostics(rows, ["bad"], 2).first()
    assert (got.bad, got.warning_count, got.messages) == (5, 3, ["a", "b"])
    totals = spark.createDataFrame([("unknown", 1), ("—", 2), ("a", 9)] + [(f"m{i:02}", 4) for i in range(12)], "model string, us long")
    ranked = report.ranked_models(totals, "us").orderBy("rank").collect()
    assert len(ranked) == 12 and ranked[0].model == "a" and ranked[0].omitted == 2


def _every_path(needle, label):
    """All increasing places of the needle's characters, in order."""
    low = [c.lower()[:1] or c for c in label]
    found = [()]
    for c in needle.lower():
        found = [(*p, i) for p in found for i in range(p[-1] + 1 if p else 0, len(low)) if low[i] == c]
    return sorted(found)


def _by_the_rule(needle, label):
    """Four times: the first path from a place, and the first one from the latest start that ends as it does."""
    paths, at, best = _every_path(needle, label), 0, []
    for _ in range(4):
        ahead = [p for p in paths if p[0] >= at]
        if not ahead:
            break
        start = max(p[0] for p in ahead if p[-1] == ahead[0][-1])
        best += [ahead[0], min(p for p in ahead if p[0] == start)]
        at = start + 1

    def worth(p):
        def bonus(i):
            if i == 0 or not label[i - 1].isalnum():
                return 10
            return 6 if label[i].isupper() and not label[i - 1].isupper() else 0

        total = 16 * len(p) + 2 * bonus(p[0]) - min(p[0], 12)
        for a, b in zip(p, p[1:]):
            total += 8 if b == a + 1 else bonus(b) - 5 - (b - a - 2)
        return total

    return max(map(worth, best), default=None)


@settings(max_examples=400, deadline=None)
@given(st.text("abAB_/", min_size=1, max_size=4), st.text("abAB_/é", max_size=14))
def test_fuzzy_is_the_rule(needle, label):
    assert fuzzy.score(needle, label) == _by_the_rule(needle, label)


def test_masks_never_reject_a_hit(spark):
    labels = ["src/Main.rs", "İstanbul", "ΣΑΣ", "Kelvin K", "", "a~!9", "日本語", "ẞß", "tab\tand\nline", None]
    needles = ["smr", "i", "σ", "k", "9", "~!", "本", "ß", "zz", "\t"]
    df = spark.createDataFrame([(x,) for x in labels], "label string").withColumn("mask", fuzzy.presence_mask(F.col("label")))
    for needle in needles:
        rows = df.select("label", fuzzy.may_hold(F.col("mask"), needle).alias("may"), fuzzy.fuzzy_score(F.col("label"), needle, F.col("mask")).alias("s")).collect()
        assert [r.s for r in rows] == [fuzzy.score(needle, r.label) for r in rows]
        assert any(not r.may for r in rows if r.label is not None)
