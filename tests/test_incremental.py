"""The parse cache by file, pruned listings, ranges of commits and scoped scans."""

import json
import os
import random
import subprocess
from datetime import date

import pytest
from chronoloom import cli, session
from chronoloom.sources import discover, events, git, manifest, transcripts
from pyspark.sql import functions as F

BASE = {"provider": "p", "cwd": "/w"}
RELATIONS = ("sessions", "points", "human", "exact", "tokens", "diagnostics")


def write(path, rows, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, encoding="utf-8") as file:
        file.writelines(json.dumps(r) + "\n" for r in rows)
    return str(path)


def event(rng, sid):
    minute = rng.randrange(600)
    return BASE | {"session_id": sid, "timestamp": f"2026-01-01T{minute // 60:02}:{minute % 60:02}:00Z", "event": rng.choice(["prompt", "activity"]), "model": rng.choice("ab")}


def content(h):
    return {n: sorted(map(repr, getattr(h, n).drop("source_file", "ord").collect())) for n in RELATIONS}


def cached(spark, cache, root):
    counts = manifest.Counts()
    read = lambda files: events.read(spark, root) if files is None else events.read(spark, root, files=files)
    return manifest.materialised(spark, cache, "events", root, read, now=manifest.source_stamps(spark, "events", root), counts=counts), counts


def test_changes_are_read_with_what_they_touch(spark, tmp_path):
    rng, root, cache = random.Random(3), str(tmp_path / "log"), str(tmp_path / "cache")
    for i in range(6):
        write(f"{root}/d{i % 2}/f{i}.jsonl", [event(rng, f"own{i}") for _ in range(3)])
    write(f"{root}/d0/f0.jsonl", [event(rng, "shared") for _ in range(2)], "a")
    write(f"{root}/d1/f1.jsonl", [event(rng, "shared") for _ in range(2)], "a")
    write(f"{root}/odd [x] {{y}}.jsonl", [event(rng, "odd")])

    def step(parsed, hits):
        found, counts = cached(spark, cache, root)
        assert content(found) == content(events.read(spark, root))
        assert (counts.parsed, counts.hits) == (parsed, hits)

    step(7, 0)
    step(0, 7)
    write(f"{root}/d0/f2.jsonl", [event(rng, "own2")], "a")  # a session of its own file
    step(1, 6)
    write(f"{root}/d0/f0.jsonl", [event(rng, "own0")], "a")  # one that shares a session
    step(2, 6)
    write(f"{root}/new.jsonl", [event(rng, "own3"), event(rng, "newer")])  # a new file of a session kept elsewhere
    step(2, 7)
    os.remove(f"{root}/d1/f1.jsonl")  # the rest of the shared session
    step(1, 7)
    os.remove(f"{root}/d0/f4.jsonl")
    step(0, 6)
    write(f"{root}/odd [x] {{y}}.jsonl", [event(rng, "odd"), {"broken": 1}])
    step(1, 5)


def test_old_runs_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "MOST_RUNS", 2)
    rng, root, cache = random.Random(4), str(tmp_path / "log"), str(tmp_path / "cache")
    for i in range(4):
        write(f"{root}/f{i}.jsonl", [event(rng, f"s{i}")])
    cached(spark, cache, root)
    for i in range(4):
        write(f"{root}/f{i}.jsonl", [event(rng, f"s{i}")], "a")
        found, counts = cached(spark, cache, root)
        assert counts.parsed == 1 and content(found) == content(events.read(spark, root))
    (at,) = os.listdir(f"{cache}/whole/events")
    assert len(os.listdir(f"{cache}/whole/events/{at}/points/store=events")) <= 3


def test_many_changes_read_the_source_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "MOST_NAMED", 2)
    rng, root, cache = random.Random(5), str(tmp_path / "log"), str(tmp_path / "cache")
    for i in range(5):
        write(f"{root}/f{i}.jsonl", [event(rng, f"s{i}")])
    cached(spark, cache, root)
    for i in range(4):
        write(f"{root}/f{i}.jsonl", [event(rng, "all")], "a")
    found, counts = cached(spark, cache, root)
    assert counts.parsed == 5 and counts.misses == 4 and content(found) == content(events.read(spark, root))


def _claude(root, project, name, *texts):
    row = lambda i, t: {"type": "user", "timestamp": f"2026-01-01T00:0{i}:00Z", "cwd": "/w/app", "sessionId": name, "message": {"content": t}}
    return write(f"{root}/{project}/{name}.jsonl", [row(i, t) for i, t in enumerate(texts)])


def test_command_line_parses_one_changed_file(spark, tmp_path):
    root, cache = str(tmp_path / "claude"), str(tmp_path / "cache")
    _claude(root, "a", "one", "hello")
    _claude(root, "a", "two", "hello", "again")
    args = ["report", "--no-git", "--history", f"claude={root}", "--group-by", "provider", "--format", "json"]
    run = lambda: json.loads(cli.run([*args, "--cache", cache, "--cache-counts"], spark))
    assert run()["cache"] == {"hits": 0, "misses": 2, "parsed": 2}
    warm = run()
    assert warm.pop("cache") == {"hits": 2, "misses": 0, "parsed": 0} and warm == json.loads(cli.run(args, spark))
    _claude(root, "a", "one", "hello", "more")
    changed = run()
    assert changed.pop("cache") == {"hits": 1, "misses": 1, "parsed": 1} and changed == json.loads(cli.run(args, spark))
    assert changed["summary"]["session_count"] == 2


def test_nothing_kept_is_left(spark, tmp_path):
    at = session._own_folder()
    before = set(os.listdir(at))
    log = write(f"{tmp_path}/e.jsonl", [event(random.Random(1), "s")])
    cli.run(["report", "--no-git", "--history", f"events={log}", "--format", "json"], spark)
    assert set(os.listdir(at)) == before


def test_side_files_are_part_of_the_stamp(spark, tmp_path):
    chat = f"{tmp_path}/ws/chatSessions/c.json"
    write(chat, [{"version": 3}])
    context = lambda: manifest.source_stamps(spark, "copilot-vscode", str(tmp_path)).collect()
    assert [r.context for r in context()] == [""]
    write(f"{tmp_path}/ws/workspace.json", [{"folder": "file:///w"}])
    (row,) = context()
    assert row.source_file == chat and row.context
    write(f"{tmp_path}/g/chats/s.jsonl", [{}])
    write(f"{tmp_path}/g/other/s.jsonl", [{}])
    with open(f"{tmp_path}/g/.project_root", "w") as file:
        file.write("/home/x")
    assert [r.context for r in manifest.source_stamps(spark, "gemini", f"{tmp_path}/g").collect()] == ["/home/x"]


# Dated directories.


def _rollouts(root):
    for y, m, d in ((2025, 12, 31), (2026, 1, 1), (2026, 1, 2), (2026, 2, 1)):
        write(f"{root}/{y}/{m:02}/{d:02}/rollout-{y}-{m}-{d}.jsonl", [
            {"type": "session_meta", "timestamp": f"{y}-{m:02}-{d:02}T00:00:00Z", "payload": {"id": f"{y}{m}{d}", "cwd": "/w"}},
            {"type": "event_msg", "timestamp": f"{y}-{m:02}-{d:02}T00:01:00Z", "payload": {"type": "x"}},
        ])
    write(f"{root}/2026/01/notes/rollout-n.jsonl", [{"type": "event_msg", "timestamp": "2026-01-01T00:01:00Z", "payload": {"type": "x"}}])
    write(f"{root}/rollout-top.jsonl", [{"type": "event_msg", "timestamp": "2026-01-01T00:01:00Z", "payload": {"type": "x"}}])
    write(f"{root}/2026/other.jsonl", [{}])


def test_dates_past_the_window_are_not_opened(spark, tmp_path):
    root = str(tmp_path / "codex")
    _rollouts(root)
    found = discover.dated_places(spark, root, "2026-01-02")
    assert [p.rsplit("/codex/")[1] for p in found.places] == ["2025/12/31", "2026/01/01", "2026/01/notes", "rollout-top.jsonl"]
    assert found.opened == 1 + 2 + 3  # the root, its years and months, no day
    assert len(discover.dated_places(spark, root).directories) == 5
    assert transcripts.codex(spark, root, until="2026-01-02").sessions.count() == 4
    assert transcripts.codex(spark, root).sessions.count() == 6
    later = discover.from_day_on(F.col("p"), root, date(2026, 1, 2))
    paths = [(f"{root}/2026/01/{d}/x", d == "02") for d in ("01", "02", "notes")] + [("/elsewhere/2026/01/02/x", False)]
    assert [(r.p, r.x) for r in spark.createDataFrame([(p,) for p, _ in paths], "p string").select("p", later.alias("x")).collect()] == paths


def test_window_and_cache_go_together(spark, tmp_path):
    root, cache = str(tmp_path / "codex"), str(tmp_path / "cache")
    _rollouts(root)

    def run(until):
        counts = manifest.Counts()
        h = cli.read_histories(spark, {"codex": [root]}, cache, until, counts)
        return h.sessions.count(), counts

    early = date(2026, 1, 2)
    assert run(early) == (4, manifest.Counts(0, 4, 4))
    assert run(None) == (6, manifest.Counts(4, 2, 2))
    assert run(early) == (4, manifest.Counts(4, 0, 0))
    os.remove(f"{root}/2026/02/01/rollout-2026-2-1.jsonl")
    assert run(early) == (4, manifest.Counts(4, 0, 0)) and run(None) == (5, manifest.Counts(5, 0, 0))


# Ranges of commits.


@pytest.fixture(scope="module")
def long_checkout(tmp_path_factory):
    repo = str(tmp_path_factory.mktemp("long") / "many")
    subprocess.run(["git", "init", "-q", "-b", "main", repo], check=True)
    lines = []
    for i in range(1200):
        who = ("Ann <ann@x.org>", "Bob <bob@x.org>", "Bot <1+Copilot@users.noreply.github.com>")[i % 3]
        stamp, text = f"{1767225600 + 60 * i} +0000", "x\n" * (i % 7 + 1)
        lines += ["commit refs/heads/main", f"author {who} {stamp}", f"committer C <c@x.org> {stamp}", "data 1", "m", f"M 644 inline src/f{i % 50}.py", f"data {len(text)}", text]
    subprocess.run(["git", "-C", repo, "fast-import", "--quiet"], input="\n".join(lines) + "\n", text=True, check=True)
    return repo


def test_one_repository_is_many_tasks(spark, long_checkout):
    whole, parts = git.read_log(spark, [long_checkout]), git.read_log(spark, [long_checkout], split_commits=250)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert (whole.rdd.getNumPartitions(), parts.rdd.getNumPartitions()) == (1, 5)
    assert rows(whole) == rows(parts) and parts.select("sha").distinct().count() == 1200
    ann = git.read_log(spark, [long_checkout], ["ann@X.org"], "2026-01-01T05:00:00+00:00", split_commits=100)
    assert ann.select("author").distinct().collect() == [("Ann <ann@x.org>",)] and ann.rdd.getNumPartitions() == 3
    assert ann.select("sha").distinct().count() == 300


def test_bounds_reach_the_log(spark, long_checkout):
    spark.conf.set(git.PUSHDOWN, "true")
    try:
        near = git.read_log(spark, [long_checkout], split_commits=10).where("ts >= '2026-01-01 19:00:00' AND ts < '2026-01-01 19:30:00'")
        assert near.rdd.getNumPartitions() == 4 and near.select("sha").distinct().count() == 30
    finally:
        spark.conf.unset(git.PUSHDOWN)


def test_authors_are_split_after_one_read(spark, long_checkout):
    from chronoloom.operators import classify

    commits, _ = cli.git_relations(spark, [long_checkout], ["ann@x.org"], ["+Copilot@users"], classify.BUILTIN)
    assert dict(commits.groupBy("agent_authored").count().collect()) == {False: 400, True: 400}
    everyone, _ = cli.git_relations(spark, [long_checkout], [], ["+Copilot@users"], classify.BUILTIN)
    assert dict(everyone.groupBy("agent_authored").count().collect()) == {False: 1200, True: 400}


# What a report scans.


def _one_commit(repo):
    os.makedirs(repo)
    subprocess.run(["git", "init", "-q", repo], check=True)
    write(f"{repo}/README.md", ["x"])
    subprocess.run(["git", "-C", repo, "add", "-A"], check=True)
    subprocess.run(["git", "-C", repo, "-c", "user.name=F", "-c", "user.email=f@x.org", "commit", "-qm", "f"], check=True)


def test_only_a_filter_widens_the_scan(spark, tmp_path):
    project, other = str(tmp_path / "base/project"), str(tmp_path / "unrelated")
    _one_commit(project)
    os.makedirs(other)
    log = write(f"{tmp_path}/e.jsonl", [{"provider": "fixture", "session_id": "s", "cwd": project, "timestamp": "2026-01-01T00:00:00Z", "event": "prompt"}])
    sessions = discover.placed(events.read(spark, log).sessions)

    def roots(*more):
        a = cli.parser().parse_args(["report", "--git", other, *more])
        return cli.scan_roots(a, cli.report_spec(a, date(2026, 1, 5)), sessions)

    here = [os.path.realpath(project)]
    assert roots() == [] and roots("--exact-repo", "project") == here and roots("--repo", "PROJ") == here
    assert roots("--exact-repo", "project", "--provider", "pi") == roots("--exact-repo", "project", "--no-git") == []
    assert roots("--git", str(tmp_path), "--depth", "1") == [] and roots("--git", str(tmp_path), "--depth", "2") == here
    doc = json.loads(cli.run(["report", "--history", f"events={log}", "--git", other, "--author", "f@x.org", "--exact-repo", "project", "--format", "json"], spark))
    assert doc["summary"]["commit_count"] == 1 and doc["summary"]["session_count"] == 1
    doc = json.loads(cli.run(["report", "--no-ai", "--git", project, "--author", "f@x.org", "--format", "json"], spark))
    assert doc["summary"]["commit_count"] == 1 and doc["summary"]["session_count"] == 0


def test_source_rules(spark):
    rules = cli.source_rules({"source_roots": [{"pattern": "^/srv/([a-z]+)/.*$", "replacement": "srv:\\1"}]}, ["^/opt/.*$=mine"])
    df = spark.createDataFrame([("/srv/team/app",), ("/opt/x",), ("/other/y",)], "cwd string")
    assert {r.cwd: r.root for r in discover.placed(df, rules).collect()} == {"/srv/team/app": "srv:team", "/opt/x": "mine", "/other/y": "other"}
    with pytest.raises(ValueError):
        cli.source_rules({}, [f"a{i}=b" for i in range(33)])
