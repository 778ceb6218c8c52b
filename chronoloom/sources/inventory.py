"""Where each source is looked for, whether it is there, and how well it is supported."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import plain_provider_name

# Sources with their names, formats and support.
SOURCES = (
    ("claude", "Claude Code", "JSONL transcripts", "built-in", ".claude/projects"),
    ("codex", "OpenAI Codex", "JSONL + optional SQLite", "built-in", ".codex/sessions"),
    ("copilot", "GitHub Copilot CLI", "events.jsonl", "best-effort", ".copilot/session-state"),
    ("copilot-vscode", "GitHub Copilot Chat (VS Code)", "chatSessions JSON", "best-effort", ".config/Code/User/workspaceStorage"),
    ("gemini", "Google Gemini CLI", "session JSON/JSONL", "built-in", ".gemini/tmp"),
    ("opencode", "OpenCode", "read-only SQLite", "best-effort", ".local/share/opencode/opencode.db"),
    ("pi", "Pi Coding Agent", "JSONL transcripts", "built-in", ".pi/agent/sessions"),
)
EVENTS = ".local/share/chronoloom/events.jsonl"
_EDITORS = ("Code", "Code - Insiders", "VSCodium")


def history_paths(home: str | None = None, environment: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Default places of each source; an editor's only where it is installed, the first otherwise."""
    home = home or os.path.expanduser("~")
    env = os.environ if environment is None else environment
    out = {key: [os.path.join(home, place)] for key, _, _, _, place in SOURCES}
    editors = [os.path.join(home, ".config", e, "User/workspaceStorage") for e in _EDITORS]
    out["copilot-vscode"] = [e for e in editors if os.path.isdir(e)] or editors[:1]
    if env.get("PI_CODING_AGENT_SESSION_DIR"):
        out["pi"] = [env["PI_CODING_AGENT_SESSION_DIR"]]
    elif env.get("PI_CODING_AGENT_DIR"):
        out["pi"] = [os.path.join(env["PI_CODING_AGENT_DIR"], "sessions")]
    return out


def overrides(values: list[str]) -> dict[str, list[str]]:
    """Settings of the form ``name=path``, by source; other spellings of a name are taken."""
    known = {"events", *(key for key, *_ in SOURCES)}
    out: dict[str, list[str]] = {}
    for value in values:
        name, sign, path = value.partition("=")
        key = plain_provider_name(name)
        if not sign or not path.strip():
            raise ValueError(f"not a source and a path joined by an equals sign: {value!r}")
        if key not in known:
            raise ValueError(f"no reader for {name.strip()!r}; there are {', '.join(sorted(known))}")
        out.setdefault(key, []).append(os.path.expanduser(path))
    return out


def inventory(spark: SparkSession, home: str | None = None, environment: dict[str, str] | None = None) -> DataFrame:
    paths, rows = history_paths(home, environment), []
    for key, name, form, support, _ in SOURCES:
        for p in paths[key]:
            there = os.path.isfile(os.path.join(p, "opencode.db") if os.path.isdir(p) else p) if key == "opencode" else os.path.isdir(p)
            rows.append((key, name, form, p, there, support))
    events = os.path.join(home or os.path.expanduser("~"), EVENTS)
    rows.append(("events", "Open events", "open JSONL", events, os.path.isfile(events), "stable"))
    return spark.createDataFrame(rows, "id string, name string, format string, path string, detected boolean, support string")
