"""Appending to an open event log, one checked record at a time."""

from __future__ import annotations

import json
import os
import re
from datetime import datetime, timezone

from ..functions.names import PROVIDER_ALIASES


def _time(text: str | None, name: str) -> datetime | None:
    if text is None:
        return None
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})", text):
        raise ValueError(f"{name} must be an RFC 3339 time")
    return datetime.fromisoformat(text.upper().replace("Z", "+00:00"))


def event_record(
    provider: str, session_id: str, cwd: str, model: str | None = None, event: str = "activity", role: str = "foreground",
    timestamp: str | None = None, started_at: str | None = None, completed_at: str | None = None, now: datetime | None = None,
) -> dict:
    """A valid record; its time is the given one, else the completion, else now."""
    name = provider.strip().lower().replace("_", "-")
    name = PROVIDER_ALIASES.get(name, name)
    if not re.fullmatch(r"[a-z0-9][a-z0-9./-]{0,63}", name) or name == "all":
        raise ValueError("invalid provider")
    if not session_id.strip() or len(session_id.encode()) > 256 or re.search(r"[\x00-\x1f\x7f-\x9f]", session_id):
        raise ValueError("invalid session id")
    if not cwd.strip():
        raise ValueError("a directory is needed")
    if model is not None and model != "<synthetic>" and not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._:/+<>-]{0,127}", model):
        raise ValueError("invalid model")
    if event not in ("activity", "prompt") or role not in ("foreground", "subagent"):
        raise ValueError("invalid event or role")
    start, end = _time(started_at, "started_at"), _time(completed_at, "completed_at")
    if (start is None) != (end is None):
        raise ValueError("started_at and completed_at go together")
    if start and end and end <= start:
        raise ValueError("completed_at must be after started_at")
    at = _time(timestamp, "timestamp") or end or now or datetime.now(timezone.utc)
    record = {"timestamp": at.isoformat(), "provider": name, "session_id": session_id, "cwd": cwd, "event": event, "role": role}
    record |= {k: v for k, v in (("model", model), ("started_at", started_at), ("completed_at", completed_at)) if v is not None}
    return record


def append(record: dict, path: str) -> None:
    """One line, in one write."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "ab") as file:
        file.write((json.dumps(record, ensure_ascii=False) + "\n").encode())
