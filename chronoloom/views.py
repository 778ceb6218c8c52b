"""Places in the explorer: a path of row keys, its replay against the data, and views saved under a name."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import explore

# Bounds of a views file.
VERSION, MAX_VIEWS, MAX_NAME_BYTES = 1, 64, 128
#: Levels from the top, and the column that identifies their rows.
LEVELS = (("repository", "cwd"), ("period", "period"), ("category", "category"), ("commit", "sha"), ("file", "path"))
GRAINS = ("month", "day")


@dataclass(frozen=True)
class Place:
    """Keys from the overview downwards, and the grain of periods."""

    path: tuple[str, ...] = ()
    grain: str = "month"

    def toggled(self) -> Place:
        """The other grain; a period belongs to one grain, so only the repository stays."""
        return replace(self, grain=GRAINS[1 - GRAINS.index(self.grain)], path=self.path[:1])


def rows_at(commits: DataFrame, files: DataFrame, place: Place) -> DataFrame:
    """The rows that a place shows, with the ``key`` that leads on from each."""
    at = [*place.path, "", "", "", ""]
    level = len(place.path)
    if level == 0:
        rows = explore.overview(commits, files)
    elif level == 1:
        rows = explore.periods(commits, files, at[0], place.grain)
    elif level == 2:
        rows = explore.categories(commits, files, at[0], at[1], place.grain)
    elif level == 3:
        rows = explore.commits_touching(commits, files, at[2], at[0], at[1], place.grain)
    elif level == 4:
        rows = explore.files_of(files, at[3])
    else:
        return explore.history(commits, files, at[4], at[0], place.grain).withColumn("key", F.col("sha"))
    return rows.withColumn("key", F.col(LEVELS[level][1]))


def replayed(commits: DataFrame, files: DataFrame, place: Place) -> tuple[Place, str | None]:
    """As far down a path as its keys are still there, and the first key that is not."""
    done = Place((), place.grain)
    for key in place.path[: len(LEVELS)]:
        if rows_at(commits, files, done).where(F.col("key") == key).isEmpty():
            return done, key
        done = replace(done, path=(*done.path, key))
    return done, None


@dataclass
class View:
    name: str
    path: list[str] = field(default_factory=list)
    grain: str = "month"

    def place(self) -> Place:
        return Place(tuple(self.path), self.grain)


def valid(view: View) -> bool:
    size = len(view.name.encode())
    return bool(view.name.strip()) and size <= MAX_NAME_BYTES and view.name.isprintable() and view.grain in GRAINS and len(view.path) <= len(LEVELS)


def load(path: str) -> list[View]:
    """Saved views; a missing or broken file holds none, and broken entries are left out."""
    try:
        with open(path, encoding="utf-8") as file:
            entries = json.load(file)["views"]
        found = [View(str(e["name"]), [str(k) for k in e.get("path", [])], e.get("grain", "month")) for e in entries]
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return []
    return [v for v in found if valid(v)][:MAX_VIEWS]


def save(views: list[View], path: str) -> None:
    """Replace the file whole, through a temporary one beside it."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, delete=False) as file:
        json.dump({"version": VERSION, "views": [asdict(v) for v in views]}, file, ensure_ascii=False, indent=2)
    os.replace(file.name, path)


def inserted(views: list[View], view: View) -> list[View]:
    """With the view added, in the place of one of its name if there is one."""
    if not valid(view):
        raise ValueError(f"a view needs a printable name of at most {MAX_NAME_BYTES} bytes, a grain and a path of at most {len(LEVELS)} keys")
    if any(v.name == view.name for v in views):
        return [view if v.name == view.name else v for v in views]
    if len(views) >= MAX_VIEWS:
        raise ValueError(f"{MAX_VIEWS} views are saved, which is the most")
    return [*views, view]


def removed(views: list[View], index: int) -> list[View]:
    return [v for i, v in enumerate(views) if i != index]
