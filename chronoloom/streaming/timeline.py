"""One timeline of work blocks over all keys, as a stream with late and unordered input.

Each micro-batch folds its signals to short blocks in the tasks that read them, so what meets
in the timeline's one state is few rows, whatever the number of signals. There blocks join
where a new signal closes the gap between them. A block is open while a signal could still
reach it; a timer on the watermark closes it and drops its state.

The result is a changelog by ``first``: the newest ``version`` of a block's first instant holds,
and one with no signals says that the block has gone into an earlier or larger one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BLOCK = "line string, first_us long, last_us long, signals long, closed boolean, version long"
_PIECE = "line string, ts timestamp, first_us long, last_us long, signals long"


def joined(blocks: list[tuple[int, int, int]], idle_us: int) -> list[tuple[int, int, int]]:
    """(first, last, signals) with those at most ``idle_us`` apart put together."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(blocks):
        if out and first - out[-1][1] <= idle_us:
            a, z, m = out[-1]
            out[-1] = (a, max(z, last), m + n)
        else:
            out.append((first, last, n))
    return out


class Blocks(StatefulProcessor):
    """Open blocks of one timeline by their first instant, and the number of changes so far."""

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "first long", "last long, signals long")
        self.version = handle.getValueState("version", "n long")

    def _due(self, last_us: int) -> int:
        """When, in milliseconds, no signal can join a block any more."""
        return (last_us + self.idle_us) // 1000 + 1

    def _next(self) -> int:
        n = self.version.get()[0] + 1 if self.version.exists() else 1
        self.version.update((n,))
        return n

    def _told(self, key: tuple, rows: list[tuple[int, int, int, bool]]) -> pd.DataFrame:
        n = self._next()
        return pd.DataFrame([(key[0], *r, n) for r in rows], columns=["line", "first_us", "last_us", "signals", "closed", "version"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: (v[0], v[1]) for k, v in self.open.iterator()}
        new = [tuple(map(int, r)) for part in rows for r in zip(part["first_us"], part["last_us"], part["signals"])]
        after = {a: (z, n) for a, z, n in joined([(a, *v) for a, v in before.items()] + new, self.idle_us)}
        told = [(a, *after.get(a, (v[0], 0)), False) for a, v in before.items() if after.get(a) != v]
        told += [(a, *v, False) for a, v in after.items() if a not in before]
        for a in before.keys() - after.keys():
            self.open.removeKey((a,))
        for a, v in after.items():
            if before.get(a) != v:
                self.open.updateValue((a,), v)
                self.handle.registerTimer(self._due(v[0]))
        yield self._told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = [(k[0], v[0], v[1], True) for k, v in self.open.iterator() if self._due(v[0]) <= now]
        for a, *_ in over:
            self.open.removeKey((a,))
        yield self._told(key, over)

    def close(self) -> None:
        pass


def timeline(signals: DataFrame, idle_us: int, late: str = "1 hour", line: str = "all") -> DataFrame:
    """Changes of the blocks of all signals (``ts``) of a stream, to be written in update mode.

    The session needs the state store that keeps several states of a key
    (``spark.sql.streaming.stateStore.providerClass`` for RocksDB).
    """

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us = [(int(t), int(t), 1) for t in batch["us"]]
            rows = joined(us, idle_us)
            frame = pd.DataFrame([(line, pd.Timestamp(z, unit="us"), a, z, n) for a, z, n in rows], columns=["line", "ts", "first_us", "last_us", "signals"])
            yield frame

    pieces = signals.select(F.unix_micros("ts").alias("us")).mapInPandas(folded, _PIECE).withWatermark("ts", late)
    return pieces.groupBy("line").transformWithStateInPandas(Blocks(idle_us), BLOCK, "update", "eventTime")


def current(changes: DataFrame) -> DataFrame:
    """The blocks that hold, from the changes written so far."""
    newest = F.max_by(F.struct("last_us", "signals", "closed"), "version").alias("b")
    return changes.groupBy("line", "first_us").agg(newest).select("line", "first_us", "b.*").where("signals > 0")
