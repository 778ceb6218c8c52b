"""Fuzzy subsequence scores, the one scalar that built-in functions cannot say.

From every place of the needle's first character one path goes on by the next place of each
further one. Paths that end alike belong together; the first and the last path of the first
few ends are scored. Matched characters count, runs, word starts and humps add, gaps and a
skipped beginning cost. A 64-bit mask of the characters a label holds is kept with it and
tested in the JVM, so that labels that lack one of the needle's are not scored.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the score.
MATCH, RUN, BOUNDARY, HUMP = 16, 8, 10, 6
GAP_OPEN, GAP_MORE, MOST_LEAD, ENDS = 5, 1, 12, 4


def _fold(text: str) -> list[str]:
    return [c.lower()[:1] or c for c in text]


def _gains(label: str) -> list[int]:
    """What a match gains at each place beyond its own worth."""
    kinds = [(c.isalnum(), c.isupper()) for c in label]
    pairs = zip([(False, False), *kinds], kinds)
    return [BOUNDARY if not told else HUMP if upper and not was else 0 for (told, was), (_, upper) in pairs]


def _worth(path: list[int], gains: list[int]) -> int:
    lead = 2 * gains[path[0]] - min(path[0], MOST_LEAD)
    gaps = [b - a - 1 for a, b in zip(path, path[1:])]
    return MATCH * len(path) + lead + sum(gains[i] - GAP_OPEN - GAP_MORE * (gap - 1) if gap else RUN for gap, i in zip(gaps, path[1:]))


def _paths(wanted: list[str], label: str):
    """The path from each place of the first character, as far as it reaches the last one."""
    places: dict[str, list[int]] = {c: [] for c in wanted}
    for i, c in enumerate(_fold(label)):
        if c in places:
            places[c].append(i)
    for first in places[wanted[0]]:
        path = [first]
        for c in wanted[1:]:
            n = bisect_right(places[c], path[-1])
            if n == len(places[c]):
                return
            path.append(places[c][n])
        yield path


def score(needle: str, label: str | None) -> int | None:
    """Higher is better; None if the needle is no subsequence; 0 for an empty needle."""
    if label is None:
        return None
    if not needle:
        return 0
    ends: dict[int, list[list[int]]] = {}
    for path in _paths(_fold(needle), label):
        if path[-1] not in ends and len(ends) == ENDS:
            break
        ends.setdefault(path[-1], []).append(path)
    gains = _gains(label) if ends else []
    return max((_worth(p, gains) for paths in ends.values() for p in (paths[0], paths[-1])), default=None)


# Bits of the mask: letters, digits, other ASCII by code, and one for all characters beyond.
_DIGITS, _REST, _BEYOND = 26, 36, 63


def _bit(c: str) -> int:
    code = ord(c)
    if code > 127:
        return _BEYOND
    return code - 97 if "a" <= c <= "z" else code - 48 + _DIGITS if c.isdigit() else _REST + code % (_BEYOND - _REST)


def needle_mask(needle: str) -> int:
    mask = 0
    for c in _fold(needle):
        mask |= 1 << _bit(c)
    return mask - (1 << 64) if mask >> 63 else mask


def presence_mask(label: Column) -> Column:
    """Which characters a label holds, in either case, as bits of a long; to be kept with the label."""
    code = F.ascii
    bit = lambda c: (
        F.when(code(c) > 127, _BEYOND)
        .when(c.between("a", "z"), code(c) - 97)
        .when(c.between("0", "9"), code(c) - 48 + _DIGITS)
        .otherwise(_REST + code(c) % (_BEYOND - _REST))
    )
    one = F.lit(1).cast("long")
    return F.aggregate(F.split(F.lower(label), ""), F.lit(0).cast("long"), lambda mask, c: mask.bitwiseOR(F.call_function("shiftleft", one, bit(c))))


def may_hold(mask: Column, needle: str) -> Column:
    """False only if a character of the needle is not among the mask's."""
    wanted = needle_mask(needle)
    return mask.bitwiseAND(F.lit(wanted)) == F.lit(wanted)


def subsequence(label: Column, needle: str) -> Column:
    """Whether the needle's characters come in this order, in either case."""
    return fuzzy_score(label, needle).isNotNull()


def fuzzy_score(label: Column, needle: str, mask: Column | None = None) -> Column:
    """The score, null where the needle is not found; ``mask`` is the label's kept one."""

    @F.pandas_udf("long")
    def scored(labels: pd.Series) -> pd.Series:
        return pd.Series([score(needle, x) for x in labels], dtype="Int64")

    open_ = F.when(may_hold(presence_mask(label) if mask is None else mask, needle), label)
    return scored(open_)
