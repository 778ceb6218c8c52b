"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it is. A transducer then normalises the text:
homoglyphs and wide or styled characters become ASCII, invisible characters vanish,
spelled digits become digits, "at" and "dot" disguises become signs. It keeps, for every
character it writes, the source characters it came from, so identifiers found in the
normalised text map back to spans of the source.

Defined results: null text counts as empty; texts without identifiers have zero counts
and empty ``spans``; every row is judged alone, so repeated rows get the same result;
extra columns are kept by ``redact`` and ignored by ``find_pii``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԝ": "W",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ⅼ": "l", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
    " ": " ", " ": " ", " ": " ",
}
# Characters without width, which vanish.
_INVISIBLE = "­​‌‍⁠﻿"
# Digit words.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}


def _fold_table() -> dict[int, str]:
    """Lookalikes, and by rule the digits and compatibility forms of one ASCII character."""
    table = {ord(k): v for k, v in _LOOKALIKES.items()}
    for code in [*range(0x250, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        char = chr(code)
        digit = unicodedata.decimal(char, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
        if code not in table and len(plain) == 1 and " " < plain < "\x7f":
            table[code] = plain
    return table


_FOLD = _fold_table()


def _char_class(codes) -> str:
    """A regex class of code points, as ranges."""
    codes = sorted(codes)
    out, start = [], codes[0]
    for now, after in zip(codes, [*codes[1:], None]):
        if after != now + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(now))}")
            start = after
    return "[" + "".join(out) + "]"


_DISGUISED_CHAR = re.compile(_char_class([*_FOLD, *map(ord, _INVISIBLE)]))
# The patterns below start at the first of a run of white space only and give no character
# back, so that each passes over a text once, however long its runs are.
_AT_SIGN = r"[\[({<]\s*+(?:at|@)\s*+[\])}>]\s*+"
_DOT_SIGN = r"[\[({<]\s*+(?:dot|\.)\s*+[\])}>]\s*+"
_AT, _DOT = rf"(?<!\s)\s*+{_AT_SIGN}", rf"(?<!\s)\s*+{_DOT_SIGN}"
_BARE_AT, _BARE_DOT = r"(?<![\s_])[\s_]++at[\s_]++", r"(?<![\s_])[\s_]++dot[\s_]++"
#: Digits, one by one or spelled, and what may stand between two of a run.
_WORD = f"(?ai:{'|'.join(_DIGITS)})"
_DIGIT = re.compile(rf"{_WORD}|[0-9]")
_DIGIT_GAP = re.compile(r"(?i)\s*+[\[({<]\s*+dot\s*+[\])}>]\s*+|\s++dot\s++|[\s,.()-]{0,3}")
#: Without one of these no run has a spelled digit or "plus"; a gap with a "dot" has a sign of its own.
_NEAR_DIGITS = re.compile(rf"{_WORD}[\s,.()-]{{0,3}}(?:{_WORD}|[0-9])|[0-9][\s,.()-]{{0,3}}{_WORD}|(?ai:plus)[\s-]++(?:{_WORD}|[0-9])")
_PLUS = re.compile(r"(?i)(?<![A-Za-z])plus[\s-]++")
_DOT_WORD = re.compile("(?i)dot")
#: Digits of a run at least.
LEAST_DIGITS = 4
#: What separates an address's local part from its domain, and labels from each other.
_AT_MARK = re.compile(rf"(?i)(?P<sure>{_AT})|@|{_BARE_AT}")
_DOT_MARK = re.compile(rf"(?i){_DOT}|{_BARE_DOT}")
_MARK = re.compile(rf"(?i)(?P<at>{_AT}|@|{_BARE_AT})|{_DOT}|{_BARE_DOT}")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]++")
_LABEL = r"[A-Za-z0-9-]++"
_ANY_DOT = rf"(?:{_DOT}|{_BARE_DOT}|\.)"
_DOMAIN_AFTER_SURE = re.compile(rf"(?i){_LABEL}(?:{_ANY_DOT}{_LABEL}){{1,6}}")
#: A bare "at" or a plain "@" is a disguise only where the domain has a disguised dot.
_DOMAIN_AFTER_BARE = re.compile(
    rf"(?i){_LABEL}(?:\.{_LABEL}){{0,4}}(?:{_DOT}|{_BARE_DOT}){_LABEL}(?:{_ANY_DOT}{_LABEL}){{0,4}}"
)
#: Labels with disguised dots that a local part may have before its last one.
LOCAL_LABELS = 4
#: Whether a text can hold a disguised sign: any bracket of the marks, or a bare "dot", without which a bare "at" does not count.
_DISGUISED_SIGN = re.compile(rf"(?i){_AT_SIGN}|{_DOT_SIGN}|dot")
_BRACKET_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9])")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end), leftmost and non-overlapping per kind."""
    found = []
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((0, start, m.end()))
            taken = m.end()
        at = text.find("@", max(at + 1, taken))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def _disguised(text: str) -> bool:
    """Whether anything in the text can be a disguise: all that ``normalise`` could rewrite passes."""
    if not text.isascii() and _DISGUISED_CHAR.search(text):
        return True
    return bool(_DISGUISED_SIGN.search(text) or _NEAR_DIGITS.search(text))


class Normalised:
    """A text under construction with the source range of each character it holds."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges by strings; each new character stands for the whole range."""
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.start, self.end = start + self.start[at:], end + self.end[at:]
        self.text = "".join(text)


def _digit_runs(text: str):
    """Runs of digits of which at least one is spelled, each as its edits: (start, end, sign).

    A run stands free of letters at both ends and may begin with "plus". Runs of plain
    digits are no disguise and stay as they are.
    """
    if not (_NEAR_DIGITS.search(text) or _DOT_WORD.search(text)):
        return
    run: list[tuple[int, int]] = []
    plus = {m.end(): m.start() for m in _PLUS.finditer(text)}
    letter = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalpha()

    def edits() -> list[tuple[int, int, str]] | None:
        first, last = 0, len(run)
        while first < last and letter(run[first][0] - 1):
            first += 1
        while last > first and letter(run[last - 1][1]):
            last -= 1
        if last - first < LEAST_DIGITS:
            return None
        start, out, end = plus.get(run[first][0]), [], None
        if start is not None:
            out.append((start, run[first][0], "+"))
        for a, b in run[first:last]:
            if end is not None and a > end:
                gap = text[end:a]
                sign = "." if _DOT_WORD.search(gap) else "".join(c for c in gap if c in ".()-")
                if sign != gap:
                    out.append((end, a, sign))
            if b - a > 1:
                out.append((a, b, _DIGITS[text[a:b].lower()]))
            end = b
        spelled = start is not None or any(b - a > 1 for a, b in run[first:last]) or any(_DOT_WORD.search(text[a:b]) for a, b, _ in out)
        return out if spelled else None

    for m in _DIGIT.finditer(text):
        if run and not _DIGIT_GAP.fullmatch(text, run[-1][1], m.start()):
            if found := edits():
                yield found
            run = []
        run.append(m.span())
    if run and (found := edits()):
        yield found


def _addresses(text: str):
    """(start, end) of addresses with a disguised sign, leftmost and non-overlapping."""
    marks = list(_AT_MARK.finditer(text))
    if not marks:
        return
    runs = [m.span() for m in _LOCAL_RUN.finditer(text)]
    starts = [a for a, _ in runs]
    dots = {m.end(): m.start() for m in _DOT_MARK.finditer(text)}
    taken = 0

    def label_before(end: int) -> int:
        """Where the run of local characters that ends at ``end`` starts; ``end`` if none does."""
        at = bisect_right(starts, end - 1) - 1
        return max(starts[at], taken) if at >= 0 and end <= runs[at][1] else end

    for m in marks:
        if m.start() < taken:
            continue
        start = label_before(m.start())
        if start >= m.start():
            continue
        domain = (_DOMAIN_AFTER_SURE if m["sure"] else _DOMAIN_AFTER_BARE).match(text, m.end())
        if not domain:
            continue
        for _ in range(LOCAL_LABELS):
            before = dots.get(start)
            if before is None or before <= taken or label_before(before) >= before:
                break
            start = label_before(before)
        taken = domain.end()
        yield start, taken


def normalise(text: str) -> Normalised:
    out = Normalised(text)
    if not text.isascii():
        out.text = text.translate(_FOLD)
        out.rewrite([(m.start(), m.end(), "") for m in re.finditer(f"[{_INVISIBLE}]+", out.text)])
    out.rewrite([edit for run in _digit_runs(out.text) for edit in run])
    edits = []
    for start, end in _addresses(out.text):
        edits += [(m.start(), m.end(), "@" if m["at"] else ".") for m in _MARK.finditer(out.text, start, end)]
    out.rewrite(edits)
    out.rewrite([(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(out.text)])
    return out


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that only show after normalising, each sorted."""
    base = sorted(identifiers(text))
    if not _disguised(text):
        return base, []
    norm = normalise(text)
    more = set()
    for kind, a, b in identifiers(norm.text):
        start, end = norm.start[a], norm.end[b - 1]
        # Base spans of a kind do not overlap: only the last that starts by then can hold this one.
        at = bisect_right(base, (kind, start, len(text))) - 1
        if at < 0 or base[at][0] != kind or end > base[at][2]:
            more.add((kind, start, end))
    return base, sorted(more)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"


def scan(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        base, more = find(text or "")
        n = Counter(k for k, _, _ in base)
        digest = hashlib.sha256(_joined(base).encode()).hexdigest()
        out.append((n[0], n[1], n[2], n[3], digest, _joined(sorted(base + more)), len(more)))
    return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"])


def redacted(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        if text:
            base, more = find(text)
            done, pieces = 0, []
            for kind, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
                if b <= done:
                    continue
                pieces += [text[done : max(a, done)], f"<{KINDS[kind]}>" if a >= done else ""]
                done = b
            text = "".join(pieces) + text[done:] if done else text
        out.append(text)
    return pd.Series(out, dtype="object")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return bounded(docs).select(F.col(id_col).alias("doc_id"), F.pandas_udf(scan, _SCHEMA)(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; null stays null."""
    return bounded(docs).withColumn(text_col, F.pandas_udf(redacted, "string")(F.col(text_col)))
