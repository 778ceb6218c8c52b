"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each with its
ancestors. Features come from ancestor tags, words of ancestors' class and id attributes,
and the text. The field is trained on labelled pages (``webpages``) and decoded by Viterbi;
blocks in the content state, in page order and one to a line, are the page's text.

Defined results: null, empty and textless pages give an empty text; scripts, styles,
comments and other elements that show no text never become blocks; damaged markup is read
as browsers do in the common cases (unclosed paragraphs, list items and cells, stray end
tags); white space within a block is one space; a line break within a block is white
space; repeated rows are judged alone; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import bounded

# Element kinds of HTML.
_BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup"
    " option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT_TAGS = frozenset(
    "script style template noscript iframe object svg math canvas video audio textarea title noembed noframes".split()
)
#: A start tag of the key ends open elements of these names, up to one of the barriers.
_ENDS = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
#: Start tags of blocks that may stand in a paragraph's place end an open paragraph.
_ENDS_P = _BLOCK_TAGS - {"button", "body", "head", "html", "legend", "caption", "td", "th", "tr", "option", "optgroup"}

_SIGN = re.compile(r"<(?:(?P<note>!--)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)|(?P<odd>[!?/]))")
#: The same where no ``>`` follows, so that no name can be a tag's.
_LATE = re.compile(r"<(?:(?P<note>!--)|(?P<end>(?!))?(?P<name>(?!))|(?P<odd>[!?/]))")
_PLAIN = re.compile(r"""[^>"']*+""")
#: Attributes as they mostly are; it looks no farther than the next sign, so it costs little where it fails.
_USUAL = re.compile(r"""[^>"'<]*+(?:"[^"<>]*+"[^>"'<]*+)*+>""")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Path(NamedTuple):
    """What the features take from an element and its ancestors; grows with the kinds of marks, not with the depth."""

    marks: tuple[str, ...] = ()  # different ones of all, outermost first
    own: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()  # the two innermost block tags
    titled: bool = False

    def within(self, name: str, own: tuple[str, ...]) -> Path:
        new = tuple(x for x in own if x not in self.marks)
        block = name in _BLOCK_TAGS and name not in ("html", "body")
        tags = (*self.tags[-1:], name) if block else self.tags
        return Path(self.marks + new if new else self.marks, own, tags, self.titled or name == "h1")


class Block:
    """A leaf block: its text, its characters within links, and its ancestors' marks."""

    __slots__ = ("linked", "links", "path", "text")

    def __init__(self, text: str, linked: int, links: int, path: Path):
        self.text, self.linked, self.links, self.path = text, linked, links, path


@lru_cache(maxsize=20_000)
def _marks(name: str, attrs: str) -> tuple[str, ...]:
    """An element's marks: its tag and the words of its telling attributes."""
    out = [f"t:{name}"]
    if attrs:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                out.append("s:hidden")
            elif key == "style":
                if re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
                    out.append("s:hidden")
            else:
                for word in _WORDS.findall(value):
                    word = word.lower()
                    if len(word) > 1:
                        out.append(f"c:{word}")
                        if len(word) > 5:
                            out.append(f"c4:{word[:4]}")
    return tuple(dict.fromkeys(out))


class Tags:
    """The tags of a page from left to right, each place read a bounded number of times.

    A tag ends at the first ``>`` outside quotes. Where none follows, or a quote does not end,
    it is loose and ends at the first ``>`` at all. A search that failed is kept: a later one
    that starts where it stood outside quotes would go the same way. There are only as many
    different ways as states (outside, and in either quote), so few searches reach far.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.failed: list[tuple[list[int], list[int], int]] = []  # starts and ends outside quotes, and where it gave up
        self.unpaired: dict[str, int] = {}

    def _hopeless(self, at: int) -> bool:
        for starts, ends, stop in self.failed:
            i = bisect_right(starts, at) - 1
            if at < stop and i >= 0 and at <= ends[i]:
                return True
        return False

    def end(self, at: int) -> int:
        """Where the attributes that start here end, -1 if they do not."""
        if (usual := _USUAL.match(self.page, at)) is not None:
            return usual.end() - 1
        if at > self.last or self._hopeless(at):
            return -1
        page, starts, ends = self.page, [], []
        while True:
            starts.append(at)
            at = _PLAIN.match(page, at).end()
            ends.append(at)
            sign = page[at : at + 1]
            if sign == ">":
                return at
            # No second quote of a kind after a place is none after a later place.
            over = -1 if not sign or at >= self.unpaired.get(sign, len(page)) else page.find(sign, at + 1)
            if over < 0:
                if sign:
                    self.unpaired[sign] = min(at, self.unpaired.get(sign, len(page)))
                self.failed.append((starts, ends, at + 1))
                return -1
            at = over + 1

    def next(self, at: int) -> tuple[re.Match, int, bool] | None:
        """(sign, where the tag ends, whether it counts) of the next tag from a place on."""
        m = _SIGN.search(self.page, at, self.last + 1) or _LATE.search(self.page, max(at, self.last + 1))
        if m is None or m["name"] is None:
            return None if m is None else (m, m.end(), True)
        stop = self.end(m.end())
        return (m, stop, True) if stop >= 0 else (m, self.page.find(">", m.end()), False)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    open_: dict[str, list[int]] = {}  # places of the open elements of a name
    parts: list[str] = []
    # Equal paths are one object, so an element deep in others of its kind costs no more than the first.
    outer = Path()
    paths: dict[Path, Path] = {outer: outer}
    within: dict[tuple[int, str, str], Path] = {}
    state = {"linked": 0, "links": 0, "path": outer, "in_a": 0}

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, state["linked"], state["links"], state["path"]))
            parts.clear()
            state["linked"] = state["links"] = 0

    def write(raw: str) -> None:
        if not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        if not parts:
            if not text.strip():
                return
            state["path"] = stack[-1][1] if stack else outer
        parts.append(text)
        if state["in_a"]:
            state["linked"] += len(text.strip())

    def close(at: int) -> None:
        for name, _ in reversed(stack[at:]):
            state["in_a"] -= name == "a"
            open_[name].pop()
        del stack[at:]

    def innermost(names) -> int:
        return max((open_[n][-1] for n in names if open_.get(n)), default=-1)

    def last(names: str, barriers: tuple = ()) -> int:
        """Where the innermost open element of these names stands, -1 if none before a barrier."""
        at = innermost(names.split())
        return at if at >= innermost(barriers) else -1

    page, at = page or "", 0
    lower, tags = None, Tags(page)
    while (found := tags.next(at)) is not None:
        m, stop, counts = found
        write(page[at : m.start()])
        at = stop + 1
        if m["note"] is not None:
            stop = page.find("-->", m.start() + 2)
            at = len(page) if stop < 0 else stop + 3
            continue
        if m["odd"] is not None:
            stop = page.find(">", m.start())
            at = len(page) if stop < 0 else stop + 1
            continue
        if not counts:
            continue
        name = m["name"].lower()
        if m["end"]:
            block = name in _BLOCK_TAGS
            if block:
                flush()
            if (i := last(name, () if block else ("td", "th", "li", "div", "section", "article", "body"))) >= 0:
                close(i)
            continue
        attrs = page[m.end() : stop]
        if name in _SILENT_TAGS:
            if attrs.endswith("/") and name in ("svg", "math"):
                continue
            lower = page.lower() if lower is None else lower
            lower = lower if len(lower) == len(page) else re.sub("[A-Z]", lambda c: c[0].lower(), page)
            stop = lower.find(f"</{name}", at)
            stop = len(page) if stop < 0 else page.find(">", stop)
            at = len(page) if stop < 0 else stop + 1
            continue
        if name == "br" or name == "wbr":
            write("\n" if name == "br" else "")
            continue
        if name in _BLOCK_TAGS:
            flush()
            if name in _ENDS_P and (i := last("p", ("td", "th", "li", "div", "section", "article", "button", "table"))) >= 0:
                close(i)
        if name in _ENDS and (i := last(*_ENDS[name])) >= 0:
            # the outermost of these names before the barrier
            while i and stack[i - 1][0] in _ENDS[name][0].split():
                i -= 1
            close(i)
        if name in _VOID_TAGS:
            continue
        if name == "a":
            state["links"] += 1
            state["in_a"] += 1
        open_.setdefault(name, []).append(len(stack))
        above = stack[-1][1] if stack else outer
        if (path := within.get((id(above), name, attrs))) is None:
            path = above.within(name, _marks(name, attrs))
            path = within[id(above), name, attrs] = paths.setdefault(path, path)
        stack.append((name, path))
    write(page[at:])
    flush()
    return out


# Words that mark page furniture in the languages of the labelled pages.
_CUES = frozenset(
    "cookie cookies consent accept privacy terms imprint impressum datenschutz copyright rights reserved subscribe newsletter"
    " login sign register share tweet follow comment comments reply replies read more related advertisement sponsored anzeige"
    " publicité anuncio menu home contact about search skip permalink posted likes".split()
)
_END = re.compile(r"[.!?…:;]['\"”»)\]]*$")


def _bucket(n: float, cuts: tuple) -> int:
    return sum(n >= c for c in cuts)


@lru_cache(maxsize=50_000)
def _path_features(path: Path) -> tuple[str, ...]:
    own = [f"own:{x}" for x in path.own] or ["own:none"]
    return (*path.marks, *own, f"in:{path.tags[-2] if len(path.tags) > 1 else '-'}>{path.tags[-1] if path.tags else '-'}")


def features(found: list[Block]) -> list[tuple[str, ...]]:
    """Feature names of every block."""
    out = []
    titles = [i for i, b in enumerate(found) if b.path.titled]
    first = titles[0] if titles else -1
    for i, b in enumerate(found):
        words = b.text.split()
        density = b.linked / len(b.text)
        size = _bucket(len(words), (2, 4, 8, 15, 30, 60))
        linked = _bucket(density, (0.01, 0.25, 0.5, 0.9))
        own = [f"n:{size}", f"d:{linked}", f"nd:{size}:{linked}", f"end:{bool(_END.search(b.text))}:{size > 2}", f"after:{first >= 0 and i > first}"]
        if i == first:
            own.append("title")
        if len(words) <= 25:
            cues = {w.strip(".,:;!?()[]\"'").lower() for w in words} & _CUES
            own += [f"cue:{size > 2}"] if cues else []
            if b.text[:1] in "©↑»›|" or "©" in b.text:
                own.append("sign")
        out.append((*_path_features(b.path), *own))
    return out


class Model:
    """The trained field with its feature numbers."""

    def __init__(self, names: dict[str, int], field: crf.Crf):
        self.names, self.field = names, field

    def emissions(self, found: list[Block]) -> np.ndarray:
        """Scores of the blocks by state."""
        numbers, weights = self.names.get, self.field.weights
        out = np.zeros((len(found), 2))
        for i, fs in enumerate(features(found)):
            ids = [n for n in map(numbers, fs) if n is not None]
            if ids:
                out[i] = weights[ids].sum(axis=0)
        return out

    def content(self, page: str | None) -> list[str]:
        found = blocks(page)
        return [b.text for b, y in zip(found, self.field.viterbi(self.emissions(found))) if y] if found else []


def train(pages: list[tuple[str, list[str]]], least: int = 3) -> Model:
    """Fit on ``(html, content blocks)`` pages; a block's label is whether it is listed."""
    read = []
    for html, content in pages:
        found, wanted = blocks(html), set(content)
        read.append((features(found), [int(b.text in wanted) for b in found]))
    count: dict[str, int] = {}
    for fs, _ in read:
        for f in fs:
            for x in f:
                count[x] = count.get(x, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= least))}
    sequences = [([[names[x] for x in f if x in names] for f in fs], ys) for fs, ys in read]
    return Model(names, crf.train(sequences, len(names), rounds=120, rate=0.1, l2=2e-3))


@lru_cache(maxsize=2)
def standard_model(pages: int = 500, seed: int = 5) -> Model:
    from .webpages import labelled_pages

    return train(labelled_pages(pages, seed))


def extract(
    pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = model or standard_model()

    @F.pandas_udf("string")
    def main_text(html: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(model.content(h)) for h in html], dtype="object")

    out = bounded(pages).select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(F.col(html_col)).alias("text")
    )
    return out.withColumn("n_chars", F.length("text").cast("long"))
