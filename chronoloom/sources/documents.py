"""Large JSON documents read event by event: what is not asked for is passed over, never held.

``scan`` takes a document's bytes in chunks and a schema, and gives the items of the schema's
one array field as they close, each as a small JSON text of the asked fields, then the other
asked fields of the document. It checks the whole grammar. Memory is a chunk, the open
brackets and the asked scalars of one item, whatever a document's size: a string that is not
asked for can be as long as the document, and so can the array.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import local_path

#: Documents up to this size are parsed whole in the JVM; above, they are scanned.
SMALL = 4 << 20
CHUNK = 1 << 20
#: Longest asked scalar that is kept, and deepest nesting.
MOST_SCALAR, MOST_DEPTH = 1 << 20, 512

_PLAIN = rb'[^"\\\x00-\x1f]*'
_ESCAPE = rb'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})'
_TOKEN = re.compile(
    rb"[ \t\r\n]*(?:([{}\[\]:,])|(\"" + _PLAIN + rb"(?:" + _ESCAPE + _PLAIN + rb")*\")"
    rb"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?=[ \t\r\n,\]}])|true|false|null))"
)
_SPACE = re.compile(rb"[ \t\r\n]*")
_INSIDE = re.compile(_PLAIN + rb"(?:" + _ESCAPE + _PLAIN + rb")*")


class Malformed(ValueError):
    """The bytes are not one JSON document."""


class _Open:
    """An open bracket: what is asked of it, what was found, and what may come next."""

    __slots__ = ("asked", "count", "found", "is_object", "key", "next")

    def __init__(self, is_object: bool, asked: T.DataType | None):
        self.is_object, self.asked = is_object, asked
        self.found: dict | None = {} if is_object and isinstance(asked, T.StructType) else None
        self.key: str | None = None
        self.count = 0
        self.next = "first"

    def wanted(self) -> T.DataType | None:
        """What is asked of the value that comes now."""
        if self.found is not None and self.key is not None:
            return next((f.dataType for f in self.asked.fields if f.name == self.key), None)
        return self.asked.elementType if not self.is_object and isinstance(self.asked, T.ArrayType) else None


def _written(found: dict) -> str:
    return "{" + ",".join(f'"{k}":{_written(v) if isinstance(v, dict) else v}' for k, v in found.items()) + "}"


def _tokens(chunks: Iterable[bytes], keeps) -> Iterator[tuple[str, bytes]]:
    """("mark" | "text" | "word", bytes) of a document; a long string comes cut, or empty unless ``keeps()``."""
    decoder, source = codecs.getincrementaldecoder("utf-8")(), iter(chunks)
    buffer, at, ended = b"", 0, False

    def more() -> bool:
        """Go on to the next chunk; the end counts as one, of a line end."""
        nonlocal buffer, at, ended
        if ended:
            return False
        piece = next(source, None)
        ended = piece is None
        decoder.decode(piece or b"", ended)
        buffer, at = buffer[at:] + (b"\n" if ended else piece), 0
        return True

    while True:
        met = _TOKEN.match(buffer, at)
        if met:
            at = met.end()
            yield ("mark", "text", "word")[met.lastindex - 1], met[met.lastindex]
            continue
        at = _SPACE.match(buffer, at).end()
        if buffer[at : at + 1] == b'"':
            kept = [b'"']
            size, at, hold = 0, at + 1, keeps()
            while True:
                part = _INSIDE.match(buffer, at)
                if hold and size < MOST_SCALAR:
                    kept.append(buffer[at : part.end()])
                    size += part.end() - at
                at = part.end()
                if buffer[at : at + 1] == b'"':
                    at += 1
                    break
                if len(buffer) - at > 6 or not more():  # more than a broken escape can be
                    raise Malformed("a string does not end")
            yield "text", b"".join(kept) + b'"' if hold and size < MOST_SCALAR else b""
            continue
        if not more():
            if buffer[at:].strip(b" \t\r\n"):
                raise Malformed("unexpected characters")
            return


def scan(chunks: Iterable[bytes], schema: T.StructType) -> Iterator[tuple[int, str]]:
    """(place, item) of the array's objects, then (-1, the document's other fields). Raises ``Malformed``."""
    stack: list[_Open] = []
    top: _Open | None = None
    done = False

    def keeps() -> bool:
        """Whether the string that comes is a key or asked for."""
        here = stack[-1] if stack else None
        return here is not None and (here.is_object and here.next in ("first", "key") or isinstance(here.wanted(), T.AtomicType))

    try:
        for kind, raw in _tokens(chunks, keeps):
            here = stack[-1] if stack else None
            if done:
                raise Malformed("more than one value")
            closing = kind == "mark" and raw in b"}]"
            if here is None or here.next in ("value", "first") and not closing:
                if here is not None and here.is_object and here.next == "first":
                    if kind != "text":
                        raise Malformed("a key is missing")
                    here.key, here.next = raw[1:-1].decode(), "colon"
                    continue
                asked = schema if here is None else here.wanted()
                if kind == "mark":
                    if raw not in b"{[" or len(stack) >= MOST_DEPTH:
                        raise Malformed("a value is missing")
                    opened = _Open(raw == b"{", asked)
                    if here is None:
                        top = opened
                    stack.append(opened)
                    continue
                if here is None:
                    done = True
                    continue
                if here.found is not None and isinstance(asked, T.AtomicType) and raw:
                    here.found[here.key] = raw.decode()
                here.count += 1
                here.next = "comma"
                continue
            if closing:
                if (raw == b"}") != here.is_object or here.next not in ("first", "comma"):
                    raise Malformed("a bracket does not match")
                stack.pop()
                if not stack:
                    done = True
                    continue
                outer = stack[-1]
                if outer.found is not None and here.found is not None:
                    outer.found[outer.key] = here.found
                if here.found is not None and len(stack) == 2 and not outer.is_object and outer.asked is not None:
                    yield outer.count, _written(here.found)
                outer.count += 1
                outer.next = "comma"
            elif here.next == "comma" and raw == b",":
                here.next = "key" if here.is_object else "value"
            elif here.next == "colon" and raw == b":":
                here.next = "value"
            elif here.next == "key" and kind == "text":
                here.key, here.next = raw[1:-1].decode(), "colon"
            else:
                raise Malformed("unexpected token")
    except UnicodeDecodeError as bad:
        raise Malformed("not UTF-8") from bad
    if not done:
        raise Malformed("the document does not end")
    yield -1, _written(top.found) if top is not None and top.found is not None else "{}"


def _opened(path: str) -> BinaryIO:
    if re.match("^[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_stream(inner)
    return open(path, "rb")


def _chunks(stream: BinaryIO) -> Iterator[bytes]:
    while piece := stream.read(CHUNK):
        yield piece


def scanned(files: DataFrame, schema: str, array: str) -> tuple[DataFrame, DataFrame]:
    """Heads (file, ok, d) and items (file, ord, item) of documents, by ``file``; items of malformed ones are left out.

    ``array`` names the schema's field of items; a task reads one document at a time.
    """
    whole = T.StructType.fromDDL(schema)
    item = whole[array].dataType.elementType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, path in zip(batch["file"], batch["path"]):
                rows: list[tuple] = []
                try:
                    with _opened(path) as stream:
                        for place, text in scan(_chunks(stream), whole):
                            rows.append((file, place, True, text))
                            if len(rows) >= 5000:
                                yield pd.DataFrame(rows, columns=["file", "ord", "ok", "text"])
                                rows = []
                except (Malformed, OSError):
                    rows = [(file, -1, False, None)]
                yield pd.DataFrame(rows, columns=["file", "ord", "ok", "text"])

    located = F.when(F.col("file").rlike("^(file:|/)"), local_path(F.col("file"))).otherwise(F.col("file")).alias("path")
    found = files.select("file", located).repartition("file").mapInPandas(read, "file string, ord long, ok boolean, text string")
    heads = found.where("ord < 0").select("file", "ok", F.from_json("text", schema).alias("d"))
    items = found.where("ord >= 0").select("file", "ord", F.from_json("text", item).alias("item"))
    return heads, items.join(heads.where("ok").select("file"), "file", "left_semi")


def large(spark: SparkSession, path: str | list[str], glob: str, most: int) -> DataFrame:
    """(file) of documents above ``SMALL`` and up to ``most``, by listing only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.where(F.col("length").between(SMALL + 1, most)).select(F.col("path").alias("file"))
