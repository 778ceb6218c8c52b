"""Terms of texts, cut in whole Arrow columns: no string of Python is made per term.

A term is a longest run of bytes that a class keeps. Both classes keep every byte of the
characters beyond ASCII, so cutting UTF-8 bytes is cutting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at once; one longer text is cut alone.
SLICE_BYTES = 8 << 20


def cutting_table(digits: bool) -> bytes:
    """Each byte's image: letters (A-Z lowered), bytes beyond ASCII and, if asked, digits stay; all else is a space."""
    keep = lambda b: b >= 128 or 97 <= b <= 122 or (digits and 48 <= b <= 57)
    lowered = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if keep(b) else 32 for b in lowered)


LETTERS, WORDS = cutting_table(False), cutting_table(True)


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of at most about SLICE_BYTES, each with the place of its first row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        before = ends[at] - sizes[at]
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def cut(texts: pa.Array, table: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, dictionary, code): the row of each term and its place in the dictionary of different terms."""
    whole = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.cumsum(np.asarray(pc.binary_length(whole), np.int64))
    data = b"".join(whole.to_pylist()).translate(table)
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype("<i8"))
    image = pa.Array.from_buffers(pa.large_string(), len(whole), [None, offsets, pa.py_buffer(data)])
    runs = pc.ascii_split_whitespace(image)
    row = np.asarray(pc.list_parent_indices(runs), np.int64)
    coded = pc.list_flatten(runs).dictionary_encode()
    names, code = coded.dictionary, np.asarray(coded.indices, np.int64)
    real = np.asarray(pc.not_equal(names, ""))
    if not real.all():  # a text that starts or ends with a space gives empty runs
        keep = real[code]
        row, code = row[keep], (np.cumsum(real) - 1)[code[keep]]
        names = names.filter(pa.array(real))
    return row, names, code


def per_row(row: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, times) of each different pair, by row and code."""
    pair, times = np.unique(row * max(width, 1) + code, return_counts=True)
    return pair // max(width, 1), pair % max(width, 1), times
