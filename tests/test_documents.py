"""The event-driven scanner of large documents against a whole parse."""

import json
import os
import tracemalloc

import pytest
from chronoloom.sources import documents, transcripts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

T0 = "2026-01-01T00:0{}:00Z"


def struct(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMA = struct(sessionId=T.StringType(), version=T.DoubleType(), messages=T.ArrayType(struct(type=T.StringType(), tokens=struct(input=T.LongType()))))
VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-99, 99) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
    lambda v: st.lists(v, max_size=4) | st.dictionaries(st.sampled_from(["type", "tokens", "input", "x", "sessionId", "messages", "é\""]), v, max_size=4),
    max_leaves=24,
)


def scanned(data, step):
    return [(place, json.loads(text)) for place, text in documents.scan((data[i : i + step] for i in range(0, len(data), step)), SCHEMA)]


def asked(value, schema):
    """The asked part of a parsed value."""
    out = {}
    for f in schema.fields:
        if f.name in value and f.name != "messages":
            x = value[f.name]
            if isinstance(f.dataType, T.StructType):
                if isinstance(x, dict):
                    out[f.name] = asked(x, f.dataType)
            elif not isinstance(x, (dict, list)):
                out[f.name] = x
    return out


@settings(max_examples=300, deadline=None)
@given(VALUES, st.lists(VALUES, max_size=4), st.sampled_from([1, 2, 5, 64, 4096]), st.booleans(), st.sampled_from([None, 2]))
def test_scan_is_the_whole_parse(more, items, step, escaped, indent):
    doc = {"more": more, "messages": items, "sessionId": more if isinstance(more, str) else None, "version": 2}
    data = json.dumps(doc, ensure_ascii=escaped, indent=indent).encode()
    item = SCHEMA["messages"].dataType.elementType
    want = [(i, asked(x, item)) for i, x in enumerate(items) if isinstance(x, dict)] + [(-1, asked(doc, SCHEMA))]
    assert scanned(data, step) == want


@settings(max_examples=400, deadline=None)
@given(VALUES, st.integers(0, 200), st.sampled_from(["", "{", "}", "[", "]", ",", ":", '"', "\\", "1", "-", ".", "e", " ", "\n", "\x01", "true"]), st.sampled_from([1, 3, 4096]))
def test_scan_tells_what_is_malformed(value, at, put, step):
    text = json.dumps({"messages": [value], "x": value}, ensure_ascii=False)
    text = text[: at % len(text)] + put + text[at % len(text) + 1 :]
    try:
        json.loads(text)
        good = True
    except ValueError:
        good = False
    if good:
        scanned(text.encode(), step)
    else:
        with pytest.raises(documents.Malformed):
            scanned(text.encode(), step)


def test_bytes_that_are_no_text():
    for data in (b'{"x":"\xff"}', b'{"x":"\xc3', b"", b"  ", b"{} {}", b'{"a":1}x', b"nul", b"01", b'["\\u12"]'):
        with pytest.raises(documents.Malformed):
            scanned(data, 4)
    assert scanned(b' 12 ', 1) == [(-1, {})] and scanned(b"[]", 1) == [(-1, {})]


def test_memory_is_bounded():
    def one_string():
        yield b'{"junk":"'
        yield from (b"a" * (1 << 20) for _ in range(64))
        yield b'","messages":[{"type":"user"}]}'

    def many_items():
        one = b'{"type":"user","content":"' + b"x" * 2000 + b'","tokens":{"input":1}}'
        yield b'{"messages":[' + one
        yield from (b"," + one for _ in range(20_000))
        yield b"]}"

    for source, n in ((one_string, 2), (many_items, 20_002)):
        tracemalloc.start()
        assert sum(1 for _ in documents.scan(source(), SCHEMA)) == n
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 << 20


def write(path, doc):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        json.dump(doc, file)


def content(h):
    return {n: sorted(map(repr, getattr(h, n).collect())) for n in ("sessions", "points", "human", "exact", "tokens", "diagnostics")}


@pytest.fixture
def chats(tmp_path):
    said = lambda i, who: {"type": who, "timestamp": T0.format(i), "model": "m", "content": "x" * 50, "tokens": {"input": 5, "output": 2, "cached": 1}}
    write(f"{tmp_path}/g/chats/session-a.json", {"sessionId": "a", "messages": [said(0, "user"), said(1, "gemini")]})
    write(f"{tmp_path}/g/chats/session-b.json", {"sessionId": "b", "kind": "subagent", "messages": [said(2, "user")]})
    with open(f"{tmp_path}/g/chats/session-c.json", "w") as file:
        file.write('{"sessionId": "c", "messages": [' + json.dumps(said(3, "user")))
    asks = [{"timestamp": 1.7e12 + i * 6e4, "modelId": "copilot/m", "message": {"text": "y" * 40}, "result": {"timings": {"totalElapsed": 500.0 * i}}} for i in range(4)]
    write(f"{tmp_path}/v/w/chatSessions/1.json", {"version": 3, "sessionId": "v", "requests": asks})
    write(f"{tmp_path}/v/w/chatSessions/2.json", {"version": 4, "sessionId": "new", "requests": asks})
    return tmp_path


def test_scanned_histories_are_the_parsed_ones(spark, chats, monkeypatch):
    whole = [content(transcripts.gemini(spark, f"{chats}/g")), content(transcripts.vscode(spark, f"{chats}/v"))]
    monkeypatch.setattr(documents, "SMALL", 10)
    monkeypatch.setattr(transcripts, "SMALL", 10)
    assert [content(transcripts.gemini(spark, f"{chats}/g")), content(transcripts.vscode(spark, f"{chats}/v"))] == whole
    assert len(whole[0]["points"]) == 3 and len(whole[0]["sessions"]) == 2 and len(whole[1]["sessions"]) == 1
    monkeypatch.setattr(transcripts, "MAX_DOCUMENT", 100)
    assert transcripts.gemini(spark, f"{chats}/g").diagnostics.where("unreadable_files > 0").count() == 3
