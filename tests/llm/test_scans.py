"""Secrets and personal data against plain regular expressions and planted disguises."""

import hashlib
import random
import re
import time
from collections import Counter

from chronoloom.llm import pii, secrets
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def plain_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m)
        total = sum(n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(map(int, d[::-1])))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


pieces = st.lists(
    st.sampled_from(
        ["a@b", ".c", "@", "x_y", "%", " ", "1", "22", "255", "256", ".", "4111 1111 1111 1111", "-", "+1 (555) ", "+", "token", "API_KEY",
         ' = "', ":", "abcdef12", "AKIA", "ABCD1234EFGH", "0123456789abcdef" * 2, "f", "é", "ſecret=abcdefgh", "\n", "pass", "password='hunter2hunter2'"]
    ),
    max_size=14,
).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_base_spans_are_the_plain_ones(text):
    assert [(a, k, b) for a, k, b, _ in secrets.find(text) if k < 3] == plain_secrets(text)
    assert pii.find(text)[0] == plain_pii(text)


def test_disguises_map_back():
    cases = {
        "write to john.doe [at] example [dot] com now": ("email", "john.doe [at] example [dot] com"),
        "write to john(at)mail.example(dot)org.": ("email", "john(at)mail.example(dot)org"),
        "write jane at example dot com please": ("email", "jane at example dot com"),
        "mail jane_at_example_dot_com": ("email", "jane_at_example_dot_com"),
        "mail jаne@exаmple.com": ("email", "jаne@exаmple.com"),
        "mail ja​ne@exam​ple.com": ("email", "ja​ne@exam​ple.com"),
        "call plus one five five five two three four five six seven": ("phone", "plus one five five five two three four five six seven"),
        "call ＋１ ５５５ ２３４ ５６７８": ("phone", "＋１ ５５５ ２３４ ５６７８"),
        "card four one one one 1111 1111 one one one one": ("card", "four one one one 1111 1111 one one one one"),
        "host one nine two dot one six eight dot zero dot one": ("ip", "one nine two dot one six eight dot zero dot one"),
        "host 10[.]0[.]0[.]7": ("ip", "10[.]0[.]0[.]7"),
    }
    for text, (kind, source) in cases.items():
        found = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find(text)[1]]
        assert (kind, source) in found, (text, found)


def test_every_disguise_passes_the_gate():
    ends = [(a, b) for a in "[({<" for b in "])}>"]
    gap = ("", " ", "  ", "\t")
    ats = [f"{s}{a}{s}{w}{e}{b}{s}" for a, b in ends for w in ("at", "AT", "@") for s in gap for e in gap]
    dots = [f"{s}{a}{s}{w}{e}{b}{s}" for a, b in ends for w in ("dot", "Dot", ".") for s in gap for e in gap] + [" dot ", "_dot_"]
    texts = [f"john{at}example.com" for at in ats] + [f"john@example{dot}com" for dot in dots]
    texts += [f"john{at}example{dot}com" for at in (" at ", "_at_") for dot in dots] + [f"host 10{dot}0{dot}0{dot}7" for dot in dots[:-2]]
    for text in texts:
        found = pii.identifiers(pii.normalise(text).text)
        assert found and pii.find(text)[1], text
    rng = random.Random(4)
    for words in (["one", "two", "six", "oh"], list(pii._DIGITS)):
        for _ in range(200):
            text = "call plus " + rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(11))
            assert pii.identifiers(pii.normalise(text).text)
            assert [(k, text[a:b]) for k, a, b in pii.find(text)[1] if k == 3] == [(3, text[5:])], text
    assert pii.find("call plus 1 555 234 5678 now")[1] == [(3, 5, 24)]
    assert pii.find("one of the years 2018, 2019, 2020, 2021") == ([], [])


disguises = st.lists(
    st.sampled_from(
        ["john", "jane.doe", "@", " at ", "_at_", "[at]", " ( @ ) ", "example", "com", ".", "[.]", " dot ", "_dot_", " {dot} ", "one", "Two", "seven", "oh",
         "1", "22", "4111", " ", ", ", "-", "(", "plus ", "PLUS-", "+", "a_b", "phone", "a1", "é", "а", "\u200b", "\n"]
    ),
    max_size=16,
).map("".join)


@settings(max_examples=600, deadline=None)
@given(disguises)
def test_the_gate_lets_all_rewritten_texts_through(text):
    norm = pii.normalise(text)
    assert norm.text == text or pii._disguised(text)
    assert len(norm.text) == len(norm.start) == len(norm.end)
    assert all(0 <= a < b <= len(text) for a, b in zip(norm.start, norm.end)) and norm.start == sorted(norm.start)


def test_plain_numbers_are_no_disguise():
    card = "4111, 1111, 1111, 1111"
    assert pii.find(f"two cards {card} or three") == ([], [])
    assert pii.find(f"card {card[:-1]}one")[1] == [(2, 5, 5 + len(card) + 2)]


def test_long_runs_take_one_pass():
    parts = ("x", "1", "a_", " ", "a_at_", "a.b@c.", "[ ", "one", "plus", "(dot)", "one dot ", "x@", "._-", "at dot ")
    began = time.process_time()
    for sign in ("dot ", "zero ", "(at) "):
        for part in parts:
            pii.find(sign + part * (300_000 // len(part)) + "!")
    assert time.process_time() - began < 90


def test_clean_texts_have_no_disguise():
    for text in ("we met at noon dot", "see the dot com bubble", "one two three", "at one point seven of nine", "Éléphant à Noël"):
        assert pii.find(text) == ([], [])


def test_pii_rows(spark):
    rows = [(1, "a@b.co 1.2.3.4"), (1, "a@b.co 1.2.3.4"), (2, None), (3, ""), (None, "x" * 300_000 + " 4111111111111111")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(0))
    got = {(r.doc_id, r.spans, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find_pii(docs).collect()}
    assert got == {(1, "email:0:6,ip:7:14", 1, 1, 0, 0), (2, "", 0, 0, 0, 0), (3, "", 0, 0, 0, 0), (None, "card:300001:300017", 0, 0, 1, 0)}
    texts = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert texts[1] == "<email> <ip>" and texts[2] is None and texts[None].endswith(" <card>")
    assert pii.redact(docs).columns == docs.columns
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_secret_ownership(spark):
    rng = random.Random(1)
    live = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    shared = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    rows = [(i, f"token = {shared}", f"s{i % 7}") for i in range(40)]
    rows += [(100, f"x password={live} y", "mine"), (100, f"x password={live} y", "mine"), (101, None, None), (102, "none", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("hash", F.lit(1))
    got = secrets.secrets(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].live == f"assign:2:{11 + 24}" and by[100].examples == "" and by[100].most_owners == 1
    assert by[3].examples and by[3].live == "" and by[3].most_owners == 7
    assert by[101].spans == "" and by[102].n_hex == 0
    assert by[102].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.secrets(docs.limit(0)).count() == 0


def test_secrets_of_repeated_ids_and_many_repositories(spark):
    """Rows of one id, or of none, with like spans and other values are judged each by its own."""
    own, held, spread = "q7rmz0vhk2p9xw4t", "z81nfq6ylc3vbd5s", "k4w9tgq2xm7rpz6h"
    rows = [(1, f"token={own}", "a", "r"), (1, f"token={held}", "a", "r"), (None, f"token={own}", "a", "r"), (None, f"token={held}", "b", "r")]
    rows += [(10 + i, f"token={held}", f"o{i}", "r") for i in range(3)] + [(20 + i, f"token={spread}", "one", f"r{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string").withColumn("values", F.lit(1))
    found = secrets.secrets(docs, repo=F.col("repo"), owner=F.col("owner"))
    got = Counter((r.doc_id, r.live, r.examples, r.most_owners, r.most_repos) for r in found.collect())
    span = f"assign:0:{6 + 16}"
    live, shared, wide = (span, "", 1, 1), ("", span, 5, 1), ("", span, 1, 5)
    want = [(1, *live), (1, *shared), (None, *live), (None, *shared), *[(10 + i, *shared) for i in range(3)], *[(20 + i, *wide) for i in range(5)]]
    assert got == Counter(want)
