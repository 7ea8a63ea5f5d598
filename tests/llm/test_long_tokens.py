"""Texts of one long token and of very many tokens: the spans of ``re``, in time that follows the length."""

import random
import re
import time

import numpy as np
import pytest

from tallyforge.llm import pii, secrets

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def texts():
    r = random.Random(9)
    make = lambda n, letters=LETTERS: "".join(r.choice(letters) for _ in range(n))
    return {
        "token": make(1_000_000),
        "digits": make(1_000_000, "0123456789"),
        "tokens": " ".join(make(20) for _ in range(50_000)),
        "hex": " ".join(make(r.randint(20, 30), "0123456789abcdef") for _ in range(40_000)),
        "assign": " é ".join(f"{r.choice(['token', 'Secret', 'api_key'])}={make(r.randint(3, 12))}" for _ in range(30_000)),
    }


@pytest.fixture(scope="module")
def ratio():
    r = random.Random(3)
    return [r.random() * 2 for _ in range(secrets.SIZE**2)]


@pytest.mark.parametrize("name", ["token", "digits", "tokens", "hex", "assign"])
def test_secrets_of_long_texts(spark, ratio, name):
    text = texts()[name]
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.time()
    row = secrets.scan(frame, ratio).first()
    assert time.time() - began < 30  # planning takes seconds of it
    got = {kind: [(s.start, s.end) for s in row.base if s.kind == kind] for kind in secrets.KINDS[:3]}
    assert got["assign"] == [m.span() for m in re.finditer(secrets.ASSIGN.replace("((?i:", "(?i:(").replace("key))", "key))"), text) if len(m[2]) >= 6]
    assert got["access"] == [m.span() for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 20]
    assert got["hex"] == [m.span() for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 24]
    base = [(s.start, s.end) for s in row.base]
    ends = sorted(base)
    want, at = [], 0
    for m in re.finditer(secrets.TOKEN, text):
        a, b = m.span()
        while at < len(ends) and ends[at][1] <= a:
            at += 1
        if at < len(ends) and ends[at][0] < b:
            continue
        codes = [secrets.ALPHABET.find(c) + 1 for c in m[0]]
        llr = sum(ratio[x * secrets.SIZE + y] for x, y in zip(codes, codes[1:], strict=False))
        if llr >= secrets.LEAST_SUM and llr >= secrets.LEAST_MEAN * (b - a):
            want.append((a, b))
    assert [(s.start, s.end) for s in row.found if s.kind == "random"] == want


def test_redaction_of_long_texts(spark, ratio):
    text = texts()["assign"]
    frame = spark.createDataFrame([(1, text), (2, "x" * 5000 + " é token=abcdefgh " + "\U0001f600 " * 5000), (3, "no secret")], "doc_id bigint, text string")
    rows = {x.doc_id: x for x in secrets.scan(frame, ratio).collect()}
    got = {x.doc_id: x.text for x in secrets.redact_rows(frame, ratio).collect()}
    for i, row in rows.items():
        out, at = [], 0
        for s in sorted(row.found):
            if s.start >= at:
                out += [row.text[at : s.start], "[SECRET]"]
            at = max(at, s.end)
        assert got[i] == "".join([*out, row.text[at:]])


def long_texts():
    r = random.Random(5)
    make = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    return {
        "letters": make(1_000_000, "abcd") + "@ x",
        "digits": make(1_000_000, "0123456789"),
        "addresses": " ".join(f"{make(8, 'abc.+')}@{make(5, 'abc')}.com" for _ in range(50_000)),
        "dots": "1.2.3." * 150_000,
        "sentences": "a at b. " * 100_000,
        "names": "a@" * 300_000,
        "calls": "555-123-4567 x " * 50_000,
        "blanks": "+1" + " " * 500_000 + "+1" * 100_000,
    }


@pytest.mark.parametrize("name", list(long_texts()))
def test_personal_data_of_long_texts(name):
    text = long_texts()[name]
    began = time.time()
    base = pii.base_spans(text)
    pii.beside(text, base)
    assert time.time() - began < 10
    short = text[:3000] + text[-20:]
    want = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(pii.BASE.items()) for m in re.finditer(p, short) if pii._holds(kind, m[0]))
    assert pii.base_spans(short) == want


def test_base_spans_of_random_strings():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice("aZ09..@@+-% ()1234") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(pii.BASE.items()) for m in re.finditer(p, text) if pii._holds(kind, m[0]))


def test_added_spans():
    """The search against a plain loop over all candidates, the surest first."""
    r = random.Random(4)
    x, y, _ = (np.array(v) for v in pii.examples([], 2000, seed=3))
    model = pii.boost(x.astype(float), y.astype(float), 20) | {"threshold": -1.0}
    say = ["call", "0123 456 789", "(555) 123-4567", "a.b at c.de", "joe (at) mail dot com", "x@y.org", "DE12 3456 7890 1234", "123-45-6789", "1:2:3:4:5:6:7:8", "of", "10-20", "10.0.0.1", "2024-05-06"]
    texts = [" ".join(r.choice(say) for _ in range(r.randint(1, 12))) for _ in range(300)]
    base, found = pii.finder(model)(texts)
    added = 0
    for t, b, f in zip(texts, base, found, strict=True):
        cut = lambda p, q: p[0] < q[2] and q[0] < p[2]
        asked = [s for s in pii.loose_spans(t) if not any(cut(s, o) for o in b)]
        m = pii.margins(model, np.array([pii.features(t, s[0], s[2], s[3]) for s in asked], float)) if asked else []
        want = list(b)
        for _, s in sorted(((-v, s) for v, s in zip(m, asked, strict=True) if v >= -1), key=lambda p: (p[0], p[1][:2])):
            if not any(cut(s, o) for o in want):
                want.append(s)
        assert sorted(want) == f
        added += len(f) - len(b)
    assert added > 100
