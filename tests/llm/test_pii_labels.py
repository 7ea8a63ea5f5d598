"""Personal data that stands in the training texts doesn't teach the trees that it is ordinary."""

import random

import duckdb
import numpy as np

from tallyforge.llm import pii

TEXTS = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null order by doc_id").fetchall()]


def planted(texts, n):
    """The texts with a telephone number in the middle of ``n`` of them, and where: (text, start, end)."""
    r, out, where = random.Random(5), list(texts), []
    for i in [i for i, t in enumerate(texts) if len(t) > 200][:n]:
        number = f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(0, 9999):04}"
        at = texts[i].find(" ", len(texts[i]) // 2)
        at = len(texts[i]) if at < 0 else at
        out[i] = f"{texts[i][:at]} {number}{texts[i][at:]}"
        where.append((i, at + 1, at + 1 + len(number)))
    return out, where


def test_planted_numbers_in_the_training_texts():
    texts, where = planted(TEXTS[:500], 300)
    model = pii.fit(texts)
    assert model["held_back"]["unlabelled"] >= 250
    _, every = pii.finder(model)(texts)
    found = sum(any(s[0] <= a and s[2] >= b for s in every[i]) for i, a, b in where)
    assert found >= 0.95 * len(where) == 285
    held = model["held_back"]
    assert held["precision"] >= pii.PRECISION and held["recall"] >= 0.95


def test_ordinary_proposals_stay_ordinary():
    """What the generators propose in prose is labelled, and nothing of it is added."""
    model = pii.fit(TEXTS)
    assert model["held_back"]["real"] > 0
    base, every = pii.finder(model)(TEXTS)
    assert sum(map(len, every)) - sum(map(len, base)) <= 0.02 * sum(map(len, base))


def test_judged():
    """Only unknown rows lose their label, and only those that trees of the others take for data; without unknown rows nothing changes."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 2))
    y = (x[:, 0] > 0).astype(float)
    unknown = np.vstack([[3.0, 0.0], [-3.0, 0.0]])
    labels, known = pii.judged(np.vstack([unknown, x]), np.append([pii.UNKNOWN, pii.UNKNOWN], y))
    assert known.tolist() == [False, True] + [True] * 600 and labels[1] == 0 and (labels[2:] == y).all()
    labels, known = pii.judged(x, y)
    assert known.all() and (labels == y).all()
    assert pii.fit([])["held_back"]["unlabelled"] == 0
