"""Quality classifier: ordinal cumulative-link regression over hashed text.

Ratings are graded 0 (rejected), 1 (usable, but abusive) and 2 (good). One
weight vector over hashed text features is shared by all grades; ordered
thresholds t0 < t1 turn the score s into P(grade > k) = sigmoid(s - tk). A
document has the expected grade P(>0) + P(>1) and is selected by its tail
probability P(grade >= 1).
"""

from __future__ import annotations

import math
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from .common import labelled_sample, map_rows, map_texts

BUCKETS = 4096
#: Labelled documents that the weights are fitted on at most.
SAMPLE = 4000
#: Least P(grade >= 1) of a document that is kept.
ACCEPT = 0.5
#: Words whose features a worker remembers.
REMEMBERED = 300_000

#: A text counts as having so many distinct words at least, so that a few words don't decide alone.
LEAST_WORDS = 20
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def shape(word: str) -> str:
    """Case and trailing marks of a word: 'Thnd***' is 'T***'."""
    core = word.rstrip(_MARKS)
    case = "-" if not core else "U" if core.isupper() and len(core) > 1 else "a" if core.islower() else "T" if core[1:].islower() or len(core) == 1 else "x" if core.isalpha() else "0"
    return case + word[len(core) :][:3]


def bucket(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


class Memo(dict):
    """Word to a value of it; forgets all when full, so that memory is bounded."""

    def __init__(self, value, room: int = REMEMBERED):
        super().__init__()
        self.value, self.room = value, room

    def __missing__(self, word):
        if len(self) >= self.room:
            self.clear()
        got = self[word] = self.value(word)
        return got


def levels(words: list[str], kinds: set[str]) -> tuple[int, int]:
    """Buckets for the tenths of words that repeat the word before, and of words seen before."""
    return bucket(f"r:{10 * sum(map(eq, words, words[1:])) // len(words)}"), bucket(f"q:{10 * (len(words) - len(kinds)) // len(words)}")


def counts(text: str, shapes: Memo, names: Memo) -> np.ndarray:
    """Shares of shapes among all words and of words among the distinct ones, and the levels of repeats."""
    words = text.split()
    if not words:
        return np.zeros(BUCKETS)
    kinds = set(words)
    x = np.bincount([shapes[w] for w in words], minlength=BUCKETS) / max(LEAST_WORDS, len(words))
    x += np.bincount([names[w] for w in kinds], minlength=BUCKETS) / max(LEAST_WORDS, len(kinds))
    x[list(levels(words, kinds))] += 1
    return x


def shape_bucket(word: str) -> int:
    return bucket("s:" + shape(word))


def name_bucket(word: str) -> int:
    return bucket("w:" + word.lower())


def fit(texts: list[str], grades: list[int], rounds: int = 250, l2: float = 2e-3) -> dict:
    """Cumulative-link fit by Adam over the whole sample. Without both ends of the scale everything is kept."""
    y = np.asarray(grades)
    if len(y) == 0 or (y > 0).all() or (y == 0).all():
        return {"w": np.zeros(BUCKETS), "t": np.array([-20.0, 0.0])}
    shapes, names = Memo(shape_bucket), Memo(name_bucket)
    x = np.stack([counts(t, shapes, names).astype(np.float32) for t in texts])
    scale = np.sqrt((x * x).mean(0)) + 1e-3
    x /= scale
    over = np.stack([y > 0, y > 1], 1).astype(float)
    # Each grade boundary weighs the rarer side up, as rejected documents are few.
    balance = np.where(over > 0, 0.5 / np.maximum(over.mean(0), 1e-3), 0.5 / np.maximum(1 - over.mean(0), 1e-3)) ** 0.5
    p = np.zeros(x.shape[1] + 2)
    p[-2:] = -1.0, 0.0  # t0 and log(t1 - t0)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, rounds + 1):
        t = np.array([p[-2], p[-2] + math.exp(p[-1])])
        s = x @ p[:-2].astype(np.float32)
        e = (1 / (1 + np.exp(-np.clip(s[:, None] - t, -30, 30))) - over) * balance / len(y)
        g = np.empty_like(p)
        g[:-2] = x.T @ e.sum(1).astype(np.float32) + l2 * p[:-2]
        g[-2], g[-1] = -e.sum(), -e[:, 1].sum() * math.exp(p[-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return {"w": p[:-2] / scale, "t": np.array([p[-2], p[-2] + math.exp(p[-1])])}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE) -> dict:
    rows = labelled_sample(docs, labels, id_col, text_col, limit)
    return fit([r[1] for r in rows], [0 if not r["quality"] else 1 if r["toxic"] else 2 for r in rows])


def scorer(model: dict):
    """texts to arrays of P(grade >= 1) and P(grade >= 2)."""
    w, t = model["w"].tolist(), model["t"]
    shapes, names = Memo(lambda word: w[shape_bucket(word)]), Memo(lambda word: w[name_bucket(word)])

    def fn(texts):
        s = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if words := text.split():
                kinds = set(words)
                s[i] = sum(map(shapes.__getitem__, words)) / max(LEAST_WORDS, len(words)) + sum(map(names.__getitem__, kinds)) / max(LEAST_WORDS, len(kinds)) + sum(w[f] for f in levels(words, kinds))
        return [1 / (1 + np.exp(-np.clip(s - k, -30, 30))) for k in t]

    return fn


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Per row: id, expected_grade, p_usable (grade 1 or more), p_good (2), accepted.

    Null and empty texts have no features and get the thresholds' own
    probabilities; equal rows get equal results; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        fn = scorer(model)

        def rows(ids, texts):
            a, b = fn(texts)
            return ids, a + b, a, b, a >= accept

        return rows

    return map_texts(docs, id_col, text_col, make, f"{id_col} {kind}, expected_grade double, p_usable double, p_good double, accepted boolean")


def keep_accepted(docs: DataFrame, model: dict, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows that are accepted, with all their columns."""

    def make():
        fn = scorer(model)
        return lambda texts: (fn(texts)[0] >= accept, None)

    return map_rows(docs, text_col, make)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


