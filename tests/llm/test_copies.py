"""Copies among labelled texts: only those that share most of their word pairs."""

import random

import pyarrow.parquet as pq

from tallyforge.llm import toxicity


def test_one_of_each():
    r = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    base = [" ".join(r.choices(words, k=r.randrange(3, 60))) for _ in range(150)]
    texts = base + [t + " more" if len(t) > 90 else t for t in base] + ["", "", "one", "one"]
    kept = toxicity.one_of_each(texts)
    pairs = [frozenset(zip(t.split(), t.split()[1:], strict=False)) or frozenset(t.split()) for t in texts]
    for i in set(range(len(texts))) - set(kept):
        assert any(len(pairs[i] & pairs[j]) >= 0.8 * len(pairs[i] | pairs[j]) for j in kept if j < i)
    assert len(kept) <= 155


def test_different_texts_with_a_common_pair_stay():
    texts = [f"the same begin {k} " + " ".join(f"{k}x{j}" for j in range(30)) for k in range(50)]
    assert toxicity.one_of_each(texts) == list(range(50))


def held_out_recall(folder):
    from zlib import crc32

    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = [(r["doc_id"], r["text"] or "", labels[r["doc_id"]]) for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["doc_id"] in labels]
    own = [x for x in rows if crc32(str(x[0]).encode()) % 4 != 2]
    asked = [x for x in rows if crc32(str(x[0]).encode()) % 4 == 2]
    model = toxicity.fit([t for _, t, _ in own], [y for *_, y in own])
    s = toxicity.score_all([t for _, t, _ in asked], model, toxicity.hit_memo(model["index"])) >= toxicity.THRESHOLD
    bad = [x for x, (*_, y) in zip(s, asked, strict=True) if y]
    clean = [x for x, (*_, y) in zip(s, asked, strict=True) if not y]
    return sum(bad) / len(bad), sum(clean) / len(clean)


def test_held_out_recall():
    found, false = held_out_recall("/root/testdata/sf0.1")
    assert found >= 0.95 and false <= 0.02
