"""What the array decides doesn't depend on how a host is dealt over parts."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from tallyforge.llm import htmltext


def site(seed):
    """A host with notices on half, a fifth and a few of its pages, near copies of two stories, and exact copies."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    notices = [(say(9), share) for share in (0.9, 0.55, 0.45, 0.3, 0.15)]
    stories = [[say(60), say(30), say(25)] for _ in range(2)]
    rows = []
    for i in range(90):
        blocks = [say(40), say(20)] if i < 60 else [*stories[i % 2][:2], stories[i % 2][2] + (f" {i}" if i % 3 else "")]
        for text, share in notices:
            if r.random() < share:
                blocks.insert(r.randrange(len(blocks) + 1), text)
        body = "".join(f"<p>{b}</p>" for b in blocks)
        rows.append((i, f"https://{'a' if i % 9 else 'b'}.example/{i}", f"<article>{body}</article>" if i % 4 else f"<div>{body}</div>"))
    return [*rows, (90, rows[5][1], rows[5][2]), (91, rows[70][1], None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_parts_decide_as_the_whole_host(spark, monkeypatch, seed):
    frame = spark.createDataFrame(site(seed), "page_id bigint, url string, html string").repartition(3)
    read = lambda: {x._id: (x.text, x.by_array) for x in htmltext.decisions(frame).collect()}
    whole = read()
    assert sum(by_array for _, by_array in whole.values()) > 20
    for size in (8_000, 1_500, 200):
        monkeypatch.setattr(htmltext, "SECTION", size)
        assert read() == whole


def test_parts_tell_runs_by_a_few_bits():
    """What a part says first takes less than 20 bits a run; whole hashes follow of what another part may hold, and only what several hold is met."""
    r = random.Random(5)
    say = lambda n: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(400)) for _ in range(n))
    same, parts = say(60), []
    for task in range(3):
        texts = [[say(200), *[same] * (i == 0)] for i in range(60)]
        rows = [{"host": "h", "digest": f"{task} {i}", "size": 1, "marked": True, "places": "m" * len(t), "packed": htmltext.pack(t), "tie": 0, "tasks": 3, "task": task} for i, t in enumerate(texts)]
        parts.append(pa.Table.from_pylist(rows))
    said = [htmltext._say_items(table) for table in parts]
    runs = sum(sum(m.column("n").to_pylist()) for m in said)
    assert runs > 30_000 and 8 * sum(len(b) for m in said for b in m.column("body").to_pylist()) < 20 * runs
    told = answers(said, htmltext._meet, 1)
    whole = [htmltext._say_whole(table, mine(told, k)) for k, table in enumerate(parts)]
    assert all(60 <= sum(m.column("n").to_pylist()) < 1_500 for m in whole)
    told = pa.concat_tables([told, answers(whole, htmltext._meet, 2)])
    held = [htmltext._pages_of(table)[1].held() for table in parts]
    for k, hashes in enumerate(held):
        others = np.concatenate([h for i, h in enumerate(held) if i != k])
        assert (htmltext._elsewhere(hashes, 3, mine(told, k)) == np.isin(hashes, others)).all()


def mine(table, task):
    return table.filter(pa.compute.equal(table.column("task"), task))


def answers(said, add, step):
    every = pa.concat_tables(said)
    out = pa.concat_tables([add(every.filter(pa.compute.equal(every.column("part"), k))) for k in sorted(set(every.column("part").to_pylist()))])
    return out.append_column("step", pa.array([step] * len(out), pa.int32()))


def test_few_bits_are_read_back():
    r = random.Random(1)
    for n in (1, 2, 5, 1000):
        for most in (1, 3, 1000, 2**40, 2**64):
            values = np.sort(np.array([r.randrange(most) for _ in range(n)], np.uint64))
            assert (htmltext._unlisted(htmltext._listed(values), n) == values).all()


def test_hashes_of_words():
    r = random.Random(1)
    words = sorted({bytes(r.choice(b"abcdef\x00\xff") for _ in range(r.randint(0, 9))) for _ in range(5000)})
    column = pa.array(words, pa.large_binary())
    want = htmltext._word_hashes(column)
    assert len(set(want.tolist())) == len(words) and (htmltext._word_hashes(column, 7) == want).all() and (htmltext._word_hashes(column[99:]) == want[99:]).all()
