"""Nulls, empty and long texts, ties, repeated rows, clashing names and empty tables, for every operator."""

import pytest

from tallyforge.llm import ctw, decontaminate, gif, htmltext, packing, pii, quality, secrets, simhash, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _text string, start string, score string, fp string, base string, more string, row string, word string, media string"
LONG = "alpha beta gamma, delta. " * 6000 + "password=abcdef12345 me@example.org"
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "same text here, twice told"), (5, "same text here, twice told"), (6, "same text here, twice told"), (None, "no id, token: 0123456789abcdef0123456789abcdef"), (8, "日本語 ÄÖ x y é \U0001f600 <|endoftext|>"), (9, "one")]
EXTRA = (None, "x", None, *"abcdefghij")


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 1), (5, 1, 0), (5, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta alpha beta gamma delta"), (2, None), (3, ""), (4, "one"), (1, "alpha beta gamma delta alpha beta gamma delta")], "item_id bigint, text string")


def by_id(rows, column="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[column], []).append(r)
    return out


def test_quality(messy, labels):
    model = quality.train(messy, labels)
    got = by_id(quality.score(messy, model).collect())
    assert sum(map(len, got.values())) == len(TEXTS)
    assert got[5][0] == got[5][1] and got[1][0][1:] == got[2][0][1:]
    assert all(0 <= r.p_good <= r.p_usable <= 1 for rs in got.values() for r in rs)
    kept = quality.keep_accepted(messy, model)
    assert kept.columns == messy.columns and kept.count() == sum(r.accepted for rs in got.values() for r in rs)


def test_secrets(messy):
    ratio = secrets.train(messy)
    got = by_id(secrets.digest(secrets.scan(messy, ratio)).collect())
    assert sum(map(len, got.values())) == len(TEXTS)
    assert got[1][0].spans == "" and got[4][0].n_assign == 1 and got[None][0].n_hex == 1
    clean = by_id(secrets.redact_rows(messy, ratio).collect())
    assert clean[1][0].text is None and "abcdef12345" not in clean[4][0].text and clean[5][0].text == TEXTS[4][1]
    assert clean[4][0].base == "f" and clean[4][0].more == "g"


def test_packing(messy):
    got = packing.pack(messy).collect()
    held = by_id(got)
    assert {r.doc_tokens for r in held[1]} == {1} == {r.length for r in held[2]}
    assert sum(r.length for r in held[4]) == held[4][0].doc_tokens
    assert sum(r.length for r in held[5]) == 2 * held[5][0].doc_tokens


def test_simhash(messy):
    got = by_id(simhash.near_duplicates(messy).collect())
    assert sum(map(len, got.values())) == len(TEXTS)
    assert got[1][0].fp == 0 == got[3][0].fp and {got[i][0].component_id for i in (1, 2, 3)} == {1}
    assert {r.component_id for i in (5, 6) for r in got[i]} == {5}
    kept = simhash.keep_first(messy)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 8), (False, 9), (True, 0)]
    assert kept.columns == messy.columns


def test_toxicity(messy, labels):
    got = by_id(toxicity.score(messy, toxicity.train(messy, labels)).collect())
    assert sum(map(len, got.values())) == len(TEXTS)
    assert got[1][0].score == got[2][0].score and got[None][0].held_out is False


def test_decontamination(messy, benchmark):
    model = decontaminate.train(messy, benchmark)
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(messy, model).collect()}
    assert (4, 1) in got and (9, 4) in got and not any(i in (2, 3) for _, i in got)
    kept = decontaminate.keep_clean(messy, model)
    assert kept.columns == messy.columns and {4, 9}.isdisjoint(r.doc_id for r in kept.collect())


def test_media(messy):
    got = by_id(gif.media(messy).collect())
    assert sum(map(len, got.values())) == len(TEXTS)
    assert got[1][0].payload_bytes == 192 == got[2][0].payload_bytes and got[1][0].n_bytes == 0
    assert got[4][0].n_bytes == len(LONG) and got[5][0] == got[5][1]


def test_pii(messy):
    got = by_id(pii.find(messy, pii.train(messy)).collect())
    assert sum(map(len, got.values())) == len(TEXTS)
    assert got[4][0].n_email == 1 and "me@example.org" not in got[4][0].redacted and got[1][0].spans == ""


def test_lm(messy):
    got = by_id(ctw.score(messy, ctw.train(messy)).collect())
    assert sum(map(len, got.values())) == len(TEXTS)
    assert got[1][0].n_tokens == 1 == got[3][0].n_tokens and got[5][0][1:] == got[5][1][1:]
    assert all(r.score < 0 and r.base_score < 0 for rs in got.values() for r in rs)


def test_pages(spark):
    rows = [(1, None, None, "x"), (2, "http://h/a", "", "x"), (3, "::bad", "<p>a", "x"), (None, "http://h/b", "<article><p>t</article>", "x"), (3, "::bad", "<p>a", "x")]
    got = by_id(htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect(), "page_id")
    assert sum(map(len, got.values())) == 5
    assert got[1][0].text == "" == got[2][0].text and got[3][0].text == "a" and got[None][0].text == "t"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert quality.score(docs, quality.train(docs, labels)).count() == 0
    assert secrets.scan(docs, secrets.train(docs)).count() == 0
    assert packing.pack(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 0
    assert decontaminate.matches(docs, decontaminate.train(docs, bench)).count() == 0
    assert gif.media(docs).count() == 0
    assert pii.find(docs, pii.train(docs)).count() == 0
    assert htmltext.extract(pages).count() == 0
    assert ctw.score(docs, ctw.train(docs)).count() == 0


@pytest.mark.parametrize("rows", [[], TEXTS], ids=["empty", "messy"])
def test_pipeline_stages(spark, tmp_path, labels, benchmark, rows, monkeypatch):
    """Every stage on an empty table and on odd rows: all columns, and no row lost but by a decision."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (labels if rows else labels.limit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    (benchmark if rows else benchmark.limit(0)).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        # Each stage on what was read back, as the pipeline does it.
        path = f"{tmp_path}/{len(sizes)}"
        stage(spark, kept, str(tmp_path)).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    got = packed.groupBy("doc_id").sum("length").count()
    if rows:
        assert sizes[2] == sizes[3] and got == kept.select("doc_id").distinct().count()
        assert all("abcdef12345" not in (r.text or "") and (r.text is None) == (r.n_chars is None) for r in kept.collect())
    else:
        assert sizes == [0, 0, 0, 0] and packed.count() == 0
