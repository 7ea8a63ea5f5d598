"""Token alignment, SentencePiece with offsets, and interval overlaps against plain loops and the libraries."""

import hashlib
import random
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import alignment, intervals, pieces

SF = "/root/testdata/sf0.001"
BITS = [" ", "  ", "a", "b", "é", "漢", "🎉", "\n", "\t", "\x00", "́", "word", "ﬁ", "①", "<s>", "<|endoftext|>", "<0x41>", "﻿", "x" * 70, "'s", "12", "!?", " the", " of", "\n\n", "\xa0", "▁"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(1)
    made = ["".join(r.choices(BITS, k=r.randrange(30))) for _ in range(1500)]
    return made + [x[0] or "" for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["q" * 200_000, "ab " * 50_000, " " * 3000]


def test_pieces_and_spans(library, texts):
    model = pieces.Model()
    ids, begins, ends, offsets = model.encode(texts)
    for k, text in enumerate(texts):
        want = library.encode(text, return_type="proto").pieces if len(text) < 5000 else None
        lo, hi = offsets[k], offsets[k + 1]
        own = ids[lo:hi].tolist()
        assert own == library.encode(text), text[:50]
        if want is not None:
            assert list(zip(begins[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)) == [(p.begin, p.end) for p in want]
        assert model.decode(own) == library.decode(own)


def test_decoding_of_any_ids(library):
    model, r = pieces.Model(), random.Random(2)
    for _ in range(3000):
        ids = [r.choice((r.randrange(32_000), r.randrange(3, 259), r.randrange(3), 28_705)) for _ in range(r.randrange(12))]
        assert model.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_maps(rule, squeeze):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    spec = {}
    for n, value in pieces.fields(theirs.serialized_model_proto()):
        if n == 3:
            spec |= dict(pieces.fields(value))
    own, r = pieces.Normalizer(spec), random.Random(3)
    for _ in range(1500):
        text = "".join(r.choices([*BITS, "ｶﾞ", "Ａ", "ß", "İ", "　", "é", "한", "가"], k=r.randrange(25)))
        want, offsets = theirs.normalize(text, with_offsets=True)
        got, at = own(text)
        place = {len(text[:i].encode()): i for i in range(len(text) + 1)}
        assert got == want
        if got:  # else there is nothing whose source could be told
            assert [place[int(x)] for x in at] == list(offsets)


def test_pieces_of_odd_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "c\n" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = pieces.encode(df, decoded=True).collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 3, None] and [r.decoded for r in got] == ["", "", "a b", "a b", "c\n" * 50_000]
    assert got[2].ids == got[3].ids == library.encode("a b") and (got[2].begins, got[2].ends) == ([0, 1], [1, 3])
    assert pieces.encode(df.limit(0)).count() == 0
    again = pieces.decode(spark.createDataFrame([([264, 287], "k"), ([], "l"), (None, "m")], "ids array<int>, decoded string")).collect()
    assert [r.decoded for r in again] == ["a b", "", None]


def test_pieces_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pieces.query(spark, SF).collect()}
    assert set(got) == set(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for k, text in docs.items():
        ids = library.encode(text)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256, got[k].span_bytes) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len(text.encode()))


def plain_alignment(a, b, text):
    """Tokens, groups as text and links, by two pointers."""
    none = (0, 0, "", Counter())
    if not text:
        return none
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = alignment.ByteLevel().raw if not hasattr(plain_alignment, "raw") else plain_alignment.raw
    plain_alignment.raw = raw
    own_a = [raw[i] for i in ids_a]
    own_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not (b"".join(own_a) == b"".join(own_b) == (" " + text).encode()):
        return none
    groups, links, i, j, x, y = [], Counter(), 0, 0, 0, 0
    while i < len(ids_a):
        lo_i, lo_j = i, j
        x += len(own_a[i])
        y += len(own_b[j])
        i += 1
        j += 1
        while x != y:
            if x < y:
                x += len(own_a[i])
                i += 1
            else:
                y += len(own_b[j])
                j += 1
        groups.append(",".join(map(str, ids_a[lo_i:i])) + "|" + ",".join(map(str, ids_b[lo_j:j])))
        links[ids_a[i - 1], ids_b[j - 1]] += 1
    return len(ids_a), len(ids_b), ";".join(groups), links


def test_alignment(spark, library, texts):
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    want = [plain_alignment(a, library, t) for t in texts]
    rows = list(enumerate(texts)) + [(5000, None), (5001, texts[7]), (5001, texts[7])]
    want += [(0, 0, "", Counter()), want[7], want[7]]
    total, best = Counter(), defaultdict(int)
    for w in want:
        total.update(w[3])
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    expected = Counter()
    for (k, _), (n_a, n_b, groups, links) in zip(rows, want, strict=True):
        n = sum(links.values())
        top = sum(c for p, c in links.items() if total[p] == best[p[1]])
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        expected[k, n_a, n_b, n, n, top, sum(total[p] * c for p, c in links.items()), digest] += 1
    df = spark.createDataFrame([(k, t, "own") for k, t in rows], "doc_id bigint, text string, n_a string").repartition(3)
    got = alignment.score(df)
    assert Counter(tuple(r)[:8] for r in got.collect()) == expected
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sum(w[0] == 0 for w in want) > 50 < sum(w[0] > 0 for w in want)
    assert alignment.score(df.limit(0)).count() == 0


def plain_overlaps(queries, sessions):
    out = {}
    for q, (key, a, b) in queries.items():
        for key2, s, e, n, extra in sessions:
            if key2 != key or s > b or e < a:
                continue
            name = intervals.RELATIONS[3 * ((a >= s) + (a > s)) + (0 if b < e else 1 if b == e else 2)]
            row = out.setdefault((q, name), [0, 0, 0])
            row[0] += n
            row[2] += extra
            row[1] = None if b == e == intervals.OPEN or row[1] is None else row[1] + n * (min(b, e) - max(a, s) + 1)
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_overlaps(spark, monkeypatch, seed):
    r = random.Random(seed)
    if seed:
        monkeypatch.setattr(intervals, "BLOCK", 40)
    key = lambda: 1 if r.random() < 0.5 else r.randrange(2, 6)

    def some(n):
        for _ in range(n):
            a = r.randrange(-9, 30)
            yield key(), a, intervals.OPEN if r.random() < 0.3 else a + r.randrange(12)

    queries = dict(enumerate(some(500)))
    sessions = [(*x, r.randrange(1, 4), r.randrange(100)) for x in some(90)]
    end = lambda e: (None, True) if e == intervals.OPEN else (e, False)
    q = spark.createDataFrame([(i, k, a, *end(e)) for i, (k, a, e) in queries.items()] + [(900, None, 1, 2, False), (901, 1, None, 2, False), (902, 1, 1, None, False)], "id bigint, key bigint, start bigint, end bigint, open boolean")
    s = spark.createDataFrame([(k, a, *end(e), n, x) for k, a, e, n, x in sessions], "key bigint, start bigint, end bigint, open boolean, n bigint, extra bigint")
    got = intervals.overlaps(q, s).collect()
    assert len(got) == len({(x.id, x.relation) for x in got})
    assert {(x.id, x.relation): (x.n_pairs, x.overlap_slots, x.extra_sum) for x in got} == plain_overlaps(queries, sessions)
    assert {x.relation for x in got} == set(intervals.RELATIONS)
    assert intervals.overlaps(q.limit(0), s).count() == 0 == intervals.overlaps(q, s.limit(0)).count()


def test_sessions(spark):
    r = random.Random(4)
    minute = 60_000_000
    clicks = [(r.randrange(3), r.randrange(-400, 900) * 5 * minute + r.choice([0, 0, 1]), r.choice(["error", "view", None])) for _ in range(500)]
    clicks += [(7, k * 30 * minute, "error") for k in range(3)] + [(8, 0, "view"), (8, 30 * minute + 1, "error"), (8, 0, "error")]
    want = set()
    for k in {c[0] for c in clicks}:
        own = sorted({t for c, t, _ in clicks if c == k})
        runs = [[own[0]]]
        for a, b in zip(own, own[1:], strict=False):
            runs.append([b]) if b - a > 30 * minute else runs[-1].append(b)
        want |= {(k, x[0], x[-1], any(c == k and t == x[-1] and kind == "error" for c, t, kind in clicks)) for x in runs}
    df = spark.createDataFrame([*clicks, *clicks[:50], (None, 0, "view"), (1, None, "view")], "c bigint, us bigint, kind string")
    for ts in (F.timestamp_micros("us"), F.timestamp_micros("us").cast("timestamp_ntz")):
        got = intervals.sessions_of(df.withColumn("ts", ts), "c", "ts", F.col("kind") == "error").collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_moments_without_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59.999999' AS t UNION ALL SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00.5'")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert sorted(r[0] for r in df.select(intervals.micros(df, "t")).collect()) == [-1, 1711852200500000]
        assert df.select(intervals.whole(F.lit(-1), 6), intervals.whole(F.lit(12), 6), intervals.whole(F.lit(-12), 6)).first()[:] == (-1, 2, -2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sales_query(spark):
    con = duckdb.connect()
    for t in ("sales", "sale_lines", "clicks"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = intervals.query(spark, SF)
    want = con.execute(intervals.SQL)
    names = [d[0] for d in want.description]
    want = Counter(want.fetchall())
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == want and len(want) > 1000
    assert crc32(b"1704067200000000") == df.sparkSession.sql("SELECT crc32('1704067200000000')").first()[0]
    empty = [spark.read.parquet(f"{SF}/{t}.parquet").limit(0) for t in ("sales", "sale_lines", "clicks")]
    assert intervals.sales_and_sessions(*empty).count() == 0
