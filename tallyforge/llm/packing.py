"""Packing: order-preserving dynamic programming over window cuts.

The documents of a task, in the order of the table, form one token stream. A cut
may fall at a document's end (free), at a sentence's end or, inside of sentences
longer than a window, at fixed steps; the latter two truncate a document and cost
a penalty. A window costs its padding: none if it is full or as long as a power
of two, else what is missing. With cuts at p and f the least cost up to one,

    f(j) = penalty(j) + min( min{f(i) - p(j) + p(i) + WINDOW : p(j) - WINDOW <= p(i) < p(j)},
                             min{f(i) : p(j) - p(i) a power of two} )

the first minimum is that of f(i) + p(i) in a sliding window: a monotone queue
gives it in constant time a cut. Nothing is shuffled, and only the last window
of a task's stream can be short for want of tokens.
"""

from __future__ import annotations

import base64
import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, table

WINDOW = 1024
#: Costs, in tokens of padding, of a cut at a sentence's end and of one inside a sentence.
SENTENCE_CUT, HARD_CUT = 2.0, 64.0
#: Steps of the cuts inside of sentences that are longer.
HARD_STEP = 256
#: The id that ends a document.
END_ID = 0
#: Windows of a power of two that are shorter aren't considered: they would save no padding worth a sequence.
SHORTEST = 128
#: Tokens of a stream that is planned at once; its last window is carried into the next one.
STREAM = 1_500_000
#: Distinct words whose ids a worker remembers.
REMEMBERED = 500_000

_ODD_SPACE = re.compile(r"[^\S \n]")


class Words(dict):
    """Text between blanks to its ids as bytes (two each), with the blank before it or without."""

    def __init__(self, blank: str, fast, exact):
        super().__init__()
        self.blank, self.fast, self.exact = blank, fast, exact
        self.bare = self  # the words without a blank before them

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = self.ids(word)
        return got

    def ids(self, word: str) -> bytes:
        text = self.blank + word
        if word and max(word) >= "ɐ":  # beyond Latin letters the libraries' tables of letters may differ by version
            return array("H", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        if word.isalpha():  # a pre-token by itself
            return array("H", self.fast.encode_single_piece(text.encode())).tobytes()
        if word[:-1].isalpha() and word[-1] in ".,!?:;":  # the mark is a pre-token
            return self[word[:-1]] + self.bare.mark(word[-1])
        line, _, more = word.partition("\n")
        if line and more and "\n" not in more:
            return self[line] + self.bare.mark("\n") + self.bare[more]
        return array("H", self.fast.encode_ordinary(text)).tobytes()

    def mark(self, c: str) -> bytes:
        return self.get(c) or self.setdefault(c, array("H", self.fast.encode_ordinary(c)).tobytes())


def encoder(path: str | None = None):
    """Text to the ids of the tokenizers file, each in two bytes.

    The file's pre-tokenizer never joins what stands on both sides of a single
    blank between two words, so most texts are the concatenation of words looked
    up with the blank before them. A word not seen lately is split by the same
    vocabulary's ranks (the tests hold both equal); texts with other or repeated
    white space, or with a special token, go to the tokenizers library whole.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    exact.no_truncation()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    first, rest = Words("", fast, exact), Words(" ", fast, exact)
    rest.bare = first

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or "\n \n" in text or text[-1] == " " or "<|" in text or _ODD_SPACE.search(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        words = text.split(" ")
        return first[words[0]] + b"".join(map(rest.__getitem__, words[1:])) if words[0] else rest[words[1]] + b"".join(map(rest.__getitem__, words[2:]))

    return encode


def sentence_ends(path: str | None = None) -> np.ndarray:
    """For each id whether a sentence can end after it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([bool(re.search(r"[.!?][\"')\]]?$|(Ċ|\n)$", t.id_to_token(i) or "")) for i in range(t.get_vocab_size())])


def candidates(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of possible cuts (0 and the stream's end among them) and their penalties."""
    cost = np.full(len(ids) + 1, np.inf)
    cost[-1] = HARD_CUT  # where a document goes on after the stream
    cost[1:][ends[ids]] = SENTENCE_CUT
    cost[0] = 0
    cost[doc_ends] = 0
    at = np.flatnonzero(np.isfinite(cost))
    for lo in at[:-1][np.diff(at) > HARD_STEP]:
        hi = at[np.searchsorted(at, lo, "right")]
        cost[lo + HARD_STEP : hi : HARD_STEP] = HARD_CUT
    at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def plan(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """Cuts of least cost from the first candidate to the last."""
    n = len(at)
    place = np.full(int(at[-1]) + 1, -1, np.int32)
    place[at] = np.arange(n)
    exact: dict[int, list[int]] = {}
    for k in range(SHORTEST.bit_length() - 1, window.bit_length() - 1):
        j = np.flatnonzero(at >= 2**k)
        i = place[at[j] - 2**k]
        for x, y in zip(j[i >= 0].tolist(), i[i >= 0].tolist(), strict=True):
            exact.setdefault(x, []).append(y)
    p, pen = at.tolist(), cost.tolist()
    best, back = [0.0] * n, [0] * n
    # The monotone queue: cuts i with f(i) + p(i) rising, from head to tail.
    sums, which, reach = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    head, tail = 0, 1
    for j in range(1, n):
        here = p[j]
        least = here - window
        while reach[head] < least:
            head += 1
        value, source = sums[head] - least, which[head]
        if j in exact:
            for i in exact[j]:
                if best[i] < value:
                    value, source = best[i], i
        best[j] = value = value + pen[j]
        back[j] = source
        value += here
        while tail > head and sums[tail - 1] >= value:
            tail -= 1
        sums[tail], which[tail], reach[tail] = value, j, here
        tail += 1
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [p[i] for i in reversed(cuts)]


def pack_stream(docs, encode, ends, window: int = WINDOW, stream: int = STREAM):
    """(id, text) pairs to rows (id, start, length, crc32, document's tokens, sequence, offset), in batches of lists."""
    held: list = []  # (id, document's tokens, ids before these, ids)
    size = sequence = 0

    def emit(last: bool):
        nonlocal held, size, sequence
        ids = np.concatenate([h[3] for h in held])
        stops = np.cumsum([len(h[3]) for h in held])
        complete = stops if held[-1][2] + len(held[-1][3]) == held[-1][1] else stops[:-1]
        at, cost = candidates(ids, ends, complete)
        cuts = plan(at, cost, window)
        if not last and len(cuts) > 2:
            cuts.pop()  # the last window joins the next stream
        bounds = np.unique(np.concatenate([cuts, stops[stops < cuts[-1]]]))
        owner = np.searchsorted(stops, bounds[:-1], "right")
        begins = np.concatenate([[0], stops[:-1]])
        place = np.searchsorted(cuts, bounds[:-1], "right") - 1
        raw = ids.astype("<u4")
        rows = [[], [], [], [], [], [], []]
        for lo, hi, o, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), owner.tolist(), place.tolist(), strict=True):
            doc, total, before, _ = held[o]
            for column, value in zip(rows, (doc, before + lo - int(begins[o]), hi - lo, crc32(raw[lo:hi]), total, sequence + w, lo - cuts[w]), strict=True):
                column.append(value)
        sequence += len(cuts) - 1
        rest = []
        for (doc, total, before, own), begin, stop in zip(held, begins.tolist(), stops.tolist(), strict=True):
            if stop > cuts[-1]:
                skip = max(0, cuts[-1] - begin)
                rest.append((doc, total, before + skip, own[skip:]))
        held, size = rest, len(ids) - cuts[-1]
        return rows

    for doc, text in docs:
        own = np.frombuffer(encode(text) + END_ID.to_bytes(2, "little"), "<u2")
        for lo in range(0, len(own), stream):
            held.append((doc, len(own), lo, own[lo : lo + stream]))
            size += len(held[-1][3])
            if size >= stream:
                yield emit(False)
    if held:
        yield emit(True)


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``window`` tokens.

    Every document ends with one id more, so null and empty texts are pieces of
    length 1. Repeated rows are packed like any others; an empty table gives no
    rows. Sequence ids are unique: the task's number in the upper bits, a count
    below. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    target = spark.createDataFrame([], f"{id_col} {kind}, {SCHEMA}").schema
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encode, ends = to_arrow_schema(target), encoder(), sentence_ends()
        first = TaskContext.get().partitionId() << 40

        def pairs():
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for lo, hi in pieces(texts.to_pylist()):
                    yield from zip(ids.slice(lo, hi - lo).to_pylist(), (t or "" for t in texts.slice(lo, hi - lo).to_pylist()), strict=True)

        for rows in pack_stream(pairs(), encode, ends, window):
            rows[5] = [first + x for x in rows[5]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, arrow, strict=True)], schema=arrow)

    return source.mapInArrow(run, target)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
