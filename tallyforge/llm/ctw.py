"""Language-model scores by context-tree weighting, beside a unigram base.

Bytes are coded as 8 binary decisions. For each decision a node stands in every
context of the last 0 to DEPTH bytes and holds how often 0 and 1 followed. Its
Krichevsky-Trofimov estimate and those of the longer contexts below are mixed,

    Pw(s) = KT(s)/2 + prod over longer contexts of Pw / 2      (KT(s) at the bottom),

so that each context's share w(s) = KT(s) / 2Pw(s) follows from the counts. A
text's probability is the product of its bits' predictions, mixed with these
shares along the contexts that were seen. Counts are gathered from all training
texts by groupings, and none is left out. The tree is split by the last TOP bytes of
the contexts: what lies below them is grown by workers, each some whole branches,
and the few nodes above from the branches' sums. Scoring workers hold the values
of the most frequent sequences; all others, and those never seen, are
answered by the branches and joined, so that the result doesn't depend on what
fits into a worker.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, table, written

DEPTH = 5
#: Bytes of context that tell the branches of the tree apart.
TOP = 2
#: Sequences and words whose values a worker has at hand; the others' are joined.
LIMIT, FREQUENT = 600_000, 200_000
#: Sequences of which a worker grows branches at once (one branch at least).
GROWN = 1_000_000
#: Stands for the end of a text, and before its start; it occurs in no UTF-8 text.
END = 0xFF
BATCH = 2_000_000
#: Distinct words that a worker counts or remembers before it passes them on.
HELD = 400_000
WORD, GRAM, TEXTS = 0, 1, 2


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text leaves 1 by 5; a row without an id is training text."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only


def word_key(word: bytes) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(word, 42)
    return x - (1 << 64) if x >> 63 else x


def grams_of(texts: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts (words joined by blanks, and an end) it and the ``depth`` before as one number; bytes of each text."""
    start = bytes([END]) * depth
    raw = [b" ".join(w) + bytes([END]) for w in texts]
    flat = np.frombuffer(b"".join(start + r for r in raw), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raw], np.int64)
    key = np.zeros(max(0, len(flat) - depth), np.uint64)
    for i in range(depth + 1):
        key = key << np.uint64(8) | flat[i : len(flat) - depth + i]
    keep = np.ones(len(key), bool)  # not those that begin in one text and end in the next
    ends = np.cumsum(sizes + depth)[:-1]
    for i in range(depth):
        keep[ends - depth + i] = False
    return key[keep], sizes


def _merge(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def count(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, key, n) over all rows of ``docs``: words by their hash, grams of DEPTH + 1 bytes, and texts."""
    bounded_batches(docs.sparkSession)
    arrow = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        words: Counter = Counter()
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        texts = 0

        def out(kind, keys, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], schema=arrow)

        for batch in batches:
            column = batch.column(0).to_pylist()
            for lo, hi in pieces(column, BATCH):
                split = [words_of(t or "") for t in column[lo:hi]]
                texts += len(split)
                for w in split:
                    words.update(w)
                new = np.sort(grams_of(split)[0])
                first = np.flatnonzero(np.append(True, new[1:] != new[:-1]))
                keys, n = _merge(np.concatenate([keys, new[first]]), np.concatenate([n, np.diff(np.append(first, len(new)))]))
                if len(words) > HELD:
                    yield out(WORD, [word_key(w) for w in words], list(words.values()))
                    words.clear()
                if len(keys) > 2 * HELD:
                    yield out(GRAM, keys.astype(np.int64), n)
                    keys, n = keys[:0], n[:0]
        yield out(WORD, [word_key(w) for w in words], list(words.values()))
        yield out(GRAM, keys.astype(np.int64), n)
        yield out(TEXTS, [0], [texts])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _fitting(rows: DataFrame, size: Column, weight: str, limit: int) -> int:
    """The least power of two so that the rows with at least that ``size`` weigh ``limit`` together at most."""
    got = rows.groupBy(F.floor(F.log2(size)).cast("int").alias("b")).agg(F.sum(weight).alias("w")).collect()
    total, least = 0, 0
    for b, w in sorted(((r["b"], r["w"]) for r in got), reverse=True):
        total += w
        if total > limit:
            least = b + 1
            break
    return 1 << least


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving small arguments up."""
    shift = np.where(x < 8, 8.0, 0.0)
    low = np.zeros_like(x)
    small = x < 8
    for i in range(8):
        low[small] += np.log(x[small] + i)
    y = x + shift
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def _nodes(key: np.ndarray, n: np.ndarray, level: int):
    """Nodes of one depth and decision: (context, bits so far) numbers, and how often 0 and 1 followed."""
    at = key >> np.uint64(8 - level)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    one = (key >> np.uint64(7 - level) & np.uint64(1)).astype(np.int64)
    if not len(first):
        return at, n, n
    ones = np.add.reduceat(n * one, first)
    return at[first], np.add.reduceat(n, first) - ones, ones


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


def _mixed(at, a, b, deeper=None):
    """What predicts at the nodes of one depth, (numbers, estimates of a 1, shares), and log Pw.

    ``deeper`` holds the sums of log Pw over the longer contexts; without it the nodes are the deepest.
    """
    kt, one = _kt(a, b), (b + 0.5) / (a + b + 1.0)
    if deeper is None:
        return (at, one, np.ones(len(at))), kt
    pw = np.logaddexp(kt, deeper) - math.log(2)
    return (at, one, np.exp(np.minimum(0, kt - math.log(2) - pw))), pw


def grow(key: np.ndarray, n: np.ndarray, depth: int = DEPTH, top: int = TOP) -> tuple[list[dict], list[tuple]]:
    """Whole branches from the counts of their sequences: for each decision the nodes by depth, and (numbers, zeros, ones, log Pw) of the branches' roots."""
    entries = {depth: _merge(key, n)}
    for d in range(depth - 1, top - 1, -1):
        k, m = entries[d + 1]
        entries[d] = _merge(k & np.uint64((1 << 8 * (d + 1)) - 1), m)
    levels, roots = [], []
    for level in range(8):
        own, below = {}, None
        for d in range(depth, top - 1, -1):
            at, a, b = _nodes(*entries[d], level)
            deeper = None
            if below is not None:
                # Every node has longer contexts, whose numbers without their first byte are its own.
                parent = np.searchsorted(at, below[0] & np.uint64((1 << 8 * d + level) - 1))
                deeper = np.bincount(parent, below[1], len(at))
            own[d], pw = _mixed(at, a, b, deeper)
            below = (at, pw)
        levels.append(own)
        roots.append((at, a, b, pw))
    return levels, roots


def crown(rows, top: int = TOP) -> list[dict]:
    """For each decision the nodes with less than ``top`` bytes of context, from (level, number, zeros, ones, sum of log Pw) of the longest of these."""
    levels = []
    for level in range(8):
        part = sorted(r[1:] for r in rows if r[0] == level)
        at = np.array([r[0] for r in part], np.uint64)
        a, b, deeper = (np.array([r[i] for r in part], float) for i in (1, 2, 3))
        own = {}
        for d in range(top - 1, -1, -1):
            own[d], pw = _mixed(at, a, b, deeper)
            if d:
                at, parent = np.unique(at & np.uint64((1 << 8 * (d - 1) + level) - 1), return_inverse=True)
                a, b, deeper = (np.bincount(parent, x, len(at)) for x in (a, b, pw))
        levels.append(own)
    return levels


def predict(levels: list[dict], key: np.ndarray) -> np.ndarray:
    """log10 of the probability of each number's last byte after the others; nodes of all depths are looked up."""
    total = np.zeros(len(key))
    for level, own in enumerate(levels):
        bit = (key >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
        p, below = np.full(len(key), 0.5), np.zeros(len(key), bool)
        for d in sorted(own, reverse=True):
            at, one, share = own[d]
            if not len(at):
                continue
            asked = (key & np.uint64((1 << 8 * (d + 1)) - 1)) >> np.uint64(8 - level)
            i = np.minimum(np.searchsorted(at, asked), len(at) - 1)
            seen = at[i] == asked
            kt = np.where(bit, one[i], 1 - one[i])
            # The deepest context seen takes all of what is left, whatever its share.
            p = np.where(seen, np.where(below, share[i] * kt + (1.0 - share[i]) * p, kt), p)
            below |= seen
        total += np.log10(p)
    return total


def _branches(batches):
    """Rows (branch, key, n) in order of branch as arrays (keys, n) of whole branches."""
    held, size = [], 0
    for batch in batches:
        branch, key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
        n = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        held.append((branch, key, n))
        size += len(key)
        if size >= GROWN:
            branch, key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = int(np.searchsorted(branch, branch[-1])) if len(branch) else 0  # the last one may go on
            if whole:
                yield key[:whole], n[:whole]
            held, size = [(branch[whole:], key[whole:], n[whole:])], 0
    if held:
        key, n = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        if len(key):
            yield key, n


def _by_branch(grams: DataFrame) -> DataFrame:
    """(branch, key, n), each branch in one partition and in order. Sequences are counted, so a frequent context is no longer than its kinds."""
    branch = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1)).alias("branch")
    return grams.select(branch, "key", "n").repartition("branch").sortWithinPartitions("branch", "key")


def tree_top(grams: DataFrame) -> list[dict]:
    """The nodes above the branches: 256 contexts with 255 decisions at most."""

    def run(batches):
        for key, n in _branches(batches):
            for level, (at, a, b, pw) in enumerate(grow(key, n)[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level, np.int32)), pa.array(at.astype(np.int64)), pa.array(a), pa.array(b), pa.array(pw)], names=["level", "at", "a", "b", "pw"])

    roots = _by_branch(grams).mapInArrow(run, "level int, at bigint, a bigint, b bigint, pw double")
    # Without the first byte of the context.
    short = F.expr(f"at & (shiftleft(1L, level + {8 * (TOP - 1)}) - 1)")
    return crown([tuple(r) for r in roots.groupBy("level", short.alias("at")).agg(F.sum("a"), F.sum("b"), F.sum("pw")).collect()])


def answers(grams: DataFrame, asked: DataFrame, top: list[dict]) -> DataFrame:
    """(key, value): log10 probabilities of the distinct keys of ``asked``, seen in training or not."""

    def run(batches):
        for key, n in _branches(batches):
            own, wanted = n > 0, np.unique(key[n == 0])
            levels, _ = grow(key[own], n[own])
            yield pa.RecordBatch.from_arrays([pa.array(wanted.astype(np.int64)), pa.array(predict([low | high for low, high in zip(levels, top, strict=True)], wanted))], names=["key", "value"])

    both = grams.select("key", "n").unionByName(asked.select("key", F.lit(0).cast("bigint").alias("n")))
    return _by_branch(both).mapInArrow(run, "key bigint, value double")


class Values:
    """Keys to values by hash; tells what it doesn't know."""

    BITS = 21

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.key, self.value = key, value
        self.keys = np.full(1 << self.BITS, np.uint64(1) << np.uint64(63))
        self.values = np.zeros(1 << self.BITS)
        slot = self.slot(key)
        self.keys[slot], self.values[slot] = key, value

    def slot(self, key):
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where there is none, and the places of these."""
        slot = self.slot(key)
        out = self.values[slot]
        other = np.flatnonzero(self.keys[slot] != key)
        if not len(other):
            return out, other
        if not len(self.key):
            out[other] = 0
            return out, other
        asked, back = np.unique(key[other], return_inverse=True)
        i = np.minimum(np.searchsorted(self.key, asked), len(self.key) - 1)
        seen = self.key[i] == asked
        out[other] = np.where(seen, self.value[i], 0.0)[back]
        return out, other[~seen[back]]


def train(docs: DataFrame, text_col: str = "text", limit: int = LIMIT, frequent: int = FREQUENT) -> dict:
    """Counts of all rows of ``docs``: the tree's top, the tables of all sequences and words, and the most frequent of both.

    Null texts count as empty ones; repeated rows count each time; without rows all counts are 0.
    """
    counts = written(count(docs, text_col), "counts")
    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("word"), F.col("n").alias("c"))
    grams = counts.where(F.col("kind") == GRAM).select("key", "n")
    texts = counts.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = tree_top(grams)

    def sorted_pairs(rows, key, value):
        got = rows.select(key, value).toArrow()
        k, x = got.column(0).to_numpy(), got.column(1).to_numpy()
        order = np.argsort(k)
        return k[order], x[order]

    common = words.where(F.col("c") >= _fitting(words.withColumn("one", F.lit(1)), F.col("c"), "one", frequent))
    often = answers(grams, grams.where(F.col("n") >= _fitting(grams.withColumn("one", F.lit(1)), F.col("n"), "one", limit)), top)
    key, value = sorted_pairs(often, "key", "value")
    return {"top": top, "grams": grams, "often": (key.astype(np.uint64), value), "words": words, "frequent": sorted_pairs(common, "word", "c"), "texts": texts, "tokens": n + texts, "kinds": v + (texts > 0)}


class BaseScores(dict):
    """Word to log10 of its base probability if it is frequent, else 0; forgets all when full."""

    def __init__(self, frequent, norm: float):
        super().__init__()
        self.keys_, self.counts, self.norm = *frequent, norm

    def __missing__(self, word):
        if len(self) >= HELD:
            self.clear()
        key = word_key(word)
        i = int(np.searchsorted(self.keys_, key))
        got = self[word] = math.log10((int(self.counts[i]) + 0.5) / self.norm) if i < len(self.keys_) and self.keys_[i] == key else 0.0
        return got


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte.

    Values of rare words and sequences are joined, frequent ones are at hand. Null and empty texts
    are an end alone; equal texts get equal scores; an empty table gives no rows,
    and without training texts all probabilities are those of empty counts. Words
    are told apart by 64-bit hashes. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    norm = model["tokens"] + 0.5 * (model["kinds"] + 1)
    end = math.log10((model["texts"] + 0.5) / norm)
    often, frequent, known_end = model["often"], model["frequent"], int(model["texts"] > 0)
    kind = docs.schema[id_col].dataType.simpleString()
    target = spark.createDataFrame([], f"row bigint, {id_col} {kind}, n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint, rare array<bigint>, seldom array<bigint>").schema

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, memo, values_of = to_arrow_schema(target), BaseScores(frequent, norm), Values(*often)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in pieces(texts, BATCH):
                split = [words_of(t or "") for t in texts[lo:hi]]
                key, sizes = grams_of(split)
                values, lacking = values_of(key)
                ends = np.cumsum(sizes)
                logs = np.add.reduceat(values, np.concatenate([[0], ends[:-1]]))
                offsets = np.searchsorted(lacking, np.append(0, ends)).astype(np.int32)
                seldom = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[lacking].astype(np.int64)))
                columns: list[list] = [[], [], [], []]
                for words in split:
                    values = [*map(memo.__getitem__, words)]
                    rare = [word_key(w) for w, x in zip(words, values, strict=True) if not x] if 0.0 in values else []
                    for c, x in zip(columns, (len(words) + 1, len(words) - len(rare) + known_end, sum(values) + end, rare), strict=True):
                        c.append(x)
                out = [range(row, row + hi - lo), ids[lo:hi], *columns[:3], logs, sizes, columns[3]]
                row += hi - lo
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(out, list(arrow)[:-1], strict=True)), seldom.cast(arrow.field(len(arrow) - 1).type)], schema=arrow)

    scored = written(docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, target), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n"))
    c = F.coalesce("c", F.lit(0))
    more = rare.join(model["words"], "word", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(norm))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("seen"))
    seldom = scored.select("row", F.explode("seldom").alias("key")).groupBy("row", "key").agg(F.count("*").alias("n"))
    found = answers(model["grams"], scored.select(F.explode("seldom").alias("key")).distinct(), model["top"])
    rest = seldom.join(found, "key").groupBy("row").agg(F.sum(F.col("n") * F.col("value")).alias("rest"))
    both = scored.drop("rare", "seldom").join(more, "row", "left").join(rest, "row", "left")
    total = F.col("score") + F.coalesce("rest", F.lit(0.0))
    return both.select(
        id_col,
        held_out(F.col(id_col)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(model["tokens"]).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        "n_bytes",
        (-total / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs.where(~held_out(F.col("doc_id")))))
