"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of words. A randomised singular value decomposition
of their TF-IDF matrix A gives a latent space: with random signs R, all tasks sum
T'T R over the passages' counts T (whole numbers, so in any order), and the
Nystroem approximation of A'A, whose test matrix R without the IDF weights is as
good, follows from this one pass. In a second pass windows of every text are
folded in (divided by the singular values, so that frequent words don't decide)
and compared with the benchmark's items, a stated set of queries, by cosine. Two
kinds of windows go on. Those within CLOSE of an item can be paraphrases. And as
an item is diluted by the foreign words of its windows, a short one the most, the cosine
alone would lose some near copies; these are told by word bounds that hold for each of
them: an item of n words, r of them rare, shares at least r - (1 - LEAST_ITEM) n of these
with a window that holds LEAST_ITEM of it, and LEAST_ITEM n words in all (counted for
every window where the former is 0). What goes on is checked word by word: the longest
common subsequence has to hold most of the item (for a paraphrase, which is close by
meaning, half of it), and much of its answer, the item's end. So inserted, dropped,
changed and some exchanged words don't hide an item, and texts that only share its
frequent words are left.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows, map_texts, pieces, table
from .quality import Memo

#: Terms: the commonest words of the benchmark have one of their own, all others share the rest. What is found
#: doesn't depend on it: bounds by shared terms are weaker, so that more windows are checked.
OWN, SHARED = 6144, 2048
TERMS = OWN + SHARED
#: Words of a passage; columns of the sketch; dimensions kept.
PASSAGE, SKETCH, KEPT = 64, 32, 24
#: Words from one window to the next; windows of an item are as much longer than it, so that one holds all of it.
STRIDE = 8
#: Least shares of the item's words, and of its answer's, in the common subsequence.
LEAST_ITEM, LEAST_ANSWER = 0.7, 0.6
#: The same for windows within such a cosine of an item.
CLOSE, CLOSE_ITEM, CLOSE_ANSWER = 0.85, 0.5, 0.6
#: Terms are rare if at most this share of the passages hold them.
RARE = 0.005
#: An answer is such a share of an item's words, its last ones.
ANSWER = 0.25
#: Items that a worker holds at once; more are searched in several passes.
ITEMS = 4000
#: Tasks that sum one part of the sketch before the last sum.
SALTS = 16
_BLOCK = 256
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BATCH = 2_000_000
#: Words whose terms a worker remembers.
REMEMBERED = 700_000


def norm(word: str) -> str:
    return word.strip(_STRIP).lower()


def words_of(text: str) -> list[str]:
    return [w for w in map(norm, text.split()) if w]


def term_of(own: dict[str, int]):
    """Raw word to its term; -1 for marks alone."""

    def term(raw):
        w = norm(raw)
        return own.get(w, OWN + crc32(w.encode("utf-8", "surrogatepass")) % SHARED) if w else -1

    return term


def signs() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2, (TERMS, SKETCH)).astype(np.float64) * 2 - 1


def terms_of(texts, memo) -> tuple[np.ndarray, np.ndarray]:
    """Terms of all texts, and of each text how many."""
    out, sizes = [], []
    for t in texts:
        words = t.split()
        ids = np.fromiter(map(memo.__getitem__, words), np.int32, len(words))
        ids = ids[ids >= 0]
        out.append(ids)
        sizes.append(len(ids))
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(sizes, np.int64)


def laid_out(ids: np.ndarray, sizes: np.ndarray, steps: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms of texts end to end, each text filled up to its ``steps`` of ``length`` by TERMS; where each text begins."""
    begin = (np.cumsum(steps) - steps) * length
    flat = np.full(int(steps.sum()) * length, TERMS, np.int32)
    flat[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
    return flat, begin


def add_passages(z: np.ndarray, ids: np.ndarray, sizes: np.ndarray, r: np.ndarray) -> None:
    """Add the passages of texts, given by their terms, to the sums ``z``.

    All numbers are whole and small. Sums of eight rows at a time are formed first,
    as these are much cheaper than sums over runs of any length.
    """
    if not len(ids):
        return
    flat, _ = laid_out(ids, sizes, -(-sizes // PASSAGE), PASSAGE)
    n = len(flat) // PASSAGE
    y = np.zeros((n + 1, SKETCH), np.int16)
    y[:n] = r.take(flat, axis=0).reshape(n, PASSAGE, SKETCH).sum(axis=1, dtype=np.int16)  # PASSAGE at most
    at = np.flatnonzero(flat < TERMS)
    at = at[np.argsort(flat[at].astype(np.uint16), kind="stable")]
    term, place = flat[at], at // PASSAGE
    count = np.bincount(term, minlength=TERMS)
    eights = -(-count // 8)
    begin = (np.cumsum(eights) - eights) * 8
    rows = np.full(int(eights.sum()) * 8, n)
    rows[np.arange(len(term)) + np.repeat(begin - (np.cumsum(count) - count), count)] = place
    some = np.flatnonzero(count)
    sums = y.take(rows, axis=0).reshape(-1, 8, SKETCH).sum(axis=1, dtype=np.int16)
    z[some, :SKETCH] += np.add.reduceat(sums, begin[some] // 8, axis=0, dtype=np.int64)
    new = np.append(True, (place[1:] != place[:-1]) | (term[1:] != term[:-1]))
    z[:, SKETCH] += np.bincount(term[new], minlength=TERMS)
    z[0, SKETCH + 1] += n


def sketch(docs: DataFrame, text_col: str, own: dict[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(T'T R, passages by term, passages) over all rows."""
    bounded_batches(docs.sparkSession)
    arrow = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("z", pa.list_(pa.float64()))])

    def run(batches):
        from pyspark import TaskContext

        memo, r = Memo(term_of(own), REMEMBERED), np.vstack([signs(), np.zeros((1, SKETCH))]).astype(np.int16)
        z = np.zeros((TERMS, SKETCH + 2))  # and the passages that hold the term, and all passages
        for batch in batches:
            column = batch.column(0).to_pylist()
            for lo, hi in pieces(column, BATCH):
                add_passages(z, *terms_of([t or "" for t in column[lo:hi]], memo), r)
        salt = TaskContext.get().partitionId() % SALTS
        n = TERMS // _BLOCK
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array(list(z.reshape(n, -1)), pa.list_(pa.float64()))], schema=arrow)

    def add(batches):
        total: dict = {}
        for batch in batches:
            for block, salt, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                z = z.values.to_numpy()
                total[block, salt] = total[block, salt] + z if (block, salt) in total else z.copy()
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], schema=arrow)

    schema = "block int, salt int, z array<double>"
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, schema)
    once = parts.repartition("block", "salt").mapInArrow(add, schema).select("block", F.lit(0).alias("salt"), "z")
    z = np.zeros((TERMS, SKETCH + 2))
    for r in once.repartition("block").mapInArrow(add, schema).toLocalIterator():  # TERMS rows of the sketch in all
        z[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] += np.array(r["z"]).reshape(_BLOCK, -1)
    return z[:, :SKETCH], z[:, SKETCH], int(z[0, SKETCH + 1])


def latent(z: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """TERMS x KEPT: what folds a passage's counts in, IDF weights times right singular vectors over singular values."""
    idf = np.log((n + 1) / (df + 1)) + 1.0
    y = z * idf[:, None]  # A'A (R / idf)
    core = signs().T @ z
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    keep = value > value.max(initial=0) * 1e-9
    if not keep.any():
        return np.zeros((TERMS, KEPT))
    half = y @ (vector[:, keep] / np.sqrt(value[keep]))  # half @ half.T is about A'A
    u, sigma, _ = np.linalg.svd(half, full_matrices=False)
    k = min(KEPT, int((sigma > sigma[0] * 1e-6).sum()))
    v = np.zeros((TERMS, KEPT))
    v[:, :k] = u[:, :k] / sigma[:k]
    return v * idf[:, None]


def space(z: np.ndarray, df: np.ndarray, n: int) -> dict:
    return {"basis": latent(z, df, n), "rare": df <= RARE * n}


def lcs(words: list, masks: dict, n: int) -> int:
    """Bits of the longest common subsequence with a text whose words have the places in ``masks``."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full & ~v


def masks_of(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def verify(window: list[str], item: dict) -> tuple[float, float]:
    """Shares of the item's words, and of its answer's, in the longest common subsequence."""
    n = item["n"]
    whole = lcs(window, item["masks"], n).bit_count()
    if whole < CLOSE_ITEM * n:
        return whole / n, 0.0
    return whole / n, lcs(window, item["answer"], item["k"]).bit_count() / item["k"]


class Search:
    """Texts to their matches with the items: (text, item, share, share of the answer, cosine), the best of each pair."""

    def __init__(self, model: dict, items: list[tuple[int, str]]):
        self.memo, self.basis = Memo(term_of(model["own"]), REMEMBERED), np.ascontiguousarray(model["basis"], np.float32)
        self.basis = np.vstack([self.basis, np.zeros((1, self.basis.shape[1]), np.float32)])
        self.rare = np.append(model["rare"], False)
        term = term_of(model["own"])
        groups: dict[int, list] = {}
        for key, text in items:
            words = words_of(text)
            if not words:
                continue
            n, k = len(words), max(1, round(ANSWER * len(words)))
            terms = [term(w) for w in words]
            q = self.basis[terms].sum(axis=0)
            least = int(np.ceil(self.rare[terms].sum() - (1 - LEAST_ITEM) * n - 1e-9))
            item = {"key": key, "n": n, "k": k, "masks": masks_of(words), "by_term": masks_of(terms), "answer": masks_of(words[-k:]), "q": q / (np.linalg.norm(q) + 1e-9), "least": least, "terms": terms}
            groups.setdefault(-(-(n + STRIDE - 1) // STRIDE), []).append(item)
        self.groups = []
        for steps, own in sorted(groups.items()):
            own.sort(key=lambda i: i["least"])
            holds = np.zeros((len(own), TERMS + 1), bool)
            for row, i in zip(holds, own, strict=True):
                row[i["terms"]] = True
            least, enough = np.array([i["least"] for i in own]), np.array([LEAST_ITEM * i["n"] - 1e-9 for i in own])
            plain = int(np.searchsorted(least, 1))  # so many items have too few rare words to be told by these
            by_term = np.ascontiguousarray(holds.T).view(np.uint8)
            # The least of these words that a near copy's window holds, and the least that a paraphrase's does.
            bound = np.where(np.arange(len(own)) < plain, np.ceil(enough), least).astype(np.uint16)
            words = np.array([i["n"] for i in own])
            counted = np.where(np.arange(len(own)) < plain, words, [self.rare[i["terms"]].sum() for i in own])
            close_bound = np.maximum(np.ceil(counted - (1 - CLOSE_ITEM) * words - 1e-9), 0).astype(np.uint16)
            self.groups.append((steps, own, np.stack([i["q"] for i in own]), holds, enough, plain, np.ascontiguousarray(by_term[:, :plain]), np.ascontiguousarray(by_term[:, plain:]), bound, close_bound))

    def _own_words(self, flat: np.ndarray, group: tuple) -> np.ndarray:
        """For each stride of ``flat`` that begins a window, and each item, how many of the item's words (of most items, of its rare words) the window holds."""
        n, items, _, _, _, plain, every, rare, _, _ = group
        held = np.zeros((len(flat) // STRIDE + 1, len(items)), np.uint16)  # sums may wrap, their differences are small
        if plain:
            held[1:, :plain] = every.take(flat, axis=0).reshape(-1, STRIDE, plain).sum(axis=1, dtype=np.uint16)
        at = np.flatnonzero(self.rare[flat])
        if len(at) and plain < len(items):
            step = at // STRIDE
            first = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
            held[step[first] + 1, plain:] = np.add.reduceat(rare.take(flat[at], axis=0), first, axis=0, dtype=np.uint16)
        np.cumsum(held, axis=0, dtype=np.uint16, out=held)
        return held[n:] - held[:-n]

    def __call__(self, texts: list[str]):
        ids, sizes = terms_of(texts, self.memo)
        most = max((g[0] for g in self.groups), default=0)
        # Each text is followed by a window without weight.
        flat, begin = laid_out(ids, sizes, -(-sizes // STRIDE) + most, STRIDE)
        real = np.flatnonzero(flat[::STRIDE] < TERMS)
        rows = np.zeros((len(flat) // STRIDE, self.basis.shape[1]), np.float32)
        for i in range(STRIDE):
            rows += self.basis.take(flat[i::STRIDE], axis=0)
        best: dict = {}
        split: dict[int, list[str]] = {}
        folded, long_ = rows.copy(), 1  # the windows of so many strides from each stride on
        for group in self.groups:
            n, items, q, holds, enough = group[:5]
            bound, close_bound = group[-2:]
            close_enough = np.array([CLOSE_ITEM * i["n"] - 1e-9 for i in items])
            some = max(256, min(8192, 4_000_000 // len(items)))
            for i in range(long_, n):
                folded[: len(rows) - i] += rows[i:]
            long_ = n
            for lo in range(0, len(real), some):
                part = real[lo : lo + some]
                own = self._own_words(flat[part[0] * STRIDE : (part[-1] + n) * STRIDE], group)
                unit = folded[part]
                unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None] + 1e-9
                cosine = unit @ q.T
                own = own[part - part[0]]
                close = (cosine >= CLOSE) & (own >= close_bound)
                found_at, found_j = np.divmod(np.flatnonzero((own >= bound) | close), len(items))
                # No common subsequence is longer than the window's words that the item has.
                shared = np.zeros(len(found_at), np.int32)
                at, of = part[found_at] * STRIDE, found_j * (TERMS + 1)
                for i in range(n * STRIDE):
                    shared += holds.take(of + flat.take(at + i))
                long = shared >= np.where(close[found_at, found_j], close_enough[found_j], enough[found_j])
                for at, j in zip(found_at[long].tolist(), found_j[long].tolist(), strict=True):
                    step = int(part[at])
                    # By terms first, which words share: no less than by words, and the text needn't be split again.
                    least = (CLOSE_ITEM if close[at, j] else LEAST_ITEM) * items[j]["n"] - 1e-9
                    if lcs(flat[step * STRIDE : (step + n) * STRIDE].tolist(), items[j]["by_term"], items[j]["n"]).bit_count() < least:
                        continue
                    text, item = int(np.searchsorted(begin, step * STRIDE, "right")) - 1, items[j]
                    if text not in split:
                        split[text] = words_of(texts[text])
                    first = step * STRIDE - int(begin[text])
                    share, answer = verify(split[text][first : first + n * STRIDE], item)
                    near = float(cosine[at, j])
                    if share >= LEAST_ITEM and answer >= LEAST_ANSWER or near >= CLOSE and share >= CLOSE_ITEM and answer >= CLOSE_ANSWER:
                        found = (share, answer, near)
                        key = (text, item["key"])
                        if key not in best or found > best[key]:
                            best[key] = found
        return [(text, item, *found) for (text, item), found in sorted(best.items())]


def train(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> dict:
    """The benchmark's items and the latent space of the documents' passages."""
    rows = benchmark.where(F.col(item_text).isNotNull()).select(item_col, item_text).distinct().toLocalIterator()
    items = sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    words = Counter(w for _, t in items for w in set(words_of(t)))
    own = {w: i for i, (w, _) in enumerate(sorted(words.items(), key=lambda x: (-x[1], x[0]))[:OWN])}
    return {"items": items, "own": own} | space(*sketch(docs, text_col, own))


def matches(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: id, item_id, lcs_share, answer_share, cosine.

    Null and empty texts hold nothing; repeated rows are told once each; an item
    that occurs several times in a text is told once, where it matches best. Null
    or empty items match nothing. Empty tables give no rows; other columns are
    ignored. Documents of any length are searched whole, against every item.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, item_id bigint, lcs_share double, answer_share double, cosine double"
    parts = []
    for lo in range(0, max(1, len(model["items"])), ITEMS):
        items = model["items"][lo : lo + ITEMS]

        def make(items=items):
            search = Search(model, items)

            def rows(ids, texts):
                found = [f for a, b in pieces(texts, BATCH) for f in ((t + a, *rest) for t, *rest in search(texts[a:b]))]
                return [[ids[f[0]] for f in found], *([f[k] for f in found] for k in range(1, 5))]

            return rows

        parts.append(map_texts(docs, id_col, text_col, make, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keep_clean(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows that hold no item, with all their columns."""
    out = docs
    for lo in range(0, len(model["items"]), ITEMS):
        items = model["items"][lo : lo + ITEMS]

        def make(items=items):
            search = Search(model, items)

            def rows(texts):
                bad = {t + a for a, b in pieces(texts, BATCH) for t, *_ in search(texts[a:b])}
                return [i not in bad for i in range(len(texts))], None

            return rows

        out = map_rows(out, text_col, make)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return matches(docs, train(docs, table(spark, sf_dir, "benchmark")))
