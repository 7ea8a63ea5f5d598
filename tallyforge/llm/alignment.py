"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers' tokens have lengths in bytes of blank + text; their running sums are
two rising lists of ends, which are merged: an end that stands in both closes a group,
and the two tokens that end there are linked. Spark counts the linked pairs over all
documents and joins each pair's count, and the highest count of its two ids, back to
the documents that hold it.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, table, written
from .packing import Words
from .pieces import Model

_BEFORE_WORD = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"\s\s|[^\S\n]")
#: Text whose tokens are merged at once: fewer characters than elsewhere, as both sides' tokens are held beside their texts.
PIECE = 1_000_000
#: A pair of ids is one number: the first id above, the second below.
SECOND = 1 << 32


class Spelling:
    """The bytes of each id; those of many ids in a row are fetched from one buffer."""

    BLOCK = 500_000

    def __init__(self, raw: Sequence[bytes]):
        self.sizes = np.array([*map(len, raw)], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        parts = [np.zeros(0, np.uint8)]
        for lo in range(0, len(ids), self.BLOCK):
            own = ids[lo : lo + self.BLOCK]
            n = self.sizes[own]
            ends = np.cumsum(n)
            parts.append(self.flat[np.arange(ends[-1]) + np.repeat(self.begins[own] - ends + n, n)])
        return np.concatenate(parts)


class _Words(Words):
    """Words behind one blank; those with white space inside go to the tokenizers library."""

    def ids(self, word: str) -> bytes:
        if _ODD_SPACE.search(word):
            return array("H", self.exact.encode(self.blank + word, add_special_tokens=False).ids).tobytes()
        return super().ids(word)


class ByteLevel:
    """Ids of blank + text by the byte-level file; the strings of special tokens are ordinary text."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        exact.no_truncation()
        exact.encode_special_tokens = True
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.words = _Words(" ", fast, exact)
        self.words.bare = _Words("", fast, exact)
        # Printable bytes stand for themselves in the file, the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.raw = [bytes(map(letters.__getitem__, exact.id_to_token(i))) if all(c in letters for c in exact.id_to_token(i)) else exact.id_to_token(i).encode() for i in range(exact.get_vocab_size())]

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the ids of each text; a single blank before a word always starts a token."""
        found = [b"".join(map(self.words.__getitem__, _BEFORE_WORD.split(t))) if t else b"" for t in texts]
        return np.frombuffer(b"".join(found), np.uint16).astype(np.int64), np.array([len(x) // 2 for x in found], np.int64)


class Pieces:
    """Ids of text by the SentencePiece model, which puts the blank before it."""

    def __init__(self, path: str | None = None):
        self.model = Model(path)
        self.raw = [bytes([v]) if b else name.replace("▁", " ").encode() for name, b, v in zip(self.model.names, self.model.is_byte.tolist(), self.model.byte.tolist(), strict=True)]

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.split([self.model.normalize(t)[0] for t in texts])
        return np.frombuffer(b"".join(found), np.int32).astype(np.int64), np.array([len(x) // 4 for x in found], np.int64)


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in each of two rising lists of the ends that both hold: the step of two pointers, for all ends at once."""
    at = np.searchsorted(ends_b, ends_a)
    at[at == len(ends_b)] = 0
    both = ends_b[at] == ends_a if len(ends_b) else np.zeros(len(ends_a), bool)
    return np.flatnonzero(both), at[both]


class Aligner:
    """Groups and links of texts, by two encoders whose ids have bytes."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.spell_a, self.spell_b = Spelling(a.raw), Spelling(b.raw)
        # An id is written with what follows it: more of its side, the other side or the next group.
        self.write = Spelling([f"{i}{mark}".encode() for own, marks in ((a.raw, ",|"), (b.raw, ",;")) for mark in marks for i in range(len(own))])

    @staticmethod
    def tokens(encoder, spell: Spelling, texts: list[str], sources: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Ids, ids of each text, and whether each text's bytes are those of its tokens."""
        ids, sizes = encoder(texts)
        if np.array_equal(spell(ids), np.frombuffer(b"".join(sources), np.uint8)):
            return ids, sizes, [True] * len(texts)
        stops = np.cumsum(sizes).tolist()
        same = [spell(ids[lo:hi]).tobytes() == own for lo, hi, own in zip([0, *stops[:-1]], stops, sources, strict=True)]
        return ids, sizes, same

    def __call__(self, texts: list[str]) -> list[list]:
        """Columns n_a, n_b, groups (as text), pairs and times (the distinct links), of each text."""
        sources = [(" " + t).encode() if t else b"" for t in texts]
        ids_a, sizes_a, same_a = self.tokens(self.a, self.spell_a, texts, sources)
        ids_b, sizes_b, same_b = self.tokens(self.b, self.spell_b, texts, sources)
        ok = np.array([bool(t) and x and y for t, x, y in zip(texts, same_a, same_b, strict=True)], bool)
        if not ok.all():
            ids_a, sizes_a = ids_a[np.repeat(ok, sizes_a)], np.where(ok, sizes_a, 0)
            ids_b, sizes_b = ids_b[np.repeat(ok, sizes_b)], np.where(ok, sizes_b, 0)
        in_a, in_b = merge(np.cumsum(self.spell_a.sizes[ids_a]), np.cumsum(self.spell_b.sizes[ids_b]))
        n_a, n_b = len(self.a.raw), len(self.b.raw)
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[in_a], last_b[in_b] = True, True
        # In the text of the groups a token stands behind all tokens of both sides of the groups before.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        place_a = np.arange(len(ids_a)) + np.concatenate([[0], in_b + 1])[group_a]
        place_b = np.arange(len(ids_b)) + np.concatenate([in_a + 1, [0]])[group_b]
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[place_a], codes[place_b] = ids_a + n_a * last_a, ids_b + 2 * n_a + n_b * last_b
        links = ids_a[in_a] * SECOND + ids_b[in_b]
        text = self.write(codes).tobytes()
        stops = np.concatenate([[0], np.cumsum(self.write.sizes[codes])])[np.cumsum(sizes_a + sizes_b)].tolist()
        link_stops = np.searchsorted(in_a, np.cumsum(sizes_a)).tolist()
        groups, pairs, times = [], [], []
        for lo, hi, x, y in zip([0, *stops[:-1]], stops, [0, *link_stops[:-1]], link_stops, strict=True):
            groups.append(text[lo : max(lo, hi - 1)].decode())
            own, n = np.unique(links[x:y], return_counts=True)
            pairs.append(own)
            times.append(n)
        return [sizes_a, sizes_b, groups, pairs, times]


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Tokens of both sides, groups and distinct links of every whole text, one row for each input row.

    Columns: the id, ``n_a``, ``n_b``, ``groups`` (ids of the first side | of the second,
    groups divided by ;), ``pairs`` (first id * 2^32 + second id) and ``times`` (how often
    each is linked in the text). Texts that are null or empty, or that one side's tokens
    don't spell, have no tokens. Repeated rows give repeated rows, an empty table none;
    other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(frames):
        aligner = Aligner(ByteLevel(path_a), Pieces(path_b))
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["_text"]]
            for lo, hi in pieces(texts, PIECE):
                columns = aligner(texts[lo:hi])
                out = {id_col: frame[id_col].array[lo:hi]} | dict(zip(("n_a", "n_b", "groups", "pairs", "times"), columns, strict=True))
                yield pd.DataFrame(out)

    # An id that is null mustn't turn into a number with a fraction on its way through pandas.
    text_id = source.withColumn(id_col, F.col(id_col).cast("string"))
    rows = text_id.mapInPandas(run, f"`{id_col}` string, n_a bigint, n_b bigint, groups string, pairs array<bigint>, times array<bigint>")
    return rows.withColumn(id_col, F.col(id_col).cast(kind))


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair``, ``n`` (links that hold it, over all rows), ``best_a`` and ``best_b`` (the highest n of its ids)."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    counts = counts.withColumns({"a": F.expr(f"pair div {SECOND}"), "b": F.expr(f"pair % {SECOND}")})
    best_a = counts.groupBy("a").agg(F.max("n").alias("best_a"))
    best_b = counts.groupBy("b").agg(F.max("n").alias("best_b"))
    return counts.join(best_a, "a").join(best_b, "b").select("pair", "n", "best_a", "best_b")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document its tokens, groups and links, and how its links stand among those of all documents.

    ``n_best`` counts its links whose pair is the one linked most often of all pairs of
    its second id (ties included), ``n_best_a`` those of its first id, ``count_sum`` adds
    the pairs' counts over its links. Rows are treated as ``align`` says; rows of one id
    stay apart.
    """
    rows = align(docs, id_col, text_col, path_a, path_b).select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col),
        "n_a",
        "n_b",
        F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"),
        "pairs",
        "times",
    )
    rows = written(rows, "aligned")
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n_here"))
    # The counts are few beside the occurrences: each task keeps its share of them in a table.
    known = each.join(pair_counts(rows).hint("shuffle_hash"), "pair")
    sums = known.groupBy("_row").agg(
        F.sum(F.when(F.col("n") == F.col("best_b"), F.col("n_here")).otherwise(0)).alias("n_best"),
        F.sum(F.when(F.col("n") == F.col("best_a"), F.col("n_here")).otherwise(0)).alias("n_best_a"),
        F.sum(F.col("n") * F.col("n_here")).alias("count_sum"),
    )
    links = F.aggregate("times", F.lit(0).cast("bigint"), lambda s, x: s + x)
    every = rows.select("_row", F.col(id_col), "n_a", "n_b", links.alias("n_groups"), links.alias("n_links"), "groups_sha256")
    found = every.join(sums, "_row", "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "n_best_a", "count_sum")]
    return found.select(F.col(id_col), "n_a", "n_b", "n_groups", "n_links", zero[0], zero[2], "groups_sha256", zero[1])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
