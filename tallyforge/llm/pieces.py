"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the model's compiled character map: from each place the
longest prefix that the map holds is replaced, any other character stays. For every
character of the result the byte of the source where it comes from is recorded.
The model's merges split the result into pieces, and each piece is projected over
that record to the bytes of the source that it stands for.

No piece of such a model holds a blank behind a letter, so that no merge crosses the
place before a word: runs of blanks with the word behind them are split one by one,
and those seen lately are looked up.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import bounded_batches, pieces, table

BLANK = "▁"
#: Distinct words whose ids a worker remembers, and characters of the longest one among them.
REMEMBERED, LONGEST = 400_000, 64
#: Appended to a model: a normaliser that changes nothing, for texts that are normalised already.
_AS_IT_IS = bytes([0x1A, 8, 0x12, 0, 0x18, 0, 0x20, 0, 0x28, 0])


def _number(raw: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[i] & 127) << shift
        shift += 7
        i += 1
        if raw[i - 1] < 128:
            return value, i


def fields(raw: bytes):
    """(number, value) of each field of a serialised message."""
    i = 0
    while i < len(raw):
        tag, i = _number(raw, i)
        if tag & 7 == 0:
            value, i = _number(raw, i)
        else:
            n, i = _number(raw, i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: a double array over UTF-8 bytes, whose leaves point at replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix at a place."""
        units, found = self.units, None
        node = self._step(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= self._step(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        lo = found[1]
        return found[0], self.replacements[lo : self.replacements.index(0, lo)]


class Normalizer:
    """Text to (normalised text, source byte of each of its characters and of its end)."""

    def __init__(self, spec: dict):
        self.map = CharacterMap(spec[2]) if spec.get(2) else None
        self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int32)
        blank = BLANK if self.escape else " "
        if self.map is None and not self.squeeze:
            out = text.replace(" ", blank)
            at = np.arange(len(text) + 1, dtype=np.int32)
            if not text.isascii():
                raw = np.frombuffer(text.encode(), np.uint8)
                at = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw)).astype(np.int32)
            return (blank + out, np.concatenate([[0], at])) if self.prefix else (out, at)
        raw, out, at = text.encode(), [], []
        i = begin = 0
        steps = []
        while i < len(raw):  # prefix by prefix
            if hit := self.map and self.map.longest(raw, i):
                n, new = hit[0], hit[1].decode()
            else:
                n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                new = raw[i : i + n].decode()
            steps.append((i, new))
            i += n
        if self.squeeze:
            while begin < len(steps) and steps[begin][1] == " ":
                begin += 1
        before = self.squeeze
        if begin < len(steps) and self.prefix:
            out.append(blank)
            at.append(steps[begin][0])
        for place, new in steps[begin:]:
            if before:
                new = new.lstrip(" ")
            for c in new:
                out.append(blank if c == " " else c)
                at.append(place)
            if new:
                before = self.squeeze and new[-1] == " "
        end = len(raw)
        while self.squeeze and out and out[-1] == blank:
            out.pop()
            end = at.pop()
        if not out:
            return "", np.zeros(1, np.int32)
        return "".join(out), np.array([*at, end], np.int32)


class Model:
    """Encoder and decoder of a model file with byte fallback; others are refused."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import public_tokenizers
        import sentencepiece

        if proto is None:
            with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
                proto = f.read()
        spec = {}
        for n, value in fields(proto):
            if n == 3:
                spec |= dict(fields(value))
        self.normalize = Normalizer(spec)
        self._split = sentencepiece.SentencePieceProcessor(model_proto=proto + _AS_IT_IS)
        names = [self._split.id_to_piece(i) for i in range(self._split.vocab_size())]
        is_byte = np.array([self._split.is_byte(i) for i in range(len(names))])
        if is_byte.sum() != 256:
            raise ValueError("a model with byte fallback is needed")
        value = np.array([int(x[3:5], 16) if b else 0 for x, b in zip(names, is_byte, strict=True)])
        self.is_byte, self.byte = is_byte, value
        #: Characters of each piece; a byte counts one, unless the next one belongs to the same character.
        self.chars = np.array([1 if b else len(x) for x, b in zip(names, is_byte, strict=True)], np.int32)
        self.goes_on = is_byte & (value & 0xC0 == 0x80)
        self.surface = [None if b else "" if self._split.is_control(i) else x.replace(BLANK, " ") for i, (x, b) in enumerate(zip(names, is_byte, strict=True))]
        self.surface[self._split.unk_id()] = " ⁇ "
        self.control = [self._split.is_control(i) for i in range(len(names))]
        self.names = names
        whole = any(BLANK in x.lstrip(BLANK) for x, b in zip(names, is_byte, strict=True) if not b)
        self._by_word = not whole
        self._words = re.compile("(?s).+" if whole else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+").findall
        self._known: dict[str, bytes] = {}

    def split(self, normalised: list[str]) -> list[bytes]:
        """The ids of each normalised text, four bytes each."""
        words = []
        for t in normalised:
            # Single blanks before words, the usual case, are quicker to cut at.
            usual = t[:1] == BLANK != t[1:2] and self._by_word and BLANK * 2 not in t and " " not in t
            words.append((BLANK + t[1:].replace(BLANK, f" {BLANK}")).split(" ") if usual else self._words(t))
        known = self._known
        new = list(set().union(*words) - known.keys())
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set().union(*words))
        long = {}
        for w, ids in zip(new, self._split.encode(new, num_threads=1) if new else [], strict=True):
            (known if len(w) <= LONGEST else long)[w] = array("i", ids).tobytes()
        if long:
            return [b"".join([known.get(w) or long[w] for w in own]) for own in words]
        return [b"".join(map(known.__getitem__, own)) for own in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, their first and last source bytes, and the ids before each text."""
        normal = [self.normalize(t) for t in texts]
        split = self.split([x for x, _ in normal])
        sizes = np.array([len(x) for x in split], np.int64) // 4
        ids = np.frombuffer(b"".join(split), np.int32)
        chars = self.chars[ids]
        chars[:-1][self.is_byte[ids[:-1]] & self.goes_on[ids[1:]]] = 0
        # Each text's characters and its end stand in one array of source bytes.
        at = np.concatenate([x for _, x in normal]) if normal else np.zeros(0, np.int32)
        base = np.cumsum([0, *(len(x) for _, x in normal)])[:-1]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(chars)
        before = np.concatenate([[0], ends])[offsets[:-1]] if len(sizes) else ends
        shift = np.repeat(base - before, sizes)
        return ids, at[ends - chars + shift], at[ends + shift], offsets

    def decode(self, ids: list[int]) -> str:
        """Text of ids: blanks for their mark, bytes joined, the blank put before the text taken away."""
        first = next((i for i in ids if not self.control[i]), None)
        parts = list(map(self.surface.__getitem__, ids))
        if None in parts:
            out, i = [], 0
            while i < len(ids):
                if parts[i] is not None:
                    out.append(parts[i])
                    i += 1
                    continue
                j = i
                while j < len(ids) and parts[j] is None:
                    j += 1
                out.append(_utf8(bytes(self.byte[ids[i:j]].tolist())))
                i = j
            parts = out
        text = "".join(parts)
        return text[1:] if self.normalize.prefix and first is not None and self.names[first].startswith(BLANK) else text


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that belongs to no character becomes a mark."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """Ids of every whole text with the source bytes of each, one row for each input row.

    Columns: the id, ``ids``, ``begins`` and ``ends`` (byte offsets in the UTF-8 text,
    end exclusive; of the bytes that stand for one character the last has its span,
    the others are empty before it), and ``decoded`` (the text of the ids) if asked
    for. Null and empty texts have no ids; repeated rows give repeated rows; an empty
    table gives none. Other columns are ignored, so they can have any name.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    target = docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decoded).schema
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, model = to_arrow_schema(target), Model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in pieces(texts):
                ids, begins, ends, offsets = model.encode(texts[lo:hi])
                columns = [batch.column(0).slice(lo, hi - lo)]
                columns += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32()), type=arrow.field(1 + k).type) for k, x in enumerate((ids, begins, ends))]
                if decoded:
                    flat = ids.tolist()
                    columns.append(pa.array([model.decode(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, target)


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``decoded``, the text of each row's ids; null for a null list. Other columns stay, but for one of that name."""
    bounded_batches(rows.sparkSession)
    rows = rows.drop("decoded")
    target = StructType([*rows.schema.fields, StructField("decoded", StringType())])
    at = rows.columns.index(ids_col)

    def run(batches):
        model = Model(path)
        for batch in batches:
            text = [None if x is None else model.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], schema=batch.schema.append(pa.field("decoded", pa.string())))

    return rows.mapInArrow(run, target)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all ids and of the decoded texts; ``span_bytes``, the source bytes that the pieces cover."""
    rows = encode(table(spark, sf_dir, "documents"), decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.expr("aggregate(zip_with(begins, ends, (b, e) -> e - b), 0L, (s, x) -> s + x)").alias("span_bytes"),
    )
