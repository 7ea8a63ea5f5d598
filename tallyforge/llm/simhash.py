"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of
their 8 bytes, so they share at least 5 (position, byte) postings. Lists of
single bytes would hold a 256th of all fingerprints each; any 5 of the positions
0..7 hold exactly one set of four whose exclusive or is 0 (the 14 planes of the
affine space), so each fingerprint is posted under its 14 four-byte keys, and a pair
that shares enough bytes meets in a list. Within a list the shared positional bytes
of each pair are tallied, pairs with fewer than 5 are left out, and the bits of
the others are compared. Equal fingerprints are one posting.

Lists longer than BLOCK are posted anew: under each further (position, byte), one of
which a pair has to share, and if they are still long, under each quarter of the 24
bits that are left, of which a pair has to share one. What is long even then has
at most 2**18 members, is cut into blocks, and each pair of blocks gives a spanning
forest of its links. So no group expands into all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, settle, table, written
from .components import components

BITS = 3
LEAST_SHARED = 8 - BITS
PLANES = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
#: Rows of a block of a posting list.
BLOCK = 1024


def make_hasher():
    import xxhash

    hash64 = xxhash.xxh64_intdigest

    def fn(ids, texts):
        hashes, sizes = [], []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
            if not words:
                sizes.append(0)
                continue
            if len(words) <= 3:
                shingles = [b" ".join(words)]
            else:
                joined = b" ".join(words)
                sizes_ = np.fromiter(map(len, words), np.int64, len(words))
                ends = np.cumsum(sizes_ + 1) - 1
                shingles = [joined[a:b] for a, b in zip((ends - sizes_)[:-2].tolist(), ends[2:].tolist(), strict=True)]
            sizes.append(len(shingles))
            hashes.append(np.fromiter((hash64(s, 42) for s in shingles), np.uint64, len(shingles)))
        prints = np.zeros(len(texts), np.uint64)
        full = [i for i, n in enumerate(sizes) if n]
        for i, h in zip(full, hashes, strict=True):
            over = np.zeros(64, np.int64)
            for lo in range(0, len(h), 65_536):  # bits of so many hashes at once
                over += np.unpackbits(h[lo : lo + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
            prints[i] = np.packbits(over * 2 > len(h), bitorder="little").view("<u8")[0]
        return ids, prints.view(np.int64)

    return fn


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the SimHash of the 3-word shingles as a signed 64-bit number; 0 for a text without words."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, make_hasher, f"{id_col} {kind}, fp bigint")


def _key(fp: Column, plane: int) -> Column:
    value = F.lit(plane).cast("bigint")
    for position in PLANES[plane]:
        value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255).cast("bigint")))
    return value


def candidates(fp: np.ndarray, least: int = LEAST_SHARED) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j that share at least ``least`` positional bytes, by a tally over the eight positions."""
    n = len(fp)
    own = np.ascontiguousarray(fp).view(np.uint8).reshape(n, 8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, n, 256):
        tally = np.zeros((min(256, n - lo), n), np.uint8)
        for position in range(8):
            tally += own[lo : lo + 256, position, None] == own[None, :, position]
        i, j = np.nonzero(tally >= least)
        i += lo
        found.append((i[i < j], j[i < j]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join what is linked among the fingerprints: a spanning forest, as stars."""
    i, j = candidates(fp)
    near = np.bitwise_count(fp[i] ^ fp[j]) <= BITS
    i, j = i[near], j[near]
    label = np.arange(len(fp))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(a), int(b)) for a, b in enumerate(label) if a != b]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("part", pa.int64()), ("fp", pa.int64())])


def _search(block: int):
    """Rows (key, part, fp) in order of key and part to links (a, b) of each list, or, of a list longer than ``block``, to its rows as they are."""

    def run(batches):
        def out(links, rows=((), (), ())):
            none = [None] * len(links)
            tail = [None] * len(rows[0])
            return pa.RecordBatch.from_arrays([pa.array([*(int(x[i]) for x in links), *tail], pa.int64()) for i in range(2)] + [pa.array([*none, *map(int, c)], pa.int64()) for c in rows], schema=_LINK)

        key = part = fp = np.zeros(0, np.int64)  # of the list that may go on
        passed = None  # the list whose rows are passed on
        for batch in batches:
            key, part, fp = (np.concatenate([a, batch.column(i).to_numpy(zero_copy_only=False)]) for i, a in enumerate((key, part, fp)))
            if not len(key):
                continue
            begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
            size = np.diff(np.append(begin, len(key)))
            if passed is not None and passed != (key[0], part[0]):
                passed = None
            links: list = []
            for b, n in zip(begin[:-1].tolist(), size[:-1].tolist(), strict=True):
                if passed == (key[b], part[b]) or n > block:
                    yield out((), (key[b : b + n], part[b : b + n], fp[b : b + n]))
                elif n > 1:
                    own = fp[b : b + n]
                    links += [(own[i], own[j]) for i, j in forest(own.view(np.uint64))]
            if links:
                yield out(links)
            b = int(begin[-1])
            if passed == (key[b], part[b]) or len(key) - b > block:
                yield out((), (key[b:], part[b:], fp[b:]))
                passed, b = (key[b], part[b]), len(key)
            key, part, fp = key[b:], part[b:], fp[b:]
        if len(key) > 1:
            links = [(fp[i], fp[j]) for i, j in forest(fp.view(np.uint64))]
            yield out(links)

    return run


def _lists(posted: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) links within the lists of (key, part, fp), and the rows of lists longer than ``block``."""
    found = posted.repartition("key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(_search(block), "a bigint, b bigint, key bigint, part bigint, fp bigint")
    found = written(found, "links")
    return found.where("a is not null").select("a", "b"), found.where("fp is not null").select("key", "part", "fp")


def _others(fp: Column, plane: int) -> Column:
    """The bytes that are no part of the plane, each with its position, as keys."""
    rest = [p for p in range(8) if p not in PLANES[plane]]
    return F.array(*[F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("bigint")) + F.lit(256 * (p + 1)).cast("bigint") for p in rest])


def _quarters(fp: Column, plane: int, position: int) -> Column:
    """The four sixths of a byte, six bits each, of the three bytes that are neither in the plane nor at the position."""
    rest = [p for p in range(8) if p not in PLANES[plane] and p != position]
    bits = F.lit(0).cast("bigint")
    for p in rest:
        bits = F.shiftleft(bits, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("bigint")))
    return F.array(*[F.shiftrightunsigned(bits, 6 * q).bitwiseAND(F.lit(63).cast("bigint")) + F.lit(64 * (q + 1)).cast("bigint") for q in range(4)])


def _dealt(long_: DataFrame, block: int) -> DataFrame:
    """Links within the lists of (key, part, fp), each cut into blocks: a forest for each pair of them."""
    sizes = long_.groupBy("key", "part").agg(F.count("*").alias("n")).select("key", "part", F.ceil(F.col("n") / block).cast("int").alias("g"))
    own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int").alias("own")
    rows = long_.join(sizes, ["key", "part"]).select("key", "part", "fp", "g", own)
    rows = rows.select("key", "part", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    pair = F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other")).alias("pair")
    rows = rows.select("key", pair, "fp").repartition("key", "pair").sortWithinPartitions("key", "pair", "fp")
    return rows.mapInArrow(_search(1 << 62), "a bigint, b bigint, key bigint, part bigint, fp bigint").select("a", "b")


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) links between the distinct fingerprints ``fp`` that connect all pairs within 3 bits."""
    posted = classes.select("fp", F.explode(F.array(*[_key(F.col("fp"), k) for k in range(len(PLANES))])).alias("key"))
    found, long_ = _lists(posted.select("key", F.lit(0).cast("bigint").alias("part"), "fp"), block)
    if long_.isEmpty():
        return found.distinct()
    plane = F.shiftrightunsigned("key", 32)  # the number before the four bytes
    choose = lambda make: F.element_at(F.array(*[make(k) for k in range(len(PLANES))]), (plane + 1).cast("int"))
    more, long_ = _lists(long_.select("key", F.explode(choose(lambda k: _others(F.col("fp"), k))).alias("part"), "fp"), block)
    found = found.unionByName(more)
    if long_.isEmpty():
        return found.distinct()
    position = F.shiftrightunsigned("part", 8) - 1
    by_place = lambda k: F.element_at(F.array(*[_quarters(F.col("fp"), k, p) for p in range(8)]), (position + 1).cast("int"))
    quarter = long_.select("key", "part", F.explode(choose(by_place)).alias("quarter"), "fp")
    more, long_ = _lists(quarter.select("key", (F.col("part") * 512 + F.col("quarter")).alias("part"), "fp"), block)
    return found.unionByName(more).unionByName(_dealt(long_, block)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fp, component_id (the smallest id that it reaches by links of at most 3 bits).

    Whole texts count; null texts are empty ones, with fingerprint 0, linked like
    any other. Repeated rows and equal texts share a component. Rows without an id
    link others like any row; a component of such rows only has a null id. Ids
    are of any type that has an order. An empty table gives no rows; other columns
    are ignored.
    """
    prints = settle(fingerprints(docs, id_col, text_col))
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(classes.select("fp")))
    whole = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(whole.join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one of its smallest id, with all columns; rows without an id stay.

    Of rows with the same id one stays. Null and empty texts are near copies of each
    other. An empty table stays empty.
    """
    found = near_duplicates(docs, id_col, text_col)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    one = docs.join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return one.unionByName(docs.where(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
