"""Secret scans in DataFrame functions only.

Three formats give the base spans. Two first-order Markov models of characters,
one of random strings and one of ordinary identifiers, add spans of kind
``random``: long tokens whose log-likelihood ratio is high in all and per
character. Positions come from ``split`` and ``regexp_extract_all`` of the same
pattern: what lies between the matches, and the matches, add up to the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The formats of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
# End of the fixed values.

#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Random strings made, and documents (chosen by a hash of their id) whose words serve as ordinary identifiers.
RANDOM_STRINGS, IDENTIFIER_DOCS = 4000, 400
#: Least log-likelihood ratio (nats) of a token in all and by character.
LEAST_SUM, LEAST_MEAN = 12.0, 0.6
#: Numbers that are folded at once; characters of a part of a text that is cut.
BLOCK, PART = 64, 4096


_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once, also where ``fn`` uses it inside of a lambda."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array ``op`` over all numbers before it (0 for the first): running sums or maxima.

    The state of ``aggregate`` is copied at each step, so it can't gather a result.
    Folds over blocks, and over blocks of blocks, are added to those within a block.
    """

    def fold(a):
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: op(x, y).cast("bigint"))

    def blocks(a):
        last = F.greatest(F.ceil(F.size(a) / BLOCK) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))

    def all_of(rows, sums, tops):
        def start(b):
            high = F.floor(b / BLOCK).cast("int")
            return op(fold(F.slice(tops, F.lit(1), high)), fold(F.slice(sums, high * BLOCK + 1, b - high * BLOCK)))

        return F.flatten(F.transform(rows, lambda row, b: let(start(b), lambda z: F.transform(row, lambda _, j: op(z, fold(F.slice(row, F.lit(1), j)))))))

    rows_of = let(values, blocks)
    return let(rows_of, lambda rows: let(F.transform(rows, fold), lambda sums: let(F.transform(blocks(sums), fold), lambda tops: all_of(rows, sums, tops))))


def spans(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column], group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, rank, end, kind), where ``keep`` holds of their ``group``."""
    p, rank = F.lit(pattern), KINDS.index(kind)
    lengths = F.zip_with(
        F.transform(F.split(text, pattern, -1), F.length),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length),
        lambda gap, n: F.struct(gap.cast("bigint").alias("gap"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n")),
    )
    flags = F.transform(F.regexp_extract_all(text, p, F.lit(group)), keep)

    def placed(parts):
        at = before(F.transform(parts, lambda x: x["gap"] + x["n"]), lambda a, b: a + b)
        every = F.arrays_zip(parts.alias("part"), flags.alias("keep"), at.alias("at"))
        some = F.filter(every, lambda x: F.coalesce(x["keep"], F.lit(False)))
        start = lambda x: x["at"] + x["part"]["gap"]
        return F.transform(some, lambda x: F.struct(start(x).alias("start"), F.lit(rank).alias("rank"), (start(x) + x["part"]["n"]).alias("end"), F.lit(kind).alias("kind")))

    return F.when(text.rlike(pattern), let(lengths, placed)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> Column:
    # Runs of hex digits and of an access key are maximal, so their least length can stand in the pattern.
    return F.concat(
        spans(text, ASSIGN, "assign", lambda s: F.length(s) >= 6, 2),
        spans(text, ACCESS.replace("+", "{16,}"), "access", lambda s: F.length(s) >= 20),
        spans(text, HEX.replace("+", "{24,}"), "hex", lambda s: F.length(s) >= 24),
    )


def joined(found: Column) -> Column:
    """kind:start:end by start, then kind; comma-joined."""
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strings: int = RANDOM_STRINGS, sample: int = IDENTIFIER_DOCS) -> list[float]:
    """Log-likelihood ratios, random to ordinary, of each pair of following characters.

    Labelled samples: random strings from digests of numbers, in hexadecimal,
    in base64 with marks and without, and in capitals with digits; ordinary are the words
    outside of base spans of ``sample`` documents, alone and joined in pairs,
    numbers, dates and rulers. An empty table leaves the made samples, and so do
    null and empty texts and rows without an id; of rows with equal ids all count.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    b64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    size = (F.col("id") % 21 + 16).cast("int")
    number = F.conv(F.substring(digest, 1, 15), 16, 10)
    made = spark.range(strings)
    random = made.select(F.explode(F.array(F.substr(digest, F.lit(1), size), F.substr(b64, F.lit(1), size), F.substr(F.regexp_replace(b64, "[+/]", ""), F.lit(1), size), F.substr(F.regexp_replace(F.upper(b64), "[+/]", ""), F.lit(1), size))).alias("s"))
    plain = made.select(F.explode(F.array(number, F.concat_ws("-", F.substring(number, 1, 4), F.substring(number, 5, 2), F.substring(number, 7, 2)), F.repeat(F.substring(F.lit("-=_"), F.col("id").cast("int") % 3 + 1, 1), size))).alias("s"))
    chosen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample).distinct()
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), ASSIGN, " "), "AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", " ")
    words = docs.select(F.col(id_col).alias("_id"), text.alias("t")).join(F.broadcast(chosen), "_id").select(F.regexp_extract_all("t", F.lit("[A-Za-z0-9+/_=-]{2,}"), F.lit(0)).alias("w"))
    pairs = F.transform(F.col("w"), lambda w, i: F.concat(w, F.element_at(F.array(F.lit(""), F.lit("_"), F.lit("-"), F.lit("/")), (i % 4 + 1).cast("int")), F.coalesce(F.try_element_at(F.col("w"), (i + 2).cast("int")), F.lit(""))))
    words = words.select(F.explode(F.concat("w", pairs)).alias("s"))
    labelled = random.select("s", F.lit(1).alias("y")).unionByName(plain.unionByName(words).select("s", F.lit(0).alias("y")))
    steps = labelled.where(F.length("s") > 1).select("y", F.explode(pairs_of(F.col("s"))).alias("k"))
    got = {(r["y"], r["k"]): r["n"] for r in steps.groupBy("y", "k").agg(F.count("*").alias("n")).collect()}  # SIZE² pairs at most for each label
    ratio = [0.0] * (SIZE * SIZE)
    for a in range(SIZE):
        row = {y: sum(got.get((y, a * SIZE + b), 0) for b in range(SIZE)) for y in (0, 1)}
        for b in range(SIZE):
            p = {y: (got.get((y, a * SIZE + b), 0) + 0.5) / (row[y] + 0.5 * SIZE) for y in (0, 1)}
            ratio[a * SIZE + b] = math.log(p[1] / p[0])
    return ratio


def pairs_of(s: Column) -> Column:
    """For each two following characters their row and column, as one number; characters outside of the alphabet count as one."""
    codes = F.transform(F.split(s, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    return let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a * SIZE + b))


def random_spans(text: Column, ratio: list[float]) -> Column:
    """Spans of tokens that the models take for random strings."""
    # One literal; an array of thousands of them would be planned one by one.
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")

    def is_random(token):
        llr = F.aggregate(pairs_of(token), F.lit(0.0), lambda acc, k: acc + F.element_at(table, k + 1))
        return let(llr, lambda x: (x >= LEAST_SUM) & (x >= LEAST_MEAN * F.length(token)))

    return spans(text, TOKEN, "random", is_random)


def merged(base: Column, more: Column) -> Column:
    """All spans in order, those of ``more`` (which don't overlap each other) left out where they overlap one of ``base``."""
    rank = KINDS.index("random")

    def apart(every):
        ends = before(F.transform(every, lambda s: F.when(s["rank"] < rank, s["end"]).otherwise(0)), F.greatest)
        beside = F.arrays_zip(every.alias("s"), ends.alias("end"), F.slice(every, F.lit(2), F.size(every)).alias("after"))
        # A base span begins before (the farthest end is at hand) or inside (then it is the next one).
        inside = lambda x: F.coalesce((x["after"]["rank"] < rank) & (x["after"]["start"] < x["s"]["end"]), F.lit(False))
        return F.transform(F.filter(beside, lambda x: (x["s"]["rank"] < rank) | (x["end"] <= x["s"]["start"]) & ~inside(x)), lambda x: x["s"])

    return F.when((F.size(base) > 0) & (F.size(more) > 0), let(F.sort_array(F.concat(base, more)), apart)).otherwise(F.concat(base, more))


def scan(docs: DataFrame, ratio: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text, and ``base`` and ``found`` (base and more), arrays of (start, rank, end, kind).

    Positions count code points, ends are exclusive. A null text counts as empty
    and has no spans; equal rows give equal results; an empty table gives no rows;
    other columns are ignored. A token that overlaps a base span is part of it and
    isn't told again. Time and memory are in proportion to the text, whatever its tokens.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("more", random_spans(F.col("text"), ratio))
    return rows.select(F.col(id_col), "text", "base", merged(F.col("base"), F.col("more")).alias("found"))


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by a mark."""
    def cut(chunks):
        """Characters from a to b, without a walk from the text's begin: ``chunks`` are its parts of PART characters."""

        def part(i, lo, n):
            return F.substr(F.element_at(chunks, (i + 1).cast("int")), (lo + 1).cast("int"), n.cast("int"))

        def fn(x):
            i, j, lo, hi = F.floor(x["a"] / PART), F.floor((x["b"] - 1) / PART), x["a"] % PART, (x["b"] - 1) % PART + 1
            whole = F.array_join(F.slice(chunks, (i + 2).cast("int"), F.greatest(j - i - 1, F.lit(0)).cast("int")), "")
            return F.when(x["b"] <= x["a"], F.lit("")).when(i == j, part(i, lo, hi - lo)).otherwise(F.concat(part(i, lo, F.lit(PART) - lo), whole, part(j, F.lit(0), hi)))

        return fn

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))

    def between(spans):
        """What no span covers: from the farthest end so far to the next start, and what follows all."""
        ends = before(F.transform(spans, lambda s: s["end"]), F.greatest)
        open_ = F.filter(F.arrays_zip(spans.alias("s"), ends.alias("end")), lambda x: x["end"] <= x["s"]["start"])
        last = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("a"), F.length(text).cast("bigint").alias("b"))
        return F.concat(F.transform(open_, lambda x: F.struct(x["end"].alias("a"), x["s"]["start"].alias("b"))), F.array(last))

    done = let(chunks, lambda c: F.array_join(F.transform(let(F.sort_array(found), between), cut(c)), mark))
    return F.when(F.size(found) > 0, done).otherwise(text)


def redact_rows(docs: DataFrame, ratio: list[float], text_col: str = "text") -> DataFrame:
    """All rows and columns, with the secrets in the text replaced.

    A null text stays null, one without secrets as it is; repeated rows are changed
    alike; an empty table stays empty; columns of any name are kept.
    """
    base_col, more_col = fresh(docs, "base"), fresh(docs, "more")
    text, base, more = F.coalesce(F.col(text_col), F.lit("")), F.col(base_col), F.col(more_col)
    rows = docs.withColumns({base_col: base_spans(text), more_col: random_spans(text, ratio)})
    clean = F.when((F.size(base) > 0) | (F.size(more) > 0), redact(text, merged(base, more))).otherwise(F.col(text_col))
    return rows.withColumn(text_col, clean).select(*docs.columns)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def with_sizes(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``n_chars``, where there is one, as long as the text."""
    if size_col not in docs.columns:
        return docs
    return docs.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select(F.col(id_col), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(scan(docs, train(docs)))
