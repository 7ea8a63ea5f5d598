"""Interval overlap join by dominance counting, without making pairs.

Two kinds of closed intervals of whole numbers share keys. For each interval of the
one kind (queries) the operator returns, by Allen's relation, how many of the other
kind (sessions) share a slot with it, how many slots they share, and a sum of theirs.

Starts are swept upwards. A session enters a Fenwick tree over the ranks of its key's
ends, with its count, its start, its end and its sum; a query asks at three moments:
before its start, at its start and at its end. At each, the sums of all ends below
its own, equal to it and above it tell three relations apart. All keys of a batch are
swept together, each with a tree of its own, so that a step of the sweep is a few
numpy calls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")
#: The end of an interval that has none.
OPEN = 1 << 40
#: A key with a larger share of all queries than one in so many is split; there can be no more such keys than this.
SHARES = 200
#: Queries that are swept at once.
BLOCK = 200_000


class Fenwick:
    """Trees of sums, one behind the other: tree k has the ranks 1 to sizes[k]."""

    def __init__(self, sizes: np.ndarray, columns: int):
        self.sizes, self.before = sizes, np.cumsum(sizes) - sizes
        self.sums = np.zeros((columns, int(sizes.sum()) + 1), np.int64)

    def add(self, tree: np.ndarray, rank: np.ndarray, values: np.ndarray) -> None:
        while len(rank):
            at = self.before[tree] + rank - 1
            for own, new in zip(self.sums, values, strict=True):
                np.add.at(own, at, new)
            rank = rank + (rank & -rank)
            stay = rank <= self.sizes[tree]
            tree, rank, values = tree[stay], rank[stay], values[:, stay]

    def below(self, tree: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Sums over the ranks 1 to ``rank``."""
        out, here = np.zeros((len(self.sums), len(rank)), np.int64), np.arange(len(rank))
        while True:
            stay = rank > 0
            tree, rank, here = tree[stay], rank[stay], here[stay]
            if not len(rank):
                return out
            out[:, here] += self.sums[:, self.before[tree] + rank - 1]
            rank = rank & (rank - 1)


def sweep(key: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray, extra: np.ndarray, q_key: np.ndarray, q_start: np.ndarray, q_end: np.ndarray) -> np.ndarray:
    """Counts, shared slots and sums of ``extra`` by query and relation: an array (3, 9, queries).

    Keys are numbers from 0; a session row stands for ``n`` sessions. Shared slots of
    two open ends are meaningless.
    """
    keys = int(max(key.max(initial=-1), q_key.max(initial=-1))) + 1
    order = np.lexsort((end, key))
    fresh = np.ones(len(key), bool)
    fresh[1:] = (np.diff(key[order]) != 0) | (np.diff(end[order]) != 0)
    ends, end_keys = end[order][fresh], key[order][fresh]  # distinct ends of each key
    sizes = np.bincount(end_keys, minlength=keys)
    tree = Fenwick(sizes, 4)
    at_key = lambda k, x: k * (2 * OPEN + 2) + x + OPEN  # noqa: E731  rises with key and number, which can be negative
    place = at_key(end_keys, ends)
    rank = np.searchsorted(place, at_key(key, end)) - tree.before[key] + 1
    up_to = np.searchsorted(place, at_key(q_key, q_end), "right") - tree.before[q_key]
    under = np.searchsorted(place, at_key(q_key, q_end)) - tree.before[q_key]
    gone = np.searchsorted(place, at_key(q_key, q_start)) - tree.before[q_key]  # ends before the query's start
    values = np.stack([n, n * start, n * np.where(end == OPEN, 0, end), extra])

    # At a moment all sessions that start until then are in the trees.
    moments = np.unique(start)
    at = np.concatenate([q_start - 1, q_start, q_end])
    step = np.searchsorted(moments, at, "right")  # sweeps done before the question; 0: nothing is there yet
    asks = np.argsort(step, kind="stable")
    ask_stops = np.searchsorted(step[asks], np.arange(len(moments) + 2))
    entry = np.argsort(start, kind="stable")
    entry_stops = np.searchsorted(start[entry], moments, "right")
    m = len(q_key)
    ranks = np.stack([up_to, under, np.full(m, -1), gone])
    found = np.zeros((3, 4, 4, m), np.int64)  # moment, rank, sum, query
    lo = 0
    for k, hi in enumerate(entry_stops.tolist(), 1):
        new = entry[lo:hi]
        tree.add(key[new], rank[new], values[:, new])
        lo = hi
        asked = asks[ask_stops[k] : ask_stops[k + 1]]
        if not len(asked):
            continue
        moment, query = asked // m, asked % m
        for r in range(4):
            own = ranks[r][query] if r != 2 else sizes[q_key[query]]
            found[moment, r, :, query] = tree.below(q_key[query], own).T
    (before, at_start, at_end), out = found, np.zeros((3, 9, m), np.int64)
    open_q = q_end == OPEN
    q_stop = np.where(open_q, 0, q_end)
    for k, part in enumerate((at_end - at_start, at_start - before, before)):  # the query starts earlier, equally, later
        up, low, every, dead = part
        longer, equal, shorter = every - up, up - low, low
        if k == 2:
            shorter = low - dead
        first = q_start if k else None
        for j, own in enumerate((longer, equal, shorter)):
            count, starts, stops, sums = own
            last = stops if j == 2 else count * q_stop
            out[0, 3 * k + j], out[2, 3 * k + j] = count, sums
            out[1, 3 * k + j] = last - (starts if first is None else count * first) + count
    return out


class _Sweeper:
    """Rows of keys in order, the sessions of a key before its queries, to results."""

    def __init__(self):
        self.rows = self.kept = None

    def push(self, rows: dict, last: bool):
        """Answers all queries of the rows; the last key's sessions stay, as more of its queries can follow."""
        if self.kept is not None:
            rows = {c: np.concatenate([self.kept[c], v]) for c, v in rows.items()}
        change = np.ones(len(rows["key"]), bool)
        change[1:] = (np.diff(rows["key"]) != 0) | (np.diff(rows["part"]) != 0)
        key = np.cumsum(change) - 1
        asks = rows["asks"]
        if not last and len(key):
            held = ~asks & (key == key[-1])
            self.kept = {c: v[held] for c, v in rows.items()}
        s, q = ~asks, asks
        got = sweep(key[s], rows["start"][s], rows["end"][s], rows["n"][s], rows["extra"][s], key[q], rows["start"][q], rows["end"][q])
        relation, query = np.nonzero(got[0])
        ends = rows["end"][q][query]
        shared = pa.array(got[1][relation, query], mask=(ends == OPEN) & (relation % 3 == 1))
        return rows["place"][q][query], relation, got[0][relation, query], shared, got[2][relation, query]


def overlaps(queries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per query and relation: its ``id``, ``relation``, ``n_pairs``, ``overlap_slots`` and ``extra_sum``.

    ``queries`` have the columns id, key, start, end, open; ``sessions`` key, start,
    end, open, n (how many such sessions there are) and extra (a sum over them), all
    whole numbers but for open and the id, starts and ends between -2^40 and 2^40. An
    open interval's end is past all others and equal to any other open one; ``overlap_slots`` is null where both are open. Relations that no
    pair has give no row. Rows without key, start, end (if not open) are left out;
    queries of one id are answered one by one; empty tables give no rows.

    A key's sessions are gathered: their number has to be bounded by what they are,
    as slots in time are. Queries aren't: those of a key that holds more than one in
    ``SHARES`` of all are dealt over parts, each with a copy of the key's sessions.
    """
    spark = queries.sparkSession
    kind = queries.schema["id"].dataType.simpleString()
    stop = F.when(F.coalesce("open", F.lit(False)), F.lit(OPEN)).otherwise(F.col("end").cast("bigint"))
    asked = queries.select("id", F.col("key").cast("bigint").alias("key"), F.col("start").cast("bigint").alias("start"), stop.alias("end")).dropna(subset=["key", "start", "end"])
    there = sessions.select(F.col("key").cast("bigint").alias("key"), F.col("start").cast("bigint").alias("start"), stop.alias("end"), "n", "extra").dropna(subset=["key", "start", "end"])

    total = asked.agg(F.count("*")).scalar()
    hot = asked.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") * SHARES > total)
    hot = hot.select("key", F.ceil(F.col("rows") * SHARES / total).cast("int").alias("parts"))  # SHARES rows at most
    asked = asked.join(F.broadcast(hot), "key", "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "start", "end"), F.col("parts"))).cast("int")
    zero = F.lit(0).cast("bigint")
    asked = asked.select("key", part.alias("part"), F.lit(True).alias("asks"), "start", "end", zero.alias("n"), zero.alias("extra"), "id")
    there = there.join(F.broadcast(hot), "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    there = there.select("key", "part", F.lit(False).alias("asks"), "start", "end", "n", "extra", F.lit(None).cast(kind).alias("id"))
    every = asked.unionByName(there).repartition("key", "part").sortWithinPartitions("key", "part", "asks")
    target = spark.createDataFrame([], f"id {kind}, relation string, n_pairs bigint, overlap_slots bigint, extra_sum bigint").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, sweeper, held, size = to_arrow_schema(target), _Sweeper(), [], 0
        names = pa.array(RELATIONS)

        def answer(last: bool):
            ids = pa.concat_arrays([b.column(7) for b in held])
            rows = {c: np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i, c in enumerate(("key", "part", "asks", "start", "end", "n", "extra"))}
            rows["place"] = np.arange(size)
            place, relation, n, shared, extra = sweeper.push(rows, last)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(place)), names.take(pa.array(relation)), pa.array(n), shared, pa.array(extra)], schema=arrow)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                yield answer(False)
                held, size = [], 0
        if held:
            yield answer(True)

    return every.mapInArrow(run, target)


def micros(df: DataFrame, name: str) -> Column:
    """Whole microseconds since 1970; of a moment without a zone as if it were UTC, whatever the session's zone."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c)
    minutes = F.unix_date(c.cast("date")).cast("bigint") * 1440 + F.hour(c) * 60 + F.minute(c)
    return minutes * 60_000_000 + (F.expr(f"date_part('SECONDS', `{name}`)") * 1_000_000).cast("bigint")


def whole(c: Column, size: int) -> Column:
    """The number of the step of that size, counted from 0 downwards too."""
    return F.call_function("div", c, F.lit(size)) - (c % size < 0).cast("bigint")


def sessions_of(clicks: DataFrame, key: str, ts: str, error: Column, gap_minutes: int = 30) -> DataFrame:
    """Sessions of each key: ``key``, ``first`` and ``last`` in microseconds, ``open`` (an error at its last moment).

    A moment more than the gap after the key's one before begins another session.
    Clicks of one key in the same gap-long block of time belong together, so that
    blocks are what is ordered: of one key there are at most 48 in a day, however
    many clicks it has. Rows without key or moment are left out; repeated rows change nothing.
    """
    gap = gap_minutes * 60_000_000
    rows = clicks.select(F.col(key).alias("key"), micros(clicks, ts).alias("us"), error.alias("error")).dropna(subset=["key", "us"])
    last = F.col("us") * 2 + F.coalesce(F.col("error"), F.lit(False)).cast("bigint")  # of equal moments the one with an error
    blocks = rows.groupBy("key", whole(F.col("us"), gap).alias("block")).agg(F.min("us").alias("first"), F.max(last).alias("last"))
    before = Window.partitionBy("key").orderBy("block")
    begins = F.coalesce(F.col("first") - F.lag(F.shiftright("last", 1)).over(before) > gap, F.lit(True))
    numbered = blocks.withColumn("begins", begins.cast("bigint")).withColumn("session", F.sum("begins").over(before))
    found = numbered.groupBy("key", "session").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return found.select("key", "first", F.shiftright("last", 1).alias("last"), (F.pmod("last", F.lit(2)) == 1).alias("open"))


def slots(c: Column, hours: int) -> Column:
    return whole(c, hours * 3_600_000_000)


def sales_and_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame, hours: int = 6, gap_minutes: int = 30) -> DataFrame:
    """Each sale with the click sessions of its client that share a slot, by relation.

    A sale lasts from ``sold_at`` to the latest of it and its lines' ``shipped_at``,
    and has no end while its status is open; a session while its last click is an
    error. Sales without client or moment and clicks without client or ts are left out,
    a null status or kind is neither open nor an error; lines of other sales or none
    say nothing, lines said twice the same as once; empty tables give no rows.
    """
    shipped = lines.select("sale_id", micros(lines, "shipped_at").alias("us")).dropna().groupBy("sale_id").agg(F.max("us").alias("shipped"))
    sold = sales.select("sale_id", F.col("client_id").alias("key"), micros(sales, "sold_at").alias("sold"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open")).dropna(subset=["key", "sold"])
    ended = sold.join(shipped, "sale_id", "left")
    queries = ended.select(F.col("sale_id").alias("id"), "key", slots(F.col("sold"), hours).alias("start"), slots(F.greatest("sold", "shipped"), hours).alias("end"), "open")
    found = sessions_of(clicks, "client_id", "ts", F.col("kind") == "error", gap_minutes)
    # Sessions of the same slots are one row with their number.
    cells = found.groupBy("key", slots(F.col("first"), hours).alias("start"), F.when(~F.col("open"), slots(F.col("last"), hours)).alias("end"), "open")
    sessions = cells.agg(F.count("*").alias("n"), F.sum(F.crc32(F.col("first").cast("string"))).alias("extra"))
    return overlaps(queries, sessions).withColumnsRenamed({"id": "sale_id", "extra_sum": "sessions_crc"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_and_sessions(*(table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clicks")))


#: The same by a join; crc32 of a number's digits by the usual table of 256 remainders.
SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
steps AS (SELECT client_id, epoch_us(ts) AS us, kind FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
marked AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client_id ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM steps),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS session FROM marked),
bounds AS (SELECT client_id, session, min(us) AS first, max(us) AS last FROM numbered GROUP BY client_id, session),
sessions AS (SELECT b.client_id, b.first, b.first // 21600000000 AS s, bool_or(coalesce(n.kind = 'error', false)) AS open, b.last // 21600000000 AS e
  FROM bounds b JOIN numbered n ON n.client_id = b.client_id AND n.session = b.session AND n.us = b.last GROUP BY b.client_id, b.session, b.first, b.last),
summed AS (SELECT client_id, s, CASE WHEN open THEN 1099511627776 ELSE e END AS e,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(first AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: xor(crc.step[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
  FROM sessions, crc),
shipped AS (SELECT sale_id, max(epoch_us(shipped_at)) AS us FROM sale_lines WHERE sale_id IS NOT NULL AND shipped_at IS NOT NULL GROUP BY sale_id),
asked AS (SELECT a.sale_id, a.client_id, epoch_us(a.sold_at) // 21600000000 AS s,
  CASE WHEN a.status = 'open' THEN 1099511627776 ELSE greatest(epoch_us(a.sold_at), coalesce(b.us, epoch_us(a.sold_at))) // 21600000000 END AS e
  FROM sales a LEFT JOIN shipped b USING (sale_id) WHERE a.client_id IS NOT NULL AND a.sold_at IS NOT NULL),
pairs AS (SELECT a.sale_id, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS shared, a.e = 1099511627776 AND b.e = 1099511627776 AS endless, b.crc,
  CASE WHEN a.s < b.s THEN CASE WHEN a.e < b.e THEN 'overlaps' WHEN a.e = b.e THEN 'finished_by' ELSE 'contains' END
       WHEN a.s = b.s THEN CASE WHEN a.e < b.e THEN 'starts' WHEN a.e = b.e THEN 'equals' ELSE 'started_by' END
       ELSE CASE WHEN a.e < b.e THEN 'during' WHEN a.e = b.e THEN 'finishes' ELSE 'overlapped_by' END END AS relation
  FROM asked a JOIN summed b ON b.client_id = a.client_id AND b.s <= a.e AND b.e >= a.s)
SELECT sale_id, relation, count(*) AS n_pairs, CAST(CASE WHEN bool_or(endless) THEN NULL ELSE sum(shared) END AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc
FROM pairs GROUP BY sale_id, relation"""
