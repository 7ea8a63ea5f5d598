"""Two scans as multisets: introduced, pre-existing and fixed findings.

Four passes pair what is left over by ever looser keys: the k-th row of a key on
one side with the k-th on the other. A pass ranks both sides' rows within their keys
and groups them by (key, k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle
from .ordered import ranked

EVIDENCE = ("path", "origin", "code", "message")


def fingerprint(origin: Column, code: Column, message: Column, proof: Column) -> Column:
    """Digest of what a finding says and shows, not of where; null without a proof."""
    return F.when(proof.isNotNull(), F.sha2(F.to_json(F.array(origin, code, message, proof)), 256))


def _pass(rows: DataFrame, key: list[str], left: Column, right: Column) -> DataFrame:
    """Rows of both sides with ``k``, their place among those of their key and side, where the other side has as many; else null."""
    asked = F.when(F.col("side") == 0, left).otherwise(right)
    # ``asked`` is false, never null, for rows that this pass doesn't take.
    taken = ranked(rows.where(asked), [*key, "side"], ["idx"], "k")
    side = lambda n: F.count_if(F.col("side") == n)
    both = taken.groupBy(*key).agg(F.least(side(0), side(1)).alias("pairs")).where("pairs > 0")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}"))
    met = taken.alias("t").join(both.alias("c"), same, "left")
    k = F.when(F.col("t.k") < F.col("c.pairs"), F.col("t.k"))
    found = met.select(*[F.col(f"t.{c}").alias(c) for c in rows.columns], k.alias("k"))
    return settle(found.unionByName(rows.where(~asked).withColumn("k", F.lit(None).cast("bigint"))))


def pair(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(baseline_idx, current_idx, pass): both sides have idx, path, origin, code, message, fp (null: unproven).

    Pass 1: path and fingerprint. 2: an unproven baseline row with a proven current
    one by path and message. 3: any baseline row with an unproven current one, the
    same way. 4: fingerprints across paths. Rows are read once and settled; after
    each pass only what it left goes on.
    """
    columns = ("idx", *EVIDENCE, "fp")
    sides = [d.select(F.lit(i).alias("side"), *columns) for i, d in enumerate((baseline, current))]
    rows = settle(sides[0].unionByName(sides[1]))
    proven = F.col("fp").isNotNull()
    steps = [(proven, proven, ["path", "fp"]), (~proven, proven, list(EVIDENCE)), (F.lit(True), ~proven, list(EVIDENCE)), (proven, proven, ["fp"])]
    pairs = None
    for number, (left, right, key) in enumerate(steps, 1):
        done = _pass(rows, key, left, right)
        idx = lambda n: F.max(F.when(F.col("side") == n, F.col("idx")))
        found = done.where("k is not null").groupBy(*key, "k").agg(idx(0).alias("baseline_idx"), idx(1).alias("current_idx"))
        found = found.select("baseline_idx", "current_idx", F.lit(number).alias("pass"))
        pairs = found if pairs is None else pairs.unionByName(found)
        rows = done.where("k is null").drop("k")
    return settle(pairs)


def introduced(current: DataFrame, pairs: DataFrame) -> DataFrame:
    return current.join(pairs, current.idx == pairs.current_idx, "left_anti")


def fixed(baseline: DataFrame, pairs: DataFrame) -> DataFrame:
    return baseline.join(pairs, baseline.idx == pairs.baseline_idx, "left_anti")
