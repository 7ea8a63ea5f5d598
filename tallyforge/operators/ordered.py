"""Work that follows an order without gathering it: places, budgets spent in order, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle

#: Rows of a part once they have places, and children of a digest.
PART, FAN = 100_000, 1000
#: A group with a larger share of all rows than one in so many is spread over ranges.
SHARES = 200


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """With the place from 0 of each row within its group, by an order that is total.

    Rows are dealt into ranges of (group, order); each range counts its own, and the
    rows of a group in earlier ranges are added. A group however large is spread over
    the ranges that it fills.
    """
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = settle(rows.repartitionByRange(*group, *by).withColumn("_range", F.spark_partition_id()))
    n = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = n.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*by)) - 1
    return dealt.join(before, same).withColumn(name, (F.col("_before") + inside).cast("bigint")).drop("_range", "_r", "_before", *[f"_g{i}" for i in range(len(group))])


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """As ``placed``, for groups that are mostly small: only those with more than one in ``SHARES`` of all rows are dealt into ranges.

    There are no more than ``SHARES`` of these, whatever the table's size. Rows are read
    up to three times; settle what is dear to make.
    """
    total = rows.agg(F.count("*")).scalar()
    named = [F.col(g).alias(f"_h{i}") for i, g in enumerate(group)]
    found = rows.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") * SHARES > total).select(*named)
    few_keys = found.collect()  # SHARES at most
    usual = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    if not few_keys:
        return rows.withColumn(name, usual.cast("bigint"))
    hot = rows.sparkSession.createDataFrame(few_keys, found.schema)
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_h{i}"))
    few = rows.join(F.broadcast(hot), same, "left_anti").withColumn(name, usual.cast("bigint"))
    return few.unionByName(placed(rows.join(F.broadcast(hot), same, "left_semi"), group, order, name))


def running(rows: DataFrame, group: Sequence[str], place: str, size: str, name: str = "before") -> DataFrame:
    """With the sum of ``size`` over the rows of the group that have smaller places."""
    rows = rows.withColumn("_part", F.expr(f"{place} div {PART}"))
    sums = rows.groupBy(*group, "_part").agg(F.sum(size).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy(*group, "_part").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(before, [*group, "_part"]).withColumn(name, F.col("_before") + inside).drop("_part", "_before")


def spend(rows: DataFrame, group: Sequence[str], place: str, size: str, budget: int, skips: bool = True) -> DataFrame:
    """With ``within``: whether a row's size still fits into its group's budget, asked in the order of places.

    With ``skips`` a row that doesn't fit costs nothing and later, smaller ones can
    still fit; without, nothing fits after the first that didn't.
    Each round decides all rows of a group up to the first that doesn't fit, and drops
    those larger than what is left, so that rounds are few.
    """
    group = list(group)
    if not skips:
        at = running(rows, group, place, size)
        return at.withColumn("within", F.col("before") + F.col(size) <= budget).drop("before")
    open_rows = settle(rows.select(*group, place, size).withColumn("_left", F.lit(budget).cast("bigint")).where(F.col(size) <= budget))
    taken = open_rows.limit(0).select(*group, place)
    while not open_rows.isEmpty():
        tried = settle(running(open_rows, group, place, size).withColumn("_fits", F.col("before") + F.col(size) <= F.col("_left")))
        stops = tried.where("not _fits").groupBy(*group).agg(F.min(F.struct(place, "before")).alias("_stop"))
        decided = tried.join(stops, group, "left")
        early = F.col("_stop").isNull() | (F.col(place) < F.col(f"_stop.{place}"))
        taken = settle(taken.unionByName(decided.where(early).select(*group, place)))
        rest = decided.where(F.col(place) > F.col(f"_stop.{place}")).withColumn("_left", F.col("_left") - F.col("_stop.before"))
        open_rows = settle(rest.where(F.col(size) <= F.col("_left")).select(*group, place, size, "_left"))
    found = taken.withColumn("within", F.lit(True))
    return rows.join(found, [*group, place], "left").withColumn("within", F.coalesce("within", F.lit(False)))


def digest(lines: DataFrame, line: str, place: str, levels: int = 3, fan: int = FAN) -> DataFrame:
    """(digest, lines): one digest of all lines in the order of their places (from 0), as a tree.

    Each run of ``fan`` lines has a digest, each run of so many digests another, at
    least ``levels`` times and until one is left; no task holds more than a run.
    """
    n = lines.count()
    rows = lines.select(F.col(place).alias("_at"), F.col(line).alias("_line"))
    depth = levels
    while fan**depth < n:
        depth += 1
    for _ in range(depth):
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_line"))), lambda x: x["_line"]), "\n")
        rows = rows.groupBy(F.expr(f"_at div {fan}").alias("_up")).agg(F.sha2(run, 256).alias("_line")).withColumnRenamed("_up", "_at")
    return rows.select(F.col("_line").alias("digest"), F.lit(n).cast("bigint").alias("lines"))
