"""Rates, intervals, agreement, samples and distributions; all published as whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ranked

# Fixed values.
Z = 1.959963985
NOISE_THRESHOLD, LEAST_ARM, SAMPLE, LEAST_REVIEWED = 500, 40, 20, 5
# End of the fixed values.


def rate(fp: Column, n: Column) -> Column:
    return F.when(n > 0, F.floor(fp * 10_000 / n)).otherwise(0).cast("bigint")


def wilson(fp: Column, n: Column) -> tuple[Column, Column]:
    """95 % bounds in basis points; all of it when there is nothing to go by."""
    p, z2 = fp / F.nullif(n, F.lit(0)), Z * Z
    centre, spread = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    bound = lambda x: F.round(F.least(F.greatest(x / (1 + z2 / n), F.lit(0.0)), F.lit(1.0)) * 10_000).cast("bigint")
    void = (n == 0) | (fp > n)
    return F.when(void, 0).otherwise(bound(centre - spread)).cast("bigint"), F.when(void, 10_000).otherwise(bound(centre + spread)).cast("bigint")


def separation(low: Column, high: Column, threshold: int = NOISE_THRESHOLD) -> Column:
    return F.when(low > threshold, "above").when(high < threshold, "below").otherwise("indecisive")


def newcombe(fp1: Column, n1: Column, fp2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """Second rate less the first, with its 95 % bounds, in basis points."""
    (l1, u1), (l2, u2) = wilson(fp1, n1), wilson(fp2, n2)
    r1, r2 = rate(fp1, n1), rate(fp2, n2)
    slack = lambda x: F.greatest(x, F.lit(0)).cast("double")
    gap = r2 - r1
    low = gap - F.hypot(slack(r2 - l2), slack(u1 - r1))
    high = gap + F.hypot(slack(u2 - r2), slack(r1 - l1))
    clamp = lambda x: F.round(F.least(F.greatest(x, F.lit(-10_000.0)), F.lit(10_000.0))).cast("bigint")
    return gap, clamp(low), clamp(high)


def verdict(low: Column, high: Column) -> Column:
    return F.when((low > 0) | (high < 0), "separated").otherwise("indistinguishable")


def contingency(rows: DataFrame, first: str, second: str, *key: str) -> DataFrame:
    yes, no = (lambda c: F.col(c) == 1), (lambda c: F.col(c) == 0)
    cell = lambda a, b: F.count_if(a(first) & b(second))
    return rows.groupBy(*key).agg(cell(yes, yes).alias("both_yes"), cell(yes, no).alias("first_only"), cell(no, yes).alias("second_only"), cell(no, no).alias("neither"))


def agreement() -> tuple[Column, Column]:
    """Cohen's kappa (null without variance) and Gwet's AC1 of a contingency table, in basis points."""
    a, b, c, d = (F.col(x).cast("double") for x in ("both_yes", "first_only", "second_only", "neither"))
    n = a + b + c + d
    po, p1, p2 = (a + d) / n, (a + b) / n, (a + c) / n
    pe, mean = p1 * p2 + (1 - p1) * (1 - p2), (p1 + p2) / 2
    flat = (p1 == 0) | (p1 == 1) | (p2 == 0) | (p2 == 1)
    chance = 2 * mean * (1 - mean)
    kappa = F.when((n > 0) & ~flat, F.round((po - pe) / (1 - pe) * 10_000).cast("bigint"))
    return kappa, F.when(n > 0, F.round((po - chance) / (1 - chance) * 10_000).cast("bigint"))


def stride_sample(rows: DataFrame, key: str, order: list[str], target: int = SAMPLE) -> DataFrame:
    """Rows at the positions i * n div k, k the smaller of target and n, of each key in order; a large key is ranked over ranges."""
    n = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    at = ranked(rows, [key], order, "position")
    placed = at.join(n, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_k", F.least(F.col("_n"), F.lit(target))).drop("_key")
    # The smallest i with i * n div k >= position, if it is equal.
    i = F.expr("(position * _k + _n - 1) div _n")
    return placed.where((i < F.col("_k")) & (F.expr("((position * _k + _n - 1) div _n) * _n div _k") == F.col("position"))).drop("_n", "_k")


def median_centi(value: Column) -> Column:
    return F.round(F.median(value) * 100).cast("bigint")


def order_statistics(rows: DataFrame, key: str, value: str, **places: Column) -> DataFrame:
    """(key, a column for each of ``places``): the mean of each key's values at the places asked for, in order from 0.

    A place is an array of longs over ``n``, the number of the key's values that aren't
    null; a key without any has nulls. No key is gathered: values are ranked, large keys
    over ranges, and only those at the places asked for are aggregated. The order need
    not be total, as equal values may stand at any of their places.
    """
    n = rows.groupBy(F.col(key).alias("_key")).agg(F.count(value).alias("n"))
    at = ranked(rows.where(F.col(value).isNotNull()).select(key, value), [key], [value], "_at")
    asked = n.select("_key", "n", *[p.alias(f"_{name}") for name, p in places.items()])
    every = F.array_distinct(F.flatten(F.array(*[F.col(f"_{name}") for name in places])))
    wanted = asked.withColumn("_place", F.explode_outer(F.when(F.col("n") > 0, every)))
    found = wanted.join(at, F.col("_key").eqNullSafe(F.col(key)) & (F.col("_place") == F.col("_at")), "left")
    means = [F.avg(F.when(F.array_contains(f"_{name}", F.col("_at")), F.col(value))).alias(name) for name in places]
    return found.groupBy("_key").agg(*means).withColumnRenamed("_key", key)


def populations(scores: DataFrame, population: str) -> DataFrame:
    """One row a population: bands, bounds, spread and median of its scores, ceilings, and whether they collapse.

    ``scores`` have score (null: none), findings, lines and ceiling (null: none).
    Density is that of all findings over all lines. A population without a score has
    zeros and counts as collapsed.
    """
    s, held = F.col("score"), F.col("score").isNotNull()
    told = scores.groupBy(population).agg(
        F.count_if(s >= 75).alias("great"),
        F.count_if((s >= 50) & (s < 75)).alias("needs_work"),
        F.count_if(s < 50).alias("critical"),
        F.coalesce(F.min(s), F.lit(0)).cast("bigint").alias("least"),
        F.coalesce(F.max(s), F.lit(0)).cast("bigint").alias("most"),
        F.count_if(held & F.col("ceiling").isNotNull()).alias("ceilings"),
        (F.count_distinct(s) <= 1).alias("one_value"),
        density_milli(F.sum("findings"), F.sum("lines")).cast("bigint").alias("density_milli"),
    )
    bands = sum(((F.col(c) > 0).cast("int") for c in ("great", "needs_work", "critical")), F.lit(0))
    mid = order_statistics(scores, population, "score", mid=middle()).select(F.col(population).alias("_p"), F.coalesce(F.round(F.col("mid") * 100), F.lit(0)).cast("bigint").alias("median_centi"))
    met = told.join(mid, F.col(population).eqNullSafe(F.col("_p"))).drop("_p")
    return met.withColumns({"spread": F.col("most") - F.col("least"), "one_band": bands <= 1})


def apart(told: DataFrame, population: str, first: str, second: str) -> DataFrame:
    """(least, most, spread, separation_centi): two populations together, and the first's median less the second's."""
    of = lambda p: F.coalesce(F.max(F.when(F.col(population) == p, F.col("median_centi"))), F.lit(0))
    both = told.where(F.col(population).isin(first, second)).agg(F.min("least").alias("least"), F.max("most").alias("most"), (of(first) - of(second)).cast("bigint").alias("separation_centi"))
    return both.withColumn("spread", F.col("most") - F.col("least"))


def middle() -> Column:
    """The places of the median, one or two, for ``order_statistics``."""
    return F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))


def discrete(percent: int) -> Column:
    """The place of the smallest value that at least so many in a hundred don't exceed, for ``order_statistics``."""
    return F.array(F.expr(f"greatest((n * {percent} + 99) div 100, 1) - 1"))


def density_milli(findings: Column, lines: Column) -> Column:
    return F.when(lines > 0, F.floor(findings * 1_000_000 / lines)).otherwise(0).cast("bigint")


def precision_status(n: Column, findings: Column, stale: Column, duplicated: Column) -> Column:
    """unobserved without findings; publishable when enough of them are reviewed, each once and all still observed; else incomplete."""
    enough = (n >= F.least(F.lit(LEAST_REVIEWED), findings)) & (n <= findings) & ~stale & ~duplicated
    return F.when(findings == 0, "unobserved").when(enough, "publishable").otherwise("incomplete")


def admission(tier: Column, fp: Column, n: Column, low: Column, high: Column, threshold: int = NOISE_THRESHOLD) -> Column:
    """How the corpus gate takes a rule: unproven, refused, noisy, indecisive or admitted. All but a refused one are let in."""
    return F.when(n == 0, "unproven").when((tier == "P0") & (fp > 0), "refused").when(rate(fp, n) > threshold, "noisy").when(~(high < threshold), "indecisive").otherwise("admitted")
