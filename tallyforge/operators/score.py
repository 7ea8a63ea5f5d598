"""Health scores from densities of findings, with ceilings, and the ranking of repairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dimensions with their scale of decay and their weight (doubled), and ceilings by worst tier.
DIMENSIONS = {"security": (1.0, 4), "reliability": (10.0, 3), "maintainability": (3.0, 2), "performance": (4.0, 2), "dependencies": (3.0, 2)}
WEIGHTS = 13
FLOOR = 2.0
DIMENSION_CEILING = {0: 20, 1: 50, 2: 75}
OVERALL_CEILING = {0: 40, 1: 65}
SHARED_MOST = 1_000_000
# End of the fixed values.


def dimension(category: Column) -> Column:
    return F.when(category.isin("correctness", "reliability"), "reliability").when(category.isin("cargo", "dependencies"), "dependencies").when(category.isin("security", "performance", "maintainability"), category)


def weight(severity: Column) -> Column:
    return F.when(severity == "error", 2).when(severity.isin("warning", "info"), 1)


def _pick(values: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def aggregate_rules(findings: DataFrame, *key: str, extra: Sequence[Column] = ()) -> DataFrame:
    """By rule: occurrences, worst severity rank (0 error), weight of the scoring rows, dimension and tier.

    Rows with a context, without a known severity or without a dimension don't
    score. A rule whose scoring rows disagree on the dimension has none, and makes
    the score unreliable, as do rows without a context that can't score or whose rule
    the catalog lacks (no tier).
    """
    w, d = weight(F.col("severity")), dimension(F.col("category"))
    scores = F.col("context").isNull() & w.isNotNull() & d.isNotNull()
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(3)
    conflict = F.count_distinct(F.when(scores, d)) > 1
    return findings.groupBy(*key, "rule").agg(
        F.sum("occurrences").alias("occurrences"),
        F.min(rank).alias("worst_severity"),
        F.coalesce(F.sum(F.when(scores, w)), F.lit(0)).cast("bigint").alias("numerator"),
        F.when(~conflict, F.min(F.when(scores, d))).alias("dimension"),
        F.min(F.substring("tier", 2, 1).cast("int")).alias("tier"),
        F.min("producer").alias("producer"),
        F.min("noise_bp").alias("noise_bp"),
        (F.bool_and(F.col("context").isNotNull() | scores & F.col("tier").isNotNull()) & ~conflict).alias("authoritative"),
        *extra,
    )


def densities(rules: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Rules with their density: per 1,000 lines (2,000 at least) for rules of code, as they are for others."""
    scale = F.greatest(F.col("production_lines") / 1000.0, F.lit(FLOOR))
    by_code = F.col("producer").isin("clippy", "source", "structure")
    return rules.join(sizes, key).withColumn("density", F.col("numerator") / F.when(by_code, scale).otherwise(1.0))


def by_dimension(rules: DataFrame, key: str) -> DataFrame:
    return rules.where("dimension is not null").groupBy(key, "dimension").agg(F.sum("density").alias("density"), F.min(F.when(F.col("numerator") > 0, F.col("tier"))).alias("tier"))


def score(sizes: DataFrame, dimensions: DataFrame, key: str) -> DataFrame:
    """One row a key of ``sizes`` (key, production_lines, source_files): its dimensions' scores, value and label.

    Without findings a key scores 100; without files or lines it has no score.
    """
    aggregates = []
    for d in DIMENSIONS:
        here = F.col("dimension") == d
        aggregates += [F.coalesce(F.sum(F.when(here, F.col("density"))), F.lit(0.0)).alias(f"_{d}"), F.min(F.when(here, F.col("tier"))).alias(f"_{d}_tier")]
    wide = sizes.join(dimensions, key, "left").groupBy(key, "production_lines", "source_files").agg(*aggregates)
    points = {d: F.least(F.round(100 * F.exp(-F.col(f"_{d}") / lam)).cast("int"), _pick(DIMENSION_CEILING, F.col(f"_{d}_tier"), 100)) for d, (lam, _) in DIMENSIONS.items()}
    wide = wide.withColumns(points)
    worst = F.least(*[F.col(f"_{d}_tier") for d in DIMENSIONS])
    total = sum((F.col(d) * w for d, (_, w) in DIMENSIONS.items()), F.lit(WEIGHTS // 2))
    value = F.least((total / WEIGHTS).cast("int"), _pick(OVERALL_CEILING, worst, 100))
    held = (F.col("source_files") > 0) & (F.col("production_lines") > 0)
    wide = wide.withColumn("score", F.when(held, value))
    return wide.select(key, "production_lines", "source_files", *DIMENSIONS, "score", label(F.col("score")).alias("label"))


def label(value: Column) -> Column:
    return F.when(value >= 75, "Great").when(value >= 50, "Needs work").when(value.isNotNull(), "Critical")


def contributions(rules: DataFrame, key: str) -> DataFrame:
    """Each rule's loss of score in millionths (only its own dimension moves), and that loss less the rule's noise."""
    lam = _pick({d: v[0] for d, v in DIMENSIONS.items()}, F.col("dimension"), 1.0)
    w = _pick({d: v[1] for d, v in DIMENSIONS.items()}, F.col("dimension"), 0)
    total = F.sum("density").over(Window.partitionBy(key, "dimension"))
    gain = 1e6 * w / WEIGHTS * 100.0 * (F.exp(-(total - F.col("density")) / lam) - F.exp(-total / lam))
    out = rules.where("dimension is not null").withColumn("contribution", F.greatest(F.round(gain), F.lit(0.0)).cast("bigint"))
    return out.withColumn("repair_value", F.expr("contribution * (10000 - coalesce(noise_bp, 0)) div 10000"))


def authority(units: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, authoritative): whether a unit's score can be relied on.

    ``units`` have status and inventory (whether all files were seen), ``rules`` are
    aggregated. A scan has to be complete, its files all known and each of its rules
    sure; a unit without findings has sure rules, one with a null status or inventory isn't
    relied on.
    """
    sure = rules.groupBy(F.col(key).alias("_key")).agg(F.bool_and("authoritative").alias("_sure"))
    whole = (F.col("status") == "complete") & F.col("inventory") & F.coalesce("_sure", F.lit(True))
    return units.join(sure, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce(whole, F.lit(False)).alias("authoritative"))


def published(rules: DataFrame, key: str) -> DataFrame:
    """Rules of the keys whose score can be relied on; nothing is ranked for the others."""
    return rules.withColumn("_sure", F.min("authoritative").over(Window.partitionBy(key))).where("_sure").drop("_sure")


def ranking(rules: DataFrame, key: str) -> DataFrame:
    """Scorable rules in the order of their repair: by value, contribution and name."""
    order = Window.partitionBy(key).orderBy(F.desc("repair_value"), F.desc("contribution"), "rule")
    return rules.where("contribution > 0 and repair_value > 0").withColumn("rank", F.row_number().over(order))


def withheld(rules: DataFrame, key: str) -> DataFrame:
    """Rules whose findings are all noise, so that no repair is asked for."""
    order = Window.partitionBy(key).orderBy(F.desc("contribution"), "rule")
    return rules.where("contribution > 0 and repair_value = 0").withColumn("rank", F.row_number().over(order))


def without_top(rules: DataFrame, ranked: DataFrame, key: str, n: int = 3) -> DataFrame:
    """What is left once each key's first ``n`` repairs are made."""
    return rules.join(ranked.where(F.col("rank") <= n).select(key, "rule"), [key, "rule"], "left_anti")


def share_payload(score_: Column, counts: dict[str, Column]) -> Column:
    """s=..&m=..&e=..: counts of 0 are left out; null if a count is too large to share."""
    parts = [F.concat(F.lit("s="), score_.cast("string")), F.lit("m=core-v3"), *[F.when(c > 0, F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in counts.items()]]
    fits = score_.between(0, 100)
    for c in counts.values():
        fits = fits & (c <= SHARED_MOST)
    return F.when(fits, F.concat_ws("&", *parts))


assert math.isclose(sum(w for _, w in DIMENSIONS.values()), WEIGHTS)
