"""A run over many units in which what is wrong with one stays with that one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(records: DataFrame, unit: str, measured: Column, checks: Sequence[tuple[str, Column]], observations: dict[str, Column], expected: DataFrame | None = None) -> DataFrame:
    """(unit, outcome, code, bad, and the observations): processed, skipped or failed, one row a unit.

    A unit without a row that can be ``measured`` is skipped. ``checks`` are (code,
    condition) pairs, in their order of precedence; a row that meets one is bad and
    fails its unit, which then has the first code and no observations. ``expected``
    units (by name) that have no rows at all fail with the code missing. Nothing
    stops the run: conditions over damaged rows are null or false, not errors.
    """
    code = F.lit(None).cast("int")
    for k, (_, condition) in reversed(list(enumerate(checks))):
        code = F.when(F.coalesce(condition, F.lit(False)), k).otherwise(code)
    rows = records.withColumn("_code", code).withColumn("_measured", F.coalesce(measured, F.lit(False)))
    good = F.col("_measured") & F.col("_code").isNull()
    sums = [F.sum(F.when(good, c)).alias(name) for name, c in observations.items()]
    per = rows.groupBy(unit).agg(F.min("_code").alias("_first"), F.count("_code").alias("bad"), F.bool_or("_measured").alias("_any"), *sums)
    if expected is not None:
        per = expected.select(unit).distinct().join(per, unit, "left")
    names = F.array(*[F.lit(name) for name, _ in checks])
    missing = F.col("_any").isNull()
    outcome = F.when(missing | F.col("_first").isNotNull(), "failed").when(~F.col("_any"), "skipped").otherwise("processed")
    shown = [F.when(outcome == "processed", F.coalesce(F.col(name), F.lit(0))).alias(name) for name in observations]
    return per.select(unit, outcome.alias("outcome"), F.when(missing, "missing").otherwise(F.get(names, F.col("_first"))).alias("code"), F.coalesce("bad", F.lit(0)).cast("bigint").alias("bad"), *shown)


def curated(findings: DataFrame) -> DataFrame:
    """Findings of catalogued rules, in the order in which they are digested: by place, occurrences, path, rule, context and id."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    named = lambda c: F.coalesce(F.col(c), F.lit(""))
    kept = findings.where("category is not null")
    return kept.select(*[zero(c).alias(c) for c in ("column_start", "column_end", "line_start", "line_end", "occurrences")], named("path").alias("path"), named("code").alias("rule"), "context", named("id").alias("id"))
