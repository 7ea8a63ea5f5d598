"""Findings: detected, brought to one schema, merged, restamped, scoped, counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import catalog

COLUMNS = ("rule", "doc_id", "source", "occurrences")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
LICENSE = r"(?i)(copyright|license|spdx)"
TOKEN = r'token = "[0-9a-f]{40}"'
OVERSIZED, ENORMOUS, REPEATED = 10_000, 20_000, 20
#: Stands for the size of a document among its findings: its occurrences are characters.
SIZE = "#size"
#: Paths on which a rule has to fire before its advisory.
ADVISORY = 40


def unanimous(c: Column) -> Column:
    """The value all rows of a group agree on, null being a value; null where they differ."""
    return F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c))


# Detectors. Most look at one row and are an expression, its occurrences (0: no finding): all of
# them together take one scan. Those that compare rows are a function from documents to findings.


def _repeated_lines() -> Column:
    """Number of long lines that a text has more than once."""
    lines = F.sort_array(F.filter(F.split("text", "\n"), lambda x: F.length(x) > REPEATED))
    # The sorted lines are bound to a variable, so that they are sorted once and not for each line.
    again = lambda own: F.zip_with(own, F.slice(own, F.lit(2), F.size(own)), lambda x, after: F.when(x == after, x))
    held = F.element_at(F.transform(F.array(lines), again), 1)
    return F.size(F.array_distinct(F.filter(held, lambda x: x.isNotNull()))).cast("bigint")


def _once(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("bigint")


BY_ROW = {
    "oversized_unit": lambda: _once(F.col("n_chars") >= OVERSIZED),
    "repeated_line": _repeated_lines,
    "email": lambda: _once(F.col("text").rlike(EMAIL)),
    "license_line": lambda: _once(F.col("text").rlike(LICENSE)),
    "token_literal": lambda: _once(F.col("text").rlike(TOKEN)),
    "enormous_unit": lambda: _once(F.col("n_chars") >= ENORMOUS),  # no rule of the catalog
}


def duplicates(docs: DataFrame) -> DataFrame:
    """One finding a family of equal texts, anchored on its smallest id. Texts are shuffled as digests."""
    families = docs.groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"), F.count("*").alias("occurrences"))
    return families.where("occurrences > 1").select(F.lit("duplicate_body").alias("rule"), "doc_id", "source", "occurrences")


ACROSS_ROWS = {"duplicate_body": duplicates}


def detect(docs: DataFrame, active: set[str] | None = None, sized: bool = False) -> DataFrame:
    """Findings of the active detectors; inactive ones are not in the plan at all.

    Findings of rules that the catalog lacks stay, as warnings without category and
    tier. ``sized`` adds a row SIZE for each document, from the same scan.
    """
    docs = docs.select("doc_id", "source", "n_chars", F.coalesce("text", F.lit("")).alias("text"))
    chosen = lambda detectors: {k: v for k, v in detectors.items() if active is None or k in active}
    found = [fn(docs) for fn in chosen(ACROSS_ROWS).values()]
    single = chosen(BY_ROW)
    if sized:
        single |= {SIZE: lambda: F.coalesce(F.col("n_chars"), F.lit(0)).cast("bigint")}
    if single:
        each = F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), v().alias("occurrences")) for k, v in single.items()]), lambda x: (x["occurrences"] > 0) | (x["rule"] == SIZE))
        found.append(docs.select("doc_id", "source", F.inline(each)).select(*COLUMNS))
    if not found:
        return docs.sparkSession.createDataFrame([], "rule string, doc_id bigint, source string, occurrences bigint, category string, producer string, tier string, severity string, noise_bp int, context string")
    rules = F.broadcast(catalog.document_rules(docs.sparkSession))  # six rows
    every = reduce(DataFrame.unionByName, found)
    known = every.join(rules, "rule", "left").withColumn("severity", F.coalesce("severity", F.lit("warning")))
    return known.withColumn("context", F.when(F.col("doc_id") % 10 == 0, "tests"))


def merge(findings: DataFrame, key: list[str], summed: str, unanimity: list[str], first: list[str]) -> DataFrame:
    """One row a key: occurrences summed, columns kept where all rows agree; equal columns as they are."""
    return findings.groupBy(*key).agg(F.sum(summed).alias(summed), *[unanimous(F.col(c)).alias(c) for c in unanimity], *[F.min(c).alias(c) for c in first])


def by_severity(findings: DataFrame, *key: str, severity: str = "severity", occurrences: str = "occurrences") -> DataFrame:
    """Distinct findings and occurrences of each severity, by ``key`` (all together without)."""
    out = []
    for s in ("error", "warning", "info", "unknown"):
        out.append(F.count_if(F.col(severity) == s).alias(f"{s}_distinct"))
        out.append(F.coalesce(F.sum(F.when(F.col(severity) == s, F.col(occurrences))), F.lit(0)).cast("bigint").alias(f"{s}_occurrences"))
    return findings.groupBy(*key).agg(*out)


def bucket(category: Column) -> Column:
    """Report category of a rule's category."""
    return F.when(category == "security", "Security").when(category.isin("correctness", "reliability"), "Bugs").when(category == "performance", "Performance").when(category.isin("cargo", "dependencies"), "Dependencies").when(category == "maintainability", "Maintainability").otherwise("Other")


def drop_inactive(findings: DataFrame, plan: DataFrame) -> DataFrame:
    """Without findings of rules that are switched off; rules that the plan doesn't know stay."""
    return findings.join(plan.where(F.col("level") == "off").select("rule"), "rule", "left_anti")


def restamp(findings: DataFrame, plan: DataFrame) -> DataFrame:
    """Severities by the plan's levels, where these are not the default ones."""
    changed = plan.where(F.col("level_source") != "default").select("rule", F.col("level").alias("_level"))
    stamped = F.when(F.col("_level") == "warn", "warning").when(F.col("_level") == "error", "error").when(F.col("_level") == "off", "info")
    return findings.join(changed, "rule", "left").withColumn("severity", F.coalesce(stamped, "severity")).drop("_level")


def in_scope(rows: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows whose path is in the changed set; one without a path is not."""
    return rows.join(changed.select(key), key, "left_semi")


def advisories(findings: DataFrame, rule: str, path: str, least: int = ADVISORY) -> DataFrame:
    return findings.groupBy(rule).agg(F.count_distinct(path).alias("paths"), F.count("*").alias("findings")).where(F.col("paths") >= least)
