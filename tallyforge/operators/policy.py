"""Policy: overrides, precedence, gates and exit codes."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("off", "warn", "error")


def parse_override(text: str) -> tuple[str, str]:
    """KEY=LEVEL; ValueError with a closed code, which never repeats the input."""
    key, sep, level = text.partition("=")
    if not sep:
        raise ValueError("override-syntax")
    if level not in LEVELS:
        raise ValueError("override-level")
    if not re.fullmatch("[a-z0-9_:]{1,128}", key):
        raise ValueError("override-selector")
    return key, level


def validate(overrides: list[tuple[str, str]], known: set[str]) -> None:
    """Each selector known, and given once."""
    keys = [k for k, _ in overrides]
    if any(k not in known for k in keys):
        raise ValueError("override-unknown")
    if len(set(keys)) < len(keys):
        raise ValueError("override-repeated")


def parsed(text: Column) -> tuple[Column, Column, Column]:
    """(key, level, code) of KEY=LEVEL as ``parse_override`` reads it; where a code says what is wrong the others are null. A null text has a wrong syntax."""
    key, level = F.substring_index(text, "=", 1), F.substr(text, F.instr(text, F.lit("=")) + 1)
    code = (
        F.when(~F.coalesce(F.contains(text, F.lit("=")), F.lit(False)), "override-syntax")
        .when(~level.isin(*LEVELS), "override-level")
        .when(~key.rlike(r"^[a-z0-9_:]{1,128}\z"), "override-selector")
    )
    return F.when(code.isNull(), key), F.when(code.isNull(), level), code


def checked(overrides: DataFrame, known: DataFrame, unit: Sequence[str], text: str = "override") -> DataFrame:
    """The rows with key, level and code: what is wrong with each override, null if nothing is.

    ``known`` has selector, in every unit the same: rules or categories, as many as a catalog
    holds, so it goes to all tasks. Beyond ``parsed``, a selector has to be known, and be given once
    within ``unit``: override-unknown, override-repeated, which all its rows have.
    """
    key, level, code = parsed(F.col(text))
    rows = overrides.withColumns({"key": key, "level": level, "code": code})
    times = rows.where("key is not null").groupBy(*[F.col(u).alias(f"_u{i}") for i, u in enumerate(unit)], F.col("key").alias("_key")).agg(F.count("*").alias("_times"))
    same = F.col("key") == F.col("_key")
    for i, u in enumerate(unit):
        same = same & F.col(u).eqNullSafe(F.col(f"_u{i}"))
    named = known.select(F.col("selector").alias("_selector")).distinct()
    met = rows.join(F.broadcast(named), F.col("key") == F.col("_selector"), "left").join(times, same, "left")
    late = F.when(F.col("key").isNotNull() & F.col("_selector").isNull(), "override-unknown").when(F.col("_times") > 1, "override-repeated")
    return met.withColumn("code", F.coalesce("code", late)).select(*rows.columns)


def compile_plan(rules: DataFrame, overrides: DataFrame, unit: Sequence[str] = ()) -> DataFrame:
    """(rule, level, level_source): request before configuration, rule before category, else the default.

    ``rules`` has rule, category, default_level; ``overrides`` kind, selector,
    level, layer. An override table is as large as what people write by hand, and
    pivots to one row a selector before it is joined. With ``unit`` columns in both
    tables each unit has its own rules and overrides.
    """
    pivot = lambda kind, key: overrides.where(F.col("kind") == kind).groupBy(*unit, F.col("selector").alias(key)).agg(*[F.max(F.when(F.col("layer") == x, F.col("level"))).alias(f"{x}_{kind}") for x in ("request", "config")])
    joined = rules.join(pivot("rule", "rule"), [*unit, "rule"], "left").join(pivot("category", "category"), [*unit, "category"], "left")
    order = ["request_rule", "request_category", "config_rule", "config_category"]
    source = F.lit("default")
    for c in reversed(order):
        source = F.when(F.col(c).isNotNull(), c).otherwise(source)
    return joined.select(*unit, "rule", F.coalesce(*order, "default_level").alias("level"), source.alias("level_source"))


def blocks(severity: Column, blocking: str) -> Column:
    return {"none": F.lit(False), "error": severity == "error", "warning": severity.isin("error", "warning")}[blocking]


def blocking_level(request: Column, config: Column) -> tuple[Column, Column]:
    """The level at which findings block, and where it comes from: request before configuration, else errors block."""
    return F.coalesce(request, config, F.lit("error")), F.when(request.isNotNull(), "request").when(config.isNotNull(), "config").otherwise("default")


def blocks_at(severity: Column, level: Column) -> Column:
    """As ``blocks`` for a level in each row; a null or unknown level blocks nothing."""
    return F.coalesce((level == "error") & (severity == "error") | (level == "warning") & severity.isin("error", "warning"), F.lit(False))


def gate(findings: DataFrame, *key: str, blocking: str = "error") -> DataFrame:
    """Blocking findings that weigh (have no context), and whether the gate passes."""
    n = F.count_if(F.col("context").isNull() & blocks(F.col("severity"), blocking))
    return findings.groupBy(*key).agg(n.alias("blocking_findings"), F.when(n > 0, "failed").otherwise("passed").alias("gate"))


def baseline_gate(findings: DataFrame, introduced: DataFrame, key: list[str], blocking: str = "error") -> DataFrame:
    """Blocking findings among the introduced ones; those with a context count here."""
    return findings.join(introduced.select(*key).distinct(), key, "left_semi").agg(F.count_if(blocks(F.col("severity"), blocking)).alias("blocking_findings"))


def status(failed: Column, complete: Column, outcomes: Column) -> Column:
    return F.when(failed | (outcomes == 0), "failed").when(complete, "complete").otherwise("incomplete")


def exit_code(status_: Column, gate_: Column) -> Column:
    return F.when(status_ == "failed", 2).when((status_ == "complete") & (gate_ == "passed"), 0).otherwise(1)
