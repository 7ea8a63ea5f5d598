"""Findings of all producers in one schema, with their identities, packages and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity

COLUMNS = ("id", "source", "code", "severity", "message", "path", "line", "column", "package")


def compiler(rows: DataFrame, **c: Column) -> DataFrame:
    """Messages of a compiler: at a place, of a package."""
    span = identity.span_json(c["line"], c["column"], c["line_end"], c["column_end"])
    return _shape(rows, identity.positional(c["source"], c["code"], c["path"], span, c["severity"], c["message"]), **c)


def manifests(rows: DataFrame, **c: Column) -> DataFrame:
    """Findings of manifests: a path without a span."""
    return _shape(rows, identity.of_manifest(c["source"], c["code"], c["path"], c["severity"], c["message"]), **c)


def structures(rows: DataFrame, key: Column, **c: Column) -> DataFrame:
    """Families: identified by what they have in common."""
    return _shape(rows, identity.structural(c["source"], c["code"], c["severity"], identity.family(c["code"], key)), **c)


def _shape(rows: DataFrame, id_: Column, **c: Column) -> DataFrame:
    of = {name: c.get(name, F.lit(None)) for name in COLUMNS[1:]}
    kinds = {"line": "bigint", "column": "bigint"}
    return rows.select(id_.alias("id"), *[v.cast(kinds.get(k, "string")).alias(k) for k, v in of.items()])


def union(*shapes: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, shapes)


def with_package(findings: DataFrame, packages: DataFrame, key: str, name: str) -> DataFrame:
    """The name of each finding's package in place of its key; null where it is unknown."""
    known = packages.select(F.col(key).cast("string").alias("_key"), F.col(name).alias("_name"))
    return findings.join(known, F.col("package") == F.col("_key"), "left").withColumn("package", F.col("_name")).drop("_key", "_name")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).when(severity == "info", 2).otherwise(3)


def ordered(findings: DataFrame) -> DataFrame:
    """By path (none last), start, severity, code and identity: a sort by ranges, in no single task."""
    return findings.orderBy(F.col("path").asc_nulls_last(), F.col("line").asc_nulls_last(), F.col("column").asc_nulls_last(), severity_rank(F.col("severity")), F.col("code").asc_nulls_first(), "id")
