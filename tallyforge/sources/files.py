"""Other inputs: manifests, lock files, dependency lists, path lists, configuration, source trees."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CONFIG_BYTES, MANIFEST_BYTES = 65_536, 4 << 20
LEVELS = ("off", "warn", "error")
BLOCKING = ("none", "error", "warning")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files, for message streams."""
    return spark.read.text(path)


def read_tree(spark: SparkSession, path: str, glob: str = "*.rs", longest: int = 8 << 20) -> DataFrame:
    """(path, text, too_long): whole files below a folder; one longer than the limit has no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    fits = F.col("length") <= longest
    return files.select("path", F.when(fits, F.decode("content", "UTF-8")).alias("text"), (~fits).alias("too_long"))


def bounded(content: Column, limit: int) -> tuple[Column, Column]:
    """(the first ``limit`` bytes, whether there were more)."""
    return F.substring(content, 1, limit), F.octet_length(content) > limit


def zero_separated(content: Column) -> Column:
    """The paths of a list that ends each with a zero byte, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.filter(F.split(content, "\\x00"), lambda p: p != "")))


def line_count(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return texts.agg(F.coalesce(F.sum(T.lines_of(F.col(text_col))), F.lit(0)).alias("lines"))


def lock_packages(content: str | None) -> tuple[str, list[tuple[str, str]]]:
    """(absent, unusable or packages; (name, version) of a lock file)."""
    if content is None:
        return "absent", []
    try:
        got = tomllib.loads(content).get("package", [])
        return "packages", sorted((p["name"], p["version"]) for p in got)
    except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError):
        return "unusable", []


def manifest(content: str, limit: int = MANIFEST_BYTES) -> dict | None:
    """A manifest's tables; None if it is too long or malformed."""
    if len(content.encode()) > limit:
        return None
    try:
        return tomllib.loads(content)
    except tomllib.TOMLDecodeError:
        return None


@dataclass(frozen=True)
class Configuration:
    """A closed document: blocking level, and levels by rule and by category."""

    blocking: str | None = None
    rules: dict[str, str] = field(default_factory=dict)
    categories: dict[str, str] = field(default_factory=dict)


def configuration(content: str) -> Configuration:
    """Validated configuration; ValueError names the first field at fault, never its content."""
    if len(content.encode()) > CONFIG_BYTES:
        raise ValueError("configuration is too long")
    try:
        got = tomllib.loads(content)
    except tomllib.TOMLDecodeError:
        raise ValueError("configuration is not TOML") from None
    if set(got) - {"blocking", "rules", "categories"}:
        raise ValueError("configuration has an unknown field")
    if got.get("blocking") not in (None, *BLOCKING):
        raise ValueError("blocking is not a level")
    for name in ("rules", "categories"):
        table = got.get(name, {})
        if not isinstance(table, dict) or any(v not in LEVELS for v in table.values()):
            raise ValueError(f"{name} has an unknown level")
    return Configuration(got.get("blocking"), got.get("rules", {}), got.get("categories", {}))
