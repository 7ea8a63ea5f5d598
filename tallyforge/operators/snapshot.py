"""Versions of a table as manifests: written, validated, and compared by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Entries, bytes of one and of all, and bytes of a path.
ENTRIES, ENTRY_BYTES, TOTAL_BYTES, PATH_BYTES = 100_000, 64 * 1024 * 1024, 1024 * 1024 * 1024, 4096
# End of the fixed values.


def manifest(rows: DataFrame, path: str, text: str) -> DataFrame:
    """(path, digest, size): each row's content by its digest, a null one as empty."""
    content = F.coalesce(F.col(text), F.lit(""))
    return rows.select(F.col(path).cast("string").alias("path"), F.sha2(content, 256).alias("digest"), F.octet_length(content).cast("bigint").alias("size"))


def write_version(entries: DataFrame, folder: str, version: int) -> None:
    """A version is written once; an existing one is never replaced."""
    entries.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/version={version}")


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/version={version}")


def defects(entries: DataFrame, limits: tuple[int, int, int] = (ENTRIES, ENTRY_BYTES, TOTAL_BYTES)) -> DataFrame:
    """(path, defect): entries that make an inventory unusable, and one row without a path for each limit of the whole.

    A path has to be relative, not empty and without empty, . or .. parts; a digest 40
    or 64 hexadecimal digits; no path may stand there twice.
    """
    most, one, total = limits
    parts = F.split("path", "/")
    bad_path = F.col("path").isNull() | (F.octet_length("path") > PATH_BYTES) | F.exists(parts, lambda p: p.isin("", ".", ".."))
    twice = entries.where("path is not null").groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("entry-invalid: twice").alias("defect"))
    own = F.when(bad_path, "entry-invalid: path").when(~F.coalesce(F.col("digest").rlike("^([0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"), F.lit(False)), "entry-invalid: digest").when(F.col("size").isNull() | (F.col("size") < 0), "inventory-failed: size").when(F.col("size") > one, "limit-exceeded: entry")
    single = entries.select("path", own.alias("defect")).where("defect is not null")
    sums = entries.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    over = sums.select(F.explode(F.array(F.when(F.col("n") > most, "limit-exceeded: entries"), F.when(F.col("bytes") > total, "limit-exceeded: bytes"))).alias("defect")).where("defect is not null")
    return single.unionByName(twice).unionByName(over.select(F.lit(None).cast("string").alias("path"), "defect"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): added, changed, gone, same, or inconsistent (equal digests with different sizes), by one full outer join."""
    o, n = old.select("path", F.col("digest").alias("od"), F.col("size").alias("os")), new.select("path", F.col("digest").alias("nd"), F.col("size").alias("ns"))
    state = F.when(F.col("od").isNull(), "added").when(F.col("nd").isNull(), "gone").when((F.col("od") == F.col("nd")) & (F.col("os") != F.col("ns")), "inconsistent").when(F.col("od") == F.col("nd"), "same").otherwise("changed")
    return o.join(n, "path", "full_outer").select("path", state.alias("state"))


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """(before, path): gone entries whose content was added elsewhere, each with the first such path; content seen once on both sides."""
    states = compare(old, new)
    gone = old.join(states.where("state = 'gone'"), "path", "left_semi").groupBy("digest").agg(F.min("path").alias("before"), F.count("*").alias("n")).where("n = 1").drop("n")
    added = new.join(states.where("state = 'added'"), "path", "left_semi").groupBy("digest").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1").drop("n")
    return gone.join(added, "digest").select("before", "path")


def latest(entries: DataFrame, version: str = "version") -> DataFrame:
    """The entry of the highest version of each path."""
    at = F.row_number().over(Window.partitionBy("path").orderBy(F.col(version).desc(), F.col("digest")))
    return entries.withColumn("_at", at).where("_at = 1").drop("_at")
