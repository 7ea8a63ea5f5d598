"""Names that a package declares and its files read: declared but unread, read but undeclared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The feature that is always read, marks of entries that name none.
ALWAYS, ELSEWHERE, DEPENDENCY = "default", "/", "dep:"
# End of the fixed values.


def unread(declared: DataFrame, read: DataFrame, optional: DataFrame) -> DataFrame:
    """(package, feature): what is declared, does nothing and is read by nobody.

    ``declared`` has package, feature and activates (array of entries), ``read``
    feature and packages (array: those that compile the place), ``optional`` package
    and feature (optional dependencies, which have a feature of their name). A feature
    is read by a place of its own package, by another feature's list, or by who
    activates a dependency. A null or empty list activates nothing; repeats count once.
    """
    entries = declared.select("package", F.explode("activates").alias("feature"))
    listed = entries.where(~F.contains("feature", F.lit(ELSEWHERE)) & ~F.startswith("feature", F.lit(DEPENDENCY)))
    places = read.select(F.explode("packages").alias("package"), "feature")
    readers = listed.unionByName(places).unionByName(optional.select("package", "feature")).withColumn("_idle", F.lit(0))
    idle = F.coalesce(F.size("activates"), F.lit(0)) <= 0
    own = declared.select("package", "feature", F.when(idle & (F.col("feature") != ALWAYS), 1).otherwise(0).alias("_idle")).withColumn("_own", F.lit(True))
    # One grouping tells all: a name with a declaration, none of them with an effect, and no reader.
    told = own.unionByName(readers.withColumn("_own", F.lit(False))).groupBy("package", "feature").agg(F.min("_idle").alias("_idle"), F.bool_or("_own").alias("_own"))
    return told.where("_own and _idle = 1").select("package", "feature")


def undeclared(read: DataFrame, declared: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``read`` (``key``, feature, packages) that no package which compiles them declares.

    A place that no package compiles is left out; so is a null feature. ``key`` tells
    places apart; equal rows are told once.
    """
    named = declared.select("package", "feature").distinct().withColumn("_known", F.lit(True))
    each = read.where(F.col("feature").isNotNull()).select(*key, "feature", F.explode("packages").alias("package"))
    met = each.join(named, ["package", "feature"], "left")
    return met.groupBy(*key, "feature").agg(F.bool_or(F.coalesce("_known", F.lit(False))).alias("_known")).where("not _known").drop("_known")
