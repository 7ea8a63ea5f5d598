"""Checks between tables: what one declares and another uses, and what disagrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import context_of_path
from .ordered import placed, ranked

# Entries that a walk looks at, files that it takes, a folder that it leaves.
WALK, SOURCE, BUILD_FOLDER = 20_000, ".rs", "target"
# End of the fixed values.


def unreferenced(declared: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    return declared.join(used.select(*on), on, "left_anti")


def unknown(references: DataFrame, declared: DataFrame, on: list[str]) -> DataFrame:
    return references.join(declared.select(*on), on, "left_anti")


def several(rows: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """Keys with several values: their number, and the values in order."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n"), F.concat_ws(", ", F.array_sort(F.collect_set(F.col(value).cast("string")))).alias("listed")).where(F.col("n") >= least)


def flags(rows: DataFrame, key: list[str], **conditions: Column) -> DataFrame:
    """Whether any row of a key meets each condition."""
    return rows.groupBy(*key).agg(*[F.bool_or(c).alias(name) for name, c in conditions.items()])


def compare(published: DataFrame, recomputed: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of either side whose values differ, or that the other side lacks."""
    p = published.select(key, F.col(value).alias("published"))
    r = recomputed.select(key, F.col(value).alias("recomputed"))
    return p.join(r, key, "full_outer").where(~F.col("published").eqNullSafe(F.col("recomputed")))


def order_defects(rows: DataFrame, partition: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value isn't above that of the row before."""
    before = F.lag(value).over(Window.partitionBy(partition).orderBy(*order))
    return rows.withColumn("before", before).where(F.col("before") >= F.col(value))


def representative(rows: DataFrame, key: str, located: Column, order: list[str]) -> DataFrame:
    """The first row of each key that has a location, else its first."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(located.isNull(), *order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def closure(roots: DataFrame, edges: DataFrame, depth: int = 64) -> DataFrame:
    """(node, gated): nodes reachable from ``roots`` (node, gated) by ``edges`` (parent, child, gated).

    A node is gated if every path to it is; the gate of an edge is inherited. The
    frontier only holds what changed, and the rounds are bounded by ``depth``.
    """
    from .graph import settle

    seen = settle(roots.groupBy("node").agg(F.bool_and("gated").alias("gated")))
    frontier = seen
    for _ in range(depth):
        nxt = frontier.alias("f").join(edges.alias("e"), F.col("f.node") == F.col("e.parent")).groupBy(F.col("e.child").alias("node")).agg(F.bool_and(F.col("f.gated") | F.col("e.gated")).alias("gated"))
        fresh = settle(nxt.alias("n").join(seen.alias("s"), "node", "left").where(F.col("s.gated").isNull() | (F.col("s.gated") & ~F.col("n.gated"))).select("node", F.col("n.gated").alias("gated")))
        if fresh.isEmpty():
            return seen
        seen = settle(seen.unionByName(fresh).groupBy("node").agg(F.bool_and("gated").alias("gated")))
        frontier = fresh
    raise RuntimeError(f"deeper than {depth}")


def dependency_truth(declared: DataFrame, references: DataFrame) -> DataFrame:
    """Declared dependencies (package, name) that nothing references, or only tests do.

    ``references`` has package, name (with underscores), production, test.
    """
    used = references.groupBy("package", F.col("name").alias("_name")).agg(F.bool_or("production").alias("production"), F.bool_or("test").alias("test"))
    both = declared.withColumn("_name", F.translate("name", "-", "_")).join(used, ["package", "_name"], "left")
    verdict = F.when(F.col("production"), None).when(F.col("test"), "test_only").otherwise("unused")
    return both.select("package", "name", verdict.alias("verdict")).where("verdict is not null")


def stacked(attributes: DataFrame, key: str, lints: str, least: int = 2, wide: int = 4) -> DataFrame:
    """Items with several suppressions, or one that is wide: (key, attributes, widest, all lints in order)."""
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list(lints))))
    found = attributes.groupBy(key).agg(F.count("*").alias("attributes"), F.max(F.size(lints)).alias("widest"), F.array_join(merged, ", ").alias("lints"))
    return found.where((F.col("attributes") >= least) | (F.col("widest") >= wide))


def shared_aliases(aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """Aliases (package, alias, target) that all packages have with the same target."""
    n = packages.select("package").distinct().agg(F.count("*").alias("_n"))
    kept = aliases.join(packages, "package", "left_semi").groupBy("alias").agg(F.count_distinct("package").alias("_has"), F.count_distinct("target").alias("_targets"), F.min("target").alias("target"))
    return kept.join(F.broadcast(n), F.col("_has") == F.col("_n")).where("_targets = 1").select("alias", "target")  # n is one row


def enrolment(plans: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Scopes whose plan and number of judged sites disagree, and why."""
    both = plans.select(key, "target").join(judged.groupBy(key).agg(F.count("*").alias("judged")), key, "full_outer")
    why = F.when(F.col("target").isNull(), "no plan").when(F.col("judged").isNull(), "not judged").when(F.col("judged") < F.col("target"), "too few").when(F.col("judged") > F.col("target"), "too many")
    return both.select(key, why.alias("defect")).where("defect is not null")


def orphans(files: DataFrame, compiled: DataFrame, included: DataFrame, scripted: DataFrame, unit: str, most: int = WALK) -> DataFrame:
    """(unit, path, context): source files on disk that nothing compiles, includes or names.

    ``files`` have path and generated, all in ``unit``; ``compiled`` and ``included``
    unit and path, ``scripted`` unit and name (a script names files by their base name).
    Only the first ``most`` entries of a unit by path are looked at. Hidden entries,
    what lies below a hidden or a build folder and files of other languages count
    as looked at, but are no sources; a generated one is nobody's. Null paths are left
    out, repeated ones count once. Large units are ranked over ranges.
    """
    own = files.where("path is not null").groupBy(unit, "path").agg(F.bool_or(F.coalesce("generated", F.lit(False))).alias("generated"))
    parts = F.split("path", "/")
    away = F.exists(parts, lambda x: x.startswith(".")) | F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), BUILD_FOLDER)
    seen = ranked(own, [unit], ["path"], "_entry").where(F.col("_entry") < most).where(F.col("path").endswith(SOURCE) & ~away & ~F.col("generated"))
    left = seen.join(compiled.select(unit, "path").unionByName(included.select(unit, "path")), [unit, "path"], "left_anti")
    named = left.withColumn("name", F.element_at(parts, -1)).join(scripted.select(unit, "name"), [unit, "name"], "left_anti")
    return named.select(unit, "path", context_of_path(F.col("path")).alias("context"))


def queue(universe: DataFrame, decided: DataFrame, key: str, level: str) -> DataFrame:
    """(key, level, place): what isn't decided and isn't denied anyway, warned ones first, then by key.

    A null level isn't denied and comes with the others; equal rows of the universe count once.
    """
    left = universe.select(key, level).distinct().join(decided.select(key), key, "left_anti").where(~F.coalesce(F.col(level) == "deny", F.lit(False)))
    late = (~F.coalesce(F.col(level) == "warn", F.lit(False))).cast("int")
    return placed(left.withColumn("_late", late), [], ["_late", key, level]).select(key, level, "place")
