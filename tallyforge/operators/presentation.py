"""How findings are laid out for a reader: families with their anchor, lists by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranked

# Categories in the order they are shown.
CATEGORIES = ["Security", "Bugs", "Performance", "Dependencies", "Maintainability", "Other"]
# End of the fixed values.


def family_members(members: DataFrame, key: list[str], order: list[str], context: str = "context") -> DataFrame:
    """Each family's distinct members in order: ``place`` 0 is its anchor, the others are related to it.

    With each member go the family's number of members (``occurrences``) and its
    context, which it has only if all members have the same one. Members are equal if
    they are in ``key``, ``order`` and context; null keys are a family. No family is
    gathered: a large one is ranked over ranges.
    """
    own = members.select(*key, *order, context).distinct()
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    one = (F.count(context) == F.count("*")) & (F.min(context) == F.max(context))
    whole = own.groupBy(*named).agg(F.count("*").alias("occurrences"), F.when(one, F.min(context)).alias("family_context"))
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked(own, key, [*order, context]).join(whole, same).drop(*[f"_k{i}" for i in range(len(key))])


def interactive(groups: DataFrame, unit: str, category: str = "category", place: str = "place") -> DataFrame:
    """(unit, position, category, place): the groups of each unit's report below a heading for each category.

    Headings have no place. Categories come in their fixed order, those without groups
    are left out, groups keep the order of ``place``; a null or unknown category is
    the last one. A unit has as many groups as there are rules.
    """
    shown = F.array(*[F.lit(c) for c in CATEGORIES])
    rank = F.array_position(shown, F.col(category))
    items = groups.select(unit, F.when(rank > 0, rank).otherwise(len(CATEGORIES)).cast("int").alias("_rank"), F.col(place).alias("place"))
    rows = items.unionByName(items.select(unit, "_rank").distinct().withColumn("place", F.lit(None).cast("bigint")))
    position = F.row_number().over(Window.partitionBy(unit).orderBy("_rank", F.asc_nulls_first("place")))
    return rows.select(unit, position.cast("bigint").alias("position"), F.element_at(shown, F.col("_rank")).alias("category"), "place")
