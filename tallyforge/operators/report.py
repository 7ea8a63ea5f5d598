"""Reports: invariants that refuse to write, sinks, and texts for hand-off."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_bytes, rule_title

# Limits of a hand-off and of a frame.
GROUPS, LOCATIONS, SITES, PROMPT_BYTES, FRAME_BEFORE, FRAME_LINES, LINE_BYTES = 3, 24, 8, 12 * 1024, 2, 5, 8192
# End of the fixed values.
HAND_OFF = "Repair the findings that weigh most, leave all else as it is, and scan again."
#: Parts of a group that offer their first sites.
PARTS = 64


def title(rule: Column) -> Column:
    return rule_title(rule)


def check(summary: DataFrame, details: DataFrame, key: str, counted: str) -> None:
    """Raise if a report's counts are not those of its details."""
    own = details.groupBy(key).agg(F.count("*").alias("_n"))
    wrong = summary.join(own, key, "full_outer").where(~F.coalesce(F.col(counted), F.lit(0)).eqNullSafe(F.coalesce("_n", F.lit(0))))
    if not wrong.isEmpty():
        raise ValueError("report-invariant: counts differ from the findings")


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_catalog(rules: DataFrame, path: str, tsv: bool = False) -> None:
    (rules.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path) if tsv else rules.write.mode("overwrite").json(path))


def code_frame(rows: DataFrame, key: list[str], text: str = "text", line: str = "line") -> DataFrame:
    """(key, number, content): the lines around each row's line, from two before it, five at most.

    A line loses its carriage return and is cut to a bounded number of bytes at a
    character. A frame with a null character shows nothing. The lines are taken out of
    the row's own text, so that none is joined or spread.
    """
    lines = F.split(text, "\n")
    first = F.greatest(F.col(line) - FRAME_BEFORE, F.lit(1)).cast("int")
    shown = rows.select(*key, first.alias("_first"), F.slice(lines, first, F.lit(FRAME_LINES)).alias("_shown"))
    safe = shown.where(~F.exists("_shown", lambda x: F.contains(x, F.lit("\x00"))))
    each = safe.select(*key, "_first", F.posexplode("_shown").alias("_at", "content"))
    return each.select(*key, (F.col("_first") + F.col("_at")).alias("number"), first_bytes(F.regexp_replace("content", "\r$", ""), LINE_BYTES).alias("content"))


def hand_off(units: DataFrame, groups: DataFrame, sites: DataFrame, unit: str, most: int = PROMPT_BYTES) -> DataFrame:
    """(unit, body, refused): the text that hands each unit's first groups on, within a budget of bytes.

    ``units`` have audit and rescan (lines as they are), ``groups`` place (from 1),
    rule, severity, occurrences and help, ``sites`` rule, at (their order), path, line
    and column. The first three groups are told, with 24 sites in all. Lines are taken
    while they fit; ``refused`` says why the text isn't all of it: payload-too-large,
    or unsafe-payload where a line has control characters or a rule others than its
    own. Each part of a group offers its first sites, so that no task orders them all.
    """
    told = groups.where(F.col("place") <= GROUPS)
    heading = F.format_string("%d. %s (%s, %d occurrences)", "place", "rule", "severity", "occurrences")
    unsafe = ~F.col("rule").rlike("^[A-Za-z0-9:_.-]+$")
    heads = told.select(unit, F.col("place").alias("g"), F.lit(0).alias("k"), F.lit(0).alias("n"), heading.alias("text"), unsafe.alias("unsafe"))
    helps = told.where("help is not null").select(unit, F.col("place").alias("g"), F.lit(1).alias("k"), F.lit(0).alias("n"), F.concat(F.lit("   Help: "), "help").alias("text"), F.lit(False).alias("unsafe"))
    own = sites.join(told.select(unit, "rule", "place"), [unit, "rule"])
    site = F.struct("at", "path", "line", "column")
    parted = own.select(unit, "place", F.pmod(F.xxhash64(site), F.lit(PARTS)).alias("part"), site.alias("site"))
    first = parted.withColumn("n", F.row_number().over(Window.partitionBy(unit, "place", "part").orderBy("site"))).where(F.col("n") <= LOCATIONS)
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(unit, "place").orderBy("site"))).where(F.col("n") <= LOCATIONS)
    counted = ranked.withColumn("all", F.row_number().over(Window.partitionBy(unit).orderBy("place", "n"))).where(F.col("all") <= LOCATIONS)
    place = F.format_string("   - %s:%d:%d", "site.path", F.greatest("site.line", F.lit(1)), F.greatest("site.column", F.lit(1)))
    listed = counted.select(unit, F.col("place").alias("g"), F.lit(2).alias("k"), "n", place.alias("text"), F.lit(False).alias("unsafe"))
    fixed = [(0, 0, F.lit(HAND_OFF)), (0, 1, F.col("audit")), (GROUPS + 1, 0, F.concat(F.lit("Validate with: "), "rescan"))]
    edges = [units.select(unit, F.lit(g).alias("g"), F.lit(k).alias("k"), F.lit(0).alias("n"), t.alias("text"), F.lit(False).alias("unsafe")) for g, k, t in fixed]
    every = reduce(DataFrame.unionByName, [*edges, heads, helps, listed])
    order = Window.partitionBy(unit).orderBy("g", "k", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bad = F.col("unsafe") | F.col("text").rlike(r"\p{Cc}")
    # The first line that can't be taken ends the text.
    rows = every.withColumns({"bytes": F.sum(F.octet_length("text") + 1).over(order), "spoilt": F.max(bad.cast("int")).over(order)})
    rows = rows.withColumn("taken", (F.col("bytes") <= most) & (F.col("spoilt") == 0))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("taken"), F.struct("g", "k", "n", "text")))), lambda x: F.concat(x["text"], F.lit("\n")))
    # What stopped the text is the first line that wasn't taken.
    why = F.min(F.when(~F.col("taken"), F.struct("g", "k", "n", F.when(F.col("spoilt") == 1, "unsafe-payload").otherwise("payload-too-large").alias("why"))))
    return rows.groupBy(unit).agg(F.array_join(lines, "").alias("body"), why["why"].alias("refused"))
