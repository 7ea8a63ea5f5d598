"""Element trees of pages as node tables: nodes, complexity, and hashes of subtrees."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle
from .nesting import DEEPEST, holders, levels, parts_of, sound

# Bounds from which a unit is complex, and elements of HTML that have no end or may do without, or stand within a line.
CYCLOMATIC, COGNITIVE = 20, 25
ENDLESS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "p", "li", "dt", "dd", "option", "optgroup", "tr", "td", "th", "thead", "tbody", "tfoot", "colgroup", "caption", "b", "i", "em", "strong", "u", "small", "font", "span", "script", "style")
# End of the fixed values.
TAG = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|</?[a-z][^<>]*>"


def tag_marks(pages: DataFrame, unit: str, html: str) -> DataFrame:
    """(unit, pos, tag, mark): tags in order; comments, and what stands in scripts and styles, are passed over."""
    names = F.transform(F.regexp_extract_all(html, F.lit(TAG), F.lit(0)), lambda t: F.lower(F.regexp_extract(t, r"^<(/?[a-zA-Z][a-zA-Z0-9]*)", 1)))
    rows = pages.select(unit, F.posexplode(names).alias("pos", "name")).where("name <> ''")
    tag = F.regexp_replace("name", "^/", "")
    closes = F.col("name").startswith("/")
    mark = F.when(tag.isin(*ENDLESS), 0).when(closes, -1).otherwise(1)
    return rows.where(~(closes & tag.isin(*ENDLESS))).select(unit, "pos", tag.alias("tag"), mark.alias("mark"))


def page_nodes(pages: DataFrame, unit: str = "page_id", html: str = "html", deepest: int = DEEPEST) -> DataFrame:
    """(unit, node, parent, depth, tag): the elements of each page that can be read.

    A page where an element isn't closed, an end has no begin, or elements nest too
    deep is damaged and left out whole, as what stands in it is a guess. An element
    without an end has no children. ``node`` is the place of its tag.
    """
    marks = levels(tag_marks(pages, unit, html), unit, parts_of(pages, html))
    placed = holders(sound(marks, unit, deepest), unit, []).where("mark >= 0")
    return placed.select(unit, F.col("pos").alias("node"), F.col("holder.pos").alias("parent"), F.col("level").alias("depth"), "tag")


def complexity(marks: DataFrame, unit: str, kinds: Mapping[str, str]) -> DataFrame:
    """(unit, cyclomatic, cognitive, complex_function) of marks with a ``tag``; ``kinds`` says what a tag does.

    branch: a path, costs 1 and its nesting, deepens; one right inside another branch
    costs 1 and doesn't deepen. loop: the same, never chained. choice: costs 1 and its
    nesting, deepens, adds no path. arm, try: a path. closure: deepens. jump: costs 1.
    logic: a path, and costs 1 unless it stands right inside the same tag.
    """
    kind = F.lit("none")
    for tag, name in kinds.items():
        kind = F.when(F.col("tag") == tag, name).otherwise(kind)
    known = levels(marks.withColumn("kind", kind), unit)
    held = holders(known, unit, ["kind", "tag"])
    chained = (F.col("kind") == "branch") & F.coalesce(F.col("holder.kind") == "branch", F.lit(False))
    deepens = F.when(F.col("mark") > 0, (F.col("kind").isin("loop", "choice", "closure") | ((F.col("kind") == "branch") & ~chained)).cast("int")).otherwise(0)
    known = held.withColumns({"chained": chained, "deepens": deepens, "same": F.coalesce(F.col("holder.tag") == F.col("tag"), F.lit(False))}).drop("holder")
    # What a mark closes has told whether it deepened.
    closed = holders(known, unit, ["deepens"], "opened")
    step = F.when(F.col("mark") < 0, -F.coalesce(F.col("opened.deepens"), F.lit(0))).otherwise(F.col("deepens"))
    order = Window.partitionBy(unit).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = closed.withColumn("nesting", F.sum(step).over(order) - F.col("deepens")).where("mark >= 0")
    k = F.col("kind")
    paths = k.isin("branch", "loop", "arm", "try", "logic").cast("int")
    cost = F.when(k.isin("branch", "loop", "choice"), 1 + F.when(F.col("chained"), 0).otherwise(F.col("nesting"))).when(k == "jump", 1).when((k == "logic") & ~F.col("same"), 1).otherwise(0)
    found = rows.groupBy(unit).agg((F.sum(paths) + 1).alias("cyclomatic"), F.sum(cost).alias("cognitive"))
    return found.withColumn("complex_function", is_complex(F.col("cyclomatic"), F.col("cognitive")))


def is_complex(cyclomatic: Column, cognitive: Column) -> Column:
    return (cyclomatic >= CYCLOMATIC) | (cognitive >= COGNITIVE)


def subtree_hashes(nodes: DataFrame, unit: str) -> DataFrame:
    """(unit, node, depth, hash): a hash of each node's tag and of its children's hashes in order.

    The deepest level is hashed first; each level above groups the one below by
    parent. There are at most ``DEEPEST`` levels.
    """
    nodes = settle(nodes)
    deepest = nodes.agg(F.max("depth")).first()[0]
    below = found = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = nodes.where(F.col("depth") == depth)
        if below is None:
            kids = F.array().cast("array<bigint>")
        else:
            grouped = below.groupBy(unit, F.col("parent").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]).alias("kids"))
            here = here.join(grouped, [unit, "node"], "left")
            kids = F.coalesce("kids", F.array().cast("array<bigint>"))
        below = settle(here.select(unit, "node", "parent", "depth", F.xxhash64("tag", kids).alias("hash")))
        found = below if found is None else found.unionByName(below)
    if found is None:
        found = nodes.select(unit, "node", "parent", "depth", F.lit(0).cast("bigint").alias("hash"))
    return found.select(unit, "node", "depth", "hash")


def bags(hashes: DataFrame, unit: str, least: int) -> DataFrame:
    """(doc_id, token, cnt): the multiset of subtree hashes of each unit of at least so many nodes."""
    large = hashes.groupBy(unit).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(unit)
    counted = hashes.groupBy(unit, F.col("hash").alias("token")).agg(F.count("*").alias("cnt"))
    return counted.join(large, unit, "left_semi").withColumnRenamed(unit, "doc_id")
