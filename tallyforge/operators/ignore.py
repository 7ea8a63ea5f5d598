"""Ordered ignore rules over paths: the last rule that matches decides, from the outermost folder inwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key of rules that no fixed name narrows down.
ANY = "*"


def rules(lines: DataFrame, line: str = "line", place: str = "place") -> DataFrame:
    """Lines in order as (place, negated, folders, anchored, pattern, regex, key).

    Empty lines and comments say nothing; ! negates, a / at the end means folders, a /
    before it anchors the rule at the root. * and ? don't cross /, ** does. ``key`` is
    what a path must hold for the rule to match at all: the first part of an anchored
    rule, else the whole name or the ending behind its star.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(line), r"\r$", ""), r"(?<!\\) +$", "")
    rows = lines.select(F.col(place).alias("place"), text.alias("t")).where("t <> '' and not startswith(t, '#')")
    rows = rows.withColumn("negated", F.col("t").startswith("!")).withColumn("t", F.regexp_replace("t", r"^(!|\\(?=[!#]))", ""))
    rows = rows.withColumn("folders", F.col("t").endswith("/")).withColumn("t", F.regexp_replace("t", "/$", ""))
    rows = rows.withColumn("anchored", F.col("t").contains("/")).withColumn("pattern", F.regexp_replace("t", "^/", "")).where("pattern <> ''")
    quoted = F.regexp_replace("pattern", r"([.+^${}()|\\])", r"\\$1")
    # Placeholders keep what ** becomes apart from what * becomes.
    many = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"^\*\*/", "\x01"), r"/\*\*/", "/\x01"), r"/\*\*$", "/\x02")
    one = F.regexp_replace(F.regexp_replace(F.regexp_replace(many, r"\*+", "[^/]*"), r"(?<!\\)\?", "[^/]"), r"\[!", "[^")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(one, "\x01", "(?:.*/)?"), "\x02", ".+"), F.lit("$"))
    plain = ~F.col("pattern").rlike(r"[*?\[\\]")
    first = F.substring_index("pattern", "/", 1)
    ending = F.regexp_extract("pattern", r"^\*(\.[^*?\[/\\.]+)$", 1)
    key = F.when(F.col("anchored"), F.when(first.rlike(r"[*?\[\\]"), ANY).otherwise(F.concat(F.lit("/"), first))).when(plain, F.col("pattern")).when(ending != "", ending).otherwise(ANY)
    return rows.select("place", "negated", "folders", "anchored", "pattern", regex.alias("regex"), key.alias("key"))


def _names(path: Column) -> Column:
    """(prefix, name, depth) of a path and of each folder that it stands in."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.struct((i + 1).alias("depth"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/").alias("prefix"), p.alias("name"), (i + 1 < F.size(parts)).alias("folder")))


def ignored(paths: DataFrame, known: DataFrame) -> DataFrame:
    """(path, ignored): whether the rules pass over each path (path, folder: bool), or a folder that it stands in.

    Of the rules that match a name the last decides. What stands in an ignored folder
    is ignored whatever later rules say. Names meet only rules of their keys: their
    own name, its ending, the first part of their path, and those without a key.
    """
    spread = paths.select("path", F.col("folder").alias("_last"), F.explode(_names(F.col("path"))).alias("n"))
    named = spread.select("path", "n.depth", "n.prefix", "n.name", (F.col("n.folder") | F.col("_last")).alias("folder"))
    ending = F.nullif(F.regexp_extract("name", r"(\.[^.]+)$", 1), F.lit(""))
    keys = F.array_distinct(F.array_compact(F.array(F.lit(ANY), F.col("name"), ending, F.concat(F.lit("/"), F.substring_index("prefix", "/", 1)))))
    met = named.withColumn("key", F.explode(keys)).join(known, "key")
    hits = met.where((~F.col("folders") | F.col("folder")) & F.when(F.col("anchored"), F.regexp_like("prefix", F.col("regex"))).otherwise(F.regexp_like("name", F.col("regex"))))
    last = hits.groupBy("path", "depth").agg(F.max_by("negated", "place").alias("negated"))
    verdict = last.groupBy("path").agg(F.bool_or(~F.col("negated")).alias("any"))
    return paths.select("path").distinct().join(verdict, "path", "left").select("path", F.coalesce("any", F.lit(False)).alias("ignored"))
