"""Marks that open and close: levels as running sums, and what holds each mark.

Marks stand in the order of ``pos`` within a unit (a page, a document, an attribute);
``mark`` is 1 where something opens, -1 where it closes and 0 for what does neither.
A unit's marks are ordered in one task, as its text was read by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels that a unit may reach; one that goes deeper is damaged.
DEEPEST = 64
#: Characters of text whose marks one task orders.
CHARS = 4_000_000


def parts_of(texts: DataFrame, text: str) -> int:
    """Parts over which the marks of these texts are dealt, by the texts' length.

    Marks are so alike that they shrink to little when they are sent, so their size
    there tells nothing of what a task holds.
    """
    chars = texts.agg(F.coalesce(F.sum(F.length(text).cast("bigint")), F.lit(0))).first()[0]
    return max(texts.sparkSession.sparkContext.defaultParallelism, chars // CHARS + 1)


def _columns(unit: str | Sequence[str]) -> list[str]:
    return [unit] if isinstance(unit, str) else list(unit)


def levels(marks: DataFrame, unit: str | Sequence[str], parts: int | None = None) -> DataFrame:
    """With ``level``, the marks that are open before this one; a closing one's is that of what it closes.

    Several columns can name a unit; then rows are dealt by the first of them alone.
    """
    units = _columns(unit)
    if parts:
        marks = marks.repartition(parts, units[0])
    before = Window.partitionBy(*units).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.sum("mark").over(before)
    return marks.withColumn("level", (after - F.when(F.col("mark") > 0, 1).otherwise(0)).cast("bigint"))


def holders(leveled: DataFrame, unit: str | Sequence[str], carried: Sequence[str], name: str = "holder") -> DataFrame:
    """With a struct of pos and the carried columns of the innermost mark open here, of a closing mark those of what it closes.

    Of the marks that open at the level above, the last one before is still open: one
    ordering by unit and level finds it, without walking a stack.
    """
    columns = leveled.columns
    offer = F.struct("pos", *carried)
    look = F.when(F.col("mark") < 0, F.col("level")).otherwise(F.col("level") - 1)
    none = F.lit(None).cast(leveled.select(offer.alias("x")).schema["x"].dataType)
    at = lambda key, what: F.struct(key.cast("bigint").alias("_key"), what.alias("_offer"))
    asks = at(look, none)
    # A mark that opens asks and offers; rows are doubled in place, so that what they come from is worked out once.
    doubled = leveled.select("*", F.inline(F.when(F.col("mark") > 0, F.array(asks, at(F.col("level"), offer))).otherwise(F.array(asks))))
    latest = Window.partitionBy(*_columns(unit), "_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = doubled.withColumn(name, F.last("_offer", ignorenulls=True).over(latest))
    return both.where("_offer is null").select(*columns, name)


def sound(leveled: DataFrame, unit: str, deepest: int = DEEPEST) -> DataFrame:
    """The marks of units whose marks all close, none before it opens, and none too deep."""
    whole = Window.partitionBy(unit)
    checked = leveled.select("*", F.sum("mark").over(whole).alias("_left"), F.min("level").over(whole).alias("_low"), F.max("level").over(whole).alias("_high"))
    return checked.where((F.col("_left") == 0) & (F.col("_low") >= 0) & (F.col("_high") < deepest)).drop("_left", "_low", "_high")


def split_arguments(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, argument): a list split at the commas outside of all brackets, without white space and comments.

    What stands in brackets stays in the argument that carries it, texts in quotes
    keep all their characters, a bracket that closes nothing is kept, and empty
    arguments are left out. A null or empty list has no rows.
    """
    token = r'"[^"\\]*(?:\\.[^"\\]*)*"|//[^\n]*|/\*(?s:.*?)\*/|[(\[{]|[)\]}]|,|[^\s"(){}\[\],/]+|["/]'
    tokens = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(token), F.lit(0))).alias("pos", "token"))
    tokens = tokens.where(~F.col("token").rlike(r"^(//|/\*)"))
    mark = F.when(F.col("token").isin("(", "[", "{"), 1).when(F.col("token").isin(")", "]", "}"), -1).otherwise(0)
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = tokens.withColumn("sum", F.sum(mark).over(order))
    depth = F.col("sum") - F.least(F.min("sum").over(order), F.lit(0))  # a stray closing bracket doesn't count
    cut = ((F.col("token") == ",") & (depth == 0)).cast("int")
    parts = summed.withColumn("cut", cut).withColumn("part", F.sum("cut").over(order)).where("cut = 0")
    joined = parts.groupBy(key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("argument"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("part"))
    return joined.select(key, place.alias("place"), "argument")
