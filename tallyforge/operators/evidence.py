"""Evidence of findings from a table of files, within the budgets of a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PROOF_BYTES, proof_words
from .ordered import placed, spend

# Rows of a side, bytes of a file, and bytes of all files and of all proofs that a comparison reads.
SIDE_ROWS, FILE_BYTES, SOURCE_BYTES, ALL_PROOF_BYTES = 50_000, 8 * 1024 * 1024, 64 * 1024 * 1024, 64 * 1024 * 1024
# End of the fixed values.


def readable(files: DataFrame, group: str, order: str, size: str, file_bytes: int = FILE_BYTES, budget: int = SOURCE_BYTES, rows: int = SIDE_ROWS) -> DataFrame:
    """Files (group, order, size) with ``outcome``: read, too large, over budget, or refused with its whole group.

    A group of more rows than a side may have is refused. Files are read in order
    while the budget lasts; one that doesn't fit is passed over, later ones can fit.
    """
    n = files.groupBy(group).agg(F.count("*").alias("_rows"))
    judged = placed(files.select(group, order, size), [group], [order]).join(n, group)
    fair = (F.col("_rows") <= rows) & (F.col(size) <= file_bytes)
    spent = spend(judged.where(fair), [group], "place", size, budget)
    kept = spent.select(group, order, F.when(F.col("within"), "read").otherwise("over budget").alias("outcome"))
    out = judged.where(~fair).select(group, order, F.when(F.col("_rows") > rows, "refused").otherwise("too large").alias("outcome"))
    return kept.unionByName(out)


def refuse_large(*sides: DataFrame, rows: int = SIDE_ROWS) -> None:
    """Raise if a side of a comparison has more rows than the limit; no more than that are counted."""
    for side in sides:
        if side.limit(rows + 1).count() > rows:
            raise ValueError(f"delta-limit-exceeded: a side has more than {rows} findings")


def proofs(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(id, proof): what each candidate's span shows, white space as single blanks; null where it can't be shown.

    Candidates have id, path, line_start, column_start, line_end and column_end (from
    1, in characters, end exclusive; a line owns its end, so the column behind its last
    character is one of it). Files have path and text. The text is cut into lines
    once, and each candidate asks for the lines that it covers by path and number: a
    join of equals. A span that covers more lines than a proof has bytes is refused
    before its lines are asked for.
    """
    sane = (F.col("line_start") >= 1) & (F.col("column_start") >= 1) & (F.col("line_end") >= F.col("line_start")) & (F.col("column_end") >= 1) & (F.col("line_end") - F.col("line_start") <= PROOF_BYTES)
    asked = candidates.where(sane).withColumn("number", F.explode(F.sequence("line_start", "line_end")))
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("path", (F.col("at") + 1).cast("bigint").alias("number"), "line")
    met = asked.join(lines, ["path", "number"])
    first, last = F.col("number") == F.col("line_start"), F.col("number") == F.col("line_end")
    begin = F.when(first, F.col("column_start")).otherwise(1)
    width = F.length("line")
    stop = F.when(last, F.col("column_end")).otherwise(width + 1)
    reaches = (begin <= width + 1) & (stop <= width + 1)
    shown = F.substr("line", begin.cast("int"), F.greatest(stop - begin, F.lit(0)).cast("int"))
    parts = met.select("id", "line_start", "line_end", "number", (begin > stop).alias("back"), F.when(reaches, shown).alias("shown"))
    whole = F.array_sort(F.collect_list(F.struct("number", "shown")))
    joined = parts.groupBy("id", "line_start", "line_end").agg(F.count("shown").alias("n"), F.bool_or("back").alias("back"), F.array_join(F.transform(whole, lambda x: x["shown"]), "\n").alias("raw"))
    complete = (F.col("n") == F.col("line_end") - F.col("line_start") + 1) & ~F.col("back")
    found = joined.where(complete).select("id", proof_words(F.col("raw")).alias("proof"))
    return candidates.select("id").join(found, "id", "left")
