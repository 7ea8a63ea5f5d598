"""Message streams as they arrive: the same classification on a stream of files.

Stateless, so batch and stream give the same rows; counts by kind keep a state of
six rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import messages

#: Messages of one stream beyond which its reader stops.
MOST = 100_000


def read_lines(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """(value): lines of the text files that appear in a folder, so many files a trigger at most."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(folder)


def classified(lines: DataFrame) -> DataFrame:
    return lines.select(messages.classify(F.col("value")).alias("kind"), "value")


def counts(lines: DataFrame) -> DataFrame:
    """Lines by kind; start it in complete or update mode."""
    return classified(lines).groupBy("kind").agg(F.count("*").alias("lines"))


def findings(lines: DataFrame) -> DataFrame:
    return messages.findings(lines)
