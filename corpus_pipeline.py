"""Documents to packed training sequences, stage by stage.

Every stage takes all rows that the one before kept, and gives back all columns of
``documents``, but for the last. Null texts are treated as empty ones and stay null
where a stage leaves them; rows without an id, repeated rows and further columns are
carried along as each stage's operator says; an empty table gives empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontaminate, packing, quality, secrets, simhash
from tallyforge.llm.common import shared_folder, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a usable grade is too low go.

    Null and empty texts are graded alike, equal texts too; repeated rows stay or go
    together. Without labels, or with those of one kind only, all documents stay.
    """
    return quality.keep_accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Null, empty and blank texts are copies of each other; of rows with the same id one
    stays; rows without an id stay.
    """
    return simhash.keep_first(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Null and empty texts hold none, null and empty items are held by none; without
    items all documents stay; repeated rows stay or go together.
    """
    return decontaminate.keep_clean(docs, decontaminate.train(docs, table(spark, sf_dir, "benchmark")))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; ``n_chars`` follows the text.

    Null texts stay null, with a null size; all rows stay.
    """
    clean = secrets.redact_rows(docs, secrets.train(docs))
    return secrets.with_sizes(clean)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null or empty text is its end alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("secrets", stage_secrets),
    ("packing", stage_packing),
]
#: The stages fit models and pack tokens, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again.

    A stage's table is removed once the next one is written; the last one stays, as
    the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            gone = spark._jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        before = path
    return docs
