"""Connected components over links, and cutting of lineages."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine a temporary one if none is set, on a cluster an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _remove(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # the session's end may have come first
        gone = jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(conf).delete(gone, True)


_seen: set[str] = set()


def settle(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder and read again: worked out once, without their lineage.

    An application's tables lie in a folder of its own, which goes when its driver
    ends; ``release`` removes one earlier.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/settled-{spark.sparkContext.applicationId}"
    if folder not in _seen:
        _seen.add(folder)
        atexit.register(_remove, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._settled = path
    return found


def release(df: DataFrame) -> None:
    """Remove a settled table that nothing reads any more."""
    spark = df.sparkSession
    _remove(spark._jvm, spark._jsc.hadoopConfiguration(), df._settled)


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by label passing with pointer jumping."""
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("now")).select("node", "now", F.col("node").alias("root")))
    for _ in range(rounds):
        # The labels of the last round are the roots that this one starts from.
        before, labels = labels, labels.select("node", F.col("now").alias("root"))
        offered = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(offered, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("next"), "root")
        jump = step.join(labels.select(F.col("node").alias("n2"), F.col("root").alias("r2")), F.col("next") == F.col("n2"), "left")
        labels = settle(jump.select("node", F.least("next", F.coalesce("r2", "next")).alias("now"), "root"))
        release(before)
        if labels.where("now <> root").isEmpty():
            return labels.select("node", F.col("now").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
