"""What the training-data operators share: inputs, bounded batches, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once in a Python worker; a longer text forms a batch of its own.
BATCH_CHARS = 4_000_000
#: Rows of one Arrow batch. With the cluster's default of 10,000 a run of long texts could outgrow a worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for workers that hold long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share and which outlives executors.

    Only a session on one machine that names none gets a temporary one; a cluster
    without the setting is refused, as its executors would write to their own disks.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, which outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: smaller than a checkpoint, and read by column."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(texts: Sequence[str | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` characters together (one text at least)."""
    lo = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable], schema: str, extra: Sequence[str] = ()) -> DataFrame:
    """One pass over (id, text, *extra) in bounded batches, without a shuffle.

    ``make`` is called once a task and gives ``fn(ids, texts, *extras)``, which
    returns the columns of ``schema`` in order; null texts arrive as empty ones.
    Only the named columns are read, so further columns can have any name.
    """
    bounded_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)])
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        fn, arrow = make(), to_arrow_schema(target)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for lo, hi in pieces(columns[1]):
                out = fn(columns[0][lo:hi], [t or "" for t in columns[1][lo:hi]], *[c[lo:hi] for c in columns[2:]])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return source.mapInArrow(run, target)


def map_rows(df: DataFrame, text_col: str, make: Callable[[], Callable]) -> DataFrame:
    """One pass over whole rows: ``fn(texts)`` gives (keep mask, new texts or None); all columns stay."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        fn = make()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for lo, hi in pieces(texts):
                part = batch.slice(lo, hi - lo)
                keep, new = fn([t or "" for t in texts[lo:hi]])
                if new is not None:
                    part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int, keep=None) -> list:
    """At most ``limit`` labelled rows, whole texts, chosen by a hash of the id; ordered by id.

    The rows are chosen among the labels alone, so that no text is sorted; a
    document labelled twice counts once, with its largest labels.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    if keep is not None:
        marks = marks.where(keep(F.col("_id")))
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_text", "quality", "toxic").collect()
    return sorted(rows, key=lambda r: (r[0], r[1]))
