"""What several corpus operators share: cutting lineage, holding out rows, picking bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import importable
from quern.sources.tables import shared_dir

#: Bounds of one Arrow batch handed to Python, in rows and in bytes: many short texts or few long ones. A single longer text is a batch of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ready(spark: SparkSession) -> SparkSession:
    """What operators that run Python need: workers can import this package, batches are small.

    Results are evaluated after an operator has returned, so the bounds stay in the session; a bound that the session already has is left alone.
    """
    importable(spark)
    have = spark.conf.getAll
    for key, bound in BATCH.items():
        if key not in have:
            spark.conf.set(key, bound)
    return spark


def packed(documents: DataFrame) -> DataFrame:
    """One column ``row`` that holds the caller's columns, so that an operator's own names cannot clash with them."""
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))


def unpacked(rows: DataFrame, documents: DataFrame, **new: Column) -> DataFrame:
    """The caller's columns again, some of them replaced."""
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns])


def cut(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that what follows survives lost executors.

    The path of the table is kept on the result as ``quern_path`` for ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quern_path = path
    return out


def drop(df: DataFrame, part: str = "") -> None:
    """Delete the table behind a result of ``cut`` that nothing reads any more, or one folder of its partitions."""
    path = getattr(df, "quern_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results have been written: they go with the driver's garbage."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators have left in the shared folder; for the end of a job, when their results are no longer read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quern")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidy() -> None:
    """Give free memory back to the system: idle Python workers stay for the next task and should not hold what the last one used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def streaming(run):
    """A function over a task's batches that tidies up at its end."""

    def tidied(batches):
        yield from run(batches)
        tidy()

    return tidied


def grouped(run):
    """A function over a group's rows that tidies up after each."""

    def tidied(pdf):
        out = run(pdf)
        tidy()
        return out

    return tidied


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (the hold-out rule); null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


#: Characters of the longest text that a training sample takes. With the bound on its rows, this bounds the sample's bytes.
SAMPLE_CHARS = 32 << 10


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, most: int, longest: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled training documents, spread by a hash of the id, of ``longest`` characters at most each.

    Only rows of ``labels`` outside the hold-out fold (crc32 modulo ``folds`` is not 0) are read; a
    document labelled more than once takes its larger label, null labels and ids are left out. The
    ids are ``most`` at most, so they may be broadcast. Of several documents with one id, the text with the least hash stands for it.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.char_length("text") <= longest)
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y")
