"""Scans, key lookups, paging, counts and sinks over tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-"))


def cut(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: what follows starts from files and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/quern/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where=None, reverse_by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A table scan with its projection and predicate (both reach the Parquet reader), in reverse key order if asked to."""
    rows = spark.read.parquet(path)
    if where is not None:
        rows = rows.where(where)
    if columns:
        rows = rows.select(*columns)
    if reverse_by:
        rows = rows.orderBy(*[F.col(c).desc() for c in reverse_by])
    return rows if limit is None else rows.limit(limit)


def page(rows: DataFrame, keys: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The next rows in key order after a continuation (the last key of the page before)."""
    if after is not None:
        past = F.lit(False)
        for i in range(len(keys)):
            same = F.lit(True)
            for j in range(i):
                same = same & (F.col(keys[j]) == F.lit(after[j]))
            past = past | (same & (F.col(keys[i]) > F.lit(after[i])))
        rows = rows.where(past)
    return rows.orderBy(*keys).limit(size)


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """_type, n: rows of each table, counted in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("_type"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
