"""Incrementally maintained aggregates and leaderboards over an event stream (Structured Streaming)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.indexes import ranks
from quern.sources.tables import cut, shared_dir


def source(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files: the folder of a table, or the folder that holds a single file."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return reader.option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def counts(events: DataFrame, by: list[str]) -> DataFrame:
    """Rows and sums of each group, kept up to date (output mode update or complete)."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def windowed(events: DataFrame, ts: str, size: str, slide: str, late: str, by: list[str]) -> DataFrame:
    """Best value of each key in overlapping half-open windows; a window closes when the watermark passes it."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    best = timed.groupBy(F.window("_ts", size, slide).alias("_w"), *by).agg(F.max("value").alias("best"))
    return best.select(F.col("_w.start").cast("timestamp_ntz").alias("start"), F.col("_w.end").cast("timestamp_ntz").alias("end"), *by, "best")


def run(stream: DataFrame, mode: str, name: str, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Process everything that is there now.

    State and offsets are kept in ``checkpoint``: a later run with the same one goes on where this one ends. Without one
    they go to a new folder of the shared one, for a run of its own.
    """
    where = checkpoint or f"{shared_dir(stream.sparkSession)}/quern/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", where).trigger(availableNow=True).start()
    q.awaitTermination()


class Latest:
    """A sink that keeps the newest row of each key: what a maintained aggregate index holds.

    Rows lie in buckets by the hash of their key. A batch rewrites the buckets that it touches, in a folder of its own
    (``epoch=n/bucket=b``); a bucket's newest folder counts. So a batch costs what its keys' buckets hold, one that is delivered again or
    was cut off leaves no trace, and a new object over the same path goes on where the last one ended.
    """

    def __init__(self, spark: SparkSession, keys: list[str], path: str | None = None, buckets: int = 32):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.path = path or f"{shared_dir(spark)}/quern/latest-{uuid.uuid4().hex}"

    def _folders(self, path: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _epochs(self) -> list[int]:
        """Epochs that were written to their end, oldest first."""
        names = [f for f in self._folders(self.path) if f.startswith("epoch=")]
        return sorted(int(f[6:]) for f in names if "_SUCCESS" in self._folders(f"{self.path}/{f}"))

    def _newest(self) -> dict[int, str]:
        out = {}
        for e in self._epochs():
            out |= {int(b[7:]): f"{self.path}/epoch={e}/{b}" for b in self._folders(f"{self.path}/epoch={e}") if b.startswith("bucket=")}
        return out

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        done = self._epochs()
        if done and epoch <= done[-1]:  # a batch that is delivered again
            return
        new = cut(batch.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")), "batch")
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        old = [path for b, path in self._newest().items() if b in touched]
        if old:
            kept = self.spark.read.schema(batch.schema).parquet(*old).alias("o")
            same = F.lit(True)
            for k in self.keys:
                same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
            stay = kept.join(new.select(*self.keys).alias("n"), same, "left_anti")
            new = stay.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).unionByName(new)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/epoch={epoch}")

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(*self._newest().values())


class Append:
    """A sink that keeps every row of closed windows."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if epoch == len(self.parts):
            self.parts.append(cut(batch, "append"))

    @property
    def rows(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out


def leaderboard(best: DataFrame) -> DataFrame:
    """Ranks from 0 inside each window."""
    return ranks(best, ["start", "end"], "best", count_duplicates=True, high_first=True)
