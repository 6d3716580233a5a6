"""Session helpers: one place for the settings every query relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(app: str = "quern", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests, the benchmark and notebooks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's path.

    On clusters whose executors do not share that path, ship the package with
    ``--py-files`` instead; the extra entry is then harmless.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{have}".rstrip(":")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a test-data folder; the path may be on any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
