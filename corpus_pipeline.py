"""A corpus-cleaning pipeline of the operators in quern.llm, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns them with the columns of
``documents``; the last returns a row of ids for each document. ``run`` writes what a stage returns to the shared folder and
reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, common, decontam, line_dedup, minhash, toxicity
from quern.session import table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the multiple-instance model, fitted on the labels, calls toxic."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of repeated three-line passages; n_chars follows the text."""
    return line_dedup.clean(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a test item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again for the digests."""
    content = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.digest(bpe.encode(docs, content, with_text=True))


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_once), ("minhash", one_of_each), ("decontamination", no_benchmark), ("bpe", encoded)]

#: The toxicity stage is a trained model, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
