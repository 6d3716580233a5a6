"""Token ids in files of a static range asymmetric numeral system (rANS).

Rows are put in ascending doc_id order by a range shuffle on (doc_id, hash of the text), so that one id with very many rows still
spreads. Each range encodes its texts, and every segment of some million ids gets one frequency table, shared by the
segment's independent interleaved blocks (``ans``). A block's directory entry (the checkpoint: count, first states, words) and
crc32 let any block be decoded alone.

Files are Parquet tables written by Spark, a row for each segment, so that a lost task leaves nothing half-written.

Nulls: a null text counts as empty (it still gets the end id); null doc_ids come first. Rows with the same id keep one row each, in the
order of their texts' hash. An empty table gives no segment and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import blocks
from quern.llm.ans import pack_segment, unpack_segment
from quern.llm.bpe import Words
from quern.llm.common import cut, ready, streaming

#: An encoder forgets its words' ids beyond so many.
KNOWN = 600_000
#: A segment (one frequency table) is closed at the first document end after so many ids.
SEGMENT_IDS = 2 << 20

SCHEMA = "range int, segment int, first long, n_ids long, doc_ids binary, lengths binary, symbols binary, frequencies binary, blocks array<struct<n: int, states: binary, words: binary, crc32: long>>"


class Known(dict):
    """The ids of words as 32-bit numbers; a word is encoded where it is first looked up."""

    def __init__(self, pack: Callable[[str], bytes]):
        super().__init__()
        self.pack = pack

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        ids = self[word] = self.pack(word)
        return ids


class Encoder:
    """Whole texts to ids by the tokenizers library: a text's ids are those of its words in order, and each word is encoded once for as long as it is remembered."""

    def __init__(self, content: str):
        self.words = Words(content)
        self.known = Known(self.words.packer)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        look_up, split = self.known.__getitem__, self.words.split
        return [np.frombuffer(b"".join(map(look_up, split(t))), np.uint32) for t in texts]  # a text's words are looked up while they are at hand


@lru_cache(1)
def encoder_of(content: str) -> Encoder:
    """Kept while the worker lives; tasks reach it by this function's name, as a table that they refer to would travel with each, empty."""
    return Encoder(content)


def write(documents: DataFrame, content: str, end: int) -> DataFrame:
    """Encode every text, append ``end``, and write the files in ascending doc_id order; returns the written table."""
    spark = ready(documents.sparkSession)
    n = blocks.buckets(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(content)
        part = TaskContext.get().partitionId()
        ids, docs, held, segment, first = [], [], 0, 0, 0

        def close() -> pd.DataFrame:
            flat = np.concatenate(ids)
            row = pack_segment(flat) | {"range": part, "segment": segment, "first": first, "n_ids": len(flat), "doc_ids": blocks.pack_ids(docs), "lengths": blocks.pack(np.fromiter(map(len, ids), np.uint32, len(ids)))}
            return pd.DataFrame([row])

        for batch in batches:
            for doc, got in zip(batch["doc_id"], encoder(batch["text"].tolist()), strict=True):
                docs.append(None if pd.isna(doc) else int(doc))
                ids.append(np.append(got, np.uint32(end)))
                held += len(got) + 1
                if held >= SEGMENT_IDS:
                    yield close()
                    ids, docs, first, held, segment = [], [], first + held, 0, segment + 1
        if ids:
            yield close()

    rows = blocks.text_rows(documents).withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    return cut(ordered.select("doc_id", "text").mapInPandas(streaming(run), SCHEMA), "rans")


def read(spark: SparkSession, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files.

    The ids before each range are summed on the driver: one number for each range, as many as the files were written with.
    """
    ready(spark)
    sizes = sorted(files.groupBy("range").agg(F.sum("n_ids").alias("n")).collect())
    before, total = {}, 0
    for r in sizes:
        before[r["range"]] = total
        total += r["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = unpack_segment(r.symbols, r.frequencies, r.blocks)
                lengths = blocks.unpack(r.lengths, np.uint32).astype(np.int64)
                ends = np.cumsum(lengths)
                each = np.split(ids, ends[:-1])
                out = pd.DataFrame({"doc_id": pd.array(blocks.unpack_ids(r.doc_ids), dtype="Int64"), "start": before[r.range] + r.first + ends - lengths, "n_tokens": lengths, "ids_crc32": [zlib.crc32(e.astype("<u4").tobytes()) for e in each]})
                yield out.assign(ids=[e.astype(np.int32) for e in each]) if with_ids else out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return files.select("range", "first", "doc_ids", "lengths", "symbols", "frequencies", "blocks").mapInPandas(streaming(run), schema)
