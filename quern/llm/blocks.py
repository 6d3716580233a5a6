"""Blocks of documents and packed cells: how operators that look up every token of a corpus keep their shuffles small.

A task cuts its rows into blocks of a few MB. Of each block only the distinct keys travel, packed into one
cell for each bucket of keys; what comes back is packed in the same order, and the block is put together again from a
compressed sequence of its keys' numbers. Nothing is kept outside the shuffles, so a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text after which a block is closed.
BLOCK_CHARS = 4 << 20


def text_rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def of_rows(batches: Iterator[pd.DataFrame], size: int = BLOCK_CHARS) -> Iterator[tuple[str, list, list[str]]]:
    """(name, doc ids, texts) of each block of a task."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    ids, texts, n, k = [], [], 0, 0
    for batch in batches:
        for i, t in zip(batch["doc_id"], batch["text"], strict=True):
            if texts and n + len(t) > size:
                yield f"{part}-{k}", ids, texts
                ids, texts, n, k = [], [], 0, k + 1
            ids.append(None if pd.isna(i) else int(i))
            texts.append(t)
            n += len(t) + 16
    if texts:
        yield f"{part}-{k}", ids, texts


def pack(a: np.ndarray, level: int = 3) -> bytes:
    """An array of numbers, its bytes by significance, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return np.uint32(len(a)).tobytes() + zstandard.ZstdCompressor(level=level).compress(planes)


def unpack(b: bytes, dtype) -> np.ndarray:
    n, size = int(np.frombuffer(b[:4], np.uint32)[0]), np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8) if n else np.empty(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(n)


def pack_small(a: np.ndarray) -> bytes:
    """Numbers as they stand, compressed; in 16 bits where all fit."""
    narrow = not len(a) or int(a.max()) < 1 << 16
    return bytes([narrow]) + zstandard.ZstdCompressor(level=9).compress(a.astype(np.uint16 if narrow else np.uint32).tobytes())


def unpack_small(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint16 if b[0] else np.uint32)


def join(parts: list[bytes]) -> bytes:
    """Several byte strings as one."""
    return np.array([len(parts), *map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def split(b: bytes) -> list[bytes]:
    n = int(np.frombuffer(b[:4], np.uint32)[0])
    ends = np.cumsum(np.frombuffer(b[4 : 4 + 4 * n], np.uint32).astype(np.int64)) + 4 + 4 * n
    return [b[a:z] for a, z in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=False)][:n]


def pack_lengths(lengths: np.ndarray, data: bytes) -> bytes:
    """Byte strings given by their lengths and their bytes."""
    return join([pack(lengths.astype(np.uint32)), zstandard.ZstdCompressor(level=12).compress(data)])


def pack_words(words: list[bytes]) -> bytes:
    return pack_lengths(np.fromiter(map(len, words), np.uint32, len(words)), b"".join(words))


def unpack_words(b: bytes) -> list[bytes]:
    lengths, data = split(b)
    ends = np.cumsum(unpack(lengths, np.uint32).astype(np.int64)).tolist()
    data = zstandard.ZstdDecompressor().decompress(data) if ends and ends[-1] else b""
    return [data[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=False)]


def pack_ids(ids: list) -> bytes:
    """Row ids, nulls among them."""
    return join([pack(np.array([i if i is not None else 0 for i in ids], np.int64)), pack(np.array([i is None for i in ids], np.uint8))])


def unpack_ids(b: bytes) -> list:
    a, nulls = split(b)
    return [None if z else i for i, z in zip(unpack(a, np.int64).tolist(), unpack(nulls, np.uint8).tolist(), strict=True)]


#: Text whose keys one bucket holds, at most about so much on average.
BUCKET_BYTES = 16 << 20


def buckets(spark, documents: DataFrame | None = None) -> int:
    """How many buckets keys are dealt into: the session's shuffle partitions, and one for every BUCKET_BYTES of ``documents`` at least."""
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if documents is None:
        return least
    size = documents.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-size // BUCKET_BYTES))
