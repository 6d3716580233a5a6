"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is cut into
blocks, each block is compressed with either dictionary, and the difference of the two compressed sizes, divided by the
text's size, says which kind it resembles. A logistic curve fitted on the labels turns it into a calibrated
score; it also sees the size ratio itself, since text that repeats itself shrinks alike with both.

Nulls: a null text counts as empty; an empty text has no compressed size to compare and gets the curve's value for a
difference of 0. A null doc_id is carried through and held out. Repeated rows give one result row each. Without labels of both kinds
there is nothing to compare and every score is the share of good labels (0.5 without any).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, labelled_sample, ready, streaming

#: Labelled documents that the model is fitted on, at most.
TRAIN_DOCS = 4000
DICT_BYTES = 64 << 10
BLOCK_BYTES = 2048
LEVEL = 3


class Model:
    """Dictionaries and curve; small enough (2 x DICT_BYTES) to travel with the task."""

    def __init__(self, good: bytes, bad: bytes, coef: list[float], mean: list[float], scale: list[float], prior: float):
        self.good, self.bad, self.coef, self.mean, self.scale, self.prior = good, bad, coef, mean, scale, prior

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.coef:
            return np.full(len(x), self.prior)
        z = self.coef[0] + ((x - self.mean) / self.scale) @ np.array(self.coef[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    for i in range(0, len(data), size):
        yield data[i : i + size]


def sizes(text: str, compressors: list[zstandard.ZstdCompressor]) -> tuple[int, int, int]:
    """Bytes of the text, and of its blocks compressed with the good and the bad dictionary."""
    data = text.encode()
    good = bad = 0
    for block in blocks(data):
        good += len(compressors[0].compress(block))
        bad += len(compressors[1].compress(block))
    return len(data), good, bad


def inputs(measured: list[tuple[int, int, int]]) -> np.ndarray:
    """The normalised difference, the ratio and its square."""
    n, good, bad = np.array(measured, dtype=float).reshape(-1, 3).T
    n = np.maximum(n, 1)
    difference, ratio = (bad - good) / n, (good + bad) / (2 * n)
    return np.stack([difference, ratio, ratio**2, difference * ratio], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method with a small ridge."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + ridge * np.r_[0, w[1:]]
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, most: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``most`` labelled documents outside the hold-out fold.

    One half of the sample trains the dictionaries, the other the curve, so that the curve sees texts the
    dictionaries do not contain.
    """
    rows = sorted(ready(documents.sparkSession) and labelled_sample(documents, labels, label, folds, most).collect())
    half = {y: [r["text"] for r in rows if r["y"] == y] for y in (0, 1)}
    prior = sum(r["y"] for r in rows) / len(rows) if rows else 0.5
    if min(len(half[0]), len(half[1])) < 8:
        return Model(b"", b"", [], [], [], prior)

    def dictionary(texts: list[str]) -> bytes:
        samples = [b for t in texts[::2] for b in blocks(t.encode())]
        most = max(1, len(samples) * BLOCK_BYTES // (100 * DICT_BYTES))  # 100 times the dictionary is plenty
        samples = samples[::most]
        try:
            return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few samples: the text itself is the dictionary
            return b"".join(samples)[-DICT_BYTES:]

    model = Model(dictionary(half[1]), dictionary(half[0]), [], [], [], prior)
    compressors = model.compressors()
    held = [(t, y) for y in (0, 1) for t in half[y][1::2]]
    x = inputs([sizes(t, compressors) for t, _ in held])
    model.mean, model.scale = x.mean(0).tolist(), np.maximum(x.std(0), 1e-9).tolist()
    model.coef = logistic((x - model.mean) / model.scale, np.array([y for _, y in held], dtype=float)).tolist()
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row, where the rows are read."""
    ready(documents.sparkSession)
    packed = pickle.dumps(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Model = pickle.loads(packed)
        compressors = own.compressors() if own.coef else None
        for batch in batches:
            x = inputs([sizes(t, compressors) for t in batch["text"]]) if compressors else np.zeros((len(batch), 4))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": own.score(x)})

    return documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(streaming(run), "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(documents, fit(documents, labels, folds=folds, most=most))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
