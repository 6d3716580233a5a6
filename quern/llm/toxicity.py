"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence s has the probability p(s) = sigmoid(b + sum of its words' weights), and
the document's is the noisy-or 1 - prod(1 - p(s)): one offending sentence is enough. Only document labels are
known; the gradient of the document's log-likelihood passes through the noisy-or to the sentences, so the model
learns which sentence offends and can point at it. A word's weight is the sum over the word and its
first 4, 5 and 6 letters, so that inflected forms count.

Nulls: a null text counts as empty; an empty text has no sentence and scores 0. A null doc_id is carried through and
held out. Repeated rows give one result row each. Without labels of both kinds every sentence scores 0.
"""

from __future__ import annotations

import pickle
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, labelled_sample, ready, tidy, streaming

#: Labelled documents that the model is fitted on, at most.
TRAIN_DOCS = 6000
#: Features that get a weight: the most telling ones.
FEATURES = 4096
#: A sentence without an end is cut after so many words.
LONGEST = 60
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")
#: A worker forgets its words' weights beyond so many.
CACHE = 150_000


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each sentence; spans in code points."""
    for m in SENTENCE.finditer(text):
        part = m.group()
        words = WORD.findall(part.lower())
        if not words:
            continue
        if len(words) <= LONGEST:
            yield m.start(), m.end(), words
            continue
        at = [(w.start(), w.end(), w.group().lower()) for w in WORD.finditer(part)]
        for i in range(0, len(at), LONGEST):
            piece = at[i : i + LONGEST]
            yield m.start() + piece[0][0], m.start() + piece[-1][1], [w for _, _, w in piece]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]


class Model:
    """At most FEATURES weights and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.cache = weights, bias, {}

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def sentence(self, words: list[str]) -> float:
        """The log-odds of one sentence."""
        cache = self.cache
        z = self.bias
        for w in words:
            v = cache.get(w)
            if v is None:
                if len(cache) >= CACHE:
                    cache.clear()
                v = cache[w] = self.word(w)
            z += v
        return z

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or, and (start, end, probability) of the sentences that offend (0.5 or more)."""
        if not self.weights:
            return 0.0, []
        spans, z = [], []
        for start, end, words in sentences(text):
            spans.append((start, end))
            z.append(self.sentence(words))
        if not z:
            return 0.0, []
        z = np.clip(np.array(z), -30, 30)
        p = 1 / (1 + np.exp(-z))
        return float(-np.expm1(-np.logaddexp(0, z).sum())), [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]


def train(bags: list[list[list[str]]], y: np.ndarray, most: int = FEATURES, epochs: int = 150, rate: float = 0.3, ridge: float = 2e-5) -> Model:
    """Fit the weights by Adam on the noisy-or likelihood. ``bags``: words of each sentence of each document."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    cache: dict[str, list[str]] = {}
    parts = lambda w: cache.get(w) or cache.setdefault(w, features(w))
    for bag, label in zip(bags, y, strict=True):
        seen[int(label)].update({f for words in bag for w in words for f in parts(w)})
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if min(n0, n1) < 2:
        return Model({}, 0.0)

    def telling(f: str) -> float:
        a, b = seen[1][f], seen[0][f]
        p = (a + b) / (n0 + n1)
        return abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)

    names = sorted((f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= 4), key=lambda f: (-telling(f), f))[:most]
    number = {f: i for i, f in enumerate(names)}
    of_word: dict[str, int] = {}  # words that have a feature; -1 for others
    known = 0
    feature, feature_word = array("i"), array("i")
    flat, sentence_of, doc_of = array("i"), array("i"), array("i")
    for d, bag in enumerate(bags):
        for words in bag:
            s = len(doc_of)
            doc_of.append(d)
            for w in words:
                k = of_word.get(w)
                if k is None:
                    own = [number[f] for f in parts(w) if f in number]
                    k = of_word[w] = known if own else -1
                    known += bool(own)
                    feature.extend(own)
                    feature_word.extend([k] * len(own))
                if k >= 0:
                    flat.append(k)
                    sentence_of.append(s)
    flat, sentence_of, doc_of, feature, feature_word = (np.frombuffer(a, np.int32) if len(a) else np.empty(0, np.int32) for a in (flat, sentence_of, doc_of, feature, feature_word))
    w, b = np.zeros(len(names)), -4.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, epochs + 1):
        of_words = np.bincount(feature_word, w[feature], known)
        z = np.clip(b + np.bincount(sentence_of, of_words[flat], len(doc_of)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(-np.bincount(doc_of, np.logaddexp(0, z), len(y)))  # prod(1 - p)
        both = np.clip(1 - none, 1e-9, 1)
        # d log-likelihood / d z(s): for a clean document -p(s); for a toxic one p(s) * none / (1 - none)
        up = np.where(y == 1, none / both, -1.0)[doc_of] * p
        by_word = np.bincount(flat, up[sentence_of], known)
        g = np.r_[np.bincount(feature, by_word[feature_word], len(names)), up.sum()] / len(y) - ridge * np.r_[w, 0]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * min(1.0, 2 * (1 - step / (epochs + 1)))
        w, b = w + move[:-1], b + move[-1]
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, float(b))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, most: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``most`` labelled documents outside the hold-out fold."""
    ready(documents.sparkSession)
    rows = sorted(labelled_sample(documents, labels, label, folds, most).collect())
    y = np.array([r["y"] for r in rows], dtype=float)
    bags = [[[sys.intern(w) for w in words] for _, _, words in sentences(r["text"])] for r in rows]
    del rows
    model = train(bags, y)
    del bags
    tidy()
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, offending: array of (start, end, p); of every row, where the rows are read."""
    ready(documents.sparkSession)
    packed = pickle.dumps(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Model = pickle.loads(packed)
        for batch in batches:
            scored = [own.document(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": [s for s, _ in scored], "offending": [[{"start": a, "end": b, "p": p} for a, b, p in o] for _, o in scored]})

    schema = "doc_id long, score double, offending array<struct<start: long, end: long, p: double>>"
    return documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(streaming(run), schema)


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (spans start:end, comma-joined)."""
    scored = score(documents, fit(documents, labels, folds=folds, most=most))
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), spans.alias("offending"))


def keep(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose text scores under ``threshold``, with all their columns."""
    ready(documents.sparkSession)
    packed = pickle.dumps(model)
    schema = documents.schema

    def run(batches):
        import pyarrow as pa

        own: Model = pickle.loads(packed)
        for batch in batches:
            clean = [own.document(t or "")[0] < threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(clean))

    return documents.mapInArrow(streaming(run), schema)
