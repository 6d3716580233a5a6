"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds are the three-word sequences of the test items, common ones too: an edited copy may keep no rare one. One pass joins the
documents to the items at the seeds. For every (document, item) pair that shares any seed, the stretches of the document that hold
enough of the item's words for a match are aligned with the item word by word (local alignment, so replaced, dropped and inserted
words only cost points); the bounds lose no alignment. A match is a score of at least THRESHOLD of the score of a verbatim copy.

The items are a query set: they travel to the documents in parts of at most PART_SEEDS seeds (their size is checked), and each part
scans the documents anew. Nothing is shuffled.

Nulls: null texts count as empty; items with a null id or without words match nothing. Items of one or two words match where they stand word for word. Null doc_ids are carried through.
Repeated rows and repeated items give one result row each. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quern.llm import blocks
from quern.llm.common import ready, streaming

N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: Steps of the numbers of common words for which passages are sought.
SCALES = 4
#: Seeds that travel with a task at once, at most.
PART_SEEDS = 500_000
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Items:
    """A part of the test items: their words as numbers, and where their seeds are."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words, short = [], [], []
        for i, text in items:
            words = words_of(text or "")
            if i is None or not words:
                continue
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            if len(words) >= N:
                self.ids.append(i)
                self.words.append(numbers)
            else:
                short.append((i, numbers))
        self.base = len(self.vocabulary) + 1
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, numbers in short:
            self.short[len(numbers)][int(self.codes(numbers, len(numbers))[0])].append(i)
        self.short = {n: dict(codes) for n, codes in self.short.items()}
        seeds = [self.codes(w) for w in self.words]
        self.every = np.unique(np.concatenate(seeds)) if seeds else np.empty(0, np.int64)
        self.own, self.times = [], []
        for w in self.words:
            own, times = np.unique(w, return_counts=True)
            self.own.append(own)
            self.times.append(times)
        self.scales = [scales(len(w)) for w in self.words]
        self.slot = np.zeros(self.base, np.int64)
        self.where: dict[int, list[int]] = defaultdict(list)
        for item, codes in enumerate(seeds):
            for c in np.unique(codes).tolist():
                self.where[c].append(item)

    def __len__(self) -> int:
        return len(self.words) + sum(len(ids) for codes in self.short.values() for ids in codes.values())

    def codes(self, numbers: np.ndarray, n: int = N) -> np.ndarray:
        """The code of the n-gram at each place."""
        out = numbers[: len(numbers) - n + 1].copy()
        for k in range(1, n):
            out = out * self.base + numbers[k : len(numbers) - n + 1 + k]
        return out

    def verbatim(self, numbers: np.ndarray) -> list[tuple[int, float, int]]:
        """(item id, 1.0, last word of its first place) of the items of fewer than N words that a text holds word for word."""
        out = []
        for n, codes in self.short.items():
            if len(numbers) < n:
                continue
            known = np.all([numbers[k : len(numbers) - n + 1 + k] >= 0 for k in range(n)], axis=0)
            places = np.flatnonzero(known)
            found, first = np.unique(self.codes(numbers, n)[places], return_index=True)
            out += [(i, 1.0, int(places[at]) + n) for c, at in zip(found.tolist(), first.tolist(), strict=True) for i in codes.get(c, ())]
        return out

    def hits(self, text: str) -> tuple[np.ndarray, list[int]]:
        """(numbers of the text's words, -1 for words of no item; the items that share a seed with the text)."""
        get = self.vocabulary.get
        words = WORD.findall(text.lower())
        numbers = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if len(numbers) < N or not len(self.every):
            return numbers, []
        known = numbers >= 0
        at = known[: len(known) - N + 1].copy()
        for k in range(1, N):
            at &= known[k : len(known) - N + 1 + k]
        at = np.flatnonzero(at)
        code = numbers[at]
        for k in range(1, N):
            code = code * self.base + numbers[at + k]
        place = np.minimum(np.searchsorted(self.every, code), len(self.every) - 1)
        found = np.unique(code[self.every[place] == code])
        return numbers, sorted({item for c in found.tolist() for item in self.where[c]})


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, end of it in the passage); words are numbers, negative ones match nothing."""
    step = np.arange(1, len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        base = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), np.maximum(row[1:] + GAP, 0))
        row[1:] = np.maximum.accumulate(base + step) - step  # gaps along the passage
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def in_windows(held: np.ndarray, width: int) -> np.ndarray:
    """How many of ``held`` are true in the window of ``width`` from each place at which a whole one begins."""
    total = np.concatenate(([0], np.cumsum(held)))
    return total[width:] - total[:-width]


def scales(n: int) -> list[tuple[int, int]]:
    """(words, width): a match with an item of n words has for one of these at least so many common words in such a window.

    With m common words, gaps and mismatches cost at most what m matches have above the threshold, so the match's length is bounded;
    m goes from the threshold to n in a few steps.
    """
    least = ceil(THRESHOLD * n)
    out, step = [], max(1, ceil((n + 1 - least) / SCALES))
    for m in range(least, n + 1, step):
        most = min(n, m + step - 1)
        out.append((m, most + floor((most - THRESHOLD * n) * MATCH / min(-GAP, -MISMATCH))))
    return out


def passages(numbers: np.ndarray, item: int, items: Items) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches of a text outside of which no alignment with the item is a match.

    Common words are counted in windows, each at most as often as the item has it.
    """
    own, times, windows = items.own[item], items.times[item], items.scales[item]
    slot = items.slot
    slot[own] = np.arange(1, len(own) + 1)
    at = slot[numbers]  # 0 for words that the item does not have; -1 reads the last slot
    slot[own] = 0
    counts = np.bincount(at, minlength=len(own) + 1)
    counts[0] = 0
    if int(np.minimum(counts[1:], times).sum()) < windows[0][0]:
        return
    often = np.flatnonzero(counts[1:] > times) + 1
    plain = at > 0
    plain &= ~np.isin(at, often)
    cover = np.zeros(len(at) + 1, np.int64)
    for least, width in windows:
        width = min(width, len(at))
        here = in_windows(at > 0, width) >= least
        if not here.any():
            continue
        common = in_windows(plain, width)
        for k in often.tolist():
            common += np.minimum(in_windows(at == k, width), times[k - 1])
        begins = np.flatnonzero(common >= least)
        cover[begins] += 1
        np.subtract.at(cover, begins + width, 1)
    inside = np.diff(np.concatenate(([0], np.cumsum(cover) > 0, [0])).astype(np.int8))
    yield from zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True)


def matches(numbers: np.ndarray, shared: list[int], items: Items) -> list[tuple[int, float, int]]:
    """(item id, best score as a share of a verbatim copy's, last word of it) of the items of ``shared`` that a text holds."""
    best: dict[int, tuple[float, int]] = {}
    for item in shared:
        words = items.words[item]
        for begin, end in passages(numbers, item, items):
            score, stop = align(numbers[begin:end], words)
            share = score / (MATCH * len(words))
            if share >= THRESHOLD and share > best.get(item, (0.0, 0))[0]:
                best[item] = (share, begin + stop)
    return [(items.ids[i], s, e) for i, (s, e) in sorted(best.items())] + items.verbatim(numbers)


def parts(benchmark: DataFrame, most: int = PART_SEEDS) -> Iterator[list[tuple[int, str]]]:
    """The test items in runs of at most about ``most`` seeds; the driver holds one run at a time."""
    held, n = [], 0
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        k = max(1, len(words_of(r["text"])))
        if held and n + k > most:
            yield held
            held, n = [], 0
        held.append((r["item_id"], r["text"]))
        n += k
    if held:
        yield held


def find(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, last_word: the test items that each document holds, verbatim or edited."""
    spark = ready(documents.sparkSession)
    schema = "doc_id long, item_id long, score double, last_word long"
    out = spark.createDataFrame([], schema)
    for k, part in enumerate(parts(benchmark)):
        items = Items(part)
        if not len(items):
            continue

        def run(batches: Iterator[pd.DataFrame], items: Items = items) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                    rows += [(None if pd.isna(i) else int(i), *m) for m in matches(*items.hits(text), items)]
                if rows:
                    yield pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "item_id": [r[1] for r in rows], "score": [r[2] for r in rows], "last_word": [r[3] for r in rows]})

        found = blocks.text_rows(documents).mapInPandas(streaming(run), schema)
        out = found if k == 0 else out.unionByName(found)
    return out


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that hold no test item, with all their columns."""
    ready(documents.sparkSession)
    out = documents
    for part in parts(benchmark):
        items = Items(part)
        if not len(items):
            continue

        def run(batches, items: Items = items):
            import pyarrow as pa

            for batch in batches:
                keep = [not matches(*items.hits(text or ""), items) for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(streaming(run), documents.schema)
    return out
