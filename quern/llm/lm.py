"""Language-model scoring with Katz backoff.

Counts of words and of word pairs are discounted by Good-Turing (counts up to K). A pair seen in training has the probability
d(c) * c / C(history); any other pair falls back to alpha(history) * P(word), evaluated recursively for each token, with

    P(word) = d(c) * c / N for known words; all unknown words share the one remaining event, with what is left
    alpha(h) = (1 - sum of seen d(c) * c / C(h)) / (1 - sum of P(word) over the words seen after h)

so that the probabilities of the known words and the unknown event add up to 1 after every history. A text is its words and one end
token; its first word's history is the end token.

Tables (``fit``): the documents' token sequences by block (one pass over the documents writes them, and all later steps read them), word counts, pair counts and backoff weights, each in packed rows by the bucket of the history, written to the
shared folder. A pair is counted in the bucket of its history; a history with more than a bucket's share of all
tokens is spread over as many buckets as it fills, and its partial sums are added up afterwards (fewer rows than two per bucket). Buckets are as
many as the corpus has shares of ``blocks.BUCKET_BYTES``, so a task that holds one keeps to some hundred MB at any size of the corpus. Of a block
of documents only the distinct words and pairs travel to the tables, and their counts come back in the same order, so what is
shuffled grows with the distinct pairs of the blocks.

Nulls: a null text counts as empty (its end token is scored). Null doc_ids are held out. Repeated rows count as often as they stand there. An empty
table gives an empty result; without training rows every token is the unknown event, with probability 1. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import ans, blocks
from quern.llm.common import crc_mod, cut, drop, grouped, ready, release, streaming

END = b"\n"
K = 5
BLOCK_CHARS = 8 << 20
FOLDS = 10
CELL = "kind string, block string, bucket int, data binary"


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end token."""
    return [*text.encode().lower().split(), END]


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def discounts(n: list[int]) -> np.ndarray:
    """d(r) for r = 0..K, where n[r] items occur r times (n[0] is unused); 1 where the counts of counts give no valid discount."""
    d = np.ones(K + 1)
    if n[1] == 0:
        return d
    common = (K + 1) * n[K + 1] / n[1]
    for r in range(1, K + 1):
        if n[r] and common < 1:
            x = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
            if 0 < x < 1:
                d[r] = x
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c > K, c, d[np.minimum(c, K)] * c)


class Unigrams:
    """P(word) by the word's count."""

    def __init__(self, n: list[int], total: int, distinct: int, mass: float):
        self.total, self.distinct, self.d = total, distinct, discounts(n)
        self.scale = 1.0
        if total and mass >= total * (1 - 1e-12):  # nothing was discounted: one count is set aside
            self.scale = total / (total + 1)
        self.unknown = 1.0 if not total else 1 - mass * self.scale / total

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) * self.scale / max(self.total, 1), self.unknown)


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each byte string, from sums of bytes times powers of an odd number, all strings at once."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    powers = np.cumprod(np.full(len(data) + 1, 0x9E3779B97F4A7C15, np.uint64))
    inverse = np.cumprod(np.full(len(data) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
    h = (sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def numbered(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(word numbers of all texts in order, tokens of each, distinct words by bucket and then as first seen, bucket of each).

    The same tokens as ``tokens`` gives, split and numbered by Arrow's kernels.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
    offsets, words = lists.offsets.to_numpy(), lists.flatten()
    full = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty word
    words = words.filter(pa.array(full))
    coded = words.dictionary_encode()
    names = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
    own = np.diff(np.concatenate(([0], np.cumsum(full)))[offsets - offsets[0]])
    bucket = (hashes(names) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    flat = np.empty(len(words) + len(texts), np.uint32)
    ends = np.cumsum(own + 1) - 1
    inner = np.ones(len(flat), bool)
    inner[ends] = False
    flat[inner] = place[coded.indices.to_numpy()]
    flat[ends] = place[-1]
    return flat, own + 1, names.take(pa.array(order)), bucket[order]


def cell_words(names: pa.Array, a: int, z: int) -> tuple[np.ndarray, bytes]:
    """(lengths, bytes) of a run of the words."""
    offsets = np.frombuffer(names.buffers()[1], np.int32)[names.offset + a : names.offset + z + 1]
    return np.diff(offsets), names.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()


def slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs of equal buckets."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
        if z > a:
            yield int(bucket[a]), a, z


def rows_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "block", "bucket", "data"], dtype=object)


class Block:
    """A block's tokens and what the word table knows of its words."""

    def __init__(self, payload: list[bytes], cells: list[tuple[int, list[bytes]]]):
        self.doc_ids, self.lengths = blocks.unpack_ids(payload[0]), blocks.unpack(payload[1], np.int64)
        coded = pickle.loads(payload[2])
        self.seq = ans.unpack_segment(coded["symbols"], coded["frequencies"], coded["blocks"]).astype(np.int64)
        self.end = int(np.frombuffer(payload[3], np.uint32)[0])
        self.ids = np.concatenate([blocks.unpack(c[0], np.int64) for _, c in cells])
        self.counts = np.concatenate([blocks.unpack(c[1], np.int64) for _, c in cells])

    def pairs(self, total: int, n: int) -> None:
        """Distinct (history, word) pairs by target bucket, then by the history's and the word's id; ``inverse``: the pair of each token."""
        history, v = np.r_[self.end, self.seq[:-1]], len(self.ids)
        code, inverse = np.unique(history * v + self.seq, return_inverse=True)
        one, two = code // v, code % v
        spread = np.maximum(1, -(-self.counts[one] * n // max(total, 1)))
        shift = ((self.ids[two].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % spread
        target = (self.ids[one] + shift) % n
        order = np.lexsort((self.ids[two], self.ids[one], target))
        self.one, self.two, self.target = one[order], two[order], target[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.inverse = place[inverse]


def scan(documents: DataFrame, n: int) -> DataFrame:
    """The only pass over the documents: kind tokens: the token sequence of each block; kind words: cells of its distinct words, with their training counts.

    It is written, and everything later reads it, so blocks and their numbering are settled once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, ids, texts in blocks.of_rows(batches, BLOCK_CHARS):
            seq, lengths, names, bucket = numbered(texts, n)
            train = np.repeat(np.array([not is_held_out(i) for i in ids]), lengths)
            counts = np.bincount(seq[train], minlength=len(names))
            data = [blocks.pack_ids(ids), blocks.pack(lengths), pickle.dumps(ans.pack_segment(seq)), np.uint32(seq[-1]).tobytes()]
            cells = [("words", name, b, blocks.join([blocks.pack_lengths(*cell_words(names, a, z)), blocks.pack(counts[a:z])])) for b, a, z in slices(bucket)]
            yield rows_frame([("tokens", name, -1, blocks.join(data)), *cells])

    return blocks.text_rows(documents).mapInPandas(streaming(run), CELL)


def count_words(cells: DataFrame, n: int) -> DataFrame:
    """kind word: (ids, counts) for each cell; kind model: the bucket's words, ids and counts; kind stats: counts of counts.

    Ids ascend as counts descend within a bucket, so that common words have small numbers.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        total: dict[bytes, int] = defaultdict(int)
        for data in pdf["data"]:
            words, counts = blocks.split(data)
            for w, c in zip(blocks.unpack_words(words), blocks.unpack(counts, np.int64).tolist(), strict=True):
                total[w] += c
        order = sorted(total, key=lambda w: (-total[w], w))
        ids = {w: k * n + bucket for k, w in enumerate(order)}
        out = []
        for block, data in zip(pdf["block"], pdf["data"], strict=True):
            words = blocks.unpack_words(blocks.split(data)[0])
            out.append(("word", block, bucket, blocks.join([blocks.pack(np.fromiter(map(ids.__getitem__, words), np.int64, len(words))), blocks.pack(np.fromiter(map(total.__getitem__, words), np.int64, len(words)))])))
        known = [w for w in order if total[w] > 0]
        counts = np.array([total[w] for w in known], np.int64)
        out.append(("model", None, bucket, blocks.join([blocks.pack_words(known), blocks.pack(counts)])))
        out.append(("stats", None, bucket, pickle.dumps((counts_of_counts(counts), int(counts.sum()), len(known)))))
        return rows_frame(out)

    return cells.groupBy("bucket").applyInPandas(grouped(run), CELL)


def counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(c[(c > 0) & (c <= K + 1)], minlength=K + 2).tolist()


def gathered(table: DataFrame) -> tuple[list[int], int, int]:
    """The sums of the stats rows: one small row for each bucket, added up on the driver."""
    n, total, distinct = [0] * (K + 2), 0, 0
    for r in table.where("kind = 'stats'").select("data").toLocalIterator():
        own, t, d = pickle.loads(r["data"])
        n, total, distinct = [a + b for a, b in zip(n, own, strict=True)], total + t, distinct + d
    return n, total, distinct


def _block_of(pdf: pd.DataFrame) -> Block:
    words = sorted((b, blocks.split(d)) for k, b, d in zip(pdf["kind"], pdf["bucket"], pdf["data"], strict=True) if k == "word")
    return Block(blocks.split(pdf.loc[pdf["kind"] == "tokens", "data"].iloc[0]), words)


def pack_pairs(bucket: int, n: int, history: np.ndarray, of_history: np.ndarray, runs: np.ndarray, two: np.ndarray, of_two: np.ndarray, c: np.ndarray) -> bytes:
    """A cell of sorted pairs: ids as differences, histories in steps of the buckets (which most of a bucket's are apart)."""
    step = two.copy()
    step[1:] -= two[:-1]
    starts = np.cumsum(runs) - runs
    step[starts] = two[starts]
    return blocks.join([blocks.pack(x) for x in (np.diff(history // n, prepend=0), (history - bucket) % n, of_history, runs, step, of_two, c)])


def unpack_pairs(bucket: int, n: int, data: bytes) -> tuple[np.ndarray, ...]:
    quotient, rest, of_history, runs, step, of_two, c = (blocks.unpack(x, np.int64) for x in blocks.split(data))
    starts = np.cumsum(runs) - runs
    total = np.cumsum(step)
    two = total - np.repeat(total[starts] - step[starts], runs)
    return np.cumsum(quotient) * n + (rest + bucket) % n, of_history, runs, two, of_two, c


def scan_pairs(tokens: DataFrame, words: DataFrame, total: int, n: int) -> DataFrame:
    """Cells of the distinct pairs of each block, with their training counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = _block_of(pdf)
        own.pairs(total, n)
        train = np.repeat(np.array([not is_held_out(i) for i in own.doc_ids]), own.lengths)
        counts = np.bincount(own.inverse[train], minlength=len(own.one))
        out = []
        for b, a, z in slices(own.target):
            starts = np.flatnonzero(np.r_[True, np.diff(own.one[a:z]) != 0])
            first, two = own.one[a:z][starts], own.two[a:z]
            out.append(("pairs", pdf["block"].iloc[0], b, pack_pairs(b, n, own.ids[first], own.counts[first], np.diff(np.r_[starts, z - a]), own.ids[two], own.counts[two], counts[a:z])))
        return rows_frame(out)

    both = tokens.unionByName(words.where("kind = 'word'"))
    return both.groupBy("block").applyInPandas(grouped(run), CELL)


def count_pairs(cells: DataFrame, n: int) -> DataFrame:
    """kind pair: the counts for each cell; kind model: histories, their counts, runs, words, their counts, pair counts; kind stats."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        got = [unpack_pairs(bucket, n, d) for d in pdf["data"]]
        one = np.concatenate([np.repeat(g[0], g[2]) for g in got])
        of_one = np.concatenate([np.repeat(g[1], g[2]) for g in got])
        two, of_two, c = (np.concatenate([g[k] for g in got]) for k in (3, 4, 5))
        order = np.lexsort((two, one))
        new = np.r_[True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)]
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        total = np.bincount(pair, c).astype(np.int64)
        out, at = [], 0
        for block, g in zip(pdf["block"], got, strict=True):
            out.append(("pair", block, bucket, blocks.pack(total[pair[at : at + len(g[3])]])))
            at += len(g[3])
        keep = order[new][total > 0]
        total = total[total > 0]
        histories, starts = np.unique(one[keep], return_index=True)
        out.append(("model", None, bucket, pack_pairs(bucket, n, histories, of_one[keep][starts], np.diff(np.r_[starts, len(keep)]).astype(np.int64), two[keep], of_two[keep], total)))
        out.append(("stats", None, bucket, pickle.dumps((counts_of_counts(total), int(total.sum()), len(total)))))
        return rows_frame(out)

    return cells.groupBy("bucket").applyInPandas(grouped(run), CELL)


def weight(c: np.ndarray, seen: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, what the history's count is raised by) from its count, the seen pairs' discounted counts and their words' P."""
    more = (seen >= c * (1 - 1e-12)).astype(np.int64)  # nothing was discounted: one count is set aside
    return (1 - seen / (c + more)) / np.maximum(1 - lower, 1e-300), more


def backoff(pairs: DataFrame, unigrams: Unigrams, d: np.ndarray, total: int, n: int) -> DataFrame:
    """kind alpha: a bucket's histories, their weights and raises; kind part: the sums of a spread history in one bucket."""
    packed = pickle.dumps((unigrams, d))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, own = pickle.loads(packed)
        for batch in batches:
            out = []
            for bucket, data in zip(batch["bucket"], batch["data"], strict=True):
                one, of_one, runs, _, of_two, c = unpack_pairs(bucket, n, data)
                at = np.repeat(np.arange(len(one)), runs)
                seen = np.bincount(at, discounted(c, own), len(one))
                lower = np.bincount(at, words.p(of_two), len(one))
                wide = of_one * n > total
                alpha, more = weight(of_one[~wide], seen[~wide], lower[~wide])
                out.append(("alpha", None, bucket, blocks.join([blocks.pack(one[~wide]), blocks.pack(alpha), blocks.pack(more)])))
                if wide.any():
                    out.append(("part", None, bucket, pickle.dumps((one[wide], of_one[wide], seen[wide], lower[wide]))))
            yield rows_frame(out)

    return pairs.where("kind = 'model'").select("bucket", "data").mapInPandas(streaming(run), CELL)


def spread(weights: DataFrame) -> dict[int, tuple[float, int]]:
    """The weights of the histories that fill more than a bucket; there are fewer of them than buckets."""
    sums: dict[int, list[float]] = {}
    for r in weights.where("kind = 'part'").select("data").toLocalIterator():
        for i, c, s, lower in zip(*pickle.loads(r["data"]), strict=True):
            old = sums.setdefault(int(i), [int(c), 0.0, 0.0])
            old[1] += s
            old[2] += lower
    out = {}
    for i, (c, s, lower) in sums.items():
        a, m = weight(np.array([c]), np.array([s]), np.array([lower]))
        out[i] = (float(a[0]), int(m[0]))
    return out


def hand_out(words: DataFrame, weights: DataFrame) -> DataFrame:
    """kind alpha: for each block and bucket, the weights and raises of its words in order; 1 for histories never seen."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = [blocks.split(d) for k, d in zip(pdf["kind"], pdf["data"], strict=True) if k == "alpha"]
        ids, alpha, more = (np.concatenate([blocks.unpack(k[x], t) for k in known]) if known else np.empty(0, t) for x, t in ((0, np.int64), (1, np.float64), (2, np.int64)))
        out = []
        for kind, block, bucket, data in zip(pdf["kind"], pdf["block"], pdf["bucket"], pdf["data"], strict=True):
            if kind != "word":
                continue
            own = blocks.unpack(blocks.split(data)[0], np.int64)
            at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            hit = ids[at] == own if len(ids) else np.zeros(len(own), bool)
            a, m = np.ones(len(own)), np.zeros(len(own), np.int64)
            a[hit], m[hit] = alpha[at[hit]], more[at[hit]]
            out.append(("alpha", block, bucket, blocks.join([blocks.pack(a), blocks.pack(m)])))
        return rows_frame(out)

    return words.where("kind = 'word'").unionByName(weights.where("kind = 'alpha'")).groupBy("bucket").applyInPandas(grouped(run), CELL)


class Fitted:
    """The model's tables and totals, and the token sequences of the documents that it was fitted over."""

    def __init__(self, tokens: DataFrame, words: DataFrame, pairs: DataFrame, weights: DataFrame, unigrams: Unigrams, d: np.ndarray, wide: dict, n: int):
        self.tokens, self.words, self.pairs, self.weights, self.unigrams, self.d, self.wide, self.n = tokens, words, pairs, weights, unigrams, d, wide, n


def fit(documents: DataFrame) -> Fitted:
    """Count the training rows; the tables also answer for every block of ``documents``."""
    spark = ready(documents.sparkSession)
    n = blocks.buckets(spark, documents)
    scanned = cut(scan(documents, n), "lm-blocks", ["kind"])
    tokens = scanned.where("kind = 'tokens'")
    words = cut(count_words(scanned.where("kind = 'words'"), n), "lm-words", ["kind"])
    drop(scanned, "kind=words")
    release(spark)
    counts, total, distinct = gathered(words)
    d = discounts(counts)
    mass = total - sum(counts[r] * r * (1 - d[r]) for r in range(1, K + 1))
    unigrams = Unigrams(counts, total, distinct, mass)
    pairs = cut(count_pairs(scan_pairs(tokens, words, total, n), n), "lm-pairs", ["kind"])
    release(spark)
    d2 = discounts(gathered(pairs)[0])
    weights = cut(backoff(pairs, unigrams, d2, total, n), "lm-weights", ["kind"])
    return Fitted(tokens, words, pairs, weights, unigrams, d2, spread(weights), n)


RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(model: Fitted) -> DataFrame:
    """Scores of every row of the documents that the model was fitted over."""
    packed = pickle.dumps((model.unigrams, model.d, model.wide))
    n = model.n

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words, d, wide = pickle.loads(packed)
        own = _block_of(pdf)
        own.pairs(words.total, n)
        parts = {kind: sorted((b, x) for k, b, x in zip(pdf["kind"], pdf["bucket"], pdf["data"], strict=True) if k == kind) for kind in ("pair", "alpha")}
        c = np.concatenate([blocks.unpack(x, np.int64) for _, x in parts["pair"]])
        alphas = [blocks.split(x) for _, x in parts["alpha"]]
        alpha = np.concatenate([blocks.unpack(a, np.float64) for a, _ in alphas])
        more = np.concatenate([blocks.unpack(m, np.int64) for _, m in alphas])
        for k in np.flatnonzero(own.counts * n > words.total):
            alpha[k], more[k] = wide.get(int(own.ids[k]), (1.0, 0))
        p = words.p(own.counts)
        history = np.maximum(own.counts + more, 1)
        prob = np.where(c > 0, discounted(c, d) / history[own.one], alpha[own.one] * p[own.two])
        log = np.log10(np.maximum(prob, 1e-300))[own.inverse]
        base = np.log10((own.counts + 0.1) / (words.total + 0.1 * (words.distinct + 1)))[own.seq]
        starts = np.cumsum(own.lengths) - own.lengths
        return pd.DataFrame({
            "doc_id": pd.array(own.doc_ids, dtype="Int64"), "n_tokens": own.lengths, "n_known": np.add.reduceat((own.counts > 0)[own.seq].astype(np.int64), starts),
            "train_tokens": words.total, "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(log, starts),
        })

    answers = model.words.where("kind = 'word'").unionByName(hand_out(model.words, model.weights)).unionByName(model.pairs.where("kind = 'pair'"))
    return model.tokens.unionByName(answers).groupBy("block").applyInPandas(grouped(run), RESULT)


def score_corpus(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learnt from the rows that are not held out."""
    scored = score(fit(documents))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
