"""Document fingerprints by a randomised edit embedding.

A random walk shared by all documents reads a text from left to right: at step j it writes the character under it and
moves on if a shared random bit h(j, character) is 1. Texts at a small edit distance fall into step again
soon after an edit, so the edit distance of the texts shows in the Hamming distance of what the walks wrote. The fingerprint
keeps the written characters (8 hash bits each) at shared random steps. Steps are sampled at nested rates: a text takes the
rate that leaves MOST / 2 to MOST of them, and two fingerprints are compared at the sparser rate of the two.

``near_classes`` samples symbols of the fingerprints into bands over their whole length, spans each band's group with a tree over the
fingerprints' likeness, and verifies its edges by their edit distance.

The walk is run in lockstep for a whole block of documents with numpy, in one step for each character: how
long the walk stays on a character is looked up by (character class, step). Where only a few long texts are left, they walk one by one.

Nulls: a null text counts as empty; empty texts have an empty fingerprint and are alike. Null doc_ids come first in the order of
documents. Rows of one id follow each other by the hash of their text. A single row is its own next document. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import blocks, minhash
from quern.llm.common import cut, ready, streaming

#: Sampled steps of a fingerprint, at most about so many.
MOST = 256
#: Classes of characters and steps after which the shared random bits repeat.
CLASSES, PERIOD = 64, 4096
SEED = 20240229
#: Characters of texts that walk in lockstep.
LOCKSTEP = 4 << 20
#: So few texts walk one by one.
ALONE = 24
#: Bands of BAND_STEPS symbols each are drawn from the first multiple of RANGE symbols, for the two largest multiples that a fingerprint has.
BANDS, BAND_STEPS, RANGE = 20, 6, 32
#: Near-duplicates: an edit distance of at most this share of the longer text.
NEAR = 0.02
#: Likeness from which a pair of one band group is verified.
ALIKE = 0.3


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash (the finaliser of splitmix64)."""
    x = np.asarray(x).astype(np.uint64) + np.uint64(SEED)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def stays() -> np.ndarray:
    """[class * PERIOD + step modulo PERIOD] -> steps that the walk stays on such a character."""
    bits = (mix(np.arange(CLASSES * PERIOD)) & np.uint64(1)).astype(bool).reshape(CLASSES, PERIOD)
    bits[:, -1] = True
    out = np.ones((CLASSES, PERIOD), np.int32)
    for j in range(PERIOD - 2, -1, -1):
        out[:, j] = np.where(bits[:, j], 1, out[:, j + 1] + 1)
    return out.reshape(-1)


@lru_cache(64)
def steps(level: int) -> np.ndarray:
    """The sampled steps at a rate of 2**-level, as far as texts of that rate reach; drawn in runs, so that memory follows their number."""
    end, run = 2 * MOST << level, 1 << 20
    out = []
    for at in range(0, end, run):
        q = np.arange(at, min(at + run, end), dtype=np.int64)
        out.append(q[(mix(q + (1 << 40)) & np.uint64((1 << level) - 1)) == 0])
    return np.concatenate(out)


def _alone(first: np.ndarray, turned: np.ndarray, j: int, run: int = 1 << 18) -> int:
    """The walk of one text from step ``j`` on: ``first`` is filled in, the step after its end returned."""
    table, mask = _stays_list(), PERIOD - 1
    for at in range(0, len(turned), run):
        out = []
        for c in turned[at : at + run].tolist():
            out.append(j)
            j += table[c + (j & mask)]
        first[at : at + len(out)] = out
    return j


@lru_cache(1)
def _stays_list() -> list[int]:
    return stays().tolist()


def walk(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text -> (first step of each character, all texts one after another; steps of each text)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths) - lengths
    total = np.zeros(len(texts), np.int64)
    if not lengths.sum():
        return np.empty(0, np.int64), total
    flat = np.concatenate(texts)
    turned = (flat * np.uint32(2654435761) >> np.uint32(26)).astype(np.int32) * PERIOD
    first = np.empty(len(flat), np.int64)
    order = np.argsort(-lengths, kind="stable")
    together = int(np.sort(lengths)[-ALONE - 1]) if len(lengths) > ALONE else 0  # as far as more than ALONE texts reach
    own = np.minimum(lengths, together)
    if together:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        active = len(texts) - np.searchsorted(np.sort(own), np.arange(together), side="right")  # texts longer than i
        begin = np.cumsum(active) - active
        index = np.int32 if len(flat) < 1 << 31 else np.int64
        at = np.arange(own.sum(), dtype=index) - np.repeat((np.cumsum(own) - own).astype(index), own)
        source = at + np.repeat(starts.astype(index), own)
        place = begin.astype(index)[at] + np.repeat(rank.astype(index), own)
        dealt, steps_of = np.empty(len(at), np.int32), np.empty(len(at), np.int32)
        del at
        dealt[place] = turned[source]
        table, mask, j = stays(), np.int32(PERIOD - 1), np.zeros(len(texts), np.int32)
        for b, n in zip(begin.tolist(), active.tolist(), strict=True):
            here = j[:n]
            steps_of[b : b + n] = here
            here += table[dealt[b : b + n] + (here & mask)]
        first[source] = steps_of[place]
        total = j[rank].astype(np.int64)
    for k in np.flatnonzero(lengths > together).tolist():
        a, z = int(starts[k] + together), int(starts[k] + lengths[k])
        total[k] = _alone(first[a:z], turned[a:z], int(total[k]))
    return first, total


def fingerprints(texts: list[str]) -> list[str]:
    """``level:hex``: the rate, and 8 bits of the character at every sampled step."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    first, total = walk(points)
    out, at = [], 0
    for p, n in zip(points, total.tolist(), strict=True):
        if not len(p):
            out.append("0:")
            continue
        level = max(0, int(n - 1).bit_length() - MOST.bit_length() + 1)
        q = steps(level)
        q = q[: np.searchsorted(q, n)]
        chars = p[np.searchsorted(first[at : at + len(p)], q, side="right") - 1]
        at += len(p)
        out.append(f"{level}:{(mix(chars) & np.uint64(255)).astype(np.uint8).tobytes().hex()}")
    return out


@lru_cache(256)
def thinned(level: int, to: int) -> np.ndarray:
    """Which of a level's sampled steps a sparser level keeps."""
    q = steps(level)
    return (mix(q + (1 << 40)) & np.uint64((1 << to) - 1)) == 0


def symbols(fingerprint: str, level: int | None = None) -> np.ndarray:
    own, digits = fingerprint.split(":")
    s = np.frombuffer(bytes.fromhex(digits), np.uint8)
    return s if level is None or level == int(own) else s[thinned(int(own), level)[: len(s)]]


def likeness(a: str, b: str) -> float:
    """Share of sampled steps at which both walks wrote the same, from 0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    level = max(int(a.split(":")[0]), int(b.split(":")[0]))
    x, y = symbols(a, level), symbols(b, level)
    n = min(len(x), len(y))
    return float((x[:n] == y[:n]).sum()) / max(len(x), len(y), 1)


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare(rows: list[tuple], after: list[str]) -> pd.DataFrame:
    """The result columns of consecutive (doc_id, text), given each one's next text."""
    texts = [t for _, t in rows]
    changed = [edited(t, a) for t, a in zip(texts, after, strict=True)]
    own = fingerprints([*texts, after[-1]])
    new = fingerprints(changed)
    return pd.DataFrame({
        "doc_id": pd.array([i for i, _ in rows], dtype="Int64"),
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(c.encode("utf-8", "replace")).hexdigest() for c in changed],
        "fingerprint": own[:-1],
        "edited_fingerprint": new,
        "near_edited": [likeness(a, b) for a, b in zip(own, new, strict=False)],
        "near_next": [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
    })


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def chain(documents: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, in doc_id order.

    The texts are shuffled by range once; each range looks one row ahead. Only the first and the last row of
    a range (its ends) leave it with their text, to meet the next range's; there are two for each range.
    """
    spark = ready(documents.sparkSession)
    n = blocks.buckets(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        size, begun = 0, False

        def end(kind: str, row: tuple) -> pd.DataFrame:
            nothing = {name: pd.Series([None], dtype=object) for name in names}
            return pd.DataFrame(nothing | {"doc_id": pd.array([row[0]], dtype="Int64"), "part": [part], "kind": pd.Series([kind], dtype=object), "text": pd.Series([row[1]], dtype=object)})

        def inner(frame: pd.DataFrame) -> pd.DataFrame:
            empty = pd.Series([None] * len(frame), dtype=object)
            return frame.assign(part=empty, kind=empty, text=empty)

        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                row = (None if pd.isna(i) else int(i), text)
                if not begun:
                    yield end("first", row)
                    begun = True
                held.append(row)
                size += len(text)
                if size > LOCKSTEP and len(held) > 1:
                    yield inner(compare(held[:-1], [t for _, t in held[1:]]))
                    held, size = [row], len(text)
        if len(held) > 1:
            yield inner(compare(held[:-1], [t for _, t in held[1:]]))
        if held:
            yield end("last", held[-1])

    names = [c.split()[0] for c in RESULT.split(", ")]
    rows = blocks.text_rows(documents).withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    found = cut(ordered.select("doc_id", "text").mapInPandas(streaming(run), RESULT + ", part int, kind string, text string"), "fingerprints")
    firsts = found.where("kind = 'first'").select(F.col("part").alias("first_part"), F.col("text").alias("after"))
    parts = sorted(r["first_part"] for r in firsts.select("first_part").collect())  # one number for each range
    follows = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, first_part int")
    lasts = found.where("kind = 'last'").select("doc_id", "text", "part").join(follows, "part").join(firsts, "first_part").select("doc_id", "text", "after")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, text, after in zip(batch["doc_id"], batch["text"], batch["after"], strict=True):
                yield compare([(None if pd.isna(i) else int(i), text)], [after])

    return found.where("kind is null").drop("part", "kind", "text").unionByName(lasts.mapInPandas(streaming(ends), RESULT))


@lru_cache(256)
def band_steps(reach: int) -> np.ndarray:
    """[band, place] -> which of the first ``reach`` sampled steps a band reads."""
    g = np.random.default_rng((SEED, reach))
    return np.stack([np.sort(g.choice(reach, BAND_STEPS, replace=False)) for _ in range(BANDS)])


def bands(fingerprint: str) -> tuple[list[tuple[int, int]], list[bytes]]:
    """((key, variant) of each band; the symbols that each variant's bands are drawn from).

    Variants are the text's own rate and the next sparser one, each with the two largest reaches, since near texts may be on either side of a
    border. A variant with fewer symbols than RANGE is one band of all of them.
    """
    own = int(fingerprint.split(":")[0])
    keys, read = [], []
    for level in (own, own + 1):
        s = symbols(fingerprint, level)
        most = len(s) // RANGE * RANGE
        for reach in [r for r in (most, most - RANGE) if r >= RANGE] or [len(s)]:
            head = s[:reach].tobytes()
            places = band_steps(reach) if reach >= RANGE else [np.arange(reach)]
            keys += [(xxhash.xxh64_intdigest(head if reach < RANGE else s[p].tobytes(), seed=(level << 20) + (reach << 8) + b) - (1 << 63), len(read)) for b, p in enumerate(places)]
            read.append(head)
    return keys, read


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most`` + 1 if it is more.

    Bit-parallel (Myers 1999): a column of the table is a few integers of len(a) bits, so a pair takes len(a) * len(b) / 64 steps of a machine
    word, and memory in proportion to its texts.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in sorted((a, b), key=len))
    n = len(x)
    ahead = int(np.argmin(np.r_[x == y[:n], False]))  # equal beginnings and ends do not count
    x, y = x[ahead:], y[ahead:]
    behind = int(np.argmin(np.r_[x[::-1] == y[::-1][: len(x)], False]))
    x, y = x[: len(x) - behind], y[: len(y) - behind]
    if not len(x):
        return min(len(y), most + 1)
    held = {c: int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x).tolist()}
    full, high = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, score, left = full, 0, len(x), len(y)
    for c in y.tolist():
        eq = held.get(c, 0)
        left -= 1
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more = down | (full & ~(h | up))
        less = up & h
        if more & high:
            score += 1
        elif less & high:
            score -= 1
        if score - left > most:
            return most + 1
        more = (more << 1 | 1) & full
        up = (less << 1 & full) | (full & ~(v | more))
        down = more & v
    return min(score, most + 1)


def near_classes(documents: DataFrame, most: float = NEAR) -> DataFrame:
    """doc_id, class_id of every row: the least doc_id among the documents that chains of verified pairs link it with.

    Verified: an edit distance of at most ``most`` of the longer text. Texts that share a band are compared by the likeness of their
    fingerprints in memory, CHUNK at a time, and each group of a band gives the edges of a spanning tree, so no group yields all of its pairs. A
    pair is lost where no band holds it or where every tree that holds both ends leads over an edge that is not verified. Exact
    copies are one text throughout. Null ids are kept and come first.
    """
    spark = ready(documents.sparkSession)

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [bands(f) for f in fingerprints(batch["text"].tolist())]
            yield pd.DataFrame({"node": batch["node"], "keys": [[{"key": k, "variant": v} for k, v in keys] for keys, _ in found], "read": [r for _, r in found]})

    rows = blocks.text_rows(documents).withColumn("node", minhash.node_of(F.col("text")))
    texts = cut(rows.groupBy("node").agg(F.first("text").alias("text")), "texts")
    nodes = cut(texts.where("text <> ''").mapInPandas(streaming(banded), "node binary, keys array<struct<key: long, variant: int>>, read array<binary>"), "bands")
    exploded = nodes.select("node", F.explode("keys").alias("k")).select("node", "k.key", "k.variant")
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = exploded.join(shared, "key").join(nodes.select("node", "read"), "node").select("key", "n", "node", F.expr("read[variant]").alias("sig"))
    tables = minhash.spanning(members, blocks.buckets(spark), ALIKE)
    pairs = tables[0]
    for t in tables[1:]:
        pairs = pairs.unionByName(t)
    pairs = pairs.where("strong").select("a", "b").distinct()
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            allowed = [int(most * max(len(a), len(b))) for a, b in zip(batch["ta"], batch["tb"], strict=True)]
            near = [edit_distance(a, b, k) <= k for a, b, k in zip(batch["ta"], batch["tb"], allowed, strict=True)]
            yield batch[["a", "b"]][near]

    labels = minhash.components(cut(both.mapInPandas(streaming(verify), "a binary, b binary"), "near"))
    owned = cut(rows.select("doc_id", "node").join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label")), "rows")
    return owned.join(owned.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.max(F.col("doc_id").isNull()).alias("no_id")), "label").select("doc_id", F.when(~F.col("no_id"), F.col("class_id")).alias("class_id"))
