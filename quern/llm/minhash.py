"""Near-duplicate documents by BagMinHash signatures.

A text is the multiset of its five-word shingles (words in lower case). A Poisson process of each (shingle, weight
level) throws points (time, register); levels are the dyadic intervals (0, 1], (1, 2], (2, 4], ... of the weight, and in the
interval that holds a shingle's count a point counts only if its weight cell is at most the count. A register keeps
its earliest point, so two registers are equal with a probability of sum(min) / sum(max) of the counts: the
weighted Jaccard similarity, without bias. Points are drawn in rounds over all shingles of a batch at once, and a process stops
as soon as it is later than every register of its document.

Registers are hashed in bands; texts that share a band are candidates, and candidates are verified by the exact overlap of their multisets.
A band's bucket never yields all of its pairs: a maximum spanning tree over estimated similarities (chunk by chunk, then
over the chunks' most central texts) gives as many edges as texts. All edges together make families, the verified ones components; all
texts of a bucket of several chunks are one family. In a family of several components, every text outside the largest one is then compared
with all others, by exact overlaps of bags in memory, which give links only. So a link is lost only to the signature's error: where no band holds the
pair, or where a bucket's estimates leave its texts in different families.
Components come from rounds of contraction over written tables; nothing of it goes to the driver.

Exact copies share one node (md5 of the text), so a group of any number of copies is one row from the first shuffle on.

Nulls: a null text counts as empty. Texts of fewer than five words are one shingle, texts without words one of their own. Null doc_ids
are carried through and sort first. Repeated rows are copies of each other. An empty table gives an empty result. Other columns are kept by
``keep_one`` and ignored by ``classes``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import blocks
from quern.llm.common import cut, drop, packed, ready, streaming, unpacked

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
#: Estimated similarity from which a pair of one bucket is verified: about three standard errors under SIMILARITY.
CANDIDATE = 0.7
#: Texts of a bucket that are compared in memory at once.
CHUNK = 1024
#: Bytes of bags (8 for each shingle) of a family that are compared in memory at once.
FAMILY_BYTES = 32 << 20
WORD = re.compile(r"\w+")
#: A worker forgets its words' hashes beyond so many.
CACHE = 150_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) | 1
        return h


HASHES = Hashes()


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), sorted; a text has one shingle at least."""
    tokens, lengths = [], []
    for t in texts:
        words = WORD.findall(t.lower())
        own = list(map(HASHES.__getitem__, words)) if words else [xxhash.xxh64_intdigest(t, seed=1)]
        own += [0] * (WIDTH - len(own))
        tokens += own
        lengths.append(len(own))
    flat, lengths = np.array(tokens, np.uint64), np.array(lengths, np.int64)
    if not len(flat):
        return np.empty(0, np.int64), flat, np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    h = flat[: len(flat) - WIDTH + 1].copy()
    for i in range(1, WIDTH):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[i : len(flat) - WIDTH + 1 + i]
    whole = doc[: len(h)] == doc[WIDTH - 1 :]
    doc, h = doc[: len(h)][whole], mix(h[whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    return doc[new], h[new], np.diff(np.r_[new, len(h)])


def registers(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The earliest time in each register of each of ``n`` bags."""
    levels = np.ones(len(h), np.int64)
    many = count > 1
    levels[many] += np.ceil(np.log2(count[many])).astype(np.int64)
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    doc, h, count = np.repeat(doc, levels), np.repeat(h, levels), np.repeat(count, levels)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0))
    low = np.where(level == 0, 0, width)
    seed = mix(h + mix((level + 1).astype(np.uint64)))
    out = np.full(n * REGISTERS, np.inf)
    time, step = np.zeros(len(h)), 0
    while len(doc):
        a, b = (mix(seed + np.uint64((step + k) * odd % 2**64)) for k, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)))
        step += 2
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (REGISTERS * width)
        register = ((b >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        cell = low + 1 + ((b & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width).astype(np.int64)
        ok = cell <= count
        np.minimum.at(out, (doc * REGISTERS + register)[ok], time[ok])
        present = np.unique(doc)
        latest = np.zeros(n)
        latest[present] = out.reshape(n, REGISTERS)[present].max(axis=1)
        on = time < latest[doc]
        doc, count, width, low, seed, time = doc[on], count[on], width[on], low[on], seed[on], time[on]
    return out.reshape(n, REGISTERS)


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, one byte of each register) of each text."""
    times = registers(*shingles(texts), len(texts))
    hashed = mix(times.view(np.uint64).reshape(times.shape) + np.uint64(3))
    keys = np.zeros((len(texts), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + hashed[:, r::ROWS])
    return mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64), (hashed & np.uint64(255)).astype(np.uint8)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (shingles, counts)."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][x], b[1][y]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of all rows of ``a`` and ``b``, from the bytes of their registers."""
    same = np.zeros((len(a), len(b)), np.uint16)
    for r in range(a.shape[1]):
        same += a[:, r, None] == b[None, :, r]
    return (same / a.shape[1] - 1 / 256) / (1 - 1 / 256)


def tree(sim: np.ndarray, least: float | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """A maximum spanning tree: its edges that reach ``least`` (CANDIDATE), and the weaker ones, which hold its parts together."""
    least = CANDIDATE if least is None else least
    best, to, inside = sim[0].copy(), np.zeros(len(sim), np.int64), np.zeros(len(sim), bool)
    inside[0] = True
    strong, weak = [], []
    for _ in range(len(sim) - 1):
        i = int(np.argmax(np.where(inside, -np.inf, best)))
        (strong if best[i] >= least else weak).append((int(to[i]), i))
        inside[i] = True
        closer = ~inside & (sim[i] > best)
        best[closer], to[closer] = sim[i][closer], i
    return strong, weak


def runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows that agree in ``by``, over the borders of batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = [batch[c].to_numpy() for c in by]
        starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        if held and any(held[0][c].iloc[0] != batch[c].iloc[0] for c in by):
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)], strict=True):
            if z < len(batch):
                yield pd.concat([*held, batch.iloc[a:z]]) if held else batch.iloc[a:z]
                held = []
            else:
                held.append(batch.iloc[a:z])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)


def node_of(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sign(documents: DataFrame) -> DataFrame:
    """doc_id, node, keys, sig of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, sig = signatures(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "node": batch["node"], "keys": list(keys), "sig": [s.tobytes() for s in sig]})

    return blocks.text_rows(documents).withColumn("node", node_of(F.col("text"))).mapInPandas(streaming(run), "doc_id long, node binary, keys array<long>, sig binary")


def spanning(members: DataFrame, n_buckets: int, least: float | None = None) -> list[DataFrame]:
    """Edges (a, b, strong) of buckets (key, n, node, sig); all tables written on the way. Signatures of one bucket are equally long.

    A bucket of CHUNK texts or fewer gives the strong edges of its spanning tree. A larger one is dealt into chunks by the node's
    and the bucket's hash, whose most central texts meet again; its weak edges are kept too, so that all of its texts are of one family, and
    pairs in different chunks are compared there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in runs(batches, ["key", "chunk"]):
            nodes, sigs, split = group["node"].tolist(), group["sig"].tolist(), bool(group["split"].iloc[0])
            if len(nodes) == 2 and not split:
                out.append((None, None, None, *sorted(nodes), True))
            else:
                sim = estimates(m := _matrix(sigs), m) if len(nodes) > 1 else np.ones((1, 1))
                strong, weak = tree(sim, least)
                out += [(None, None, None, *sorted((nodes[a], nodes[b])), True) for a, b in strong]
                out += [(None, None, None, *sorted((nodes[a], nodes[b])), False) for a, b in weak if split]
                if group["chunks"].iloc[0] > 1:  # the most central text goes on to the next level
                    c = int(sim.sum(axis=0).argmax())
                    out.append((int(group["key"].iloc[0]), nodes[c], sigs[c], None, None, None))
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        yield pd.DataFrame(out, columns=names, dtype=object)

    names = ["key", "node", "sig", "a", "b", "strong"]
    tables, split = [], False
    while True:
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        dealt = members.select("key", "node", "sig", chunks.alias("chunks"), (F.lit(split) | (chunks > 1)).alias("split"), F.pmod(F.xxhash64("key", "node"), chunks).cast("int").alias("chunk"))
        found = cut(dealt.repartition(n_buckets, "key", "chunk").sortWithinPartitions("key", "chunk", "node").mapInPandas(streaming(run), "key long, node binary, sig binary, a binary, b binary, strong boolean"), "spanning")
        tables.append(found)
        central = found.where("node is not null").select("key", "node", "sig")
        if central.isEmpty():
            return tables
        sizes = central.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        members, split = central.join(sizes, "key").where("n > 1"), True


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, similarity of the pairs (nodes) whose multisets overlap enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            doc, h, count = shingles([*batch["ta"], *batch["tb"]])
            cuts = np.searchsorted(doc, np.arange(2 * len(batch) + 1))
            bag = lambda i: (h[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]])  # noqa: B023, E731
            sims = np.array([similarity(bag(i), bag(i + len(batch))) for i in range(len(batch))])
            yield batch[["a", "b"]].assign(similarity=sims)[sims >= SIMILARITY]

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(streaming(run), "a binary, b binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node of the edges is linked with, by contraction.

    In each round every node goes over to the least of itself and its neighbours, and only edges between what is left are
    kept, each once. So all rounds together join about as many rows as there are edges, not as many in every round.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = cut(edges.select(*ordered("a", "b")).where("a != b").distinct(), "links")
    rounds: list[DataFrame] = []
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "steps")
        rounds.append(step)
        over = lambda end: step.select(F.col("node").alias(end), F.col("label").alias(f"over_{end}"))  # noqa: B023, E731
        left = cut(links.join(over("a"), "a").join(over("b"), "b").select(*ordered("over_a", "over_b")).where("a != b").distinct(), "links")
        drop(links)
        links = left
        if links.isEmpty():
            break
    labels = rounds[-1]
    for step in rounds[-2::-1]:  # a node's label is that of the node it went over to
        last = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = step.join(last, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    labels = cut(labels, "labels")
    for t in (links, *rounds):
        drop(t)
    return labels


def elements(text: str) -> np.ndarray:
    """The multiset of a text's shingles as a sorted set: one 64-bit number for each (shingle, occurrence)."""
    _, h, count = shingles([text])
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.unique(mix(np.repeat(h, count) + mix(nth.astype(np.uint64) + np.uint64(1))))


class Bags:
    """Bags that meet in memory: exact overlaps of any of them with all.

    Elements that one bag in DENSE or more has are columns of a matrix, so that their overlaps are a matrix product; the others
    are looked up in postings, which are short. Either takes a small multiple of the bags' own memory.
    """

    DENSE = 4

    def __init__(self, bags: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        owner = np.repeat(np.arange(len(bags)), self.sizes)
        flat = np.concatenate(bags) if len(bags) else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
        times = np.diff(np.r_[new, len(flat)])
        many = times * self.DENSE > len(bags)
        dense, rare = np.repeat(many & (times > 1), times), np.repeat(~many & (times > 1), times)
        column = np.repeat(np.cumsum(many & (times > 1)) - 1, times)
        self.matrix = np.zeros((len(bags), int((many & (times > 1)).sum())), np.float32)
        self.matrix[owner[dense], column[dense]] = 1
        self.hosts = owner[rare]  # the postings of rare elements, one after another
        kept = times[~many & (times > 1)]
        self.begin = np.concatenate(([0], np.cumsum(kept)))
        of = np.repeat(np.arange(len(kept)), kept)
        by_owner = np.argsort(self.hosts, kind="stable")
        self.own, self.own_at = of[by_owner], np.searchsorted(self.hosts[by_owner], np.arange(len(bags) + 1))

    def similarities(self, which: np.ndarray) -> np.ndarray:
        """Weighted Jaccard of the bags ``which`` (rows) with every other bag; not with themselves, whose own elements are left out."""
        both = (self.matrix[which] @ self.matrix.T).astype(np.float64)
        for row, i in enumerate(which.tolist()):
            own = self.own[self.own_at[i] : self.own_at[i + 1]]
            n = self.begin[own + 1] - self.begin[own]
            place = np.repeat(self.begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both[row] += np.bincount(self.hosts[place], minlength=len(self.sizes))
        return both / np.maximum(self.sizes[which][:, None] + self.sizes[None, :] - both, 1)


def links(bags: list[np.ndarray], label: np.ndarray, visitor: np.ndarray, host: np.ndarray) -> list[tuple[int, int]]:
    """Each visitor's best link (SIMILARITY or more) to every other component that a host is of."""
    met, out = Bags(bags), []
    who = np.flatnonzero(visitor)
    for at in range(0, len(who), 256):
        which = who[at : at + 256]
        sim = np.where(host[None, :] & (label[which][:, None] != label[None, :]), met.similarities(which), 0.0)
        for row in np.flatnonzero((sim >= SIMILARITY).any(axis=1)).tolist():
            hits = np.flatnonzero(sim[row] >= SIMILARITY)
            hits = hits[np.argsort(-sim[row][hits], kind="stable")]
            out += [(int(which[row]), int(hits[k])) for k in np.unique(label[hits], return_index=True)[1]]
    return out


def _remaining(families: DataFrame, labels: DataFrame, texts: DataFrame, n_buckets: int) -> DataFrame:
    """a, b: links between different components of one family, by the exact overlap of every text that may still have one.

    In a family with several components the texts outside its largest one visit all chunks of the family, as bags; a chunk
    has FAMILY_BYTES of them, so all but the widest families are one chunk and a row for each text. A visitor gives the best
    link to each other component, so nothing but links leaves a chunk.
    """
    named = cut(families.withColumnRenamed("label", "family").join(labels, "node", "left").select("node", "family", F.coalesce("label", "node").alias("label")), "named")
    counted = named.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = counted.groupBy("family").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")

    def bag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["node", "family", "label", "main"]].assign(bag=[elements(t).tobytes() for t in batch["text"]])

    bags = named.join(mixed, "family").join(texts, "node").select("node", "family", "label", "main", "text")
    bags = cut(bags.mapInPandas(streaming(bag), "node binary, family binary, label binary, main binary, bag binary"), "bags")
    sizes = bags.groupBy("family").agg(F.ceil(F.sum(F.length("bag")) / FAMILY_BYTES).cast("int").alias("chunks"))
    rows = bags.join(sizes, "family").select("family", "node", "label", "bag", "chunks", (F.col("label") != F.col("main")).alias("out"), F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("own"))
    rows = rows.withColumn("chunk", F.explode(F.when(F.col("out"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("own"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["family", "chunk"]):
            nodes = group["node"].tolist()
            label = np.unique(np.array([x.hex() for x in group["label"]]), return_inverse=True)[1]
            found = links([np.frombuffer(b, np.uint64) for b in group["bag"]], label, group["out"].to_numpy(bool), (group["own"] == group["chunk"]).to_numpy())
            if found:
                yield pd.DataFrame([tuple(sorted((nodes[a], nodes[b]))) for a, b in found], columns=["a", "b"], dtype=object)

    found = rows.repartition(n_buckets, "family", "chunk").sortWithinPartitions("family", "chunk", "node").mapInPandas(streaming(run), "a binary, b binary").distinct()
    out = cut(found, "links")
    drop(named)
    drop(bags)
    return out


def group(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node of every row; node, label, first, copies of every distinct text): texts of one label are near-duplicates."""
    spark = ready(documents.sparkSession)
    n_buckets = blocks.buckets(spark)
    signed = cut(sign(documents), "signatures")
    nodes = cut(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "nodes")
    rows = cut(signed.select("doc_id", "node"), "rows")
    drop(signed)
    exploded = nodes.select(F.explode("keys").alias("key"), "node")
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(exploded.join(shared, "key"), "members")
    sigs = nodes.select("node", "sig")
    tables = spanning(members.join(sigs, "node"), n_buckets)
    pairs = tables[0]
    for t in tables[1:]:
        pairs = pairs.unionByName(t)
    together = cut(pairs.where("a is not null").groupBy("a", "b").agg(F.max("strong").alias("strong")), "pairs")
    for t in tables:
        drop(t)
    tested = together.where("strong").select("a", "b")
    involved = members.select("node").distinct()
    distinct = documents.select(node_of(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["node"])  # copies go before the shuffle
    texts = cut(distinct.join(involved, "node", "left_semi"), "texts")
    edges = cut(verify(tested, texts), "edges")
    labels, families = components(edges), components(together)
    more = _remaining(families, labels, texts, n_buckets)
    if not more.isEmpty():
        drop(labels)
        labels = components(edges.select("a", "b").unionByName(more))
    drop(members)
    drop(texts)
    drop(together)
    drop(edges)
    return rows, nodes.select("node", "first", "copies").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first", "copies")


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id among its near-duplicates), class_rows, copies (rows with the very same text) of every row."""
    rows, nodes = group(documents)
    nodes = cut(nodes, "classes")
    whole = nodes.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_rows"))
    return rows.join(nodes.join(whole, "label").select("node", "class_id", "class_rows", "copies"), "node").select("doc_id", "class_id", "class_rows", "copies")


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class: of each text the least doc_id that is not null, of these the least (null first, ties by the text's hash)."""
    _, nodes = group(documents)
    own = lambda doc_id: (F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), doc_id.isNull().alias("none"))
    best = nodes.groupBy("label").agg(F.min(F.struct("first", "node")).alias("best"))
    stay = cut(best.select(F.col("best.node").alias("node"), *own(F.col("best.first"))), "kept")
    rows = packed(documents).select("row", node_of(F.col("row.text")).alias("node"), *own(F.col("row.doc_id")))
    # Dealt by text and id, so that the copies of a text are spread; rows that agree in both are one before the shuffle.
    kept = rows.dropDuplicates(["node", "id", "none"]).join(stay, ["node", "id", "none"])
    return unpacked(kept, documents)
