"""Secret scan over a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams (``trigrams.query``). Documents are
indexed in segments; a rule's query intersects and unites the segment's postings, and only the
candidates are verified with the expression itself, over the whole text. A rule without mandatory trigrams
(a bare run of hex digits) scans every text. Segments are built where the rows are read, so the scan
moves nothing between executors; ``build_index`` and ``search`` keep the postings as a table instead, for corpora
scanned again with other rules.

Nulls: a null text counts as empty, a null doc_id is carried through. Repeated rows and ids give one result row per
input row. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import trigrams
from quern.llm.common import ready, streaming

#: A segment is closed beyond so many bytes of text.
SEGMENT_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and non-overlapping; a match counts if its ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    def spans(self, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # [0-9a-f]+ takes maximal runs, so the length can stand in the expression
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
RULES = BASE + MORE


class Scanner:
    """The rules' queries and expressions, and the mask of the trigrams that they name."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigrams.query(r.pattern) for r in rules]
        self.compiled = [r.compiled() for r in rules]
        self.wanted = np.zeros(1 << 24, dtype=bool)
        for q in self.queries:
            self.wanted[list(trigrams.named(q))] = True

    def segment(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of each text of a segment, sorted."""
        lowered = [t.encode().lower() for t in texts]
        codes, docs = trigrams.trigram_pairs(lowered, self.wanted)
        cuts = np.flatnonzero(np.diff(codes)) + 1
        postings = {int(c[0]): d for c, d in zip(np.split(codes, cuts), np.split(docs, cuts), strict=True) if len(c)}
        everything = np.arange(len(texts))
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, q, compiled) in enumerate(zip(self.rules, self.queries, self.compiled, strict=True)):
            for i in trigrams.matching(q, postings, everything):
                found[i] += [(s, k, e) for s, e in rule.spans(texts[i], compiled)]
        return [sorted(f) for f in found]


def segments(rows: list[tuple], size: int = SEGMENT_BYTES) -> Iterator[list[tuple]]:
    """Runs of (doc_id, text) of about ``size`` characters; a longer text has a run of its own."""
    out, n = [], 0
    for row in rows:
        if out and n + len(row[1]) > size:
            yield out
            out, n = [], 0
        out.append(row)
        n += len(row[1])
    if out:
        yield out


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) in code points, sorted by start, then by the rules' order."""
    ready(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules)
        for batch in batches:
            for rows in segments(list(zip(batch["doc_id"], batch["text"], strict=True))):
                found = scanner.segment([t for _, t in rows])
                yield pd.DataFrame({
                    "doc_id": pd.array([None if pd.isna(i) else int(i) for i, _ in rows], dtype="Int64"),
                    "spans": [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in f] for f in found],
                })

    return documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(streaming(run), "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def build_index(documents: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """segment, trigram, doc_ids: the postings of every segment; ``wanted`` keeps only these trigrams."""
    ready(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = None
        if wanted is not None:
            mask = np.zeros(1 << 24, dtype=bool)
            mask[list(wanted)] = True
        for batch in batches:
            for rows in segments(list(zip(batch["doc_id"], batch["text"], strict=True))):
                ids = np.array([i for i, _ in rows], dtype=np.int64)
                codes, docs = trigrams.trigram_pairs([t.encode().lower() for _, t in rows], mask)
                cuts = np.flatnonzero(np.diff(codes)) + 1
                if len(codes):
                    name = hashlib.sha256(ids.tobytes()).hexdigest()[:16]
                    yield pd.DataFrame({"segment": name, "trigram": codes[np.r_[0, cuts]].astype(np.int32), "doc_ids": [np.unique(ids[d]) for d in np.split(docs, cuts)]})

    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(streaming(run), "segment string, trigram int, doc_ids array<long>")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """kind, doc_id: what the kept postings leave of the rules that have mandatory trigrams."""
    queries = {r.kind: q for r in rules if (q := trigrams.query(r.pattern)) != trigrams.ALL}
    named = sorted(set().union(*map(trigrams.named, queries.values())))

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        postings = {int(t): np.unique(np.asarray(d)) for t, d in zip(pdf["trigram"], pdf["doc_ids"], strict=True)}
        hits = [(kind, int(i)) for kind, q in queries.items() for i in trigrams.matching(q, postings, np.empty(0, np.int64))]
        return pd.DataFrame(hits, columns=["kind", "doc_id"])

    return index.where(F.col("trigram").isin(named)).groupBy("segment").applyInPandas(evaluate, "kind string, doc_id long").distinct()


def search(index: DataFrame, documents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, spans (as in ``scan``) of the documents in which a rule matches, by the kept index of the same documents.

    A rule with mandatory trigrams is tried on its candidates only, a rule without any on every text. Rows of one id are all tried; rows
    without an id are in no index and tried with every rule.
    """
    ready(documents.sparkSession)
    everywhere = {r.kind for r in rules if trigrams.query(r.pattern) == trigrams.ALL}
    own = candidates(index, rules).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(own, "doc_id", "left" if everywhere else "inner").where("doc_id is not null")
    if not everywhere:
        rows = rows.where("kinds is not null")
    loose = documents.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.array(*[F.lit(r.kind) for r in rules]).alias("kinds"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [r.compiled() for r in rules]
        for batch in batches:
            ids, spans = [], []
            for i, text, kinds in zip(batch["doc_id"], batch["text"], batch["kinds"], strict=True):
                tried = everywhere | set(kinds if kinds is not None else ())
                found = sorted((s, k, e) for k, (r, c) in enumerate(zip(rules, compiled, strict=True)) if r.kind in tried for s, e in r.spans(text, c))
                if found:
                    ids.append(None if pd.isna(i) else int(i))
                    spans.append([{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in found])
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "spans": pd.Series(spans, dtype=object)})

    return rows.unionByName(loose).mapInPandas(streaming(run), "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame, base: tuple[str, ...] = tuple(r.kind for r in BASE)) -> DataFrame:
    """Per document: spans of each base kind, the sha-256 of the base spans' text, and all spans as text."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(text(own).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
