"""Byte-level BPE by a distinct-word table.

Texts are split into words (the tokenizer's pre-tokens) in Spark; the distinct words of each block of documents
are dealt out by the word, each distinct word of the corpus is encoded once, and the ids return to their
block, where they are joined back to the words' positions. Decoding joins each id to its piece (the fixed
id-to-piece table of the tokenizer travels with the task) and concatenates the pieces' bytes.

The tokenizer's file is read by the driver and its content travels, so executors need no copy; it is never trained.

Nulls: a null text counts as empty and has no ids; a null doc_id is carried through. Repeated rows give one result row
each. Special tokens that stand in a text are ids of their own, as the tokenizers library has them.
"""

from __future__ import annotations

import json
import os
import pickle
import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import count, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import ans, blocks
from quern.llm.common import ready, streaming

# Fixed value: the pre-token expression of byte-level BPE (as in the public GPT-2 tokenizer).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same over ASCII, for the faster engine.
ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: The same over Latin letters up to U+024F, whose classes are written out, for the faster engine.
SPACE, LETTERS, NUMBERS = "\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
LATIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
NARROW = re.compile("[\x00-ɏ]*")
#: Characters whose classes are the same in every Unicode version in use; texts with others are split by the tokenizer itself.
SETTLED = re.compile("[\x00-ͷ΄-ԧ‐-⁣←-⏳぀-ゖ一-鿋]*")


def load(path: str) -> str:
    """The tokenizer's JSON, read by the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


#: A task forgets the ids of its words beyond so many; they are then encoded again where they come up.
KNOWN = 500_000
#: Characters of a block: larger ones repeat fewer distinct words in the shuffle.
BLOCK_CHARS = 8 << 20
#: Ids of a batch of results (about 2 MB with their text): a whole block's would be a batch of tens of MB, held several times over in the worker and the JVM.
OUT_IDS = 1 << 18


class Words:
    """Splitting and encoding with one tokenizer; made once per task."""

    def __init__(self, content: str):
        self.content = content
        self.special_ids = {t["content"]: t["id"] for t in json.loads(content).get("added_tokens", [])}
        special = sorted(self.special_ids, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    @cached_property
    def tokenizer(self):
        """Made only where something is encoded; splitting seldom needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.content)
        out.no_truncation()
        out.no_padding()
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII.findall(text)
        if NARROW.fullmatch(text):
            return LATIN.findall(text)
        if SETTLED.fullmatch(text):
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        if self.special and self.special.search(text):
            return [w for k, part in enumerate(self.special.split(text)) for w in ([part] if k % 2 else self._plain(part))]
        return self._plain(text)

    @cached_property
    def packer(self) -> Callable[[str], bytes]:
        """The ids of a word by itself, as 32-bit numbers; a text's ids are those of its words in order.

        Words are pre-tokens already, so their bytes' letters go straight to the library's model; special tokens have their own ids.
        """
        merge, own = self.tokenizer.model.tokenize, self.special_ids
        letters = {b: c for c, b in byte_of_letter().items()}
        number = [i.to_bytes(4, sys.byteorder) for i in range(1 + max(self.tokenizer.get_vocab().values(), default=-1))]

        def pack(word: str) -> bytes:
            if word in own:
                return number[own[word]]
            return b"".join([number[t.id] for t in merge(word.encode().decode("latin-1").translate(letters))])

        return pack

    def packed(self, words: list[str]) -> list[bytes]:
        return list(map(self.packer, words))

    def encode(self, words: list[str]) -> list[list[int]]:
        return [np.frombuffer(b, np.uint32).tolist() for b in self.packed(words)]


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def piece_table(content: str) -> list[bytes]:
    """The bytes of each id's piece."""
    letters, model = byte_of_letter(), json.loads(content)
    vocab = dict(model["model"]["vocab"]) | {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    return out


@lru_cache(1)
def piece_array(content: str) -> np.ndarray:
    """The id-to-piece table as an array: joining ids to it is one look-up by position."""
    pieces = piece_table(content)
    out = np.empty(len(pieces), dtype=object)
    out[:] = pieces
    return out


def text_of(ids, pieces: np.ndarray) -> str:
    return b"".join(pieces[np.asarray(ids, dtype=np.int64)].tolist()).decode("utf-8", "replace")


def numbered(words: Words, texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(numbers of all words in order, words of each text, distinct words by bucket and alphabet, bucket of each)."""
    first_seen: dict[str, int] = defaultdict(count().__next__)
    numbers = [np.fromiter(map(first_seen.__getitem__, s), np.uint32, len(s)) for s in map(words.split, texts)]
    names = [w.encode() for w in first_seen]
    bucket = np.fromiter(map(zlib.crc32, names), np.uint32, len(names)) % n
    # neighbours in the alphabet share letters and pieces, which makes cells smaller
    order = pc.sort_indices(pa.table({"bucket": bucket, "name": pa.array(names, pa.binary())}), sort_keys=[("bucket", "ascending"), ("name", "ascending")]).to_numpy()
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    flat = place[np.concatenate(numbers)] if len(names) else np.empty(0, np.uint32)
    return flat, np.fromiter(map(len, numbers), np.uint32, len(numbers)), [names[i] for i in order], bucket[order]


def assembled(block: list[bytes], content: str, with_text: bool, most: int) -> Iterator[pd.DataFrame]:
    """The rows of one block (its numbers, then its cells by bucket), ``most`` ids at a time or one longer text."""
    first, *cells = map(blocks.split, block)
    doc_ids, lengths = blocks.unpack_ids(first[0]), blocks.unpack(first[1], np.uint32)
    seq = np.empty(0, np.uint32)
    if cells:
        coded = pickle.loads(first[2])
        seq = ans.unpack_segment(coded["symbols"], coded["frequencies"], coded["blocks"])
    counts = np.concatenate([blocks.unpack(c[0], np.uint32) for c in cells]).astype(np.int64) if cells else np.empty(0, np.int64)
    flat = np.concatenate([blocks.unpack_small(c[1]) for c in cells]).astype(np.int32) if cells else np.empty(0, np.int32)
    starts = np.cumsum(counts) - counts
    pieces = piece_array(content) if with_text else None
    docs, out, held, at = [], [], 0, 0

    def close() -> pd.DataFrame:
        frame = pd.DataFrame({"doc_id": pd.array(docs, dtype="Int64"), "ids": out})
        return frame.assign(text=pd.Series([text_of(i, pieces) for i in out], dtype=object)) if with_text else frame

    for doc, k in zip(doc_ids, lengths.tolist(), strict=True):
        s = seq[at : at + k]
        at += k
        c = counts[s]
        shift = np.repeat(starts[s] - (np.cumsum(c) - c), c)
        if docs and held + len(shift) > most:
            yield close()
            docs, out, held = [], [], 0
        docs.append(doc)
        out.append(flat[shift + np.arange(len(shift))])
        held += len(shift) + 16
    if docs:
        yield close()


def encode(documents: DataFrame, content: str, with_text: bool = False) -> DataFrame:
    """doc_id, ids: array of int, of every row; the texts are read and split once. ``with_text``: also the text decoded from the ids.

    A block's word numbers (rANS-coded) and its cells of distinct words leave the scan together. Cells are dealt out by
    the words' hash, so that each distinct word is encoded in one place, and meet the numbers again by the block.
    """
    spark = ready(documents.sparkSession)
    n = blocks.buckets(spark, documents)

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(content)
        for name, ids, texts in blocks.of_rows(batches, BLOCK_CHARS):
            flat, lengths, names, bucket = numbered(words, texts, n)
            coded = [flat.tobytes()] if not len(flat) else [pickle.dumps(ans.pack_segment(flat))]
            rows = [(zlib.crc32(name.encode()) % n, -1, blocks.join([blocks.pack_ids(ids), blocks.pack(lengths), *coded]))]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
                if z > a:
                    rows.append((int(bucket[a]), int(bucket[a]), blocks.pack_words(names[a:z])))
            yield pd.DataFrame(rows, columns=["target", "bucket", "data"]).assign(block=name)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, known = Words(content), {}
        for batch in batches:
            out = []
            for bucket, data in zip(batch["bucket"], batch["data"], strict=True):
                if bucket < 0:
                    out.append(data)
                    continue
                cell = blocks.unpack_words(data)
                if len(known) > KNOWN:
                    known.clear()
                new = [w for w in cell if w not in known]
                known.update(zip(new, words.packed([w.decode() for w in new]), strict=True))
                ids = [known[w] for w in cell]
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                out.append(blocks.join([blocks.pack(lengths), blocks.pack_small(np.frombuffer(b"".join(ids), np.uint32))]))
            yield pd.DataFrame({"block": batch["block"], "bucket": batch["bucket"], "data": out})

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(batch["block"], batch["data"], strict=True))
        for _, block in groupby(rows, itemgetter(0)):
            yield from assembled([data for _, data in block], content, with_text, OUT_IDS)

    leaving = blocks.text_rows(documents).mapInPandas(streaming(distinct), "target int, bucket int, data binary, block string")
    back = leaving.repartition(n, "target").mapInPandas(streaming(encoded), "block string, bucket int, data binary")
    together = back.repartition("block").sortWithinPartitions("block", "bucket")
    return together.mapInPandas(streaming(assemble), "doc_id long, ids array<int>" + ", text string" * with_text)


def word_table(documents: DataFrame, content: str) -> DataFrame:
    """word, ids: every distinct word of the corpus, encoded once."""
    ready(documents.sparkSession)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(content)
        for batch in batches:
            yield pd.DataFrame({"word": sorted(set().union(*map(words.split, batch["text"])))}, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(content)
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "ids": [np.array(i, np.int32) for i in words.encode(batch["word"].tolist())]})

    return blocks.text_rows(documents).mapInPandas(streaming(split), "word string").distinct().mapInPandas(streaming(run), "word string, ids array<int>")


def decode(encoded: DataFrame, content: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids) and their text: every id is joined to its piece where the rows are."""
    ready(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = piece_array(content)
        for batch in batches:
            texts = [text_of(i, pieces) for i in batch["ids"]]
            yield batch[["doc_id", "ids"]].assign(doc_id=batch["doc_id"].astype("Int64"), text=texts)

    return encoded.select("doc_id", "ids").mapInPandas(streaming(run), "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
