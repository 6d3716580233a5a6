import hashlib
from itertools import islice, product

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.accumulators import AccumulatorParam
from tokenizers import Tokenizer

from quern.llm import blocks, bpe
from tests.conftest import frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
CONTENT = bpe.load(PATH)
TOKENIZER = Tokenizer.from_file(PATH)
WORDS = bpe.Words(CONTENT)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab'sdl 1\n\t!<|>endoftx²éß \x85\x1c͸՘", max_size=60)))
def test_words_encode_as_the_library_does(text):
    got = [i for ids in WORDS.encode(WORDS.split(text)) for i in ids]
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


TEXTS = ["", None, "Hello world, it's 2 o'clock!\n\n  spaced", "a<|endoftext|>b <|endoftext|>", "é²  x \x00\x1c!", "the the the " * 5000, "same", "same", "x" * 5000]


def test_round_trip_and_nulls(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 1)]
    docs = frame(spark, rows, "doc_id long, text string, ids int").repartition(3)
    out = {r["doc_id"]: r for r in bpe.digest(bpe.decode(bpe.encode(bpe_input(spark, docs), CONTENT), CONTENT)).collect()}
    assert len(out) == len(rows)
    for i, t, _ in rows:
        ids = TOKENIZER.encode(t or "", add_special_tokens=False).ids
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_text_in_one_pass(spark):
    docs = bpe_input(spark, frame(spark, [(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in bpe.encode(docs, CONTENT, with_text=True).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


class Sizes(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return a + b


def bpe_input(spark, docs):
    from quern.llm.common import cut

    return cut(docs, "test-bpe")


def test_many_blocks(spark, monkeypatch):
    docs = frame(spark, [(i, f"word{i % 7} and more{i} text") for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 300)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(bpe_input(spark, docs), CONTENT).collect()}
    assert got == {i: TOKENIZER.encode(f"word{i % 7} and more{i} text").ids for i in range(200)}


def test_results_of_a_block_leave_in_small_batches(spark, monkeypatch):
    """A block's rows are not handed to Spark at once, whatever the order its cells come in."""
    sizes, streaming = spark.sparkContext.accumulator([], Sizes()), bpe.streaming
    docs = frame(spark, [(i, f"word{i % 7} and more{i} text") for i in range(200)] + [(200, "a b " * 300), (201, None)], "doc_id long, text string")

    def watched(run):
        def seen(batches):
            for out in run(batches):
                if "ids" in out:
                    sizes.add([(len(out), int(sum(map(len, out["ids"]))))])
                yield out

        return streaming(seen)

    monkeypatch.setattr(bpe, "streaming", watched)
    monkeypatch.setattr(bpe, "OUT_IDS", 100, raising=False)
    got = {r["doc_id"]: r["text"] for r in bpe.encode(docs.coalesce(1), CONTENT, with_text=True).collect()}
    assert got == {i: f"word{i % 7} and more{i} text" for i in range(200)} | {200: "a b " * 300, 201: ""}
    assert sum(n for n, _ in sizes.value) == 202 and all(ids <= 100 or n == 1 for n, ids in sizes.value)


def test_text_of_very_many_distinct_words(spark):
    """More distinct words in one text than a frequency table has room for."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join("".join(w) for w in islice(product(letters, repeat=5), (1 << 20) + 5))
    assert bpe.encode(bpe_input(spark, frame(spark, [(1, text)], "doc_id long, text string")), CONTENT, with_text=True).first()["text"] == text


def test_empty_table(spark):
    assert bpe.encode(frame(spark, [], "doc_id long, text string"), CONTENT).count() == 0


def test_word_table(spark):
    rows = bpe.word_table(frame(spark, [(1, "a b a"), (2, "b")], "doc_id long, text string"), CONTENT).collect()
    assert sorted(r["word"] for r in rows) == [" a", " b", "a", "b"]


@pytest.mark.parametrize("words", [[], [b"", b"a", b"\x00b"], [b"x" * 1000]])
def test_packing(words):
    assert blocks.unpack_words(blocks.pack_words(words)) == words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'sdl 1\n\t!<|>endoftx²éß\x1c\x85\xa0\u2003͸՘中", max_size=12), max_size=12))
def test_words_are_encoded_as_texts_of_their_own(texts):
    words = sorted({w for t in texts for w in WORDS.split(t)})
    assert WORDS.encode(words) == [TOKENIZER.encode(w, add_special_tokens=False).ids for w in words]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=40))
def test_latin_texts_are_split_as_the_library_does(text):
    assert bpe.LATIN.findall(text) == bpe.PATTERN.findall(text)
    assert [i for ids in WORDS.encode(WORDS.split(text)) for i in ids] == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_every_latin_character_is_split_as_by_its_class():
    for c in map(chr, range(0x250)):
        for text in (f"a{c}b", f" {c}1", f"{c}{c} {c}", f"1{c}", f"!{c} "):
            assert bpe.LATIN.findall(text) == bpe.PATTERN.findall(text), (c, text)
