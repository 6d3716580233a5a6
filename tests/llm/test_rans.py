import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from tokenizers import Tokenizer

from quern.llm import ans, bpe, rans
from tests.conftest import frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
CONTENT = bpe.load(PATH)
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = rans.Encoder(CONTENT)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000, ans.BLOCK_IDS, ans.BLOCK_IDS + 1, 3 * ans.BLOCK_IDS + 777])
@pytest.mark.parametrize("kind", ["skewed", "uniform", "constant"])
def test_segments_round_trip(n, kind):
    g = np.random.default_rng(n)
    ids = {"skewed": lambda: (g.pareto(1.0, n) * 3).astype(np.uint32) % 50257, "uniform": lambda: g.integers(0, 50257, n).astype(np.uint32), "constant": lambda: np.full(n, 7, np.uint32)}[kind]()
    p = ans.pack_segment(ids)
    assert (ans.unpack_segment(p["symbols"], p["frequencies"], p["blocks"]) == ids).all()
    assert sum(b["n"] for b in p["blocks"]) == n


def test_more_numbers_than_a_table_holds():
    ids = np.random.default_rng(1).permutation((1 << ans.SCALE) + 1).astype(np.uint32)
    p = ans.pack_segment(ids)
    assert (ans.unpack_segment(p["symbols"], p["frequencies"], p["blocks"]) == ids).all()
    assert (ans.unpack_segment(p["symbols"], p["frequencies"], p["blocks"][1:2]) == ids[ans.BLOCK_IDS : 2 * ans.BLOCK_IDS]).all()
    p["blocks"][0]["crc32"] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ans.unpack_segment(p["symbols"], p["frequencies"], p["blocks"])


def test_one_block_alone_and_checksum():
    ids = np.arange(3 * ans.BLOCK_IDS, dtype=np.uint32) % 999
    p = ans.pack_segment(ids)
    assert (ans.unpack_segment(p["symbols"], p["frequencies"], p["blocks"][1:2]) == ids[ans.BLOCK_IDS : 2 * ans.BLOCK_IDS]).all()
    p["blocks"][0]["crc32"] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ans.unpack_segment(p["symbols"], p["frequencies"], p["blocks"])


def test_size_is_near_the_entropy():
    ids = (np.random.default_rng(0).pareto(1.0, 500_000) * 3).astype(np.uint32) % 5000
    p = ans.pack_segment(ids)
    c = np.bincount(ids)
    c = c[c > 0] / len(ids)
    coded = sum(len(b["words"]) + len(b["states"]) for b in p["blocks"])
    assert coded < 1.02 * len(ids) * -(c * np.log2(c)).sum() / 8 + 8 * 512


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab'sdl 1\n\t!<|>endoftx²éß \x85\x1c͸՘", max_size=60), st.sampled_from(["a<|endoftext|>b", "<|endoftext|>", ""])))
def test_ids_are_the_librarys(text):
    assert ENCODER([text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_words_are_looked_up_once(monkeypatch):
    """A text's words are gone through once, and each distinct word is encoded once."""
    texts = ["the cat and the dog", "", "the dog's 12 cats<|endoftext|>the", "é² the"]
    encoder, packed = rans.Encoder(CONTENT), []
    split, pack = encoder.words.split, encoder.words.packed
    monkeypatch.setattr(encoder.words, "split", lambda t: iter(split(t)))
    monkeypatch.setattr(encoder.known, "pack", lambda w: (packed.append(w), pack([w])[0])[1], raising=False)
    assert [a.tolist() for a in encoder(texts + texts)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts + texts]
    assert sorted(packed) == sorted({w for t in texts for w in split(t)})


def test_tasks_of_a_worker_share_an_encoder(spark, monkeypatch):
    """What is remembered is found by name in the worker; it does not travel, empty, with each task."""
    sent, made, begin, streaming = [], [], rans.Encoder.__init__, rans.streaming
    monkeypatch.setattr(rans, "streaming", lambda run: streaming(sent.append(run) or run))
    rans.write(frame(spark, [(1, "some words")], "doc_id long, text string"), CONTENT, 2)
    monkeypatch.setattr(rans.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(rans.Encoder, "__init__", lambda self, content: (made.append(1), begin(self, content))[1])
    for text in ("some words", "more words"):
        task = cloudpickle.loads(cloudpickle.dumps(sent[0]))
        (out,) = task(iter([pd.DataFrame({"doc_id": [1], "text": [text]})]))
        assert out["n_ids"].tolist() == [1 + len(TOKENIZER.encode(text).ids)]
    assert len(made) == 1


def test_an_encoder_forgets_and_encodes_again(monkeypatch):
    monkeypatch.setattr(rans, "KNOWN", 5)
    encoder = rans.Encoder(CONTENT)
    for texts in (["a b c d"], ["e f g a b", "", "h <|endoftext|> i j k l m"], ["a b c d", "e f"]):
        assert [x.tolist() for x in encoder(texts)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_files(spark, monkeypatch):
    monkeypatch.setattr(rans, "SEGMENT_IDS", 50)
    rows = [(i * 7 % 101, f"text {i} of some words " * (i % 5)) for i in range(101)] + [(5, None), (5, "again"), (None, "no id")]
    docs = frame(spark, [(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(5)
    out = rans.read(spark, rans.write(docs, CONTENT, 2), with_ids=True).collect()
    assert len(out) == len(rows)
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids"][-1] == 2 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    ids = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    want = sorted((d if d is not None else -1, [*TOKENIZER.encode(t or "").ids, 2]) for d, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in out) == want


def test_empty(spark):
    assert rans.read(spark, rans.write(frame(spark, [], "doc_id long, text string"), CONTENT, 2)).count() == 0
