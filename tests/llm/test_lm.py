import math
import random
from collections import Counter
from itertools import islice, product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import lm
from tests.conftest import frame


def brute(rows):
    """(n_tokens, n_known, N, base, score) by the definition, with plain dictionaries; also the model."""
    toks = [(i, lm.tokens(t or "")) for i, t in rows]
    uni, bi, hist = Counter(), Counter(), Counter()
    for i, t in toks:
        if not lm.is_held_out(i):
            uni.update(t)
            for a, b in zip([lm.END, *t], t):
                bi[a, b] += 1
                hist[a] += 1
    assert hist == uni
    of = lambda c: [0] + [sum(v == r for v in c.values()) for r in range(1, lm.K + 2)]
    d1, d2 = lm.discounts(of(uni)), lm.discounts(of(bi))
    disc = lambda c, d: c if c > lm.K else d[c] * c
    n = sum(uni.values())
    mass = sum(disc(c, d1) for c in uni.values())
    over = n + (mass >= n * (1 - 1e-12)) if n else 1
    unk = 1 - mass / over if n else 1.0
    p = lambda w: disc(uni[w], d1) / over if uni[w] else unk
    after = {}
    for (a, b), c in bi.items():
        s = after.setdefault(a, [0.0, 0.0])
        s[0] += disc(c, d2)
        s[1] += p(b)

    def prob(a, b):
        if a not in after:
            return p(b)
        total = hist[a] + (after[a][0] >= hist[a] * (1 - 1e-12))
        return disc(bi[a, b], d2) / total if bi[a, b] else (1 - after[a][0] / total) / (1 - after[a][1]) * p(b)

    out = []
    for i, t in toks:
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (len(uni) + 1))) for w in t)
        out.append((i if i is not None else -1, len(t), sum(uni[w] > 0 for w in t), n, base, sum(math.log10(prob(a, b)) for a, b in zip([lm.END, *t], t))))
    return sorted(out), prob, uni, after


def corpus(g, n=120):
    words = [f"w{int(g.paretovariate(0.8))}" for _ in range(4000)]
    rows = [(i, " ".join(g.choice(words) for _ in range(g.randint(0, 60)))) for i in range(n)]
    return rows + [(500, ""), (501, None), (None, "W1 w2\tÉCOLE w1"), (502, "the " * 400), (503, "same same"), (503, "same same"), (504, "x" * 3000)]


@pytest.mark.parametrize("chars", [lm.BLOCK_CHARS, 700])
def test_against_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(lm, "BLOCK_CHARS", chars)
    rows = corpus(random.Random(2))
    docs = frame(spark, [(*r, 0) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.score_corpus(docs).collect())
    want, _, _, _ = brute(rows)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5], rel=1e-9)


def test_scans_may_be_split_otherwise_later(spark, tmp_path):
    rows = corpus(random.Random(4))
    frame(spark, rows, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/d")
    docs = spark.read.parquet(f"file://{tmp_path}/d")
    old = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "12")
        model = lm.fit(docs)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["score"]) for r in lm.score(model).collect())
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if old is None else spark.conf.set("spark.sql.files.minPartitionNum", old)
    for a, b in zip(got, brute(rows)[0], strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[5], rel=1e-9)


def test_written_tables_are_normalised(spark):
    """After every history of the written tables, the probabilities of all known words and of the unknown event add up to 1."""
    model = lm.fit(frame(spark, corpus(random.Random(2)), "doc_id long, text string"))
    counts = {}
    for r in model.words.where("kind = 'model'").collect():
        words, own = lm.blocks.split(r["data"])
        counts |= {k * model.n + r["bucket"]: c for k, c in enumerate(lm.blocks.unpack(own, lm.np.int64).tolist())}
    p = {i: float(model.unigrams.p(lm.np.array([c]))[0]) for i, c in counts.items()}
    assert sum(p.values()) + model.unigrams.unknown == pytest.approx(1, abs=1e-12)
    seen, of = {}, {}
    for r in model.pairs.where("kind = 'model'").collect():
        one, of_one, runs, two, _, c = (x.tolist() for x in lm.unpack_pairs(r["bucket"], model.n, r["data"]))
        at = 0
        for h, n, k in zip(one, of_one, runs, strict=True):
            of[h] = n
            seen.setdefault(h, {}).update(zip(two[at : at + k], c[at : at + k], strict=True))
            at += k
    weights = dict(model.wide)
    for r in model.weights.where("kind = 'alpha'").collect():
        ids, alpha, more = lm.blocks.split(r["data"])
        weights |= dict(zip(lm.blocks.unpack(ids, lm.np.int64).tolist(), zip(lm.blocks.unpack(alpha, lm.np.float64).tolist(), lm.blocks.unpack(more, lm.np.int64).tolist(), strict=True), strict=True))
    assert set(weights) == set(seen) and model.wide
    for h, after in seen.items():
        alpha, more = weights[h]
        total = sum(lm.discounted(lm.np.array(list(after.values())), model.d)) / (of[h] + more)
        total += alpha * (sum(x for i, x in p.items() if i not in after) + model.unigrams.unknown)
        assert total == pytest.approx(1, abs=1e-9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50), st.integers(0, 2**40)), max_size=40), st.integers(1, 9), st.integers(0, 8))
def test_cells_of_pairs_round_trip(rows, n, bucket):
    bucket %= n
    rows = sorted({(a, b): c for a, b, c in rows}.items())
    one, two, c = (lm.np.array(x, lm.np.int64) for x in ([a for (a, _), _ in rows], [b for (_, b), _ in rows], [c for _, c in rows]))
    history, runs = lm.np.unique(one, return_counts=True)
    cell = (history, history * 7, runs, two, two * 3, c)
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(lm.unpack_pairs(bucket, n, lm.pack_pairs(bucket, n, *cell)), cell, strict=True))


def test_probabilities_add_up():
    _, prob, uni, after = brute(corpus(random.Random(2)))
    for a in [*after, b"never seen"]:
        assert sum(prob(a, b) for b in [*uni, b"unknown word"]) == pytest.approx(1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBc \t\n\v\f\r\x1c\x85\xa0É\u2003", max_size=20), min_size=1, max_size=6))
def test_numbering_follows_the_tokens(texts):
    flat, lengths, names, bucket = lm.numbered(texts, 7)
    names = names.to_pylist()
    assert [names[i] for i in flat] == [w for t in texts for w in lm.tokens(t)]
    assert lengths.tolist() == [len(lm.tokens(t)) for t in texts] and sorted(bucket.tolist()) == bucket.tolist()


def test_hashes_depend_on_the_bytes_alone():
    import pyarrow as pa

    words = [b"a", b"", b"ab", b"ba", b"a", b"a\0", b"\0", "é".encode()]
    h = lm.hashes(pa.array(words, pa.binary())).tolist()
    assert h[0] == h[4] and len(set(h)) == 7
    assert lm.hashes(pa.array(words[::-1], pa.binary())).tolist() == h[::-1]
    assert lm.hashes(pa.array(words, pa.binary()).slice(2, 3)).tolist() == h[2:5]


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert lm.score_corpus(frame(spark, [], schema)).count() == 0
    held = next(i for i in range(100) if lm.is_held_out(i))
    r = lm.score_corpus(frame(spark, [(held, "a b")], schema)).collect()[0]
    assert (r["held_out"], r["n_known"], r["train_tokens"], r["score"]) == (True, 0, 0, 0.0)


def test_text_of_very_many_distinct_words(spark):
    """More distinct words in one text than a frequency table has room for."""
    text = " ".join("".join(w) for w in islice(product("abcdefghijklmnopqrstuvwxyz", repeat=5), (1 << 20) + 5))
    assert lm.score_corpus(frame(spark, [(1, text)], "doc_id long, text string")).count() == 1
