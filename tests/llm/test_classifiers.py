import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from quern.llm import quality, toxicity
from tests.conftest import frame

SF1 = "/root/testdata/sf0.1"
WORDS = [a + b for a in "bcdfghklm" for b in "aeiouy"]


def prose(g, n):
    return " ".join(g.choice(WORDS) + g.choice(WORDS) + ("." if g.random() < 0.1 else "") for _ in range(n))


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    pos = order[labels == 1]
    n1, n0 = len(pos), len(labels) - len(pos)
    return (pos.sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.93), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    got = module.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(got["score"].to_numpy(), got[label].to_numpy()) > least
    assert (got["predicted"] == got[label]).mean() > 0.96
    if label == "quality":  # a filter keeps clean documents
        assert got[got["quality"] == 1]["predicted"].mean() > 0.99


def test_hold_out_rule(spark):
    docs = frame(spark, [(i, "some text") for i in range(50)], "doc_id long, text string")
    out = toxicity.classify(docs, frame(spark, [], "doc_id long, toxic int")).collect()
    assert {r["doc_id"]: r["held_out"] for r in out} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_sentences_are_located(spark):
    g = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        sentences = [prose(g, 12) + "." for _ in range(6)]
        if bad:
            sentences[3] = prose(g, 5) + " vilest " + prose(g, 5) + "."
        rows.append((i, "\n".join(sentences)))
        labels.append((i, int(bad)))
    docs, lab = frame(spark, rows, "doc_id long, text string"), frame(spark, labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    for r in toxicity.score(docs, model).collect():
        text = rows[r["doc_id"]][1]
        assert (r["score"] >= 0.5) == (r["doc_id"] % 3 == 0)
        for s in r["offending"]:
            assert "vilest" in text[s["start"] : s["end"]]
    assert toxicity.keep(docs, model).count() == sum(1 for _, y in labels if not y)


def test_noisy_or_by_hand():
    m = toxicity.Model({"bad": 3.0, "wor": 0.5, "wors*": 1.0}, -2.0)
    p = lambda z: 1 / (1 + np.exp(-z))
    score, spans = m.document("all fine here. bad bad thing! worst of it")
    assert score == pytest.approx(1 - (1 - p(-2)) * (1 - p(4)) * (1 - p(-1)))
    assert [("all fine here. bad bad thing!"[a:b].strip()) for a, b, _ in spans] == ["bad bad thing!"]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(spark, module):
    label = "toxic" if module is toxicity else "quality"
    g = random.Random(1)
    rows = [(i, prose(g, 40) if i % 2 else "%%% ### " * 30 + "vile") for i in range(200)]
    labels = [(i, i % 2 if label == "quality" else 1 - i % 2) for i in range(200)] + [(5, None), (None, 1), (5, 0)]
    edge = [(1000, ""), (1001, None), (1002, "x" * 100_000), (None, "no id"), (3, "again"), (3, "again")]
    docs = frame(spark, [(*r, 9.0) for r in rows + edge], "doc_id long, text string, score double")
    lab = frame(spark, labels, f"doc_id long, {label} int")
    out = module.classify(docs, lab).collect()
    assert len(out) == len(rows) + len(edge)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= (0.5 if label == "toxic" else 0.3)) for r in out)
    assert {r["score"] for r in out if r["doc_id"] in (1000, 1001)} == {next(r["score"] for r in out if r["doc_id"] == 1000)}
    assert module.classify(docs.limit(0), lab).count() == 0
    assert {round(r["score"], 6) for r in module.classify(docs, lab.limit(0)).collect()} == {0.5 if label == "quality" else 0.0}


def test_blocks_cover_whole_texts():
    data = bytes(range(256)) * 40
    assert b"".join(quality.blocks(data, 1000)) == data


def test_logistic_recovers_a_curve():
    g = np.random.default_rng(0)
    x = g.normal(size=(20_000, 2))
    y = (g.random(20_000) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(float)
    assert quality.logistic(x, y) == pytest.approx([0.5, 1.0, -2.0], abs=0.15)


def plain_training(bags, y, epochs, rate=0.3, ridge=2e-5):
    """The same fit in plain loops over dictionaries: the gradient of the noisy-or likelihood, term by term."""
    counts = {}
    for bag in bags:
        for words in bag:
            for w in words:
                for f in toxicity.features(w):
                    counts[f] = counts.get(f, 0) + 1
    names = [f for f, c in counts.items() if c >= 4]
    weights, bias = dict.fromkeys(names, 0.0), -4.0
    m, v = dict.fromkeys([*names, None], 0.0), dict.fromkeys([*names, None], 0.0)
    for step in range(1, epochs + 1):
        g = {f: -ridge * weights[f] * len(y) for f in names} | {None: 0.0}
        for bag, label in zip(bags, y, strict=True):
            p = [1 / (1 + np.exp(-(bias + sum(weights.get(f, 0.0) for w in words for f in toxicity.features(w))))) for words in bag]
            none = np.prod([1 - x for x in p])
            for x, words in zip(p, bag, strict=True):
                up = x * none / (1 - none) if label else -x
                g[None] += up
                for w in words:
                    for f in toxicity.features(w):
                        if f in weights:
                            g[f] += up
        for f in g:
            x = g[f] / len(y)
            m[f], v[f] = 0.9 * m[f] + 0.1 * x, 0.99 * v[f] + 0.01 * x * x
            move = rate * (m[f] / (1 - 0.9**step)) / (np.sqrt(v[f] / (1 - 0.99**step)) + 1e-8) * min(1.0, 2 * (1 - step / (epochs + 1)))
            if f is None:
                bias += move
            else:
                weights[f] += move
    return weights, bias


def test_training_against_plain_gradients():
    g = random.Random(8)
    bags = [[prose(g, g.randint(2, 9)).replace(".", "").split() + ["vilest"] * (d % 3 == 0 and s == 1) for s in range(3)] for d in range(40)]
    y = np.array([float(d % 3 == 0) for d in range(40)])
    model = toxicity.train(bags, y, epochs=12)
    weights, bias = plain_training(bags, y, 12)
    assert model.bias == pytest.approx(bias, rel=1e-6)
    assert set(model.weights) == {f for f, x in weights.items() if abs(x) > 1e-4}
    assert all(model.weights[f] == pytest.approx(weights[f], rel=1e-5, abs=1e-7) for f in model.weights)


def test_toxicity_query_against_brute_force(spark):
    """The whole of classify by plain Python: the rows it may learn from, the fit, sentence scores, the noisy-or."""
    g = random.Random(9)
    rows = [(i, "\n".join(prose(g, 8) + (" vilest" if i % 4 == 0 and s == 1 else "") + "." for s in range(3))) for i in range(60)]
    labels = [(i, int(i % 4 == 0)) for i in range(50)]
    docs, lab = frame(spark, rows, "doc_id long, text string").repartition(3), frame(spark, labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, lab).collect()}
    split = lambda t: [w for w in ([x for x in re.findall(r"\w+", s.lower())] for s in re.findall(r"[^.!?\n]+[.!?]*", t)) if w]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows}
    learn = [(split(t), float(i % 4 == 0)) for i, t in rows if i < 50 and not held[i]]
    weights, bias = plain_training([b for b, _ in learn], [y for _, y in learn], 150)
    for i, t in rows:
        z = [bias + sum(weights.get(f, 0.0) for w in words for f in toxicity.features(w)) for words in split(t)]
        score = 1 - np.prod([1 - 1 / (1 + np.exp(-x)) for x in z])
        assert got[i]["score"] == pytest.approx(score, abs=2e-3) and got[i]["held_out"] == held[i] and got[i]["predicted"] == (got[i]["score"] >= 0.5)


def test_quality_query_against_brute_force(spark):
    """The whole of classify by plain Python: dictionaries of every other text, sizes by zstandard itself, a curve at which the gradient vanishes."""
    g = random.Random(10)
    rows = [(i, prose(g, 200) if i % 2 else "".join(g.choice("%#! x1") for _ in range(900))) for i in range(120)]
    docs, lab = frame(spark, rows, "doc_id long, text string").repartition(3), frame(spark, [(i, i % 2) for i in range(100)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, lab).collect()}
    learn = [(i, t) for i, t in rows if i < 100 and zlib.crc32(str(i).encode()) % 5]
    half = {y: [t.encode() for i, t in learn if i % 2 == y] for y in (0, 1)}
    cut = lambda data: [data[i : i + 2048] for i in range(0, len(data), 2048)]

    def dictionary(texts):
        samples = [b for t in texts[::2] for b in cut(t)]
        try:
            return zstandard.train_dictionary(64 << 10, samples, level=3).as_bytes()
        except zstandard.ZstdError:
            return b"".join(samples)[-(64 << 10) :]

    coders = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary(half[y])), write_content_size=False, write_dict_id=False) for y in (1, 0)]

    def inputs(data):
        good, bad = (sum(len(c.compress(b)) for b in cut(data)) for c in coders)
        d, r = (bad - good) / len(data), (good + bad) / (2 * len(data))
        return [d, r, r * r, d * r]

    held = [(t, y) for y in (0, 1) for t in half[y][1::2]]
    x, y = np.array([inputs(t) for t, _ in held]), np.array([y for _, y in held], float)
    model = quality.fit(docs, lab)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-9))
    a = np.c_[np.ones(len(x)), (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)]
    w = np.array(model.coef)
    p = 1 / (1 + np.exp(-a @ w))
    assert np.abs(a.T @ (p - y) / len(y) + 1e-3 * np.r_[0, w[1:]]).max() < 1e-6
    for i, t in rows:
        z = w[0] + (np.array(inputs(t.encode())) - x.mean(0)) / np.maximum(x.std(0), 1e-9) @ w[1:]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)
