import random

import numpy as np

from quern.llm import decontam as dc
from tests.conftest import frame

WORDS = [a + b for a in "bcdfghklm" for b in "aeiouy"]


def prose(g, n):
    return " ".join(g.choice(WORDS) + g.choice(WORDS) for _ in range(n))


def slow_align(a, b):
    best, h = 0, [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            s = dc.MATCH if a[j - 1] == b[i - 1] else dc.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment():
    g = random.Random(0)
    for _ in range(200):
        a, b = ([g.randint(0, 4) for _ in range(g.randint(1, 15))] for _ in range(2))
        assert dc.align(np.array(a), np.array(b))[0] == slow_align(a, b)


def setup(g):
    items = [(i, prose(g, g.randint(12, 40))) for i in range(12)] + [(50, "the"), (51, ""), (53, "Zeta!"), (54, "zeta, theta"), (55, "theta zeta"), (52, None), (None, prose(g, 20))]
    docs = [(i, prose(g, 150)) for i in range(40)]
    for k in range(12):
        w = items[k][1].split()
        for _ in range(len(w) // 8):
            w[g.randrange(len(w))] = prose(g, 1)
        if k % 3 == 0:
            del w[len(w) // 2]
        head, tail = prose(g, 60), prose(g, 70)
        docs.append((100 + k, f"{head} {' '.join(w).upper()}, {tail}"))
    return items, [*docs, (200, items[0][1]), (201, items[0][1]), (202, ""), (203, None), (None, items[1][1]), (204, prose(g, 20000)), (205, "one zeta"), (206, "zeta theta " + prose(g, 50)), (207, "zeta"), (208, "zeta one theta")]


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, q in items:
            a, b = dc.words_of(t or ""), dc.words_of(q or "")
            if i is not None and 0 < len(b) < dc.N and any(a[k : k + len(b)] == b for k in range(len(a))):
                out.add((d, i))
            if i is not None and len(b) >= dc.N and len(a) < 5000 and slow_align(a, b) >= dc.THRESHOLD * dc.MATCH * len(b):
                out.add((d, i))
    return out


def test_against_brute_force(spark, monkeypatch):
    items, docs = setup(random.Random(3))
    d, b = frame(spark, [(*r, 0) for r in docs], "doc_id long, text string, item_id int").repartition(3), frame(spark, items, "item_id long, text string")
    want = brute(docs, items)
    assert {(100 + k, k) for k in range(12)} | {(205, 53), (206, 54), (207, 53)} <= want
    for most in (dc.PART_SEEDS, 60):
        monkeypatch.setattr(dc.parts, "__defaults__", (most,))
        assert {(r["doc_id"], r["item_id"]) for r in dc.find(d, b).collect()} == want
        left = dc.clean(d, b)
        assert left.columns == d.columns
        assert {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_hot_item_is_found(spark):
    g = random.Random(4)
    item = prose(g, 25)
    docs = frame(spark, [(i, prose(g, 20) + " " + item) for i in range(50)], "doc_id long, text string")
    assert dc.find(docs, frame(spark, [(1, item)], "item_id long, text string")).count() == 50


def test_edited_hot_item_is_found(spark):
    """Words 3 and 8 of 12 replaced: 6 of the 10 seeds occur nowhere, the other 4 in more than 0.1 % of the documents."""
    g = random.Random(5)
    item = prose(g, 12)
    w = item.split()
    w[3], w[8] = "xx", "yy"
    for copies, others in ((50, 100), (5, 1500)):
        docs = frame(spark, [(i, prose(g, 20) + (" " + " ".join(w) if i < copies else "")) for i in range(copies + others)], "doc_id long, text string")
        found = dc.find(docs, frame(spark, [(1, item)], "item_id long, text string")).collect()
        assert {(r["doc_id"], r["score"]) for r in found} == {(i, 0.75) for i in range(copies)}
        assert dc.clean(docs, frame(spark, [(1, item)], "item_id long, text string")).count() == others


def test_pair_with_a_shared_seed_is_aligned_everywhere():
    """The passage itself keeps no seed, the one shared seed stands far from it; insertions all before the first kept words."""
    g = random.Random(6)
    words = prose(g, 20).split()
    items = dc.Items([(1, " ".join(words))])
    edited = [w if k % 3 else "zz" for k, w in enumerate(words)]
    text = " ".join([*edited, *prose(g, 400).split(), *words[:3]])
    numbers, shared = items.hits(text)
    assert shared == [0]
    assert slow_align(dc.words_of(text), words) == dc.align(numbers, items.words[0])[0] >= dc.THRESHOLD * dc.MATCH * 20
    assert [i for i, *_ in dc.matches(numbers, shared, items)] == [1]


def test_bounds_lose_no_alignment():
    g = random.Random(7)
    for _ in range(300):
        item, text = ([g.choice("abcdefgh") for _ in range(n)] for n in (g.randint(3, 12), g.randint(1, 80)))
        items = dc.Items([(1, " ".join(item))])
        numbers, shared = items.hits(" ".join(text))
        best = slow_align(text, item) / (dc.MATCH * len(item))
        assert [(i, s) for i, s, _ in dc.matches(numbers, shared, items)] == ([(1, best)] if shared and best >= dc.THRESHOLD else [])


def test_short_items_alone(spark):
    docs, items = frame(spark, [(1, "a b a b"), (2, "b a"), (3, None)], "doc_id long, text string"), frame(spark, [(1, "A b"), (2, "c")], "item_id long, text string")
    assert [tuple(r) for r in dc.find(docs, items).collect()] == [(1, 1, 1.0, 2)]
    assert sorted(r["doc_id"] for r in dc.clean(docs, items).collect()) == [2, 3]


def test_empty(spark):
    docs, none = frame(spark, [(1, "a b c")], "doc_id long, text string"), frame(spark, [], "item_id long, text string")
    assert dc.find(docs, none).count() == 0 and dc.clean(docs, none).count() == 1
    assert dc.find(docs.limit(0), frame(spark, [(1, "a b c d")], "item_id long, text string")).count() == 0
