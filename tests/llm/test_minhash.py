import random
from collections import Counter

import numpy as np

from quern.llm import minhash as mh
from tests.conftest import frame

WORDS = [a + b for a in "bcdfghklm" for b in "aeiouy"]


def prose(g, n):
    return " ".join(g.choice(WORDS) + g.choice(WORDS) for _ in range(n))


def edit(g, text, k):
    w = text.split()
    for _ in range(k):
        w[g.randrange(len(w))] = prose(g, 1)
    return " ".join(w)


def bag(t):
    w = mh.WORD.findall(t.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter([t])


def exact(a, b):
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_signature_estimates_weighted_jaccard():
    g = random.Random(1)
    errors = []
    for _ in range(40):
        a = prose(g, 120) + (" " + prose(g, 8)) * g.randint(1, 9)
        b = edit(g, a, g.randint(0, 20))
        times = mh.registers(*mh.shingles([a, b]), 2)
        errors.append(float((times[0] == times[1]).mean()) - exact(a, b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_weights_count():
    times = np.concatenate([mh.registers(np.array([0, 0, 1, 1]), np.array([5, s, 5, s], np.uint64), np.array([3, 7, 6, 7]), 2) for s in range(100, 160)], axis=1)
    assert abs((times[0] == times[1]).mean() - 10 / 13) < 0.02


def brute_components(rows):
    parent = {i: i for i in range(len(rows))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a or "") == (b or "") or exact(a or "", b or "") >= mh.SIMILARITY:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted((d if d is not None else -1, min((x if x is not None else -1) for x in least[find(i)])) for i, (d, _) in enumerate(rows))


def test_overlaps():
    g = random.Random(3)
    texts = [prose(g, 40) for _ in range(5)]
    texts += [edit(g, t, 2) for t in texts] + [texts[0] + " " + texts[0], "", "a b", prose(g, 9000)]
    met = mh.Bags([mh.elements(t) for t in texts])
    others = ~np.eye(len(texts), dtype=bool)
    want = np.array([[exact(t, o) for o in texts] for t in texts])
    assert np.allclose(met.similarities(np.arange(len(texts)))[others], want[others])
    assert np.allclose(met.similarities(np.array([3, 11]))[others[[3, 11]]], want[[3, 11]][others[[3, 11]]])
    assert mh.links([], np.empty(0, int), np.empty(0, bool), np.empty(0, bool)) == []


def corpus(g):
    rows = [(i, prose(g, g.randint(30, 90))) for i in range(30)]
    base = prose(g, 150)
    rows += [(100 + i, edit(g, base, 3)) for i in range(25)] + [(150, base)]  # copies are closer to the base than to each other
    rows += [(200 + i, edit(g, rows[i][1], 1)) for i in range(12)] + [(300, rows[0][1]), (301, rows[0][1])]
    rows += [(400, ""), (401, None), (402, "..."), (403, "a b"), (404, "a b"), (None, "null id text here now"), (405, "x " * 2000)]
    return rows


def test_classes_against_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(7))
    for chunk in (1024, 8):
        monkeypatch.setattr(mh, "CHUNK", chunk)
        got = mh.classes(frame(spark, [(*r, 0) for r in rows], "doc_id long, text string, label int").repartition(3)).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["class_id"] if r["class_id"] is not None else -1) for r in got) == brute_components(rows)


def test_components_join_an_edge_in_few_rounds(spark, monkeypatch):
    """A round joins only the edges that are left, however long or dense the components are."""
    g = random.Random(23)
    names = [g.randbytes(16) for _ in range(700)]
    pairs = [(i, i + 1) for i in range(299)]  # a chain
    pairs += [(300, i) for i in range(301, 400)] + [g.sample(range(400, 640), 2) for _ in range(4000)]  # a star, a dense group
    pairs += [(i, i + 1) for i in range(640, 700, 2)]
    label = list(range(700))
    for _ in range(700):
        before = label[:]
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    want = {names[i]: min(names[j] for j in range(700) if label[j] == label[i]) for i in range(700)}
    written, cut = [], mh.cut
    monkeypatch.setattr(mh, "cut", lambda df, name, *more: written.append((name, out := cut(df, name, *more), out.count())) or out)
    edges = frame(spark, [(names[a], names[b]) for a, b in pairs], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["label"]) for r in mh.components(edges).collect()}
    assert got == want
    sizes = [n for name, _, n in written if name == "links"]
    assert len(sizes) > 1 and sizes[-1] == 0 and sum(sizes) < 1.5 * sizes[0]
    assert mh.components(edges.limit(0)).count() == 0


def family(g, n, clusters):
    """Texts around one template that are about 0.75 alike, and close copies of some of them."""
    base = prose(g, 200)
    rows = [edit(g, base, 3) for _ in range(n)]
    return rows + [edit(g, rows[i], 1) for i in range(clusters) for _ in range(3)]


def test_several_clusters_of_one_large_bucket(spark, monkeypatch):
    rows = list(enumerate(family(random.Random(17), 50, 8)))
    want = brute_components(rows)
    assert 5 < len({c for _, c in want}) < 55
    docs = frame(spark, rows, "doc_id long, text string").repartition(3)
    for chunk, size in ((1024, 1 << 30), (8, 20_000)):
        monkeypatch.setattr(mh, "CHUNK", chunk)
        monkeypatch.setattr(mh, "FAMILY_BYTES", size)
        assert sorted((r["doc_id"], r["class_id"]) for r in mh.classes(docs).collect()) == want


def test_columns_with_the_names_used_inside(spark):
    names = "row node first _own _node _first keys sig label text_1".split()
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in ((1, "a b c d e f g"), (2, "a b c d e f g"), (3, None))]
    docs = frame(spark, rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = mh.keep_one(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_keep_one(spark):
    rows = corpus(random.Random(7))
    docs = frame(spark, [(*r, 0) for r in [*rows, (5, rows[5][1])]], "doc_id long, text string, label int")
    out = mh.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out.collect()) == sorted({c for _, c in brute_components(rows)})
    assert mh.keep_one(frame(spark, [], "doc_id long, text string")).count() == 0


def test_copies_of_one_text(spark):
    """Many copies under ids of their own, under one id and without any leave one row, whatever the id's type."""
    rows = [(i, "a b c d e f g") for i in range(7, 60)] + [(7, "a b c d e f g")] * 40 + [(1, "h i j k l m n")] * 5 + [(2, None)] * 3
    for kind in ("int", "long"):
        out = mh.keep_one(frame(spark, rows, f"doc_id {kind}, text string").repartition(4))
        assert sorted(map(tuple, out.collect())) == [(1, "h i j k l m n"), (2, None), (7, "a b c d e f g")]
    out = mh.keep_one(frame(spark, [*rows, (None, rows[0][1]), (None, rows[0][1])], "doc_id int, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 7]
