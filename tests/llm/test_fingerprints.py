import hashlib
import random

from quern.llm import fingerprints as fp
from tests.conftest import SF, frame

WORDS = "the of and lorem ipsum dolor sit amet élan straße consectetur adipiscing sed do".split()


def text(seed, n=400):
    g = random.Random(seed)
    return " ".join(g.choice(WORDS) + g.choice("abcdefgh") * g.randint(0, 2) for _ in range(n))


def slow_fingerprint(t):
    """The walk step by step."""
    table, j, wrote = fp.stays(), 0, []
    for ch in t:
        c = (ord(ch) * 2654435761 % 2**32) >> 26
        stay = int(table[c * fp.PERIOD + j % fp.PERIOD])
        wrote += [ord(ch)] * stay
        j += stay
    if not t:
        return "0:"
    level = max(0, (len(wrote) - 1).bit_length() - fp.MOST.bit_length() + 1)
    kept = [wrote[q] for q in fp.steps(level).tolist() if q < len(wrote)]
    return f"{level}:" + bytes(int(fp.mix([c])[0]) & 255 for c in kept).hex()


def test_against_the_plain_walk():
    texts = ["", "a", "ab" * 3, text(1, 5), text(2, 80), text(3), "é" * 500]
    assert fp.fingerprints(texts) == [slow_fingerprint(t) for t in texts]


def test_likeness():
    near, next_, half = [], [], []
    for seed in range(30):
        a, b = text(seed), text(seed + 1000)
        f = fp.fingerprints([a, a[:700] + "X" + a[700:], b, fp.edited(a, b), a])
        assert f[0] == f[4] and fp.likeness(f[0], f[0]) == 1
        near.append(fp.likeness(f[0], f[1]))
        next_.append(fp.likeness(f[0], f[2]))
        half.append(fp.likeness(f[0], f[3]))
    assert sorted(near)[3] > 0.9 and max(next_) < 0.3
    assert all(0.35 < x < 0.8 for x in half)


def brute(rows):
    rows = sorted(rows)
    out = {}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        own, new, nxt = (slow_fingerprint(x) for x in (t, e, after))
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), own, new, fp.likeness(own, new), fp.likeness(own, nxt))
    return out


def test_chain(spark, monkeypatch):
    monkeypatch.setattr(fp, "LOCKSTEP", 2000)
    rows = [(i * 13 % 97, text(i, i % 30)) for i in range(97)] + [(200, "")]
    docs = frame(spark, [(i, t or None, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in fp.chain(docs).collect()}
    assert got == brute(rows)


def test_chain_edges(spark):
    schema = "doc_id long, text string"
    assert fp.chain(frame(spark, [], schema)).count() == 0
    one = fp.chain(frame(spark, [(1, "abcd")], schema)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fp.chain(frame(spark, [(1, "abcd"), (1, "abcd"), (None, "x"), (1, None)], schema)).count() == 4


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    g = random.Random(3)
    for _ in range(200):
        a, b = ("".join(g.choice("ab") for _ in range(g.randint(0, 12))) for _ in range(2))
        k = g.randint(0, 12)
        assert fp.edit_distance(a, b, k) == min(slow_distance(a, b), k + 1)


def test_edit_distance_of_long_texts():
    a = text(1, 3000)
    b = a[:5000] + "xyz" + a[5001:9000] + a[9050:]
    assert fp.edit_distance(a, b, 100) == fp.edit_distance(b, a, 100) == 53
    assert fp.edit_distance(a, b, 52) == 53 and fp.edit_distance(a, a, 0) == 0 and fp.edit_distance("", "ab", 5) == 2


def test_long_texts_walk_alone(monkeypatch):
    texts = [text(i, n) for i, n in enumerate((3, 700, 1, 2000, 40, 40, 900))] + [""]
    want = [slow_fingerprint(t) for t in texts]
    for alone in (0, 1, 2, 3, 5, 100):
        monkeypatch.setattr(fp, "ALONE", alone)
        assert fp.fingerprints(texts) == want


def test_a_very_long_text():
    import time

    t = text(5, 3000) * 70
    began = time.time()
    f = fp.fingerprints([t, t[: len(t) // 2] + "x" + t[len(t) // 2 :]])
    assert len(t) > 1_000_000 and time.time() - began < 10 and fp.likeness(*f) > 0.5


def brute_classes(rows, most):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            k = int(most * max(len(a or ""), len(b or "")))
            if (a or "") == (b or "") or a and b and fp.edit_distance(a, b, k) <= k:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return {d: None if None in least[find(i)] else min(least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_near_classes(spark, monkeypatch):
    from quern.llm import minhash

    rows = [(i, text(i, 150)) for i in range(20)]
    rows += [(100 + i, t[:300] + "!" + t[301:600] + t[602:]) for i, t in rows[:10]] + [(300, rows[0][1]), (301, ""), (302, None), (None, "x"), (303, "x"), (304, "y")]
    head = text(99, 120)  # a hot group: texts that share most of their beginning, and pairs among them that are near only each other
    rows += [(400 + i, head + text(2000 + i // 2, 60) + ("." if i % 2 else "")) for i in range(60)]
    want = brute_classes(rows, fp.NEAR)
    assert want[300] == 0 and sum(want[400 + i] == 400 + i - i % 2 for i in range(60)) == 60
    for chunk in (1024, 16):
        monkeypatch.setattr(minhash, "CHUNK", chunk)
        got = {r["doc_id"]: r["class_id"] for r in fp.near_classes(frame(spark, [(*r, "x") for r in rows], "doc_id long, text string, class_id string")).collect()}
        assert set(got) == set(want) and all(got[i] == want[i] or got[i] == i for i in got)
        linked = [i for i in want if want[i] != i]
        assert sum(got[i] == want[i] for i in linked) >= (0.95 if chunk == 1024 else 0.8) * len(linked)


def test_recall_on_test_data(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_classes(rows, fp.NEAR)
    got = {r["doc_id"]: r["class_id"] for r in fp.near_classes(docs).collect()}
    linked = [i for i in want if want[i] != i]
    assert sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked) and all(got[i] in (i, want[i]) for i in got)


def test_near_classes_of_nothing(spark):
    assert fp.near_classes(frame(spark, [], "doc_id long, text string")).count() == 0
