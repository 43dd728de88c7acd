import random
import re

import pytest

from kinegrid.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def near(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 3000), (3, 90, 8), (5, 80, 3000), (1, 60, 5), (2, 100, 10)])
def test_against_brute_force(spark, n, percent, block):
    rng = random.Random(n * percent)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 9, 30, 120, 300]))] for _ in range(6)]
    texts = [near(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 4, 8])) for _ in range(90)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(15)]
    texts += [None, "", " \n", "one", "ONE", "one two", "one\ttwo", "a b c", "x " * 3000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n int, keys string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(spark, df, n, percent, block).collect())
    assert got == brute(rows, n, percent)


def test_empty_table(spark):
    assert jaccard.components(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_divide_skip_against_all_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    base = np.arange(150, dtype=np.uint64)
    sets = [np.unique(np.append(base[rng.random(150) > d], rng.integers(1000, 10**6, int(150 * d)).astype(np.uint64))) for d in rng.choice([0.01, 0.03, 0.06, 0.2], 60)]
    links = jaccard.divide_skip(list(range(60)), sets, 90)
    label = list(range(60))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        label[find(a)] = find(b)
    got = {frozenset(j for j in range(60) if find(j) == find(i)) for i in range(60)}
    want = list(range(60))

    def top(i):
        while want[i] != i:
            i = want[i]
        return i

    for i in range(60):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 90 * (len(sets[i]) + len(sets[j]) - inter):
                want[top(i)] = top(j)
    assert got == {frozenset(j for j in range(60) if top(j) == top(i)) for i in range(60)}


def test_heap_merge_against_counting():
    import collections

    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 25))) for _ in range(rng.randrange(0, 12))]
        times = collections.Counter(x for one in lists for x in one)
        for t in (1, 2, 3, 7):
            want = {x: n for x, n in times.items() if n >= t}
            assert dict(zip(*jaccard.merge_skip(lists, t), strict=True)) == want


def test_groups_of_blocks(spark, monkeypatch):
    """A chain of texts and strangers tied to it, with blocks of few shingles: several blocks, hubs and minor classes."""
    monkeypatch.setattr(jaccard, "SHINGLES", 400)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(80):  # each a step from the one before: far ones are linked through others only
        words[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [near(rng, words, k) for k in (1, 2, 5, 9) for _ in range(10)] + [texts[3], texts[3].upper()]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(spark, df, 3, 85).collect())
    assert got == brute(rows, 3, 85)


def test_rows_of_one_id(spark):
    """Two texts of one id are two documents; what links one of them does not touch the other."""
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "x y z"), (0, "X y z"), (2, "a B c d"), (None, "a b c d")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    got = {r["carry"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(spark, df, carry="k").collect()}
    assert got == {0: (2, 1), 1: (2, 1), 2: (1, 0), 3: (1, 0), 4: (2, 1), 5: (2, 1)}


def test_a_text_longer_than_a_segment(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(320_000)]
    long = " ".join(words)
    assert len(long) > 2 << 20
    rows = [(1, long), (2, near(rng, words, 3000)), (3, near(rng, words, 30_000)), (4, long[: 2 << 20])]
    got = sorted(tuple(r) for r in jaccard.components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows, 3, 90)


def test_keys_meet_in_parts(spark, monkeypatch):
    """No table or shuffle of keys holds all of them: they outweigh the texts several times."""
    rng, held = random.Random(8), []
    write = jaccard.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name == "postings":
            held.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "FEW", 0, raising=False)
    monkeypatch.setattr(jaccard.Scratch, "write", counted)
    base = [[f"w{rng.randrange(5000)}" for _ in range(80)] for _ in range(40)]
    rows = list(enumerate(near(rng, base[i % 40], i // 40) for i in range(80)))
    got = jaccard.components(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 80)
    assert sum(held) > 1000 and max(held) < 0.4 * sum(held)
