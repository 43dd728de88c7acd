import random
from collections import defaultdict

import pytest

from kinegrid.llm import suffixes as S


def brute(rows, least):
    places = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        for s in range(len(raw) - least + 1):
            places[raw[s : s + least]].append((k, s))
    gone = defaultdict(set)
    for where in places.values():
        if len(where) > 1:
            for k, s in where:
                gone[k].update(range(s, s + least))
    out = []
    for k, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        spans = sum(p - 1 not in gone[k] for p in gone[k])
        out.append((i, len(raw), len(gone[k]), spans, bytes(c for p, c in enumerate(raw) if p not in gone[k])))
    return sorted(out, key=repr)


def made(rng, least, n=70):
    fresh = lambda m: "".join(rng.choice("abcdefgh é") for _ in range(m))
    shared = [fresh(rng.choice([least - 1, least, least + 3, 3 * least])) for _ in range(6)] + ["xyz " * least]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [fresh(rng.randrange(2 * least)), rng.choice([s, s[a:], s[:a], s + s])]
        rows.append((i, "".join(parts)))
    return rows + [(200, None), (201, ""), (202, "z" * 9 * least), (203, rows[5][1]), (203, rows[5][1]), (None, rows[6][1]), (204, "q" * (least - 1))]


@pytest.mark.parametrize("least", [3, 8, 40, 130])
@pytest.mark.parametrize("bucket", [1, 3, 256])
def test_against_brute_force(spark, monkeypatch, least, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rows = made(random.Random(least), least)
    df = spark.createDataFrame([(*r, 5, "g") for r in rows], "doc_id long, text string, row int, anchor string")
    found = S.remove_repeats(spark, df, least)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found.collect()]
    assert sorted(got, key=repr) == brute(rows, least)


@pytest.mark.parametrize("bucket", [2, 256])
def test_a_passage_with_other_surroundings_each_time(spark, monkeypatch, bucket):
    """Third of all rows: its anchors are busy, and all occurrences are found at once."""
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = random.Random(7)
    fresh = lambda m: "".join(rng.choice("abcdefghijklmnop") for _ in range(m))
    passage = fresh(600)
    rows = [(i, fresh(rng.randrange(300)) + (passage if i % 3 == 0 else fresh(500)) + fresh(300)) for i in range(60)]
    got = {r["doc_id"]: r for r in S.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r["n_removed"]} == set(range(0, 60, 3))
    assert all(600 <= got[i]["n_removed"] < 620 and got[i]["n_spans"] == 1 for i in range(0, 60, 3))  # neighbours may agree by chance
    want = brute(rows, 400)
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.values()], key=repr) == want


def test_thresholds(spark):
    """399 equal bytes stay, 400 go; repeats inside one text and overlapping ones count; characters can be cut."""
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in (399, 400))
    rows = [(1, "1" + a + "2"), (2, "3" + a + "4"), (3, "5" + b + "6" + b), (4, "w" * 401), (5, "w" * 399 + "é"), (6, "é" * 100 + "ü" + "ã" * 300 + "x"), (7, "ļ" + "ã" * 300 + "y")]
    got = {r["doc_id"]: r for r in S.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in range(1, 8)] == [0, 0, 800, 401, 0, 601, 601]
    want = brute(rows, 400)
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.values()], key=repr) == want


def all_repeats(lefts, rights, least):
    """Every set of members that some string of l + r bytes around the anchor has, with its longest string."""
    found = {}
    for l in range(max(map(len, lefts)) + 1):
        for r in range(max(map(len, rights)) + 1):
            by = defaultdict(list)
            for p, (a, b) in enumerate(zip(lefts, rights)):
                if len(a) >= l and len(b) >= r:
                    by[a[:l], b[:r]].append(p)
            for some in by.values():
                if len(some) > 1 and l + r >= least:
                    found.setdefault(tuple(some), set()).add((l, r))
    maximal = set()
    for some, sizes in found.items():
        for l, r in sizes:
            if (l + 1, r) not in sizes and (l, r + 1) not in sizes:
                maximal.add((l, r, some))
    return maximal


@pytest.mark.parametrize("seed", range(30))
def test_interval_tree_gives_all_maximal_repeats_with_all_occurrences(seed):
    rng = random.Random(seed)
    seen = set()
    while len(seen) < 12:
        seen.add((bytes(rng.choice(b"ab") for _ in range(rng.randrange(6))), bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 7)))))
    lefts, rights = map(list, zip(*sorted(seen)))
    got = [(l, r, tuple(sorted(some))) for l, r, some in S.maximal_repeats(lefts, rights, 4)]
    assert len(got) == len(set(got)) and set(got) == all_repeats(lefts, rights, 4)


@pytest.mark.parametrize("bucket", [1, 256])
def test_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = random.Random(2)
    fresh = lambda m: "".join(rng.choice("abcdefghijklmnop") for _ in range(m))
    p = fresh(60)
    rows = [(i, fresh(90) + p + fresh(90)) for i in range(5)] + [(9, None)]
    rows += [(20 + i, t) for i, t in rows[:3]]
    found = S.repeat_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    text = dict(rows)
    by = defaultdict(list)
    for r in found:
        by[r["repeat"]].append(r)
    assert any({r["doc_id"] for r in some} == {*range(5), 20, 21, 22} for some in by.values())
    for some in by.values():
        (string,) = {text[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in some}
        everywhere = {(i, s) for i, t in rows if t for s in range(len(t)) if t.startswith(string, s)}
        assert {(r["doc_id"], r["start"]) for r in some} == everywhere and len(string) >= 40 and len(everywhere) == len(some) > 1


def test_empty(spark):
    found = S.remove_repeats(spark, spark.createDataFrame([], "doc_id long, text string"))
    assert found.collect() == [] and found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
