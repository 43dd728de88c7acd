import random

import pyarrow as pa
import pytest

from kinegrid.llm import substring


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i, len(w), len(gone), kept))
    return sorted(out)


@pytest.mark.parametrize("window", [1, 4, 13, 50])
@pytest.mark.parametrize("everywhere", [False, True])
def test_against_brute_force(spark, monkeypatch, window, everywhere):
    monkeypatch.setattr(substring, "SHARD_WORDS", 400)
    monkeypatch.setattr(substring, "PART", 7)
    rng = random.Random(window)
    fresh = lambda n: [f"w{rng.randrange(3 if window == 4 else 5000)}" for _ in range(n)]
    shared = [fresh(rng.choice([window - 1 or 1, window, window + 3, 3 * window])) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += fresh(rng.randrange(12)) + rng.choice([s, s[a:], s[:a]])
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(60, None), (61, ""), (62, " ".join(shared[0] * 40)), (63, rows[5][1]), (64, "é à " * 30)]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, place int, passages string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(spark, df, window, everywhere).collect())
    assert got == brute(rows, window)


def test_spans_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d x"), (2, "y a b c d z")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in substring.remove_repeats(spark, df, 4).collect()}
    assert [tuple(s) for s in rows[2]["spans"]] == [(1, 5)] and rows[1]["spans"] == []
    assert substring.remove_repeats(spark, df.limit(0), 4).collect() == []


def test_rows_of_one_id_do_not_repeat_each_other(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.remove_repeats(spark, df, 4).collect()] == [0, 0]


@pytest.mark.parametrize("window", [1, 2, 5, 13, 50])
def test_slices_of_few_words(window):
    """A slice of one text of any word count: its windows, or none."""
    for n in range(2 * window + 3):
        row, place, anchor, *_ = substring._windows(pa.array([" ".join(f"w{i}" for i in range(n))]), window, min(5, window))
        count = max(0, n - window + 1)
        assert row.tolist() == [0] * count and place.tolist() == list(range(count)) and len(anchor) == count


def test_partitions_of_one_short_row(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (9, 10, 12, 13, 14, 14)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 6), df.schema)  # a partition each
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(spark, df, 13).collect())
    assert got == brute(list(enumerate(texts)), 13)


def test_located_without_a_proposal(spark, monkeypatch):
    """The automaton finds a repeat in a document for which nothing was proposed, if its batch has the passage."""
    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(1, passage), (2, "x " + passage), (3, passage + " y")], "doc_id long, text string").coalesce(1)
    found = substring._confirmed

    def fewer(*a):
        passages, routes = found(*a)
        return passages, routes.where("doc_id = 2")

    monkeypatch.setattr(substring, "_confirmed", fewer)
    assert {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(spark, df).collect()} == {1: 0, 2: 20, 3: 20}


def test_quotes_of_a_long_text_stay_short(spark, monkeypatch):
    """What is routed is a small multiple of what is quoted."""
    rng = random.Random(3)
    long = [f"w{i}" for i in range(20000)]
    rows = [(0, " ".join(long))] + [(i, " ".join(long[(a := rng.randrange(19980)) : a + 13])) for i in range(1, 301)]
    routed = []
    found = substring._by_routes
    monkeypatch.setattr(substring, "_by_routes", lambda texts, routes, *a: (routed.append(routes.selectExpr("sum(hi - lo + 13)").first()[0]), found(texts, routes, *a))[1])
    got = substring.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_removed"] for r in got) == 13 * 300 and routed[0] <= 2 * 13 * 300


def test_more_words_than_symbols(monkeypatch):
    monkeypatch.setattr(substring, "SYMBOLS", 30)
    passages = {" ".join(f"a{i}-{k}" for i in range(20)).encode(): k for k in range(5)}
    automata = substring.shards(13, passages)
    assert len(automata) == 5
    words = b" ".join(passages).split()
    assert substring._covered(automata, 9, words) == [[20 * k, 20 * k + 20] for k in range(5)] or substring._covered(automata, 9, words) == [[0, 100]]


def test_a_text_longer_than_a_segment(spark):
    """Words and windows across the cuts of a text of over 2 MiB, one of which is longer than a segment itself."""
    rng = random.Random(4)
    long = " ".join(f"word{rng.randrange(10**7)}" for _ in range(200_000)) + " " + "z" * (2 << 20) + " " + " ".join(f"tail{i}" for i in range(100))
    rows = [(1, long), (2, "some other " + long[len(long) // 2 :]), (3, long[: len(long) // 3] + " more")]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows, 13)
