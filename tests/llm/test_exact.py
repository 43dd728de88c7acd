import hashlib

import pytest

from kinegrid.llm import exact

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    keep, n = {}, {}
    for i, t in rows:
        k = (t or "").translate(LOWER)
        keep[k] = max(i, keep.get(k, i))
        n[k] = n.get(k, 0) + 1
    return sorted((i, keep[k], n[k], i == keep[k], hashlib.sha256(k.encode()).hexdigest()) for i, t in rows for k in [(t or "").translate(LOWER)])


@pytest.mark.parametrize("block", [3, 16])
def test_against_brute_force(spark, block):
    long = "abcdefgh" * 9
    texts = [None, "", "A", "a", "É", "é", long, long.upper(), long + "x", long[:-1], "abcabc", "abcabcab", "abc", "xyz" * 7, "xyz" * 7, "xyz" * 8, "same", "same"]
    rows = [*enumerate(texts), (17, "same")]
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, row string, name double")
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.groups(spark, df, block).collect())
    assert got == brute(rows)


def test_many_copies_over_many_ranges(spark):
    rows = [(i, "copy " * 5 if i % 3 else f"text {i}") for i in range(300)]
    got = sorted(tuple(r) for r in exact.groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), 8).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert exact.groups(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_longer_than_a_slice(spark):
    """Texts over 8 MiB, the size of a slice, that differ in their last byte, their case or not at all; shared ids."""
    long = "some words and more " * 430_000
    rows = [(1, long), (2, long.upper()), (3, long + "."), (3, long), (4, long[:-1]), (4, "short")]
    got = sorted(tuple(r) for r in exact.groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("many", [1, 10, 10_000])
def test_hot_groups_and_others(spark, monkeypatch, many):
    """All groups shuffled, some broadcast, all broadcast: the same rows."""
    monkeypatch.setattr(exact, "MANY", many)
    rows = [(i, "hot" if i % 3 else f"text {i % 21}") for i in range(200)] + [(None, "hot"), (None, "alone")]
    got = exact.groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute([(i, t) for i, t in rows if i is not None])
    size = {"hot": sum(t == "hot" for _, t in rows)}
    assert len(got) == 202 and sorted(tuple(r) for r in got if r["doc_id"] is not None) == sorted((i, k, size.get(t, n), kept, sha) for (i, k, n, kept, sha), (_, t) in zip(want, [r for r in rows if r[0] is not None], strict=True))
    assert sorted((r["group_size"], r["kept"]) for r in got if r["doc_id"] is None) == [(1, True), (size["hot"], False)]
