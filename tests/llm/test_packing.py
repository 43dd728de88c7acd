import zlib

import numpy as np
import public_tokenizers
import pytest

from kinegrid.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def encoded(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return [[*tok.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def check(rows, ids_by_doc, window=2048):
    """Every id in exactly one piece; sequences gapless from 0; only the last one not full."""
    by_doc, by_seq = {}, {}
    for r in rows:
        assert 0 < r["length"] <= window
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], bytes(r["ids"])))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == ids_by_doc.keys()
    for doc, ids in ids_by_doc.items():
        got = b"".join(x[2] for x in sorted(by_doc[doc]))
        assert got == np.array(ids, "<u4").tobytes()
        at = 0
        for start, n, _ in sorted(by_doc[doc]):
            assert start == at
            at += n
    assert sorted(by_seq) == list(range(len(by_seq)))
    for seq, pieces in by_seq.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == window or seq == len(by_seq) - 1


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(spark, docs, PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check(rows, dict(zip(texts, encoded(texts.values()), strict=True)))


def test_edge_cases(spark):
    rows = [(1, None, "a", 7), (2, "", None, 7), (3, "word " * 9000, "a", 7), (4, "same", "b", 7), (5, "same", "b", 7), (6, "a<|endoftext|>b", "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids int")
    got = packing.pack(spark, docs, PATH).collect()
    check(got, {r[0]: x for r, x in zip(rows, encoded([r[1] for r in rows]), strict=True)})
    assert packing.pack(spark, docs.limit(0), PATH).collect() == []


def test_many_sources_share_queues(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i}") for i in range(30)], "doc_id long, text string, source string")
    got = packing.pack(spark, docs, PATH, max_queues=4).collect()
    assert len({r["queue"] for r in got}) == 5
    check(got, {i: x for i, x in enumerate(encoded([f"text {i}" for i in range(30)]))})


@pytest.mark.parametrize("shares", [[5, 3, 1], [1, 1, 1], [0.2, 0.2, 0.6]])
def test_windows_meet_targets_and_carry_deficits(shares):
    totals = [int(200_000 * s / sum(shares)) + 37 for s in shares]
    plan = packing.Schedule(totals, shares, 2048, 128, block=8)
    place = {}
    for s, total in enumerate(totals):
        for pos, n, at in plan.pieces(s, 0, total):
            for w in range(at // 2048, (at + n - 1) // 2048 + 1):
                place.setdefault(w, [0] * len(shares))[s] += min(at + n, (w + 1) * 2048) - max(at, w * 2048)
    got = np.zeros(len(shares))
    for w in range(plan.packets // plan.slots):
        got += place[w]
        assert sum(place[w]) == 2048
        want = np.array(shares) / sum(shares) * 2048 * (w + 1)
        assert abs(got - want).max() <= 2 * 128 + 1  # the carried deficit stays within two packets


def test_blocks_agree_with_one_sequential_pass():
    totals, shares = [50_000, 20_000, 7_000, 100], [4, 2, 1, 0.5]
    plan = packing.Schedule(totals, shares, 2048, 128, block=4)
    slots = []
    for b in range(-(-plan.packets // (plan.block * plan.slots))):
        first, where, _ = plan.plan(b)
        assert (first == plan.served(b * plan.block * plan.slots)).all()
        slots += [s for w in where for s in w.tolist()]
    assert sorted(slots) == list(range(plan.packets))
    assert zlib.crc32(b"") == 0


def test_targets_hold_beyond_the_queues(spark):
    """More sources than queues: a named one keeps its part of every window, the small ones share a queue."""
    docs = spark.createDataFrame([(i, "some words of text " * 120, "big" if i % 3 else f"s{i}") for i in range(90)], "doc_id long, text string, source string")
    got = packing.pack(spark, docs, PATH, targets={"s3": 0.5, "big": 0.5}, max_queues=2).collect()
    assert {r["queue"] for r in got} >= {"big", "s3", packing.REST}
    first = [r for r in got if r["sequence_id"] == 0]
    assert abs(sum(r["length"] for r in first if r["queue"] == "big") - 1536) <= 512 and {r["queue"] for r in first} == {"big", "s3"}
    check(got, dict(enumerate(encoded(["some words of text " * 120] * 90))))


def test_sequences_are_padded_but_at_powers_of_two(spark):
    docs = spark.createDataFrame([(1, "word " * 300, "a"), (2, "more text " * 40, "b")], "doc_id long, text string, source string")
    pieces = packing.pack(spark, docs, PATH, window=256, packet=64)
    for r in packing.sequences(pieces, 256).collect():
        own = sorted((s["offset"], s["length"]) for s in r["spans"])
        n = own[-1][0] + own[-1][1]
        assert [a for a, _ in own] == [0, *(a + k for a, k in own[:-1])]
        assert len(r["input_ids"]) == (n if n & (n - 1) == 0 else 256) and all(x == 0 for x in r["input_ids"][n:])
    want = {i: x for i, x in zip((1, 2), encoded(["word " * 300, "more text " * 40]), strict=True)}
    for r in packing.sequences(pieces, 256).collect():
        for s in r["spans"]:
            assert r["input_ids"][s["offset"] : s["offset"] + s["length"]] == want[s["doc_id"]][s["start"] : s["start"] + s["length"]]
    exact = packing.pack(spark, spark.createDataFrame([(1, None, "a")] * 4, "doc_id long, text string, source string"), PATH)
    assert [len(r["input_ids"]) for r in packing.sequences(exact).collect()] == [4]


def test_rows_of_one_id_and_a_text_longer_than_a_segment(spark):
    """Repeated rows are packed as often as they occur; a text of over 2 MiB is one document."""
    long = "a few words, again " * 120_000
    rows = [(1, "copy", "s"), (1, "copy", "s"), (1, "another", "t"), (2, long, "s")]
    got = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), PATH).collect()
    sizes = [len(x) for x in encoded([t for _, t, _ in rows])]
    assert sum(r["length"] for r in got) == sum(sizes) and {r["doc_tokens"] for r in got} == set(sizes)
    two = sorted((r["start"], r["length"], bytes(r["ids"])) for r in got if r["doc_id"] == 2)
    assert b"".join(x[2] for x in two) == np.array(encoded([long])[0], "<u4").tobytes()


@pytest.mark.parametrize("unit", [" ", "\t", "\n", " \n\t ", "a"])
def test_runs_of_two_million(spark, unit):
    """White space that long is too deep for the fast encoder's pattern: the library takes such texts."""
    long = unit * (2_000_000 // len(unit))
    got = packing.pack(spark, spark.createDataFrame([(1, long, "s"), (2, f"x{long}y", "s")], "doc_id long, text string, source string"), PATH).collect()
    for i, ids in zip((1, 2), encoded([long, f"x{long}y"]), strict=True):
        parts = sorted((r["start"], bytes(r["ids"])) for r in got if r["doc_id"] == i)
        assert b"".join(x for _, x in parts) == np.array(ids, "<u4").tobytes()
