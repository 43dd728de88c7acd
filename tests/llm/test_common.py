"""Shared plumbing: segments of long texts, the shared folder, and runs that are closed."""

import os
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from kinegrid.llm import common, exact


def test_words_across_segments(monkeypatch):
    monkeypatch.setattr(common, "SEGMENT", 64)
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab \t\né") for _ in range(rng.randrange(400))) for _ in range(40)] + [None, "", "x" * 300, " " * 200, "end"]
    data, offsets = common.utf8(pa.array(texts))
    hashes, at, starts, ends = common.word_hashes(data, offsets, spans=True)
    raw = data.tobytes()
    for i, t in enumerate(texts):
        words = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())
        assert [raw[a:b] for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], strict=True)] == words
    known = {}
    for h, a, b in zip(hashes.tolist(), starts, ends, strict=True):
        assert known.setdefault(raw[a:b], h) == h
    assert len(set(known.values())) == len(known)


def test_slices_hold_a_row_at_least():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, "b" * 500, None, "c", "d" * 90, "e" * 20])], names=["text"])
    got = [s.column("text").to_pylist() for s in common.slices(batch, "text", 100)]
    assert [x for s in got for x in s] == batch.column("text").to_pylist()
    assert all(len(s) == 1 or sum(len(x or "") for x in s) <= 100 for s in got)
    assert not list(common.slices(batch.slice(0, 0), "text"))


def test_no_private_folder_on_a_cluster():
    nothing = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(SimpleNamespace(conf=nothing, sparkContext=context))
    named = SimpleNamespace(get=lambda *a: "s3://bucket/folder/")
    assert common.shared_dir(SimpleNamespace(conf=named, sparkContext=context)) == "s3://bucket/folder"


def test_closed_runs_leave_nothing(spark):
    scratch = common.Scratch(spark, "closing")
    scratch.write(spark.range(5).toDF("id"), "rows")
    where = scratch.root.removeprefix("file:")
    assert os.path.isdir(where)
    scratch.close()
    assert not os.path.isdir(where)
    found = exact.groups(spark, spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")).collect()
    assert len(found) == 2 and common._ROOTS
    common.close(spark)
    assert not common._ROOTS


def test_spans_are_told_apart_by_their_bytes():
    data = np.frombuffer(b"abcabd-ab-abc", np.uint8)
    number, words = common.numbered(data, np.array([0, 3, 7, 10]), np.array([3, 6, 9, 13]))
    assert [words[i] for i in number] == [b"abc", b"abd", b"ab", b"abc"] and len(words) == 3
    assert common.numbered(data, np.zeros(0, np.int64), np.zeros(0, np.int64))[1] == []


def test_digests_tell_words_apart():
    """Anagrams, prefixes, zero bytes, and lengths around what the tables know; equal words agree wherever they stand."""
    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab\0") for _ in range(n)) for n in (1, 2, 3, 5, 8, 31, 32, 33, 34, 90) for _ in range(60)]
    words += [b"ab", b"ba", b"a", b"a\0", b"a\0\0", b"x" * 32, b"x" * 33, b"x" * 31]
    starts = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
    data = np.frombuffer(b" ".join(words), np.uint8)
    got = common.word_digests(data, starts, starts + [len(w) for w in words])
    known = {}
    for w, d in zip(words, map(tuple, got.tolist()), strict=True):
        assert known.setdefault(w, d) == d
    assert len(set(known.values())) == len(known) and len({d[0] for d in known.values()}) == len(known)
    assert common.word_digests(data, starts[:0], starts[:0]).shape == (0, 2)


def test_distinct_words_of_one_half():
    from kinegrid.llm.hmm import distinct

    words, more = np.array([5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    first, of = distinct(words, more)
    assert len(first) == 3 and of[0] == of[3] != of[1] and (words[first][of] == words).all() and (more[first][of] == more).all()
