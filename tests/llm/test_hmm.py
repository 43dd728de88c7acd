import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kinegrid.llm import hmm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def model(k=3, classes=7, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    return hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((classes, k)), 0))


def test_forward_is_the_sum_over_all_paths():
    m = model()
    seqs = [[0, 3, 6, 1, 2], [4], [5, 5, 1, 0, 3, 2, 6]]
    at = np.append(0, np.cumsum([len(s) for s in seqs]))
    for most in (2, 3, 256):
        got = m.likelihoods(hmm.Segments.of(np.concatenate(seqs), at, most), 3)
        for g, s in zip(got, seqs, strict=True):
            total = 0.0
            for path in itertools.product(range(3), repeat=len(s)):
                p = m.first[path[0]]
                for i, (z, o) in enumerate(zip(path, s, strict=True)):
                    p *= m.emit[o, z] * (m.step[path[i - 1], z] if i else 1)
                total += p
            assert g == pytest.approx(math.log(total))


@pytest.mark.parametrize("most", [2, 3, 256])
def test_expected_counts_against_all_paths(most):
    m = model(2, 4, 1)
    seqs = [[0, 3, 1, 2, 2], [1], [3, 0]]
    first, step, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for s in seqs:
        paths = list(itertools.product(range(2), repeat=len(s)))
        p = np.array([m.first[z[0]] * np.prod([m.emit[o, x] for o, x in zip(s, z, strict=True)]) * np.prod([m.step[a, b] for a, b in itertools.pairwise(z)]) for z in paths])
        p /= p.sum()
        for z, w in zip(paths, p, strict=True):
            first[z[0]] += w
            for a, b in itertools.pairwise(z):
                step[a, b] += w
            for o, x in zip(s, z, strict=True):
                emit[o, x] += w
    at = np.append(0, np.cumsum([len(s) for s in seqs]))
    got = m.expect(hmm.Segments.of(np.concatenate(seqs), at, most))
    assert got[0] == pytest.approx(first) and got[1] == pytest.approx(step) and got[2] == pytest.approx(emit)


def test_baum_welch_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    s = hmm.Segments.of(rng.integers(0, 7, 400), np.arange(0, 401, 40))
    m, last = model(), -np.inf
    for _ in range(6):
        first, step, emit, log = m.expect(s)
        assert log >= last - 1e-9
        m, last = hmm.Model(first / first.sum(), step / step.sum(1)[:, None], emit / emit.sum(0)), log


def brute_base(rows):
    tok = {k: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)), None] for k, (_, t) in enumerate(rows)}
    c = collections.Counter(w for k, (i, _) in enumerate(rows) if zlib.crc32(str(i).encode()) % 10 for w in tok[k])
    n, v = sum(c.values()), len(c)
    return [(i, zlib.crc32(str(i).encode()) % 10 == 0, len(tok[k]), sum(c[w] > 0 for w in tok[k]), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok[k])) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("local", [10_000, 5])
def test_base_scores_and_edges(spark, local):
    rows = [(i, f"The cat {i % 3} sat on THE mat {'x' * i}") for i in range(40)] + [(40, None), (41, ""), (42, "unseen words only here" * 3), (43, "the " * 9000), (0, "the cat")]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, word int, row string")
    got = hmm.score(spark, df, states=2, own=4, local=local).collect()
    key = lambda r: (r[0], r[2], round(r[5], 6))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for g, w in zip(got, sorted(brute_base(rows), key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])


def test_scores_of_known_words_are_a_distribution(spark):
    """One-word texts over all words, unseen ones as one more a class, and longer texts add up to at most 1."""
    rows = [(i, "a b a c"[: 1 + 2 * (i % 4)]) for i in range(30)]
    probe = [(100 + i, w) for i, w in enumerate(["", *(" ".join(p) for n in (1, 2, 3) for p in itertools.product("abc", repeat=n))])]
    got = hmm.score(spark, spark.createDataFrame(rows + probe, "doc_id long, text string"), states=2, own=2).where("doc_id >= 100").collect()
    assert sum(10 ** r["score"] for r in got) < 1


def test_beats_the_base_on_held_out_texts(spark, sf_dir):
    got = hmm.score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_empty_tables(spark):
    assert hmm.score(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = hmm.score(spark, spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(3, 0, 0)] and all(np.isfinite(r["score"]) for r in got)


def test_every_round_sees_all_training_texts(spark):
    """More documents than a sample would hold, and one whose later part has words of its own."""
    from kinegrid.llm.common import Scratch

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, 6)) for _ in range(900)] + ["w1 w2 " * 3000 + "late tail words " * 3000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "test")
    vocab = hmm.vocabulary(hmm.count_words(df, scratch), 20, 1000)
    got = hmm.train(spark, df, vocab, scratch, 3)
    b = hmm.tokens(pa.array(texts))
    s = hmm.Segments.of(vocab.find(b)[0][b.token], b.at)
    share = vocab.mass / vocab.mass.sum()
    want, log, turn = hmm.Model.start(share, 3), -np.inf, 0
    while True:
        first, step, emit, now = want.expect(s)
        want = hmm.Model.of(first, step, emit, share)
        turn, before, log = turn + 1, log, now
        if turn >= 9 and log - before < 1e-3 * abs(log):
            break
    assert got.first == pytest.approx(want.first) and got.step == pytest.approx(want.step) and got.emit == pytest.approx(want.emit)


def test_a_text_longer_than_a_segment(spark):
    """Over 2 MiB in one text: base score, counts and the chained likelihood are those of the whole text."""
    rng = np.random.default_rng(9)
    long = " ".join(f"word{k}" for k in rng.integers(0, 4000, 280_000))
    rows = [(1, long), (2, "word1 word2"), (2, "word1 word2"), (10, long + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_tokens"]): r for r in hmm.score(spark, df, states=2, own=50, rounds=2).collect()}
    want = brute_base(rows)
    assert got.keys() == {(r[0], r[2]) for r in want}
    for i, held, n, known, total, base in want:
        r = got[i, n]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held, known, total) and r["base_score"] == pytest.approx(base, rel=1e-9)
    m = model(3, 7, 4)
    codes = rng.integers(0, 7, 5000)
    at = np.array([0, 5000])
    whole = m.likelihoods(hmm.Segments.of(codes, at, 10_000), 1)
    assert m.likelihoods(hmm.Segments.of(codes, at, 64), 1) == pytest.approx(whole, rel=1e-9)
