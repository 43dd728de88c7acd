"""Words that a polynomial hash modulo 2^64 mixes up, whatever its odd base: Thue-Morse words of 1,024 letters."""

import zlib

import numpy as np
import pytest
from test_jaccard import brute as jaccard_brute
from test_substring import brute as substring_brute

from kinegrid.llm import hmm, jaccard, substring, tokenstore
from kinegrid.llm.queries import tokenizer_path


def thue_morse():
    t, swap = "a", str.maketrans("ab", "ba")
    for _ in range(10):
        t += t.translate(swap)
    return t, t.translate(swap)


U, V = thue_morse()


def test_ids(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = [U, V, f"{U} {V}", f"x {V}. {U}!"]
    store = tokenstore.write_store(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    got = {r["doc_id"]: r["ids"] for r in tokenstore.read_store(spark, store, tokenstore.crc32, "long").collect()}
    for i, t in enumerate(texts):
        assert got[i] == zlib.crc32(np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())


def test_passages(spark):
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{U} {tail}"), (2, f"{V} {tail}"), (3, f"{V} {tail}")]
    got = substring.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == substring_brute(rows, 13)


def test_known_words(spark):
    from pyspark.sql import functions as F

    ids = spark.range(40).select(F.col("id").alias("doc_id"), hmm.held_out(10, 0).alias("h")).collect()
    held = next(r["doc_id"] for r in ids if r["h"])
    rows = [(next(r["doc_id"] for r in ids if not r["h"]), U), (held, f"{V} {U}")]
    (got,) = [r for r in hmm.score(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == held]
    assert (got["n_known"], got["n_tokens"], got["train_tokens"]) == (2, 3, 2)  # U and the end
    assert got["base_score"] == pytest.approx(2 * np.log10(1.1 / 2.3) + np.log10(0.1 / 2.3))


def test_links(spark):
    swap = str.maketrans("ab", "ba")
    one = [f"{U[k:]}{U[:k]}" for k in range(4)]
    rows = [(1, U), (2, V), (3, " ".join(one)), (4, " ".join(w.translate(swap) for w in one))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(spark, df).collect())
    assert got == jaccard_brute(rows, 3, 90)


def test_the_pipeline_keeps_both(spark):
    import corpus_pipeline

    rows = [(1, U, "en", "s", 1024), (2, V, "en", "s", 1024)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, "").collect()) == [1, 2]
