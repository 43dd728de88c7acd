"""Rows without an id, and nulls in every other column, in every operator."""

import public_tokenizers
import pytest

from kinegrid.llm import exact, hmm, jaccard, langid, neighbours, packing, pieces, substring, tokenstore

TEXT = "some words that are long enough to be more than thirteen words in all and then a few"
ROWS = [(None, TEXT, None, None, None), (None, None, "en", "s", 1), (1, TEXT, "en", "s", 1), (2, TEXT + " more", None, "s", None), (None, "only here, and nowhere else", "en", None, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


def test_exact(spark, docs):
    got = {(r["doc_id"], r["group_size"], r["kept"]) for r in exact.groups(spark, docs).collect()}
    assert got == {(None, 2, False), (1, 2, True), (2, 1, True), (None, 1, True)}


def test_jaccard(spark, docs):
    got = jaccard.components(spark, docs).collect()
    assert len(got) == 5 and {r["component_id"] for r in got if r["doc_id"] is not None} == {1}


def test_substring(spark, docs):
    got = substring.remove_repeats(spark, docs).collect()
    assert len(got) == 5 and {r["doc_id"]: r["n_removed"] for r in got} == {None: 0, 1: 0, 2: 18}


def test_others(spark, docs):
    path = public_tokenizers.path
    assert packing.pack(spark, docs, path("byte_bpe_50k.json")).count() >= 5
    assert langid.predict(spark, docs, langid.fit(spark, docs)).count() == 5
    assert hmm.score(spark, docs).count() == 5
    assert pieces.encode(docs, path("piece_bpe_32k.model")).count() == 5
    store = tokenstore.write_store(spark, docs, path("word_bpe_49k.json"))
    assert sorted(r["start"] for r in tokenstore.read_store(spark, store).collect())[0] == 0
    assert tokenstore.read_store(spark, store).count() == 5


def test_vectors(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_duplicates(spark, df)[0].collect()}
    assert got == {None: (0, None, True), 1: (1, 1, True), 2: (1, 1, False)}
