import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kinegrid.llm import tokenstore as T

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    from tokenizers import Tokenizer

    tok, out, start = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    passage = " ".join(f"shared{i} text" for i in range(900))
    rows = [(9, None), (3, ""), (5, passage), (1, "start " + passage + " end"), (7, "It's ÉCOLE, don't 12,5 <|endoftext|> x_. $$$, a…."), (8, "x" * 5000), (2, "tab\tnew\nline\x1cfs\x85nel"), (4, passage)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, parts string, root int")
    store = T.write_store(spark, df, PATH)
    got = T.read_store(spark, store, T.crc32, "long").collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    plain = {r["doc_id"]: bytes(r["ids"]) for r in T.read_store(spark, store).collect()}
    assert all(zlib.crc32(np.frombuffer(plain[i], f"<u{store.width}").astype("<u4").tobytes()) == c for i, _, _, c in brute(rows))
    chunks, uses = store.chunks, store.scratch.read("recipes").where("documents is null").select(F.explode("addresses").alias("a"))
    assert chunks.count() == uses.distinct().count() < uses.count()
    assert not [x.name for x in spark.catalog.listTables() if x.name.startswith("chunks_")]


def test_damage_is_found(spark):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    store = T.write_store(spark, df, PATH)
    recipes = store.scratch.read("recipes").where("documents is not null or doc_id <> 4")
    recipes.write.parquet(store.scratch.path("less"))
    store.scratch.drop("recipes")
    spark.read.parquet(store.scratch.path("less")).write.parquet(store.scratch.path("recipes"))
    with pytest.raises(Exception, match="manifest"):
        T.read_store(spark, store)


def test_empty_table(spark):
    store = T.write_store(spark, spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert T.read_store(spark, store).collect() == []


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 49000, 6000).astype("<u2")
    b = np.append(rng.integers(0, 49000, 77).astype("<u2"), a)
    cut = lambda x: T.cuts(T.marks(x).tolist(), 0, len(x))
    parts = lambda x: {x[i:j].tobytes() for i, j in zip([0, *cut(x)], cut(x), strict=False)}
    assert len(parts(a) & parts(b)) >= len(parts(a)) - 3
    assert all(T.LEAST <= j - i <= T.MOST for i, j in zip([0, *cut(a)], cut(a)[:-1], strict=False))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 13])
def test_streamed_roots(n):
    leaves = [bytes([i]) * 32 for i in range(n)]
    r = T.Roots()
    for x in leaves:
        r.add(x)
    assert r.root() == T.merkle(leaves)


ODD = ["foo%%% été&&& naïve… x× x÷, ×. a'' it's. 'tis' don't!!! o'clock? (a) [b]{c} --- é. É, ß; 3.14, 12% $$$ a_b_ Ω. Ωé, x@y.z, a.b.c, foo,,,,, bar.....", "¿qué? «oui», „ja“ … . , ; á. é,", "<|endoftext|>. x<|startoftext|>,", "\x1ca\x1f. b\x85, c\xa0d."]


@pytest.mark.parametrize("text", ODD)
def test_units_against_the_library(text):
    import pyarrow as pa

    from kinegrid.llm.tokens import WordLevel, encoder

    enc = encoder(WordLevel, PATH)
    ids, at = enc.column(pa.array(["", text, None, text.upper(), text + "\n" + text]))
    whole = [enc.whole.encode(t or "", add_special_tokens=False).ids for t in ["", text, None, text.upper(), text + "\n" + text]]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == whole


def test_rows_of_one_id_and_texts_longer_than_a_segment(spark):
    """Each row of an id keeps its own ids; a text crosses the cuts at 2 MiB."""
    long = " ".join(f"word{i % 977} Café," for i in range(200_000))
    assert len(long) > 2 << 20
    rows = [(2, "second"), (2, "another of the same id"), (2, "second"), (1, long), (3, None)]
    got = T.read_store(spark, T.write_store(spark, spark.createDataFrame(rows, "doc_id long, text string"), PATH), T.crc32, "long").collect()
    ids = lambda r: (r["doc_id"], r["n_tokens"], r["ids"])
    assert sorted(map(ids, got)) == sorted((i, n, c) for i, _, n, c in brute(rows))
    ends = sorted((r["start"], r["start"] + r["n_tokens"], r["doc_id"]) for r in got)
    assert [a for a, _, _ in ends] == [0, *(b for _, b, _ in ends[:-1])] and [i for _, _, i in ends] == [1, 2, 2, 2, 3]
