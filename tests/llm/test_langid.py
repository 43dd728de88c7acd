import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kinegrid.llm import langid
from kinegrid.llm.common import utf8


def slow_costs(samples, texts, order=langid.ORDER):
    """PPM-C code lengths by dictionaries, byte by byte."""
    out = []
    for texts_of in samples:
        counts = {}
        for t in texts_of:
            data = t.encode()
            for i in range(len(data)):
                for n in range(order + 1):
                    c = bytes(n) + data[:i] if i < n else data[:i]
                    c = c[len(c) - n :] if n else b""
                    counts.setdefault(c, {}).setdefault(data[i], 0)
                    counts[c][data[i]] += 1
        bits = []
        for t in texts:
            data, total = t.encode(), 0.0
            for i in range(len(data)):
                for n in range(order, -1, -1):
                    c = bytes(n) + data[:i] if i < n else data[:i]
                    c = c[len(c) - n :] if n else b""
                    seen = counts.get(c)
                    if not seen:
                        continue
                    s = sum(seen.values()) + len(seen)
                    if data[i] in seen:
                        total -= math.log2(seen[data[i]] / s)
                        break
                    total -= math.log2(len(seen) / s)
                else:
                    total += 8
            bits.append(total)
        out.append(bits)
    return np.array(out).T


def test_code_lengths_against_dictionaries(spark):
    samples = {"aa": ["the cat sat on the mat", "then the hat"], "bb": ["der hut und die katze", "die matte ist da"]}
    rows, i = [], 0
    for lang, texts in samples.items():
        for t in texts:
            while zlib.crc32(str(i).encode()) % 4 == 2:
                i += 1
            rows.append((i, t, lang))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(spark, docs)
    assert model.languages == ["aa", "bb"]
    texts = ["the mat", "die katze", "zzz the", "", "é then"]

    got = model.bits(*utf8(pa.array(texts)))
    assert got == pytest.approx(slow_costs(samples.values(), texts), abs=1e-3)


def test_edges_and_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(spark, docs)
    found = langid.predict(spark, docs, model).withColumn("held", langid.held_out(4, 2)).join(docs.select("doc_id", "lang"), "doc_id").where("held and lang is not null").collect()
    assert len(found) > 10 and np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 $$ --"), (4, "the " * 40000), (4, "the the"), (5, "é")], "doc_id long, text string")
    got = langid.predict(spark, odd, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert all(r["lang_pred"] == "en" for r in got if r["doc_id"] == 4)
    assert langid.predict(spark, odd.limit(0), model).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(0, "text", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.predict(spark, docs, langid.fit(spark, docs)).collect()] == ["und"]


def learners(n):
    """Ids that are not held out."""
    return [i for i in range(4 * n) if zlib.crc32(str(i).encode()) % 4 != 2][:n]


def test_ties_and_clashing_columns(spark):
    """Two languages of equal texts: the first in alphabetical order; columns of the operator's own names are ignored."""
    rows = [(i, "the very same words", ("zz", "mm")[k % 2], "x", 1, 2.0) for k, i in enumerate(learners(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label string, n_bytes int, score double")
    got = langid.predict(spark, docs, langid.fit(spark, docs)).collect()
    assert {r["lang_pred"] for r in got} == {"mm"} and {round(r["score"], 6) for r in got} == {0.5}


def test_the_most_frequent_of_many_languages(spark):
    rows = [(i, f"text number {k}", f"l{k % 5 if k < 40 else k:02d}") for k, i in enumerate(learners(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(spark, docs, most=5).languages == ["l00", "l01", "l02", "l03", "l04"]
    assert len(langid.fit(spark, docs).languages) == 25


def test_long_texts_are_learnt_and_scored_whole(spark):
    """What stands behind 2 MiB of other text counts, in learning and in scoring."""
    a, b, c = learners(3)
    filler = "neutral filler " * 160_000
    docs = spark.createDataFrame([(a, filler + "quorx zub " * 2000, "aa"), (b, filler + "mifel dant " * 2000, "bb")], "doc_id long, text string, lang string")
    model = langid.fit(spark, docs)
    probe = spark.createDataFrame([(1, "zub quorx zub"), (2, "dant mifel"), (3, filler + "mifel dant " * 3000)], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(spark, probe, model).orderBy("doc_id").collect()] == ["aa", "bb", "bb"]
