import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from kinegrid.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return pieces.transducer(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = ["", " ", "  two  spaces ", "tab\there\n\n x", "éè́ ﬁ 😀a", "a▁b ▁▁a", "a\x00b <s> <0x0A>", " " * 40, " " * 37 + "a  \n  b", "a" * 90, "=" * 77, "漢字かな交じり文", "퟿𐍈", "0001234567", "word " * 500]


@pytest.mark.parametrize("text", ODD)
def test_against_the_library(both, text):
    t, lib = both
    ids = np.frombuffer(t.encode(text), t.dtype).tolist()
    assert ids == lib.encode(text) and t.decode(t.encode(text)) == lib.decode(ids)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(both, text):
    t, lib = both
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(t.encode(text), t.dtype).tolist() == lib.encode(text)


@given(st.text(alphabet="abtheinor .,▁ ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_dense_merges(both, text):
    t, lib = both
    assert np.frombuffer(t.encode(text), t.dtype).tolist() == lib.encode(text)


def test_whole_table(spark, sf_dir, both):
    t, lib = both
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pieces.encode(docs, PATH).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(texts[r["doc_id"]])
        assert hashlib.sha256(r["decoded"].encode()).digest() == hashlib.sha256(texts[r["doc_id"]].encode()).digest()


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["ids"], r["n_ids"], r["decoded"]) for r in pieces.encode(df, PATH).collect()}
    assert got == {1: (None, None, None), 2: (bytearray(b""), 0, "")}
    assert pieces.encode(df.limit(0), PATH).collect() == []


def test_unigram_paths_are_the_best_of_all():
    t = pieces.Transducer.__new__(pieces.Transducer)
    t.bpe, t.score = False, {"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -1.2, "aba": -5.0}
    t.trie = {}
    for p in t.score:
        node = t.trie
        for c in p:
            node = node.setdefault(c, {})
        node[""] = p

    def best(s):
        if not s:
            return 0.0
        return min((-t.score[s[:n]] + best(s[n:]) for n in range(1, len(s) + 1) if s[:n] in t.score), default=np.inf)

    for s in ("ab", "abab", "baab", "ababa", "bbaba"):
        got = t.shortest(s)
        assert "".join(got) == s and sum(-t.score[p] for p in got) == pytest.approx(best(s))
    assert t.shortest("axb") == ["a", "x", "b"]


def small_model(tmp_path, kind, pieces_of, rule="identity", squeeze=False, prefix=True, fallback=True):
    """A model file made by hand, and the library on it."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    if rule != "identity":
        m.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.escape_whitespaces = squeeze, prefix, True
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, fallback
    for name, type_, score in [("<unk>", 2, 0.0), *([(f"<0x{b:02X}>", 6, 0.0) for b in range(256)] if fallback else []), *((p, 1, s) for p, s in pieces_of)]:
        p = m.pieces.add()
        p.piece, p.type, p.score = name, type_, score
    path = tmp_path / "small.model"
    path.write_bytes(m.SerializeToString())
    return pieces.Transducer(str(path)), sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


SPACED = [("▁", -9.0), *((c, -8.0 - i / 10) for i, c in enumerate("abcdefi2k")), ("ab", -3.1), ("▁a", -3.3), ("abc", -4.7), ("bc", -2.9), ("a▁b", -3.5), ("▁▁", -5.2), ("fi", -4.1), ("c▁", -4.4)]
TEXTS = ["abc ab", "  a  b c ", "ａｂｃ ﬁ ² K", "é a\u0301bc\tab", "", " ", "a\u200bb", "abcabcabc a b a b", "zz a\nb", "c " * 40]


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_normalisers_and_both_kinds(tmp_path, kind, rule, squeeze, prefix):
    """Character maps, squeezed blanks, and pieces that reach across blanks."""
    scores = [(p, s if kind == 1 else -float(i)) for i, (p, s) in enumerate(SPACED)]
    t, lib = small_model(tmp_path, kind, scores, rule, squeeze, prefix)
    assert not t.apart
    for text in TEXTS:
        ids = np.frombuffer(t.encode(text), t.dtype).tolist()
        assert ids == lib.encode(text), text
        assert t.decode(t.encode(text)) == lib.decode(ids), text


def test_whole_character_map():
    from sentencepiece import sentencepiece_model_pb2

    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(n.serialized_model_proto())
    rules = pieces.charsmap(m.normalizer_spec.precompiled_charsmap)
    assert len(rules) > 5000
    own = pieces.Normaliser(rules, True, pieces.BLANK)
    for key in sorted(rules)[::37]:
        assert own(f"x{key}y") == n.Normalize(f"x{key}y")


def test_kinds_that_are_refused(tmp_path):
    with pytest.raises(ValueError):
        small_model(tmp_path, 3, SPACED)


def test_rows_of_one_id_clashing_columns_and_a_long_text(spark, both):
    t, lib = both
    long = "Some words, again and again. " * 80_000
    rows = [(1, "first text", 7, "x"), (1, "second text", 7, "x"), (2, long, 7, None), (2, None, None, None)]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string"), PATH).collect()
    assert sorted((r["doc_id"], r["n_ids"] or 0) for r in got) == sorted((i, len(lib.encode(x)) if x else 0) for i, x, _, _ in rows)
    assert any(r["decoded"] == long for r in got)
