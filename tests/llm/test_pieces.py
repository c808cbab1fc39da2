"""The piece codec against its library, on edge cases, random texts and the smallest tables."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import piece_bpe, queries

MODEL = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = piece_bpe.PieceCodec(MODEL)
PIECES = [LIBRARY.id_to_piece(i) for i in range(259, LIBRARY.get_piece_size())]


def check(got, rows):
    want = []
    for r in rows:
        ids = LIBRARY.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_whole_tables(spark, tables, edge, sf):
    """Nulls, empty and long texts, repeated rows, and columns that clash."""
    clashing = edge.withColumns({"ids": F.lit("clash"), "decoded_text": F.lit(1)})
    check(queries.op11_sentencepiece(spark, tables(documents=clashing)).collect(), edge.collect())
    check(queries.op11_sentencepiece(spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert queries.op11_sentencepiece(spark, tables(documents=edge.limit(0))).collect() == []


@settings(max_examples=400, deadline=None)
@given(
    st.one_of(
        st.text(alphabet=st.one_of(st.sampled_from("ab  the'\n\t1é日😀▁\x00<>"), st.characters(codec="utf-8")), max_size=40),
        st.lists(st.sampled_from(PIECES), max_size=6).map("".join),
        st.text(alphabet="aeinst ", max_size=60),
        st.text(alphabet=" -=_.aA0", max_size=60),
    )
)
def test_equals_the_library(text):
    ids = np.frombuffer(OWN.encode(text), np.int32)
    assert ids.tolist() == LIBRARY.encode(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids.tolist())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, LIBRARY.get_piece_size() - 1), st.integers(0, 259), st.sampled_from([0, 1, 28705])), max_size=8))
def test_any_ids_are_decoded_as_the_library_does(ids):
    assert OWN.decode(np.array(ids, np.int32)) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinst", min_size=1, max_size=40))
def test_each_prefix_has_the_last_token_of_its_own_encoding(text):
    table = OWN.last_tokens(" " + text)
    assert table[1:] == [LIBRARY.encode(text[:k])[-1] if k else LIBRARY.piece_to_id("▁") for k in range(len(text) + 1)]


def test_pair_test_equals_merging_the_pair():
    rng = np.random.default_rng(3)
    short = [i for i in range(259, LIBRARY.get_piece_size()) if 1 <= len(OWN.texts[i]) <= 4 and OWN.steps(i)]
    for a, b in rng.choice(short, (2000, 2)).tolist():
        text = OWN.texts[a] + OWN.texts[b]
        if text.startswith(" "):
            assert OWN.compatible(a, b) == (LIBRARY.encode(text[1:]) == [a, b])


def test_small_caches_and_columns(spark, edge, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE_CUTS", 3)
    monkeypatch.setattr(piece_bpe, "CACHE_PAIRS", 3)
    own = piece_bpe.PieceCodec(MODEL)
    for text in ["one two three four", "a b c d e f", "one two"]:
        assert np.frombuffer(own.encode(text), np.int32).tolist() == LIBRARY.encode(text)
    back = piece_bpe.decode(piece_bpe.encode(edge, MODEL), MODEL).select("text", "decoded_text").collect()
    assert all(r["decoded_text"] == (r["text"] or "") for r in back)
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert [r["decoded_text"] for r in piece_bpe.decode(rows, MODEL).collect()] == ["", ""]


def test_models_that_merge_otherwise_are_refused(monkeypatch):
    class Odd:
        def __getattr__(self, name):
            return getattr(LIBRARY, name)

        def id_to_piece(self, i):
            return "a▁b" if i == 300 else LIBRARY.id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda **_: Odd())
    with pytest.raises(ValueError, match="space after another"):
        piece_bpe.PieceCodec(MODEL)
