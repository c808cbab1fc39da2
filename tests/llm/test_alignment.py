"""The alignment of two tokenizers against whole texts encoded by their libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import alignment, queries
from larder.llm.byte_bpe import byte_characters

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A = Tokenizer.from_file(FILES[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
BYTE = {c: b for b, c in enumerate(byte_characters())}


def bytes_a(i):
    return bytes(BYTE[c] for c in A.id_to_token(i))


def bytes_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def tokens(text):
    """[(id, end)] of A and of B; none where the bytes differ."""
    if not text:
        return [], []
    out = []
    for ids, of in ((A.encode(" " + text, add_special_tokens=False).ids, bytes_a), (B.encode(text), bytes_b)):
        at, own, whole = 0, [], b""
        for i in ids:
            whole += of(i)
            own.append((i, len(whole)))
        if whole != (" " + text).encode():
            return [], []
        out.append(own)
    return out


def plain(rows):
    each, counts = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text)
        common = {e for _, e in a} & {e for _, e in b}
        groups, links = [], []
        for end in sorted(common):
            start = max((e for e in common if e < end), default=0)
            groups.append(",".join(str(i) for i, e in a if start < e <= end) + "|" + ",".join(str(i) for i, e in b if start < e <= end))
            links.append((next(i for i, e in a if e == end), next(i for i, e in b if e == end)))
        counts.update(links)
        each.append((doc_id, len(a), len(b), links, ";".join(groups)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, n_a, n_b, links, groups in each:
        n_best = sum(counts[link] == best[link[1]] for link in links)
        out.append((doc_id, n_a, n_b, len(links), len(links), n_best, sum(counts[link] for link in links), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


ODD = [(50, "a▁b", "en", "x", 1), (51, " ", "en", "x", 1), (56, "if (x) {\r\n  y();\r\n}\r", "en", "x", 1), (52, "\n\n x\x1c y　z w\x85v", "en", "x", 1), (53, "日本語のテキスト" * 50, "ja", "x", 1), (54, "<s></s><|endoftext|> <0x41>\x00", "en", "x", 1), (55, "trailing  \t ", "en", "x", 1)]


@pytest.fixture(scope="module")
def odd(spark, edge):
    return edge.where("doc_id IS NULL OR doc_id <> 7").union(spark.createDataFrame(ODD, edge.schema))


def test_edge_rows(spark, tables, odd):
    want = plain(rows_of(odd))
    assert got(queries.op13_alignment(spark, tables(documents=odd.withColumn("block", F.lit("clash"))))) == want
    assert got(queries.op13_alignment(spark, tables(documents=odd.limit(0)))) == []
    clashing = odd.withColumns({"block": F.lit(1), "segment": F.lit("clash"), "n_a": F.lit("clash"), "numbers": F.lit(2)})
    found = alignment.align(clashing, *FILES)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "block", "segment", "numbers", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted((r["doc_id"], r["n_a"], r["count_sum"]) for r in found.where("doc_id IS NOT NULL").collect()) == sorted((r[0], r[1], r[6]) for r in want if r[0] is not None)


def test_small_blocks_and_no_broadcast(spark, odd, tables, monkeypatch):
    """Many blocks and spans, and pairs joined instead of broadcast, give the same rows."""
    docs = tables(documents=odd)
    want = got(queries.op13_alignment(spark, docs))
    for name, value in (("BLOCK", 20), ("SPAN", 2), ("PAIRS", 0), ("SEGMENTS", 3)):
        monkeypatch.setattr(alignment, name, value)
    assert got(queries.op13_alignment(spark, docs)) == want


def test_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(queries.op13_alignment(spark, sf)) == plain(rows_of(docs))


def test_each_segment_is_aligned_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    dealt = alignment.blocks(docs, *FILES, "text", ["doc_id"]).cache()
    distinct = dealt.where("kind = 'segment'").select("segment").distinct().count()
    found = alignment.segments(dealt, *FILES).cache()
    assert found.count() == distinct
    cut = alignment.pair(*FILES).cut
    assert found.agg(F.sum("n")).first()[0] == sum(len(cut(" " + r["text"])) for r in docs.where("text <> ''").collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 9), st.integers(65_530, 65_540), st.integers(0, 2**31 - 1), st.sampled_from([0xFFFF, 0xFFFFFFF, 0xFFFF0000])), max_size=30))
def test_numbers_are_packed_without_loss(numbers):
    assert alignment.unpacked_numbers(alignment.packed_numbers(np.array(numbers, np.int64))).tolist() == numbers


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab the'sé日 \n\t\r\x0b\x85\xa0 　\x1c.,!1"), st.characters(codec="utf-8")), min_size=1, max_size=40))
def test_segments_encode_as_their_text(text):
    own = alignment.pair(*FILES)
    cuts = own.cut(" " + text)
    assert "".join(cuts) == " " + text
    assert [i for c in cuts for i in A.encode(c, add_special_tokens=False).ids] == A.encode(" " + text, add_special_tokens=False).ids
    if "▁" not in text:
        assert b"".join(map(own.own_b.encode_spaced, cuts)) == own.own_b.encode(text)


def test_cuts_follow_the_vocabularies():
    own = alignment.pair(*FILES)
    assert " " in own.safe and "\n" in own.safe and "\r" not in own.safe  # there is a piece ";\r"
    assert own.cut(" a b;\r\n c\nd  e\r") == [" a", " b;\r\n c", "\nd", "  e\r"]
    assert alignment.cutter(alignment.WHITE)(" a;\rb") == [" a;", "\rb"]
