"""Operators over documents against brute force, on edge cases and on the smallest tables."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import bilinear_lm, byte_bpe, language, media, packing, queries, simhash, toxicity, url_rules

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXT_QUERIES = ["op1_bilinear_lm", "op2_simhash", "op3_language", "op4_packing", "op5_media", "op8_toxicity", "op9_byte_bpe"]


@pytest.fixture(scope="module")
def edge_dir(spark, tables, edge):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (7, 1, 1), (7, 1, 1), (None, 0, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    return tables(documents=edge.withColumns({"score": F.lit("clash"), "ids": F.lit("clash"), "fingerprint": F.lit(1), "media": F.lit(1), "accepted": F.lit(1)}), labels=labels)


@pytest.fixture(scope="module")
def empty_dir(spark, tables, edge):
    return tables(documents=edge.limit(0), labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))


def texts(rows):
    return [(r["doc_id"], r["text"] or "") for r in rows]


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", [n for n in TEXT_QUERIES if n != "op4_packing"])
def test_a_row_for_each_edge_row(spark, edge_dir, edge, name):
    got = queries.QUERIES[name](spark, edge_dir)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in edge.collect())


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_bpe(got, rows):
    own = encoding()
    want = []
    for doc_id, text in texts(rows):
        ids = own.encode_ordinary(text)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), len(text), len(text)))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_byte_bpe(spark, edge_dir, edge, sf):
    check_bpe(queries.op9_byte_bpe(spark, edge_dir).collect(), edge.collect())
    check_bpe(queries.op9_byte_bpe(spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").collect())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab the'\n\t 1é日😀"), st.characters(codec="utf-8")), max_size=40))
def test_byte_bpe_equals_the_rank_library(text):
    own, ids = byte_bpe.codec(RANKS, P.PATTERN), None
    ids = own.encode(text)
    assert ids == encoding_once().encode_ordinary(text)
    assert own.decode_bytes(ids) == text.encode()
    assert "".join(own.decode_parts([[i] for i in ids])) == text
    if ids:
        starts, ends = own.offsets(text, ids)
        assert starts[0] == 0 and ends[-1] == len(text) and all(text[a:b] for a, b in zip(starts, ends, strict=True))


_once = []


def encoding_once():
    if not _once:
        _once.append(encoding())
    return _once[0]


def test_byte_bpe_decodes_columns(spark, edge, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART", 2)  # so that parts end within characters
    coded = byte_bpe.encode(edge, RANKS, P.PATTERN)
    back = byte_bpe.decode(coded, RANKS, P.PATTERN).select("text", "decoded_text", "ids", "starts", "ends").collect()
    for r in back:
        assert r["decoded_text"] == (r["text"] or "") and len(r["ids"]) == len(r["starts"]) == len(r["ends"])


def test_byte_bpe_decodes_what_is_no_text(spark):
    """Nulls and no ids give nothing; bytes that make no character come back as they are, and as U+FFFD in the text."""
    broken = encoding_once()._encode_bytes(b"a\xe6\x97b")
    rows = spark.createDataFrame([(1, None), (2, []), (3, broken)], "doc_id int, ids array<int>")
    got = {r["doc_id"]: (bytes(r["decoded"]), r["decoded_text"]) for r in byte_bpe.decode(rows, RANKS, P.PATTERN).collect()}
    assert got == {1: (b"", ""), 2: (b"", ""), 3: (b"a\xe6\x97b", b"a\xe6\x97b".decode("utf-8", "replace"))}


def check_packing(got, rows, capacity=2048):
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    want = Counter()
    for doc_id, text in texts(rows):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[(doc_id, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), math.ceil(sum(r["length"] for r in got) / capacity)


def test_packing(spark, edge_dir, edge, sf):
    check_packing(queries.op4_packing(spark, edge_dir).collect(), edge.collect())
    bins, least = check_packing(queries.op4_packing(spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert bins <= least + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(lengths):
    bins = packing.best_fit(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)
    loads = sorted(sum(lengths[i] for i in b) for b in bins)
    assert len(loads) < 2 or loads[0] + loads[1] > 50  # else two bins would make one


def test_packing_carries_columns_and_refuses_long_items(spark):
    items = spark.createDataFrame([(i, 3, "x") for i in range(100)], "item int, length int, offset string")
    packed = packing.pack(items, 9)
    assert packed.groupBy("sequence_id").count().where("count = 3").count() == 33
    with pytest.raises(Exception, match="fit"):
        packing.pack(items, 2).collect()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("AB the'\n\t 1éÉß"), st.characters(codec="utf-8")), max_size=40))
def test_word_codec_equals_the_library(text):
    own = packing._codecs.setdefault("test", packing._codecs.get("test") or packing.WordCodec(P.path("word_bpe_49k.json")))
    assert own.encode(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_media(spark, edge_dir, edge):
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in queries.op5_media(spark, edge_dir).collect())
    want = Counter()
    for doc_id, text in texts(edge.collect()):
        raw = text.encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[(doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))] += 1
    assert got == want
    same = {(r["media_sha256"], r["feature"]) for r in queries.op5_media(spark, edge_dir).where("doc_id IN (1, 2)").collect()}
    assert len(same) == 1


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000))
def test_frames_round_trip(payload):
    frames, size, rate = media.demux(media.mux(media.encode_frames(payload), len(payload)))
    assert media.decode_frames(frames).tobytes()[:size] == payload and rate == media.RATE


def test_frames_decode_as_a_bit_by_bit_decoder_does():
    payload = bytes(np.random.default_rng(0).integers(0, 256, media.WIDE * media.HIGH, dtype=np.uint8))
    (frame,) = media.encode_frames(payload)
    scan = frame[len(media.HEADER) : -2].replace(b"\xff\x00", b"\xff")
    bits = "".join(f"{b:08b}" for b in scan)
    codes, code, at = {}, 0, 0
    for length in range(1, 17):
        for symbol in media.DC_TABLE[16 + at : 16 + at + media.DC_TABLE[length - 1]]:
            codes[f"{code:0{length}b}"] = symbol
            code, at = code + 1, at + 1
        code <<= 1
    levels, before, i = [], 0, 0
    for _ in range(len(payload)):
        n = 1
        while bits[i : i + n] not in codes:
            n += 1
        size = codes[bits[i : i + n]]
        i += n
        extra = int(bits[i : i + size] or "0", 2)
        before += extra if not size or bits[i] == "1" else extra - (1 << size) + 1
        i += size
        assert bits[i] == "0"  # end of block
        i += 1
        levels.append(before * 8 // 8 + 128)
    assert bytes(levels) == payload


def test_shots_and_clips(spark):
    dark, light = b"\x10" * 1024 * 5, b"\xe0" * 1024 * 5
    rows = spark.createDataFrame([(1, (dark + light + dark).decode("latin-1"))], "doc_id bigint, text string").select("doc_id", F.encode(F.col("text"), "ISO-8859-1").alias("payload"))

    def muxed(batches):
        import pyarrow as pa

        from larder.llm import media as m

        for b in batches:
            raw = b.column("payload").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m.mux(m.encode_frames(r), len(r)) for r in raw], pa.binary())], names=["doc_id", "media"])

    stored = rows.mapInArrow(muxed, "doc_id bigint, media binary")
    found = media.clips(media.read(stored), ["doc_id"]).collect()
    assert [(r["start_frame"], r["end_frame"], r["start_s"]) for r in found] == [(0, 5, 0.0), (5, 10, 0.2), (10, 15, 0.4)]


def java_jpeg(spark, pixels):
    """A JPEG of the runtime's own encoder, and the brightness that its own decoder gives."""
    jvm, (high, wide) = spark._jvm, pixels.shape[:2]
    grey = pixels.ndim == 2
    image = jvm.java.awt.image.BufferedImage(wide, high, 10 if grey else 5)
    flat = spark.sparkContext._gateway.new_array(jvm.int, pixels.size)
    for k, x in enumerate(pixels.ravel().tolist()):
        flat[k] = x
    image.getRaster().setPixels(0, 0, wide, high, flat)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    raw = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw)).getRaster()
    got = np.array(list(back.getPixels(0, 0, wide, high, spark.sparkContext._gateway.new_array(jvm.int, pixels.size)))).reshape(pixels.shape)
    return raw, got if grey else got @ np.array([0.299, 0.587, 0.114])


def waves(high, wide):
    y, x = np.mgrid[0:high, 0:wide]
    return ((np.sin(x / 7) + np.cos(y / 5)) * 60 + 120 + np.random.default_rng(0).normal(0, 10, x.shape)).clip(0, 255).astype(np.uint8)


def test_ordinary_frames_decode_as_the_runtime_does(spark):
    """Standard tables, all coefficients; grey, and in colour with subsampled components; sizes that fill no block."""
    grey = waves(37, 53)
    raw, want = java_jpeg(spark, grey)
    assert np.abs(media.decode_frame(raw) - want).max() <= 1
    raw, want = java_jpeg(spark, np.stack([grey, grey[::-1], grey[:, ::-1]], axis=-1))
    assert np.abs(media.decode_frame(raw) - want).mean() < 1
    (own,) = media.encode_frames(bytes(range(256)) * 4)
    assert media.decode_frame(own)[::8, ::8].tobytes() == bytes(range(256)) * 4


def avi(frames):
    return media.mux(frames, 0).replace(b"payload=0", b"nothing=0")


def test_media_that_store_did_not_write(spark):
    """Ordinary frames give clips and no payload, with their index or without; broken media give a reason."""
    dark, light = (java_jpeg(spark, np.full((24, 40), x, np.uint8))[0] for x in (20, 220))
    whole = avi([dark] * 3 + [light] * 4)
    bare = whole.replace(b"idx1", b"JUNK")
    own = media.mux(media.encode_frames(b"abc" * 700), 2100)
    cases = {"whole": whole, "bare": bare, "null": None, "empty": b"", "short": whole[: len(whole) // 2], "cut": own[:-3000], "progressive": avi([dark.replace(b"\xff\xc0", b"\xff\xc2")]), "text": b"RIFF....AVI movi", "own": own}
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v), 1) for k, v in cases.items()], "name string, media binary, reason int")
    got = {r["name"]: r for r in media.read(rows).collect()}
    assert set(got) == set(cases)
    for name in ("whole", "bare"):
        assert [(c["start_frame"], c["end_frame"]) for c in got[name]["clips"]] == [(0, 3), (3, 7)]
        assert got[name]["payload"] is None and got[name]["reason"] is None
    assert bytes(got["own"]["payload"]) == b"abc" * 700
    for name in ("null", "empty", "short", "cut", "progressive", "text"):
        assert got[name]["payload"] is None and got[name]["clips"] is None and (got[name]["reason"] is None) == (name == "null")


def test_media_features_are_the_shots_of_plain_histograms(spark, edge_dir, edge):
    got = Counter((r["doc_id"], r["feature"]) for r in queries.op5_media(spark, edge_dir).collect())
    want = Counter()
    for doc_id, text in texts(edge.collect()):
        raw = text.encode()
        size = media.WIDE * media.HIGH
        raw += bytes(-len(raw) % size if raw else size)
        frames = [Counter(b // 16 for b in raw[k : k + size]) for k in range(0, len(raw), size)]
        apart = [0.0] + [sum(abs(a[x] - b[x]) for x in range(16)) / size / 2 for a, b in zip(frames, frames[1:], strict=False)]
        starts = [0]
        for k in range(1, len(frames)):
            before = apart[max(starts[-1] + 1, k - media.WINDOW) : k]
            mean = sum(before) / len(before) if before else 0.0
            spread = math.sqrt(sum((x - mean) ** 2 for x in before) / len(before)) if before else 0.0
            if apart[k] > max(mean + media.DEVIATIONS * spread, media.FLOOR):
                starts.append(k)
        want[(doc_id, "shots:" + ",".join(f"{a}-{b}" for a, b in zip(starts, [*starts[1:], len(frames)], strict=True)))] += 1
    assert got == want


def plain_fingerprint(text, width=4):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, sf, edge_dir, edge):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t or "") for i, t in docs.items()}
    want = plain_components(prints)
    for r in queries.op2_simhash(spark, sf).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])
    got = {(r["doc_id"], r["component_id"]) for r in queries.op2_simhash(spark, edge_dir).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (8, 8), (None, None)} <= got


def clustered(seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(12):
        at = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, 40))):
            for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                at ^= 1 << int(bit)
            out.append(at)
    return sorted(set(out))


@pytest.mark.parametrize(("rows", "mean"), [(2048, 64), (8, 1), (16, 0)])
def test_links_join_all_that_lie_within_the_radius(spark, monkeypatch, rows, mean):
    """Chains of close fingerprints, whole shards, and shards split into blocks, of few and many bands, against all pairs."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
    monkeypatch.setattr(simhash, "SHARD_MEAN", mean)
    prints = dict(enumerate(clustered()))
    found = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")), i) for i, v in prints.items()], "fingerprint binary, rep bigint")
    labels = {r["id"]: r["component"] for r in simhash.components(simhash.links(found, 4, 64)).collect()}
    assert {i: labels.get(i, i) for i in prints} == plain_components(prints)


def test_tree_search_equals_all_pairs():
    prints = np.array(clustered(3), np.uint64)
    tree = simhash.Forest(prints[:, None], np.array([0]), np.array([len(prints)]), 4)
    tree.search(np.full(len(prints), len(prints)))
    assert tree.roots(np.arange(len(prints))).tolist() == list(plain_components({i: int(v) for i, v in enumerate(prints)}).values())
    assert 0 < tree.visited < len(prints) ** 2  # edges beyond the radius weren't followed


def test_trees_are_those_of_one_insertion_after_another(monkeypatch):
    monkeypatch.setattr(simhash, "VISITS", 50)
    prints = clustered(5)
    first, sizes = np.array([0, 40, 41]), np.array([40, 1, len(prints) - 41])
    forest = simhash.Forest(np.array(prints, np.uint64)[:, None], first, sizes, 4)
    want = {}
    for a, n in zip(first, sizes, strict=True):
        for i in range(a + 1, a + n):
            at = a
            while (step := (at, (prints[i] ^ prints[at]).bit_count())) in want:
                at = want[step]
            want[step] = i
    got = {(int(k) // forest.wide, int(k) % forest.wide): int(c) for k, c in zip(forest.edges, forest.children, strict=True)}
    assert got == want
    forest.search(np.repeat(sizes, sizes))
    apart = {}
    for a, n in zip(first, sizes, strict=True):
        apart |= plain_components({i: prints[i] for i in range(a, a + n)})
    assert forest.roots(np.arange(len(prints))).tolist() == [apart[i] for i in range(len(prints))]


@pytest.mark.parametrize("number", [10, 10**6, 10**10])
def test_every_pair_within_the_radius_shares_an_exact_key(number):
    keys = simhash.exact_keys(64, 4, number)
    rng = np.random.default_rng(number)
    for _ in range(50):
        changed = set(rng.choice(64, 4, replace=False).tolist())
        assert any(changed.isdisjoint(k) for k in keys)
    assert number / 2 ** min(map(len, keys)) <= simhash.SHARD_MEAN * 2 or number == 10**10


def test_components_of_a_long_chain(spark):
    pairs = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r["component"] for r in simhash.components(pairs).collect()} == {0}


def test_language(spark, sf):
    rows = queries.op3_language(spark, sf).collect()
    assert np.mean([r["declared"] == r["language"] for r in rows]) >= 0.99 and all(r["accepted"] for r in rows)


def test_language_rejects_what_has_none(spark, edge):
    noise = spark.createDataFrame([(100, "xqzv " * 50, "en", "a", 1)], edge.schema)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(edge).unionByName(noise)
    got = {r["doc_id"]: r["accepted"] for r in language.identify(docs, keep=["doc_id"]).collect()}
    assert [got[i] for i in (100,)] == [False]
    empty = {r["text"]: r["accepted"] for r in language.identify(edge).select("text", "accepted").collect()}
    assert empty[None] is False and empty[""] is False and empty[" \t\n\x0b "] is False


def test_language_fuses_as_bayes_says(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).cache()
    rows = language.identify(docs).collect()
    counts = language.train(docs)
    by_host = Counter((r["source"], r["lang"]) for r in docs.collect())
    whole = Counter(r["lang"] for r in docs.collect())
    langs, n = language.LANGUAGES, sum(whole.values()) + 4
    base = np.array([(whole[x] + 1) / n for x in langs])
    for r in rows:
        level = base
        for _ in range(3):  # suffix, domain and host are the same here
            own = np.array([by_host[(r["source"], x)] for x in langs])
            level = (own + language.SMOOTH * level) / (own.sum() + language.SMOOTH)
        grams = language.trigrams((r["text"] or "").encode())
        others = counts.copy()  # of all texts but this one
        others[:, langs.index(r["lang"])] -= np.bincount(grams, minlength=len(others))
        text = language.TEMPER * np.append(np.log(others / others.sum(axis=0))[grams].sum(axis=0), -math.log(len(others)) * len(grams))
        told = np.array([math.log(language.RELIABLE if x == r["lang"] else (1 - language.RELIABLE) / 3) for x in langs] + [math.log(1 / 4)])
        joint = text + told + np.append(np.log(level), math.log(language.UNKNOWN_PRIOR))
        want = np.exp(joint - joint.max()) / np.exp(joint - joint.max()).sum()
        assert np.allclose(r["posterior"], want, atol=1e-9)


def test_language_without_what_is_declared(spark):
    """A fifth of the documents, and of the pages, hide what they declare; their texts and hosts must tell."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = docs.withColumns({"told": F.col("lang"), "lang": F.when(F.col("doc_id") % 5 != 0, F.col("lang"))})
    rows = language.identify(hidden, keep=["doc_id", "told"]).where("doc_id % 5 = 0").collect()
    assert len(rows) > 150 and np.mean([r["language"] == r["told"] for r in rows]) >= 0.98
    pages = language.page_texts(url_rules.url_parts(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))
    hidden = pages.withColumns({"told": F.col("declared"), "declared": F.when(F.col("page_id") % 5 != 0, F.col("declared"))})
    rows = language.identify(hidden, "page_text", "declared", "host", keep=["page_id", "told"]).where("page_id % 5 = 0").collect()
    assert len(rows) == 50 and np.mean([r["language"] == r["told"] for r in rows]) >= 0.95


def test_page_texts(spark):
    html = "<!DOCTYPE html><HTML class='x' lang='en-GB'><style>p{margin:0}</style><script>var t='</p>';</script><!-- no --><p>one&amp;two</p>three"
    rows = spark.createDataFrame([(1, html), (2, None), (3, "<html><p>plain"), (4, "")], "page_id int, html string")
    got = {r["page_id"]: (r["declared"], r["page_text"] and r["page_text"].split()) for r in language.page_texts(rows).collect()}
    assert got == {1: ("en", ["one", "two", "three"]), 2: (None, None), 3: (None, ["plain"]), 4: (None, "")}


def test_hosts_that_declare_nothing_take_the_level_above(spark):
    a, b = language.LANGUAGES[:2]
    rows = [("one.firm.aa", a)] * 30 + [("two.firm.aa", None), ("new.other.aa", "zz"), ("new.bare.cc", None)] + [("x.bb", b)] * 30
    docs = spark.createDataFrame(rows, "source string, lang string")
    priors, whole = language.host_priors(docs, F.col("source"), "lang", language.LANGUAGES)
    got = {r["host"]: np.exp(r["host_log"]) for r in priors.collect()}
    own, base = np.array([30.0 * (x == a) for x in language.LANGUAGES]), np.exp(whole)
    suffix = (own + language.SMOOTH * base) / (30 + language.SMOOTH)
    domain = (own + language.SMOOTH * suffix) / (30 + language.SMOOTH)
    assert set(got) == {h for h, _ in rows}
    assert np.allclose(got["two.firm.aa"], domain) and np.allclose(got["new.other.aa"], suffix) and np.allclose(got["new.bare.cc"], base)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in queries.op8_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic = [r["predicted"] for r in held if labels[r["doc_id"]] == 1]
    clean = [r["predicted"] for r in held if labels[r["doc_id"]] == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in held)


def test_toxicity_without_positives_gives_the_prior(spark, edge):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(edge, none)
    assert {round(r["score"], 6) for r in toxicity.classify(edge, model).collect()} == {toxicity.PRIOR}


def test_toxicity_fits_one_text_an_id(spark):
    rows = [(1, f"text {k}") for k in range(40)] + [(i, f"other {i}") for i in range(2, 6)]
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    got = toxicity.sampled(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, 3, 10).collect()
    assert sorted((r["toxic"], r["text"]) for r in got) == [(False, f"other {i}") for i in range(2, 6)] + [(False, "text 0"), (True, "text 0")]


def test_toxicity_learns_words_and_stems():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    clean = lambda: " ".join(word() for _ in range(60))
    bad = lambda: f"{clean()} vile {clean()} grumps{word()} grumps{word()}"
    model = toxicity.fit([bad() for _ in range(200)], [bad() if rng.random() < 0.1 else clean() for _ in range(2000)], 0.1)
    score = toxicity.Scorer(model)
    assert min(score(bad()) for _ in range(50)) > 0.5 > max(score(clean()) for _ in range(50))


def test_language_model_counts(spark, edge_dir, edge, sf):
    for folder, rows in ((edge_dir, edge.collect()), (sf, spark.read.parquet(f"{sf}/documents.parquet").collect())):
        held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
        words = [(i, [*t.encode().lower().split(), b"\n"]) for i, t in texts(rows)]
        counts = Counter(w for i, ws in words if not held(i) for w in ws)
        total, distinct = sum(counts.values()), len(counts)
        want = sorted(((str(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 6)) for i, ws in words), key=str)
        got = sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in queries.op1_bilinear_lm(spark, folder).collect()), key=str)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in queries.op1_bilinear_lm(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_model_is_normalised():
    uses = np.sort(np.random.default_rng(0).integers(1, 1000, 192).astype(float))[::-1]
    model = bilinear_lm.LogBilinear(uses, np.array([0, 1, 5, 20, 90]))
    rng = np.random.default_rng(1)
    ctx = rng.integers(0, 192, (5000, bilinear_lm.CONTEXT)).astype(np.uint16)
    model.train(ctx, ctx[:, 0], rng)
    one = np.repeat(ctx[:1], 192, axis=0)
    assert (10 ** model.log10(one, np.arange(192))).sum() == pytest.approx(1, abs=1e-5)


def test_noise_contrastive_steps_learn_what_follows_what():
    """Each unit is followed by one of two: the scores come near the true ones, far from the units' shares."""
    rng = np.random.default_rng(2)
    before = rng.integers(0, 40, 60_000)
    after = (before * 7 + rng.integers(0, 2, len(before))) % 40
    ctx = np.stack([before, rng.integers(0, 40, len(before)), rng.integers(0, 40, len(before))], axis=1)
    model = bilinear_lm.LogBilinear(np.bincount(after, minlength=40).astype(float), np.array([0, 10, 20, 30]))
    for _ in range(3):
        model.train(ctx[:50_000], after[:50_000], rng)
    got = -model.log10(ctx[50_000:], after[50_000:]).mean()
    assert math.log10(2) <= got < 0.75 < math.log10(40)


def test_language_model_scores_equal_a_sum_over_all_words(spark, edge):
    """score of each text, from the fitted parameters, by plain sums over groups, units and words."""
    docs = edge.where("doc_id <> 7").select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).selectExpr("doc_id + 100", "text"))
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(1)
    coded, units = bilinear_lm.read(docs, F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True)))
    flat = bilinear_lm.fit(coded, units)
    model = bilinear_lm.LogBilinear(units.uses, units.starts).load(flat)
    counts, of_unit = Counter(), {}
    unit = lambda w: units.words.get(w, units.endings.get(w[-3:], units.rest))
    rows = docs.collect()
    words_of = [[*(r["text"] or "").encode().lower().split(), b"\n"] for r in rows]
    for r, words in zip(rows, words_of, strict=True):
        if r["doc_id"] is None or r["doc_id"] % 3 != 1:
            counts.update(words)
    for w in counts:
        of_unit.setdefault(unit(w), []).append(w)
    assert len(units.words) > 100 and len(units.endings) > 10 and len(units.starts) > 5
    exps = lambda z: np.exp(z.astype(np.float64))
    want = []
    for r, words in zip(rows, words_of, strict=True):
        own, total = [unit(w) for w in words], 0.0
        for k, w in enumerate(words):
            q = sum(model.before[own[k - 1 - j] if k > j else units.end] * model.places[j] for j in range(bilinear_lm.CONTEXT))
            g = model.group[own[k]]
            groups, members = exps(model.groups @ q + model.group_bias), np.flatnonzero(model.group == g)
            inside = exps(model.after[members] @ q + model.bias[members])
            p = groups[g] / groups.sum() * inside[members == own[k]][0] / inside.sum()
            if units.shared[own[k]]:
                p *= (counts[w] + 1) / (sum(counts[x] + 1 for x in of_unit.get(own[k], ())) + 1)
            total += math.log10(p)
        want.append((str(r["doc_id"]), total))
    got = [(str(r["doc_id"]), r["score"]) for r in bilinear_lm.score_coded(coded, units, flat).collect()]
    want.sort()
    got.sort()
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-4)


def test_units_grow_with_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few, many = (len(bilinear_lm.read(d, F.lit(True))[1].uses) for d in (docs.limit(30), docs))
    assert many > 2 * few


def test_contexts_stop_at_the_text_before():
    units, lengths = np.array([5, 6, 7, 0, 8, 0, 0, 9, 4, 3, 2, 0], np.uint16), np.array([4, 2, 1, 5])
    want, at = [], 0
    for n in lengths:
        own = units[at : at + n]
        want += [[own[i - 1 - j] if i > j else 0 for j in range(bilinear_lm.CONTEXT)] for i in range(n)]
        at += n
    assert bilinear_lm.contexts(units, lengths, 0).tolist() == np.array(want).tolist()


@pytest.mark.parametrize("split", [False, True])
def test_candidates_are_found_by_bk_trees(spark, monkeypatch, split):
    """The nearest of another component, and all such pairs, equal all pairs' comparison, and no shard is compared row by row."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (2, 6), dtype=np.uint64)
    prints = np.concatenate([base[k // 30] ^ (np.uint64(1) << rng.integers(0, 64, 6, dtype=np.uint64)) for k in range(60)] + [rng.integers(0, 2**63, 6, dtype=np.uint64) for _ in range(20)]).reshape(80, 6)
    component, side = np.arange(80) // 3, np.arange(80) % 2 if split else np.zeros(80, int)
    order = np.argsort(side, kind="stable")
    columns = [np.zeros(80, np.int64), np.zeros(80, np.int32), side[order].astype(np.int32)]
    raw = pa.array([prints[k].astype(">u8").tobytes() for k in order], pa.binary())
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), raw, pa.array(order), pa.array(component[order])], names=["key", "block", "side", "fingerprint", "rep", "component"])
    trees, caught, forest = [], [], simhash.Forest
    monkeypatch.setattr(simhash, "Forest", lambda *of: trees.append(forest(*of)) or trees[-1])
    monkeypatch.setattr(simhash, "_search", lambda rows, keys, found_in, out: caught.append(found_in) or spark.createDataFrame([], out))
    found = spark.createDataFrame([], "fingerprint binary, node bigint, component bigint")
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int)
    fits = (apart <= 76) & (component[:, None] != component[None]) & ((side[:, None] != side[None]) | (not split))
    for nearest in (True, False):
        simhash.candidates(found, 76, [[0, 1]], nearest)
        got = [(r["a"], r["b"], r["apart"]) for out in caught[-1](batch) for r in out.to_pylist()]
        if nearest:
            assert {(a, d) for a, _, d in got} == {(a, apart[a][fits[a]].min()) for a in range(80) if fits[a].any()} and all(fits[a, b] and apart[a, b] == d for a, b, d in got)
            assert 80 <= trees[-1].visited < 80 * 80  # edges beyond the nearest so far weren't followed
        else:
            assert sorted(got) == sorted((a, b, apart[a, b]) for a in range(80) for b in range(a) if fits[a, b])
    assert len(trees) == 2 and len(got) > 100


def test_near_duplicates_leave_without_a_shuffle_of_texts(spark, monkeypatch):
    """The ids that go are broadcast up to a bound, whatever Spark takes the tables' sizes for."""
    import corpus_pipeline

    monkeypatch.setattr(simhash, "near_duplicates", lambda *_: spark.createDataFrame([(1, 1), (2, 1), (3, 3), (3, 3)], "doc_id bigint, component_id bigint"))
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "b")], "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(map(tuple, kept.collect())) == [(1, "a"), (3, "b")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_what_noise_is_drawn_by_is_computed_once(monkeypatch):
    """Sums and logs over all units belong to the model, not to each step, and give the same draws."""
    uses, starts = np.array([50.0, 20, 9, 4, 2, 1]), np.array([0, 2, 4])
    model = bilinear_lm.LogBilinear(uses, starts)
    for (sums, whole, logs), noise in zip(model.drawing, (model.noise, model.group_noise), strict=True):
        assert np.array_equal(sums, np.cumsum(noise)) and whole == noise.sum() and np.allclose(logs, np.log(bilinear_lm.NOISE * noise))
    monkeypatch.setattr(np, "cumsum", lambda *_, real=np.cumsum, **__: real(*_, **__) if np.asarray(_[0]).dtype != float else pytest.fail("summed in a step"))
    model.train(np.zeros((40, bilinear_lm.CONTEXT), int), np.arange(40) % 6, np.random.default_rng(0))


def test_words_are_coded_by_runs_of_texts():
    """Places, distinct words and lengths equal a plain split's, for one run and for several, sliced arrays too."""
    raw = [b"", b"  ", b" a B\tc\n", b"x", b"\xff\xfe Q\x00q \xc3\x89\x85 \xc2\xa0 A\x1cB", b"a\x0bb\x0cc\rd", b"A a A"]
    want = [[*text.lower().split(), bilinear_lm.END] for text in raw]
    texts = pa.array(raw, pa.binary())
    for cuts in ([0, 7], [0, 1, 2, 5, 7], [0, 4, 4, 7]):
        words, tokens, lengths = bilinear_lm.merged([bilinear_lm.coded_words(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)])
        assert words.to_pylist() == list(dict.fromkeys([bilinear_lm.END, *(w for ws in want for w in ws)]))
        assert lengths.tolist() == [len(ws) for ws in want]
        assert words.take(pa.array(tokens)).to_pylist() == [w for ws in want for w in ws]


@pytest.mark.parametrize("bound", [1, 40, 1 << 30])
def test_blocks_are_cut_after_the_text_that_fills_them(spark, monkeypatch, bound):
    monkeypatch.setattr(bilinear_lm, "BLOCK_BYTES", bound)
    monkeypatch.setattr(bilinear_lm, "SLICE_BYTES", 16)
    texts = [None, "a b", "", "c " * 30, "a", "é É e", " d a  b\n" * 3, "", "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    # in this process, so that the bounds hold
    caught = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append((self, run)))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    bilinear_lm.blocks(docs, F.col("doc_id") % 2 == 0)
    rows, run = caught[0]
    got = [r for out in run(rows.toArrow().to_batches()) for r in out.to_pylist()]
    want, size = [[]], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        want[-1].append((k, raw))
        size += len(raw)
        if size >= bound:
            want.append([])
            size = 0
    want = [block for block in want if block]
    assert [r["block"] for r in got] == [3 << 24 | k for k in range(len(want))] and [r["ids"] for r in got] == [[k for k, _ in block] for block in want]
    for r, block in zip(got, want, strict=True):
        words = [[*raw.lower().split(), bilinear_lm.END] for _, raw in block]
        tokens = np.frombuffer(zlib.decompress(r["tokens"]), np.int32)
        assert [r["words"][t] for t in tokens] == [w for ws in words for w in ws] and r["lengths"] == [len(ws) for ws in words]
        used = Counter(w for (k, _), ws in zip(block, words, strict=True) if k % 2 == 0 for w in ws)
        assert r["counts"] == [used[w] for w in r["words"]] and r["training"] == [k % 2 == 0 for k, _ in block]


def test_words_are_counted_and_coded_by_one_sort_each(spark):
    """Counts need one window and one sort; blocks are gathered by a sort of one number; words come in any order."""
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "a")], "doc_id bigint, text string").repartition(3, "doc_id")
    table = bilinear_lm.materialize(bilinear_lm.blocks(docs, F.lit(True)), "test-blocks")
    counted = bilinear_lm.corpus_counts(table)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == plan.count("Window [") == 1
    assert sorted({(r["word"].decode(), r["total"]) for r in counted.collect()}) == [("\n", 3), ("a", 3), ("b", 2), ("c", 1)]
    assert sorted(r["word"].decode() for r in counted.where("first").collect()) == ["\n", "a", "b", "c"]
    coded = bilinear_lm.code(table, counted, bilinear_lm.vocabulary(counted))
    sorts = [line for line in coded._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [block#" in line]
    assert len(sorts) == 1 and "place#" not in sorts[0]


def test_slopes_of_running_text_are_added_up_once_a_token():
    """One row a token, not one a place of its context, with the sums of all places; ids of any other order keep all their rows."""
    rng = np.random.default_rng(5)
    units = rng.integers(0, 50, 2000)
    running = bilinear_lm.contexts(units, np.array([700, 1, 2, 1297]), 0).T.astype(np.int64)
    for ctx, most in ((running, 2000 + 40), (rng.integers(0, 50, (bilinear_lm.CONTEXT, 2000)), 2000 * bilinear_lm.CONTEXT)):
        slopes = [rng.normal(0, 1, (2000, bilinear_lm.WIDTH)).astype(np.float32) for _ in ctx]
        want = np.zeros((50, bilinear_lm.WIDTH))
        for ids, rows in zip(ctx, slopes, strict=True):
            np.add.at(want, ids, rows)
        ids, rows = bilinear_lm.shared_contexts(ctx, slopes)
        assert 2000 <= len(ids) <= most
        assert np.allclose(bilinear_lm.scatter(ids, rows, 50), want, atol=1e-3)


@pytest.mark.parametrize("scale", [1, 30, 1000])
def test_log_softmax_is_the_same_within_and_beyond_safe_logits(scale):
    """Logits within the bound are not shifted, those beyond are; far ones neither overflow nor vanish."""
    rng = np.random.default_rng(6)
    logits, own = (rng.uniform(-1, 1, (500, 70)) * scale).astype(np.float32), rng.integers(0, 70, 500)
    exact = logits.astype(np.float64)
    shift = exact.max(axis=1)
    want = exact[np.arange(500), own] - shift - np.log(np.exp(exact - shift[:, None]).sum(axis=1))
    for most in [scale, np.inf][scale > bilinear_lm.SAFE :]:
        assert np.allclose(bilinear_lm.log_softmax_at(logits.copy(), own, most), want, rtol=1e-5, atol=1e-5)
    assert bilinear_lm.longest(logits) == pytest.approx(np.linalg.norm(exact, axis=1).max(), rel=1e-5)
