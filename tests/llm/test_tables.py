"""URL rules, WARC bundles and the permutation index against brute force; then the pipeline."""

import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import permutation_index, queries, simhash, url_rules, warc

PAGES = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [
        (1, "https://www.example.com/en/1?a=1#t", big),
        (2, "http://example.com/en/2", big),
        (3, "http://m.Example.NET/es/3", "small"),
        (4, "http://m.example.net/es/3", "small"),
        (5, None, None),
        (6, "no scheme", ""),
        (7, "http://notexample.com/en/\r\nX: y", big + "é"),
        (8, "https://x.org?q", "x" * 400_000),
        (9, "https://com", "x" * 400_000),
        (None, "http://net/fr/", big),
        (9, "https://com", "x" * 400_000),
        (10, "ftp://a.b://c/d", ""),
    ]
    return spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("clash"), "payload_digest": F.lit("clash"), "tokens": F.lit(1)})


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    fits = [(h + p, v) for v, h, p in queries.POLICY if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_rules(spark, tables, pages):
    folder = tables(pages=pages, labels=spark.createDataFrame([(1, 1, None), (None, None, 1)], "doc_id bigint, quality int, toxic int"))
    got = queries.op6_url_rules(spark, folder).collect()
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    assert len(got) == pages.count()
    for r in got:
        assert (r["host"], r["path"]) == plain_parts(urls[r["page_id"]])
        rule, verdict = plain_rule(r["host"], r["path"])
        assert r["rule"] == rule and r["verdict"] == (verdict or "allow")


def test_long_urls_are_judged_whole(spark):
    long = "http://Example.com/en/" + "/".join(f"part{i}" for i in range(5000)) + "?" + "&".join(f"k{i}=v" for i in range(500))
    judged = url_rules.judge(spark.createDataFrame([(1, long), (1, long), (2, "http://example.com/de/" + "x" * 100_000)], "page_id bigint, url string"), queries.POLICY, None).collect()
    assert [(r["host"], r["rule"], r["verdict"]) for r in judged if r["page_id"] == 1] == [("example.com", "example.com/en/", "block")] * 2
    assert [(len(r["path"]), r["verdict"]) for r in judged if r["page_id"] == 2] == [(100_004, "allow")]


def test_mined_rules_equal_brute_force(spark):
    """All token sets that reach the support and confidence, matched to all URLs."""
    rng = np.random.default_rng(0)
    urls = [f"http://{rng.choice(['a', 'ads', 'b'])}.x.{rng.choice(['org', 'biz'])}/{rng.choice(['en', 'win'])}/{i}" for i in range(300)]
    blocked = [("ads." in u and "/win/" in u) or (rng.random() < 0.05) for u in urls]
    df = spark.createDataFrame(list(zip(range(300), urls, blocked, strict=True)), "page_id bigint, url string, blocked boolean")
    labelled = url_rules.url_parts(df).select("page_id", url_rules.url_tokens().alias("tokens"), "blocked")
    sets = {r["page_id"]: (frozenset(r["tokens"]), r["blocked"]) for r in labelled.collect()}
    support, confidence = 0.05, 0.6
    seen, bad = {}, {}
    for tokens, is_bad in sets.values():
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                seen[c] = seen.get(c, 0) + 1
                bad[c] = bad.get(c, 0) + is_bad
    rules = {frozenset(c): bad[c] / seen[c] for c in seen if bad[c] >= support * len(sets) and bad[c] / seen[c] >= confidence}
    assert rules
    got = url_rules.judge(df.drop("blocked"), [], labelled, min_support=support, min_confidence=confidence).collect()
    for r in got:
        best = max((v for k, v in rules.items() if k <= sets[r["page_id"]][0]), default=None)
        assert r["verdict"] == ("block" if best is not None else "allow")
        assert r["confidence"] == (pytest.approx(best) if best is not None else None)


def plain_warc(rows):
    raw = [(r["page_id"], (r["html"] or "").encode()) for r in rows]
    latest = {}
    for i, h in raw:
        if len(h) >= 1000 and i is not None:
            latest[h] = max(latest.get(h, i), i)
    for i, h in raw:
        to = latest.get(h) if len(h) >= 1000 and sum(x == h for _, x in raw) > 1 else None
        to = None if to == i else to
        yield (i, len(h), hashlib.sha1(h).hexdigest(), "response" if to is None else "revisit", to)


def test_warc(spark, tables, pages, sf):
    folder = tables(pages=pages)
    assert sorted(map(tuple, queries.op10_warc(spark, folder).collect()), key=str) == sorted(plain_warc(pages.collect()), key=str)
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert sorted(map(tuple, queries.op10_warc(spark, sf).collect()), key=str) == sorted(plain_warc(rows), key=str)


def test_bundles_are_seekable_and_standard(spark, pages, tmp_path):
    import zstandard

    bundles = warc.write(pages)
    some = warc.read(bundles, page_ids=[8, 3]).collect()
    assert {r["page_id"] for r in some} == {8, 3} and next(r for r in some if r["page_id"] == 3)["payload"] == b"small"
    saved = {r["bundle"]: r["size"] for r in warc.save(bundles, f"file://{tmp_path}/out").collect()}
    for row in bundles.collect():
        content = (tmp_path / "out" / row["bundle"]).read_bytes()
        assert content == bytes(row["content"]) and saved[row["bundle"]] == len(content)
        whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        assert len(whole) == sum(x["length"] for x in row["index"]) == sum(s for _, _, s in warc.seek_table(content))
        assert whole.startswith(b"WARC/1.1\r\n")


def test_index_recall_and_ties(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in queries.op7_permutation_index(spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - score[ids == i][0]) < 1e-12 for _, i, s in found)
        hits += len(set(best) & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(got)


def test_index_leaves_out_what_isnt_a_vector(spark, tables):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [3.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [])]
    folder = tables(embeddings=spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op7_permutation_index(spark, folder).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 2, 3.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]


def test_index_splits_files_and_keeps_rows_that_repeat(spark, monkeypatch):
    """Hot files in cells, a group of copies, repeated ids, clashing columns: every query's nearest are exact where all files are read."""
    monkeypatch.setattr(permutation_index, "FILE_ROWS", 16)
    monkeypatch.setattr(permutation_index, "QUERY_ROWS", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 6)).round(3)
    x[:90] = x[0]
    ids = np.arange(260)
    ids[200:230] = ids[201]
    rows = [(int(i), v.tolist(), 1, 1, 1.0, 1) for i, v in zip(ids, x, strict=True)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id int, v int, score double, rank int")
    got = {}
    for r in permutation_index.search(table, "id % 20 = 0", k=5, read=10**6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    for q, found in got.items():
        score = (x * x[ids == q][0]).sum(axis=1)
        best = [(i, s) for i, s in zip(ids[np.lexsort((ids, -score))].tolist(), np.sort(score)[::-1], strict=True) if i != q][:5]
        assert [(r, i) for r, i, _ in sorted(found)] == [(k + 1, i) for k, (i, _) in enumerate(best)]
        assert np.allclose([s for *_, s in sorted(found)], [s for _, s in best])


def test_footrule_ranks_as_the_plain_distance():
    rng = np.random.default_rng(4)
    pivots, length = 30, 8
    orders = np.array([rng.permutation(pivots)[:length] for _ in range(50)], np.uint16)
    asked = np.array([rng.permutation(pivots)[:length] for _ in range(5)])
    places = np.full((5, pivots), length, np.int16)
    np.put_along_axis(places, asked, np.arange(length, dtype=np.int16)[None], 1)
    got = permutation_index.footrule(places, orders)
    for q in range(5):
        plain = []
        for order in orders.tolist():
            a, b = {p: i for i, p in enumerate(order)}, {p: i for i, p in enumerate(asked[q].tolist())}
            plain.append(sum(abs(a.get(p, length) - b.get(p, length)) for p in range(pivots)))
        assert len(set(got[q] - np.array(plain))) == 1


@pytest.mark.parametrize("name", ["op6_url_rules", "op7_permutation_index", "op10_warc"])
def test_empty_tables(spark, tables, name):
    folder = tables(pages=spark.createDataFrame([], PAGES), labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), embeddings=spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert queries.QUERIES[name](spark, folder).collect() == []


def shingles(text, width=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def test_pipeline(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert now.items() <= kept.items()
        if name == "near-duplicates":
            sets = {i: shingles(t) for i, t in now.items()}
            ids = sorted(now)
            close = [(a, b) for a, b in combinations(ids, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            want = exact_components(list(kept.items()))
            assert not close and set(now) == {i for i, least in want.items() if i == least}
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept)


def exact_components(docs, least=0.8):
    """Smallest id of each text's component by all pairs of shingle sets."""
    sets, label = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}
    for a, b in combinations(sorted(sets), 2):
        low, high = sorted((label[a], label[b]))
        if low != high and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            label = {i: low if x == high else x for i, x in label.items()}
    return label


@pytest.mark.parametrize("rows", [2048, 8])
def test_near_duplicates_equal_exact_components(spark, monkeypatch, rows):
    """Edited copies of a few texts on both sides of the similarity, chains of them, and texts of one fingerprint."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
    monkeypatch.setattr(simhash, "CELL", 4)
    rng = np.random.default_rng(5)
    docs = []
    for base in range(6):
        words = [f"w{base}x{k}" for k in range(200)]
        docs.append(" ".join(words))
        for edits in (1, 2, 3, 4, 5, 6, 7, 8):
            own = list(words)
            for at in rng.choice(200, edits, replace=False):
                own[at] = f"new{len(docs)}at{at}"
            docs.append(" ".join(own))
    same = "a " * 60
    docs += [docs[0].upper(), same, same + "b c d e f g h", same + "t u v w x y z", ""]
    want = exact_components(list(enumerate(docs)))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame, 5, 384, 76, 0.8).collect()}
    assert got == want
    assert len({want[i] for i in range(len(docs) - 4, len(docs) - 1)}) == 3  # one fingerprint, different texts


def test_tallies_leave_out_no_pair_of_the_least_similarity():
    rng = np.random.default_rng(3)
    sets = []
    for size, buckets in ((40, 0), (400, 0), (60_000, 0), (600, 1)):  # the last ones overflow a single bucket
        base = rng.integers(0, 2**63, size, np.uint64)
        for share in (0.0, 0.05, 0.1, 0.12, 0.3, 1.0):
            own = np.where(rng.random(size) < share, rng.integers(0, 2**63, size, np.uint64), base)
            sets.append(np.unique(own & ~np.uint64(simhash.BUCKETS - 1) if buckets else own))
    sets.append(np.zeros(0, np.uint64))
    tallies = np.frombuffer(b"".join(simhash.tally(s) for s in sets), np.uint8).reshape(len(sets), -1)
    a, b = np.array(list(combinations(range(len(sets)), 2))).T
    may = simhash.may_be_alike(tallies, a, b, 0.8)
    alike = np.array([simhash.similarity(sets[i], sets[j]) >= 0.8 for i, j in zip(a, b, strict=True)])
    assert alike.any() and not (alike & ~may).any() and not may.all()


def test_pipeline_removes_near_duplicates_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    want = exact_components(list(texts.items()))
    assert kept == {i for i, least in want.items() if i == least}


def test_pipeline_keeps_one_of_rows_that_share_an_id_and_of_copies_without_one(spark):
    text = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(1, text), (1, text), (1, "another text of the same id"), (None, text), (None, other), (None, other), (None, other + " more"), (5, "five"), (None, ""), (None, None), (6, "")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id bigint, text string, component_id int, digest string, row int, node int")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 5, 6]
    assert len([t for i, t in kept if i is None]) == 1 and {t for i, t in kept if i is None} <= {other, other + " more"}


def test_stages_carry_columns_of_clashing_names(spark, edge):
    extra = ["language", "score", "fingerprint", "accepted", "row", "digest", "trigrams", "confidence"]
    docs = edge.select("*", *[F.lit(7).alias(c) for c in extra])
    labels = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, labels)
        assert got.columns == docs.columns and all(r[c] == 7 for r in got.collect() for c in extra)


def test_pipeline_runs_on_edge_rows(spark, tables, edge):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = corpus_pipeline.run(spark, tables(documents=edge, labels=labels)).collect()
    assert {r["doc_id"] for r in got} >= {1} and 2 not in {r["doc_id"] for r in got}
    assert corpus_pipeline.run(spark, tables(documents=edge.limit(0), labels=labels.limit(0))).collect() == []
