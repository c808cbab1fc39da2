"""The registered queries of the operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import alignment, bilinear_lm, byte_bpe, divergence, language, media, packing, permutation_index, piece_bpe, simhash, toxicity, url_rules, warc
from larder.llm.common import key_hash, table

#: The fixed policy of op6: verdict, host, path.
POLICY = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = key_hash("doc_id", 7) == 2
    scored = bilinear_lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"])
    return found.select("doc_id", F.col("lang").alias("declared"), "source", "language", "confidence", "accepted")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op3 where all its evidence is at hand: the language that a page's markup declares, and its host."""
    pages = url_rules.url_parts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = language.identify(language.page_texts(pages), text="page_text", declared="declared", host="host", keep=["page_id", "declared", "host"])
    return found.select("page_id", "declared", "host", "language", "confidence", "accepted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    items = items.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(items)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = media.read(media.store(docs, keep=["doc_id"]))
    cuts = F.transform("clips", lambda c: F.concat(c["start_frame"], F.lit("-"), c["end_frame"]))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("shots:"), F.array_join(cuts, ",")).alias("feature"),
    )


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    blocked = ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("blocked")
    known = url_rules.url_parts(pages).join(labels.select(F.col("doc_id").alias("page_id"), blocked), "page_id")
    labelled = known.select(url_rules.url_tokens().alias("tokens"), "blocked")
    judged = url_rules.judge(pages, POLICY, labelled)
    return judged.select("page_id", "host", "path", "rule", "verdict", "confidence")


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = permutation_index.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = key_hash("doc_id", 5) == 0
    model = toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.classify(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = byte_bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.length("decoded_text").cast("bigint").alias("n_characters"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("bigint").alias("last_end"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read(warc.write(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = piece_bpe.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", hashed.alias("groups_sha256"))


QUERIES = {
    "op1_bilinear_lm": op1_bilinear_lm,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_media": op5_media,
    "op6_url_rules": op6_url_rules,
    "op7_permutation_index": op7_permutation_index,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_warc": op10_warc,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_source_divergence": op12_source_divergence,
    "op13_alignment": op13_alignment,
    "page_languages": page_languages,
}

ORACLE_SQL = {
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, h, strlen(h) AS n, sha1(h) AS g FROM p),
        m AS (SELECT g, max(page_id) AS latest FROM d WHERE n >= 1000 GROUP BY g)
        SELECT d.page_id, d.n AS payload_bytes, d.g AS payload_digest,
               CASE WHEN m.latest IS NULL OR m.latest = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN m.latest <> d.page_id THEN m.latest END AS refers_to
        FROM d LEFT JOIN m ON d.g = m.g AND d.n >= 1000
    """,
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
            FROM documents),
        t AS (SELECT lang, source, doc, unnest(found) AS term FROM d),
        g AS (SELECT DISTINCT lang, source FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
        s AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
        w AS (SELECT lang, source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT lang, source, term, coalesce(c.n, 0) AS n,
                   CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (w.total + 2 * s.v) AS BIGINT) AS p,
                   CAST(1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // (s.total + 2 * s.v) AS BIGINT) AS q
            FROM w JOIN s USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        apart AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (
            SELECT lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM g a JOIN g b USING (lang) LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
            WHERE a.source <> b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 10
    """,
}
