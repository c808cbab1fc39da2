"""A corpus pipeline over ``documents``: language ID, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes each stage's rows to shared storage and rereads them for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import language, packing, simhash, toxicity
from larder.llm.common import broadcast_if_small, materialize, release, table

#: Near-duplicates: words of a shingle, least similarity of two texts' shingle sets, bits of a
#: fingerprint, and the differing bits that texts of that similarity hardly ever exceed (one in 220 does).
SHINGLE, SIMILARITY, BITS, RADIUS = 5, 0.8, 384, 76
#: Ids that may be broadcast (8 bytes each), lest texts be shuffled.
IDS = 1 << 22


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of names that no operator uses, and those names by the columns' own."""
    names = {c: f"column_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(c).alias(own) for c, own in names.items()]), names


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known.

    Those without letters (null and empty texts too) or in no known language go; a null or unknown
    declared language or source is no evidence; ties take the first language, so they stay; repeated
    rows stay or go together; texts count whole, whatever their length; an empty table gives an empty
    one; further columns are carried, those named like the operator's own too.
    """
    plain, names = numbered(docs)
    judged = language.identify(plain, text=names["text"], declared=names["lang"], host=names["source"])
    return judged.where("accepted").select(*[F.col(own).alias(c) for c, own in names.items()])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier learns from all labels.

    A null or empty text scores by the bias, a score of exactly 0.5 goes; labels of null or missing ids
    are left out; repeated rows stay or go together; texts are scored whole, whatever their length; an
    empty table gives an empty one; further columns are carried, one named score too.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    plain, names = numbered(docs)
    scored = toxicity.classify(plain, model, text=names["text"])
    return scored.where("score < 0.5").select(*[F.col(own).alias(c) for c, own in names.items()])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Documents without an id count after all others, by their texts' hashes. Of rows that share an id,
    or of copies without one, the row of the least hash of all its columns stays, once. Null and empty
    texts are copies of each other; texts are compared whole, whatever their length; an empty table
    gives an empty one; further columns are carried, those named like the operator's own too.
    """
    last = 1 << 62
    key = F.coalesce("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(last - 1).bitwiseOR(last))
    rows = docs.select(key.alias("doc_id"), "text", F.struct(*docs.columns).alias("row"))
    pairs = simhash.near_duplicates(rows, SHINGLE, BITS, RADIUS, SIMILARITY)
    found = materialize(pairs, "near-duplicates")
    release(pairs)
    gone = found.where("doc_id > component_id").select("doc_id").distinct()
    repeated = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = rows.join(broadcast_if_small(gone, IDS), "doc_id", "left_anti")
    if not repeated.isEmpty():
        repeated = broadcast_if_small(repeated, IDS)
        once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(repeated, "doc_id", "left_anti").select("row").union(once.select("row"))
    return kept.select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its sequence and its place there.

    A null or empty text is its end token alone; a text over a sequence is cut into pieces, nothing is
    left out; repeated rows are packed as often as they occur; pieces of equal length go in any order;
    an empty table gives an empty one; further columns are not carried.
    """
    items = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(items.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The stages' models can't be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
