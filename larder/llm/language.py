"""Language identification by fusing evidence in Bayes' way.

Text: naive Bayes over hashed byte trigrams of the letters, counted over all texts by their declared
language, tempered because neighbouring trigrams share letters; a text's own trigrams are left out of the
counts it is judged by, so that junk doesn't vouch for itself. Declared markup language: right with
probability RELIABLE. Hosts: priors counted by grouped aggregation and smoothed hierarchically, each
host towards its domain (the last two labels), each domain towards its address suffix, each suffix
towards the whole. A further hypothesis, no known language, gives every trigram the same
probability. A row is accepted unless that hypothesis wins or its text has no letters.

Null or empty texts have no letters; null or unknown declared languages give no evidence; null hosts
count as the empty host; texts of any length count whole; of languages of equal posterior the first in
alphabetical order wins; repeated rows are judged alike; an empty table gives an empty one; clashing
columns are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import as_bytes, broadcast_if_small, map_batches, materialize

LANGUAGES = ("de", "en", "es", "fr")
BUCKET_BITS, TEMPER, RELIABLE, SMOOTH = 14, 0.3, 0.9, 20.0
#: The prior of no known language, which spreads trigrams evenly over the buckets.
UNKNOWN_PRIOR = 1e-3
#: Hosts whose priors may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000

_letters = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def trigrams(raw: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text's letters; words are set apart by one space."""
    kept = b" ".join(raw.translate(_letters).split())
    if not kept:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(b" " + kept + b" ", np.uint8).astype(np.uint32)
    mixed = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
    return mixed * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS)


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Append declared (the language of the html element, without its region) and page_text (the markup's text, without scripts and styles)."""
    told = F.regexp_extract(F.col(html), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1)
    text = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"&#?\w+;", " ")
    return pages.withColumns({"declared": F.nullif(F.lower(told), F.lit("")), "page_text": text})


def train(docs: DataFrame, text: str = "text", declared: str = "lang", languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Trigram counts (buckets x languages, each plus a half) of all texts with a known declared language."""
    size = 1 << BUCKET_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            for raw, lang in zip(as_bytes(batch.column(text)), batch.column(declared).to_pylist(), strict=True):
                total[languages.index(lang)] += np.bincount(trigrams(raw), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["at", "n"])

    rows = docs.where(F.col(declared).isin(*languages)).select(text, declared).mapInArrow(counted, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.full(len(languages) * size, 0.5)
    for at, n in rows.collect():  # at most buckets x languages
        counts[at] += n
    return counts.reshape(len(languages), size).T.copy()


def text_likelihoods(docs: DataFrame, counts: np.ndarray, text: str = "text", declared: str | None = None, languages: tuple[str, ...] = LANGUAGES, keep: list[str] | None = None) -> DataFrame:
    """Append trigrams (their number) and text_log: the text's log-likelihood in each language, then in none, tempered.

    declared: the column of the languages that train() counted these rows under; None where the
    counts come from other texts, so that there is nothing to leave out.
    """
    table = docs.sparkSession.sparkContext.broadcast(counts)

    def make():
        counts = table.value
        totals, number = counts.sum(axis=0), {x: k for k, x in enumerate(languages)}
        logs, none = np.log(counts / totals), -math.log(len(counts))

        def likelihoods(found: np.ndarray, lang: str | None) -> list[float]:
            out = np.append(logs[found].sum(axis=0), none * len(found))
            if lang in number and len(found):
                k, own = number[lang], np.bincount(found)
                at = np.flatnonzero(own)
                out[k] = own[at] @ np.log((counts[at, k] - own[at]) / (totals[k] - len(found)))
            return (TEMPER * out).tolist()

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [trigrams(raw) for raw in as_bytes(batch.column(text))]
            langs = batch.column(declared).to_pylist() if declared else [None] * len(found)
            logs_of = [likelihoods(t, x) for t, x in zip(found, langs, strict=True)]
            return [pa.array([len(t) for t in found], pa.int64()), pa.array(logs_of, pa.list_(pa.float64()))]

        return work

    return map_batches(docs, make, "trigrams bigint, text_log array<double>", keep)


def host_priors(docs: DataFrame, host: Column, declared: str, languages: tuple[str, ...]) -> tuple[DataFrame, list[float]]:
    """(host, host_log): log priors of the languages at each host, smoothed towards its domain, its suffix and the whole; and the whole's log priors.

    Hosts that declare nothing have counts of zero, so that they take the priors of the level above.
    """
    one = [F.coalesce(F.sum((F.col(declared) == x).cast("double")), F.lit(0.0)).alias(x) for x in languages]
    hosts = docs.groupBy(host.alias("host")).agg(*one)
    labels = F.split("host", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")
    hosts = hosts.withColumns({"suffix": F.element_at(labels, -1), "domain": domain})
    summed = lambda *by: hosts.groupBy(*by).agg(F.array(*[F.sum(x) for x in languages]).alias("n"))

    def towards(rows: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
        """n becomes the smoothed distribution p, given that of the level above."""
        total = F.aggregate("n", F.lit(0.0), lambda a, x: a + x)
        p = F.zip_with("n", "above", lambda n, q: (n + SMOOTH * q) / (total + SMOOTH))
        return rows.join(above.withColumnRenamed("p", "above"), on).select(*[c for c in rows.columns if c != "n"], p.alias("p"))

    whole = hosts.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in languages]).first()
    n = sum(whole) + len(languages)
    base = F.array(*[F.lit((x + 1) / n) for x in whole])
    total = F.aggregate("n", F.lit(0.0), lambda a, x: a + x)
    suffixes = summed("suffix").select("suffix", F.zip_with("n", base, lambda n, q: (n + SMOOTH * q) / (total + SMOOTH)).alias("p"))
    domains = towards(summed("domain", "suffix"), suffixes, ["suffix"])
    own = towards(hosts.select("host", "domain", F.array(*languages).alias("n")), domains.drop("suffix"), ["domain"])
    return own.select("host", F.transform("p", lambda x: F.log(x)).alias("host_log")), [math.log((x + 1) / n) for x in whole]


def identify(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", languages: tuple[str, ...] = LANGUAGES, keep: list[str] | None = None) -> DataFrame:
    """Append language (null where none is known), confidence (its posterior), posterior (of each language, then of none) and accepted."""
    counts = train(docs, text, declared, languages)
    at = F.coalesce(F.lower(F.col(host).cast("string")), F.lit(""))
    priors, whole = host_priors(docs, at, declared, languages)
    priors = broadcast_if_small(materialize(priors, "host-priors"), BROADCAST_ROWS)
    likely = text_likelihoods(docs, counts, text, declared, languages, list(dict.fromkeys([*(docs.columns if keep is None else keep), declared, host])))
    told = F.array(*[F.when(F.col(declared) == x, math.log(RELIABLE)).when(F.col(declared).isin(*languages), math.log((1 - RELIABLE) / max(1, len(languages) - 1))).otherwise(0.0) for x in languages], F.lit(0.0) + F.when(F.col(declared).isin(*languages), math.log(1 / len(languages))).otherwise(0.0))
    prior = F.concat(F.coalesce("host_log", F.array(*map(F.lit, whole))), F.array(F.lit(math.log(UNKNOWN_PRIOR))))
    joint = F.zip_with(F.zip_with("text_log", told, lambda a, b: a + b), prior, lambda a, b: a + b)
    most = F.array_max("joint")
    weights = F.transform("joint", lambda x: F.exp(x - most))
    joined = likely.withColumn("_host", F.coalesce(F.lower(F.col(host).cast("string")), F.lit(""))).join(priors.withColumnRenamed("host", "_host"), "_host", "left")
    posterior = joined.withColumn("joint", joint).withColumn("_weights", weights).withColumn("posterior", F.transform("_weights", lambda x: x / F.aggregate("_weights", F.lit(0.0), lambda a, b: a + b)))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    language = F.when(F.col("trigrams") > 0, F.element_at(F.array(*map(F.lit, languages), F.lit(None).cast("string")), best))
    carried = [c for c in (docs.columns if keep is None else keep) if c not in ("language", "confidence", "posterior", "accepted")]
    return posterior.withColumn("language", language).select(*carried, "language", F.array_max("posterior").alias("confidence"), "posterior", F.col("language").isNotNull().alias("accepted"))
