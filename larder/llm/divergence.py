"""How far the sources of each language differ in their words, by exact integer arithmetic.

Terms are runs of letters (A-Z lower-cased, every character beyond ASCII counts as a letter). Each
language keeps the terms of at least `least` of its documents, and pivots each into a vector indexed by
its sources: entries (number of the source, occurrences there) in order of the sources, those without the
term left out. A source's smoothed rate of a term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two
rates differ by f(p, q) = floor((p - q)^2 / (p + q)).

Two sources differ by the sum of f over all V terms. Each vector emits, for two of its entries, what their
meeting changes: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), where p0 and q0 are the rates of a term without
occurrences. What a source's terms add beside a source without them depends on their counts alone, so a
histogram of them (a row for each count) gives it; and V f(p0, q0) is common to all. The three sum to exactly
the sum over all terms, and no vector emits pairs with sources that lack its term.

Null texts, languages and sources count as empty; texts of any length are taken whole; equal values go by
the item's bytes; repeated rows are documents of their own; a language without kept terms gives pairs of
value 0; an empty table gives an empty one; other columns, whatever their names, are not carried.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import materialize

#: What separates terms, and the scale of the rates.
BREAKS, SCALE = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", 1_000_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z alone lower-cased: of ASCII texts by the built-in function, which is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)), whatever the size of the counts; null without terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    below = (total + 2 * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.lit(1).cast("bigint") + F.call_function("div", above, below))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term, of docs (lang, source, text)."""
    words = F.sort_array(F.filter(F.split(ascii_lower(F.col("text")), BREAKS), lambda x: x != ""))
    sorted_words = docs.select("lang", "source", words.alias("words"))
    # of equal words, which stand together, the first counts for the document
    marked = F.transform("words", lambda x, i: F.struct(x.alias("term"), F.when(x.eqNullSafe(F.get("words", i - 1)), 0).otherwise(1).alias("first")))
    # the outer form, as the plain one filters by the array's size, for which it would be made twice
    found = sorted_words.select("lang", "source", F.inline_outer(marked)).where("term IS NOT NULL")
    return found.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


def term_vectors(docs: DataFrame, sources: DataFrame, least: int) -> DataFrame:
    """(lang, term, n, vector): each kept term's occurrences in its language, and by the numbers of the sources."""
    entries = F.array_sort(F.collect_list(F.struct("number", "n")))
    held = term_counts(docs).join(sources, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), entries.alias("vector"))
    return held.where(F.col("docs") >= least).drop("docs")


def described(sources: DataFrame, vectors: DataFrame) -> DataFrame:
    """(lang, source, number, terms, in_lang, total, p0, steps): each source's total, its rate of an absent term, and a histogram (p, m) of its terms' rates."""
    entries = vectors.select("lang", F.explode("vector").alias("e")).groupBy("lang", F.col("e.number").alias("number"), F.col("e.n").alias("n")).agg(F.count("*").alias("m"))
    of_source = entries.groupBy("lang", "number").agg(F.sum(F.col("n") * F.col("m")).alias("total"), F.collect_list(F.struct("n", "m")).alias("counts"))
    of_lang = vectors.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("in_lang"))
    whole = sources.join(of_source, ["lang", "number"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "terms", "in_lang"])
    steps = F.transform(F.coalesce("counts", F.array().cast("array<struct<n:bigint,m:bigint>>")), lambda c: F.struct(rate(c["n"], F.col("total"), F.col("terms")).alias("p"), c["m"].alias("m")))
    return whole.select("lang", "source", "number", "terms", "in_lang", "total", rate(F.lit(0), F.col("total"), F.col("terms")).alias("p0"), steps.alias("steps"))


def pair_values(weighted: DataFrame, known: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, a, b, value): how far each two sources (numbers a < b) differ."""
    one_by_one = weighted.select("lang", "vector", F.posexplode("vector").alias("k", "one"))
    p, p0 = F.col("one.p"), F.col("one.p0")
    later = F.slice("vector", F.col("k") + 2, F.size("vector"))
    meeting = lambda e: apart(p, e["p"]) - apart(p, e["p0"]) - apart(p0, e["p"]) + apart(p0, e["p0"])
    met = one_by_one.select("lang", F.inline(F.transform(later, lambda e: F.struct(F.col("one.number").alias("a"), e["number"].alias("b"), meeting(e).alias("value")))))
    beside = known.join(langs.select("lang", "members"), "lang").select("*", F.explode("members").alias("other")).where("other.number <> number")
    common = apart(F.col("p0"), F.col("other.p0"))
    alone = F.aggregate("steps", F.lit(0).cast("bigint"), lambda total, s: total + s["m"] * (apart(s["p"], F.col("other.p0")) - common))
    value = alone + F.when(F.col("number") < F.col("other.number"), F.col("terms") * common).otherwise(0)
    single = beside.select("lang", F.least("number", "other.number").alias("a"), F.greatest("number", "other.number").alias("b"), F.coalesce(value, F.lit(0)).alias("value"))
    # each side is summed before it is shuffled
    return met.unionByName(single).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", rank)
    return out if top is None else out.where(F.col("rank") <= top)


def audit(docs: DataFrame, least: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part pair lists all other sources of the language by how far they differ,
    part term the source's top terms that it uses more than its language.

    Sources, and what is known of each, are joined by a broadcast only where Spark finds them small.
    """
    empty = F.lit("")
    docs = docs.select(F.coalesce(lang, empty).alias("lang"), F.coalesce(source, empty).alias("source"), F.coalesce(text, empty).alias("text"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = materialize(docs.select("lang", "source").distinct().withColumn("number", number), "sources")
    vectors = materialize(term_vectors(docs, sources, least), "vectors")
    known = materialize(described(sources, vectors), "described")
    members = F.array_sort(F.collect_list(F.struct("number", "source", "total", "p0"))).alias("members")
    langs = materialize(known.groupBy("lang").agg(F.max("terms").alias("terms"), F.max("in_lang").alias("in_lang"), members), "languages")
    member = lambda n: F.get("members", n)
    entry = lambda e: F.struct(e["number"].alias("number"), rate(e["n"], member(e["number"])["total"], F.col("terms")).alias("p"), member(e["number"])["p0"].alias("p0"))
    weighted = vectors.join(langs, "lang").select("lang", "term", rate(F.col("n"), F.col("in_lang"), F.col("terms")).alias("q"), F.transform("vector", entry).alias("vector"))
    weighted = materialize(weighted, "weighted-vectors")
    pairs = pair_values(weighted, known, langs)
    ways = F.array(F.struct(F.col("a").alias("one"), F.col("b").alias("other")), F.struct(F.col("b").alias("one"), F.col("a").alias("other")))
    both = pairs.select("lang", "value", F.inline(ways)).join(langs.select("lang", "members"), "lang")
    both = both.select("lang", member(F.col("one"))["source"].alias("source"), F.lit("pair").alias("part"), member(F.col("other"))["source"].alias("item"), "value")
    used = weighted.select("lang", "term", "q", F.explode("vector").alias("e")).where("e.p > q")
    used = used.select("lang", F.col("e.number").alias("number"), F.col("term").alias("item"), apart(F.col("e.p"), F.col("q")).alias("value"))
    best = ranked(used.withColumnRenamed("number", "source"), top).withColumnRenamed("source", "number").join(sources, ["lang", "number"])
    best = best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return ranked(both).unionByName(best)
