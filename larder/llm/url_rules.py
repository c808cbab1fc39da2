"""URL filtering by fixed host and path rules, and by association rules mined from labelled URLs.

Everything runs in the JVM. FP-growth mines sets of URL tokens that come with a block label; rules
pruned by support and confidence are posted under their rarest token, and each distinct token set
is matched against the postings of its own tokens.

Null URLs and URLs without "://" have an empty host and path and no tokens; without labels there are
no mined rules and the default verdict is allow; repeated rows are judged alike; an empty table gives
an empty one; input columns that clash with the new ones are replaced.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import broadcast_if_small, materialize

BLOCK, ALLOW = "=block", "=allow"
#: Matched token sets, and postings, that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Append host and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return df.withColumns({"host": F.translate(host, ascii_uppercase, ascii_lowercase), "path": path})


def url_tokens(url: str = "url") -> Column:
    """Distinct tokens of a URL with host and path: h= host suffixes, p= path segments, q= query keys."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    suffixes = F.when(F.size(labels) > 0, F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p="), F.regexp_replace(x, r"\d+", "#")))
    keys = F.transform(F.regexp_extract_all(F.coalesce(F.col(url), F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("q="), x))
    return F.array_sort(F.array_distinct(F.concat(suffixes, segments, keys)))


def policy_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest (verdict, host, path) rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Block rules (antecedent, confidence, support) from (tokens, blocked) rows, each with its rarest token."""
    items = F.concat("tokens", F.array(F.when(F.col("blocked"), BLOCK).otherwise(ALLOW)))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(labelled.select(items.alias("items")))
    said = model.associationRules.where((F.col("consequent")[0] == BLOCK) & ~F.array_contains("antecedent", ALLOW))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = said.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    return rules.select("*", F.explode("antecedent").alias("token")).join(single, "token").groupBy("antecedent", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("token"))


def judge(pages: DataFrame, policy: list[tuple[str, str, str]], labels: DataFrame | None = None, url: str = "url", min_support: float = 0.002, min_confidence: float = 0.5) -> DataFrame:
    """Append host, path, rule, verdict and confidence (of the best mined block rule that matches, else null).

    labels: (tokens, blocked) rows, see url_tokens(); a URL that no policy rule fits is blocked if a
    mined rule matches it.
    """
    parts = url_parts(pages, url).withColumn("tokens", url_tokens(url))
    rule, verdict = policy_rule(policy)
    mined = None
    if labels is not None and not labels.isEmpty():
        mined = materialize(mine(labels, min_support, min_confidence), "url-rules")
    if mined is None or mined.isEmpty():
        judged = parts.withColumn("confidence", F.lit(None).cast("double"))
    else:
        sets = parts.select("tokens").groupBy("tokens").count().select("tokens", F.explode("tokens").alias("token"))
        hits = sets.join(broadcast_if_small(mined, BROADCAST_ROWS), "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
        matched = materialize(hits.groupBy("tokens").agg(F.max("confidence").alias("confidence")), "url-matches")
        judged = parts.drop("confidence").join(broadcast_if_small(matched, BROADCAST_ROWS), "tokens", "left")
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)}).drop("tokens")
