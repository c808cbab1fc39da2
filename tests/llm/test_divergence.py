"""The divergence audit against plain integer arithmetic over all terms and all pairs of sources."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larder.llm import divergence, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=10):
    found, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        found.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (own, t), n in docs.items() if own == lang and n >= least]
        sources = [s for own, s in groups if own == lang]
        counts = {s: [found[lang, s, t] for t in kept] for s in sources}
        rate = lambda ns: [1 + 10**9 * (n + 2) // (sum(ns) + 2 * len(kept)) for n in ns]  # noqa: B023, E731
        p = {s: rate(ns) for s, ns in counts.items()}
        q = rate([sum(ns) for ns in zip(*counts.values(), strict=True)])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(map(f, p[s], p[o])), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted((-f(a, b), t.encode()) for t, n, a, b in zip(kept, counts[s], p[s], q, strict=True) if n > 0 and a > b)
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms[:top])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "source", "text").collect()]


def test_edge_rows(spark, edge):
    """Nulls, empty and long texts, letters beyond ASCII, sources without terms, languages without kept terms."""
    more = [(100 + i, f"Alpha ÉTÉ été {'beta ' * (i % 3)}{'ÄX' if i % 2 else ''} İ ﬁ 日本 x_y", "de" if i % 4 else None, f"s{i % 5}", 1) for i in range(60)]
    more += [(200, "", "de", "silent", 0), (201, None, "zz", "a", 0), (202, "one", "zz", "b", 0), (203, "!!", "zz", "", 0)]
    docs = edge.union(spark.createDataFrame(more, edge.schema)).withColumns({"term": F.lit("clash"), "number": F.lit(9), "n": F.lit(1)})
    assert got(divergence.audit(docs)) == plain(rows_of(docs))
    assert got(divergence.audit(docs, least=1, top=2)) == plain(rows_of(docs), 1, 2)
    assert got(divergence.audit(docs.limit(0))) == []


def test_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(queries.op12_source_divergence(spark, sf)) == plain(rows_of(docs))


def test_equal_values_go_by_bytes(spark):
    docs = spark.createDataFrame([("en", s, "same words here") for s in ("b", "a", "é", "z")] * 10, "lang string, source string, text string")
    found = got(divergence.audit(docs))
    assert [r[3] for r in found if r[1] == "b"] == ["a", "z", "é"] and {r[4] for r in found} == {0}


@pytest.mark.parametrize(("count", "total", "terms"), [(0, 0, 1), (8 * 10**11, 16 * 10**12, 5 * 10**6), (10**18, 2 * 10**18, 10**9)])
def test_rates_of_counts_of_any_size(spark, count, total, terms):
    row = spark.range(1).select(divergence.rate(F.lit(count).cast("bigint"), F.lit(total).cast("bigint"), F.lit(terms).cast("bigint")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (count + 2) // (total + 2 * terms)
