"""Edit distance and folding against plain ones, run log, hydration, JSON."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import documents, drain, search
from larder.sources import catalog

SF = "/root/testdata/sf0.001"


def optimal_alignment(a, b):
    """Edits with swaps of neighbours, none of which is edited again."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def edited(word, rng):
    word = list(word)
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(word) + 1)
        kind = rng.choice("idsw")
        if kind == "i":
            word.insert(at, rng.choice("abcd"))
        elif at < len(word) and kind == "d":
            del word[at]
        elif at < len(word) and kind == "s":
            word[at] = rng.choice("abcd")
        elif at + 1 < len(word):
            word[at], word[at + 1] = word[at + 1], word[at]
    return "".join(word)


def test_edits_are_those_of_the_optimal_alignment(spark):
    rng = random.Random(1)
    pairs = [("abcdef", "bxacdef"), ("abcdef", "badcef"), ("abcdef", "bacdfe"), ("ab", "ba"), ("abc", "bca"), ("abcdef", "cab")]
    for _ in range(3000):
        term = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
        pairs.append((term, edited(term, rng)))
    rows = spark.createDataFrame(pairs, "term string, word string")
    for r in rows.withColumn("got", text.within_edits(F.col("term"), F.col("word"))).collect():
        allowed = 0 if len(r["term"]) < 3 else 1 if len(r["term"]) <= 5 else 2
        assert r["got"] == (optimal_alignment(r["term"], r["word"]) <= allowed), r


def test_folding_covers_latin_letters(spark):
    words = {"große": "grosse", "ærø": "aero", "œuvre": "oeuvre", "þórr": "thorr", "łódź": "lodz", "ğüş": "gus", "ǎẽ": "aẽ", "plain": "plain"}
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["f"] for r in rows.select("w", text.fold(F.col("w")).alias("f")).collect()} == words


def plain_stem(word):
    for endings, least in ((text.CASE_ENDINGS, 3), (text.POSSESSIVES, 4)):
        word = next((word[: -len(e)] for e in sorted(endings, key=len, reverse=True) if word.endswith(e) and len(word) - len(e) >= least), word)
    for end, new in (("čt", "ck"), ("št", "sk"), ("c", "k"), ("č", "k"), ("z", "h"), ("ž", "h")):
        if word.endswith(end):
            return word[: -len(end)] + new
    if len(word) >= 2 and word[-2] == "e":
        return word[:-2] + word[-1]
    if len(word) >= 3 and word[-2] == "ů":
        return word[:-2] + "o" + word[-1]
    return word


def test_stems_of_czech_words(spark):
    words = "vrtačkami kladivo kladiva zahradních hadice pes psů kůň koněm Petrův bratrovi čeští vojáci knize praží hrůz děvčatech sůl e oe ůl žák".split()
    (row,) = spark.createDataFrame([(" ".join(words),)], "t string").select(text.stems(F.col("t")).alias("s")).collect()
    unaccented = str.maketrans(text.ACCENTED, text.PLAIN)
    assert row["s"] == [plain_stem(w.lower()).translate(unaccented) for w in words if w.lower() not in text.STOPWORDS]


def test_a_batch_of_absent_deletions_is_a_run_of_its_own(spark):
    result = drain.DrainResult(taken=3)
    row = drain.run_row(spark, result, dt.datetime(2026, 1, 1)).first()
    assert (row["written_product_count"], row["unchanged_product_count"]) == (0, 0)
    log = drain.run_row(spark, result, dt.datetime(2026, 1, 2)).union(drain.run_row(spark, drain.DrainResult(written=5, taken=5), dt.datetime(2026, 1, 3)))
    assert [r["written_product_count"] for r in drain.latest_run(log).collect()] == [5]
    assert drain.latest_run(log.limit(0)).collect() == []


def test_hydration_by_ids(spark):
    products = spark.createDataFrame([(1, 10, 100, "a"), (2, 11, 100, "b"), (3, 10, 999, "c")], "id int, brand_id int, category_id int, sku string")
    brands = spark.createDataFrame([(10, "X"), (11, "Y")], "id int, name string")
    categories = spark.createDataFrame([(100, "a/b")], "id int, slug_path string")
    ids = spark.createDataFrame([(2,), (2,), (3,), (7,)], "id int")
    assert [tuple(r) for r in documents.hydrated(products, brands, categories, ids).select("id", "sku", "brand", "slug_path").collect()] == [(2, "b", "Y", "a/b")]


def test_by_id(spark):
    products = catalog.product(spark, SF)
    assert catalog.by_id(products, 7).first()["sku"] == "PRT-0000007"
    with pytest.raises(catalog.NotFound):
        catalog.by_id(products, -1)


def test_a_result_as_json(spark):
    docs = documents.analysed(documents.build_documents(catalog.product(spark, SF)))
    found = json.loads(search.search(docs, search.SearchRequest(text="small ring", size=3)).to_json())
    assert found["total"] >= len(found["hits"]) > 0 and {"brand", "category", "availability"} == set(found["facets"])
    assert found["hits"][0]["score"] > 0 and isinstance(found["hits"][0]["price"], float) and "<mark>" in found["hits"][0]["highlight"]["name"][0]
