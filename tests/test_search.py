"""Search over the five-document fixture: counts, facets, highlights, paging, validation."""

import pytest
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators.documents import analysed, build_documents
from larder.operators.search import InvalidRequest, ResultWindowExceeded, SearchRequest, SearchUnavailable, search

ROWS = [
    ("MAK-DHP484Z", "Makita DHP484Z příklepový šroubovák", "Makita", "naradi/elektro/vrtacky", 12, True, "8590000000001"),
    ("BOS-GWS18V10", "Bosch GWS 18V-10 úhlová bruska", "Bosch", "naradi/elektro/brusky", 0, True, "8590000000002"),
    ("NAR-0000003", "Narex kladivo <300 g>", "Narex", "naradi/rucni/kladiva", 7, True, "8590000000003"),
    ("MAK-0000004", "Makita zahradní hadice", "Makita", "zahrada/zavlaha/hadice", 4, True, "8590000000004"),
    ("MAK-0000005", "Makita skrytý produkt", "Makita", "naradi/elektro/vrtacky", 9, False, "8590000000005"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "sku string, name string, brand string, slug_path string, stock_quantity int, visible boolean, ean string")
    products = rows.withColumns({"id": F.col("sku"), "description": F.lit("Popis produktu."), "price_in_minor_units": F.lit(19990), "updated_at": F.lit("2026-09-01 10:00:00").cast("timestamp")})
    return analysed(build_documents(products)).cache()


def ask(docs, **request):
    return search(docs, SearchRequest(**request))


@pytest.mark.parametrize(
    ("words", "total"),
    [("prikelpovy", 1), ("8590000000002", 1), ("EAN 8590000000002", 1), ("EAN8590000000002", 1), ("  8590000000002 ", 1), ("85900000000025", 0), ("hadice mak-0000004", 1), ("   ", 4), ("sroub", 1), ("sr", 1), ("s", 0), ("makita kladivo", 0), ("kladiva", 1), ("makita sroub", 1), ("kladivo", 1)],
)
def test_hit_counts(docs, words, total):
    assert ask(docs, text=words).total == total


def test_without_selection(docs):
    found = ask(docs)
    assert found.total == 4
    assert found.facets["category"] == [("naradi", 3), ("zahrada", 1)]
    assert found.facets["availability"] == [("in_stock", 3), ("out_of_stock", 1)]


def test_category_selection_narrows_hits_and_lists_children(docs):
    found = ask(docs, category="naradi")
    assert (found.total, found.facets["category"]) == (3, [("naradi/elektro", 2), ("naradi/rucni", 1)])
    assert ask(docs, category="naradi/elektro").total == 2


def test_a_facet_ignores_its_own_selection(docs):
    found = ask(docs, brands=("Makita",))
    assert (found.total, found.facets["brand"]) == (2, [("Makita", 2), ("Bosch", 1), ("Narex", 1)])


def test_zero_bucket_stays(docs):
    assert ask(docs, text="kladivo").facets["availability"] == [("in_stock", 1), ("out_of_stock", 0)]


@pytest.mark.parametrize(
    ("words", "marks"),
    [
        ("kladivo", {"name": ["Narex <mark>kladivo</mark> &lt;300 g&gt;"]}),
        ("sroub", {"name": ["Makita DHP484Z příklepový <mark>šroubovák</mark>"]}),
        ("makita sroub", {"name": ["<mark>Makita</mark> DHP484Z příklepový <mark>šroubovák</mark>"]}),
        ("MAK-0000", {"sku": ["<mark>MAK-0000004</mark>"]}),
    ],
)
def test_highlights(docs, words, marks):
    hits = ask(docs, text=words).hits
    assert len(hits) == 1
    assert hits[0]["highlight"] == marks


def test_sku_with_a_split_number(docs):
    assert [h["sku"] for h in ask(docs, text="GWS-18").hits] == ["BOS-GWS18V10"]


def test_sort_paging_and_price(docs):
    assert [h["sku"] for h in ask(docs, size=2, page=2).hits] == ["MAK-DHP484Z", "NAR-0000003"]
    assert ask(docs, price_from=200).total == 0
    assert ask(docs, price_from=199, price_to=200).total == 4
    assert SearchRequest(size=100, page=100).offset == 9900
    with pytest.raises(ResultWindowExceeded):
        _ = SearchRequest(size=100, page=101).offset


def test_requests_are_validated(docs):
    with pytest.raises(InvalidRequest) as wrong:
        SearchRequest(text="x" * 201, category="../", availability="soon", sort="best", price_from=5, price_to=4, size=0, page=0)
    assert set(wrong.value.violations) == {"text", "category", "availability", "sort", "price_to", "size", "page"}
    assert "in_stock, out_of_stock" in wrong.value.violations["availability"]
    with pytest.raises(SearchUnavailable):
        search(None, SearchRequest())


def test_stems_and_swaps(spark):
    row = spark.range(1).select(text.stems(F.lit("Sek vrtačky a příklepový, kladiva!")).alias("s"), text.within_edits(F.lit("wigdet"), F.lit("widget")).alias("swap"), text.within_edits(F.lit("ab"), F.lit("ba")).alias("short"), text.within_edits(F.lit("bacdfe"), F.lit("abcdef")).alias("two")).first()
    assert row["s"][0] == "sk" and "a" not in row["s"]
    assert (row["swap"], row["short"], row["two"]) == (True, False, True)


def test_every_document_field_is_used(docs):
    """The declared fields are those that documents are built of; test_text_index looks at which of them plans read."""
    from larder import schemas
    from larder.operators import documents as d

    assert schemas.DOCUMENT.names == d.FIELDS
