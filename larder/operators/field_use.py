"""Which declared fields of the documents no search request reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larder.operators import search
from larder.operators.facets import facet_counts
from larder.operators.search import SORTS, SearchRequest
from larder.operators.store import Store
from larder.operators.text_index import TextIndex

#: Requests that between them use each clause, filter, facet and order, in one text or apart.
REQUESTS = [
    SearchRequest(),
    SearchRequest(brands=("A",), category="a/b", availability="in_stock", price_from=1, price_to=2),
    SearchRequest(availability="out_of_stock"),
    *[SearchRequest(text=text) for text in ("word beginn", "ABC-0001", "8590000000002")],
    *[SearchRequest(sort=sort) for sort in SORTS],
]


def fields_read(df: DataFrame, path: str) -> set[str]:
    """Columns that the plan's scans of files below the path read."""
    leaves, found, k = df._jdf.queryExecution().sparkPlan().collectLeaves(), set(), 0
    while k < leaves.size():
        leaf = leaves.apply(k)
        if leaf.nodeName().startswith("Scan parquet") and path in leaf.relation().location().rootPaths().mkString(" "):
            found |= set(leaf.requiredSchema().fieldNames())
        k += 1
    return found


def unused_fields(store: Store) -> list[str]:
    """Fields of the store's documents that neither a request's plans nor the text index's filling read."""
    documents, index, read = store.read("documents"), TextIndex(store), set()
    for request in REQUESTS:
        found = search.base(documents, request, index)
        for df in (search.hits(documents, request, index), facet_counts(found, request.brands, request.category, request.availability), search.selected(found, request).groupBy().count()):
            read |= fields_read(df, "/data/documents-")
    return sorted(set(documents.columns) - read)
