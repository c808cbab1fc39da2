"""Faceted search over analysed documents.

A document is found if any text clause matches: all words within typing tolerance in one field, all
words but a last one that may be a beginning, a SKU beginning, or exact codes lifted from the text. With a
text index (text_index.py) a text's matches, scores and highlights come from its postings, and documents
needn't be analysed; without one, analysed documents are scanned, and scores order clauses by their weights
and closeness only.
Price narrows hits and facets alike; brand, category and availability narrow the hits, and each
facet is counted under the other dimensions' selections. Scores are not comparable with those of other
engines. Ties go by SKU.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.codes import EAN_INSIDE, SKU_INSIDE, SKU_PREFIX
from larder.functions.text import closeness, fold, folded_words, marked, html_escaped, stems, within_edits
from larder.operators.facets import facet_counts, selections
from larder.operators.text_index import TextIndex

# The result window, the clauses' weights, the orders and availabilities of a request.
MAX_WINDOW = 10_000
NAME_WEIGHT, PREFIX_WEIGHT, SKU_PREFIX_WEIGHT, CODE_WEIGHT = 3.0, 1.5, 20.0, 10.0
SORTS, AVAILABILITIES = ("relevance", "price_asc", "price_desc"), ("in_stock", "out_of_stock")
SLUG = re.compile(r"[a-z0-9-]+(/[a-z0-9-]+)*")


class InvalidRequest(ValueError):
    """What is wrong with a request, by field."""

    def __init__(self, violations: dict[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in violations.items()))
        self.violations = violations


class ResultWindowExceeded(ValueError):
    """Paging beyond MAX_WINDOW rows."""


class SearchUnavailable(RuntimeError):
    """There is no index to search."""


@dataclass(frozen=True)
class SearchRequest:
    text: str | None = None
    brands: tuple[str, ...] = ()
    category: str | None = None
    availability: str | None = None
    price_from: int | None = None
    price_to: int | None = None
    sort: str = "relevance"
    size: int = 24
    page: int = 1

    def __post_init__(self):
        wrong: dict[str, str] = {}
        if self.text is not None and len(self.text) > 200:
            wrong["text"] = "at most 200 characters"
        if self.category is not None and not SLUG.fullmatch(self.category):
            wrong["category"] = "not a category path"
        if self.availability not in (None, *AVAILABILITIES):
            wrong["availability"] = f"one of {', '.join(AVAILABILITIES)}"
        if self.sort not in SORTS:
            wrong["sort"] = f"one of {', '.join(SORTS)}"
        for name in ("price_from", "price_to"):
            if (bound := getattr(self, name)) is not None and bound < 0:
                wrong[name] = "at least 0"
        if None not in (self.price_from, self.price_to) and self.price_to < self.price_from:
            wrong["price_to"] = "at least price_from"
        if not 1 <= self.size <= 100:
            wrong["size"] = "from 1 to 100"
        if self.page < 1:
            wrong["page"] = "at least 1"
        if wrong:
            raise InvalidRequest(wrong)

    @property
    def words(self) -> str | None:
        return (self.text or "").strip() or None

    @property
    def offset(self) -> int:
        first = (self.page - 1) * self.size
        if first + self.size > MAX_WINDOW:
            raise ResultWindowExceeded(f"paging stops at {MAX_WINDOW} rows")
        return first


@dataclass
class TextClauses:
    """Whether each clause matches, what it adds to the score, and what it marks."""

    matches: list[Column] = field(default_factory=list)
    scores: list[Column] = field(default_factory=list)
    sku: list[Column] = field(default_factory=list)
    ean: list[Column] = field(default_factory=list)
    name_word: list = field(default_factory=list)
    stem_terms: Column | None = None


def text_clauses(text: str) -> TextClauses:
    out = TextClauses()

    def add(match: Column, score: Column) -> None:
        out.matches.append(match)
        out.scores.append(F.when(match, score).otherwise(0.0))

    # The query's terms are constants, which the optimizer folds.
    terms = stems(F.lit(text))
    out.stem_terms = terms

    def all_in(column: str) -> Column:
        return (F.size(terms) > 0) & F.forall(terms, lambda t: F.exists(column, lambda w: within_edits(t, w)))

    def mean_in(column: str) -> Column:
        return F.aggregate(terms, F.lit(0.0), lambda a, t: a + closeness(t, F.col(column))) / F.greatest(F.size(terms), F.lit(1))

    in_name, in_description = all_in("name_stems"), all_in("description_stems")
    by_name = F.when(in_name, NAME_WEIGHT * mean_in("name_stems")).otherwise(0.0)
    by_description = F.when(in_description, mean_in("description_stems")).otherwise(0.0)
    add(in_name | in_description, F.greatest(by_name, by_description))

    if len(text.split(" ")[-1]) >= 2:
        words = folded_words(F.lit(text))
        last, whole = F.element_at(words, -1), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
        begun = (F.size(words) > 0) & F.forall(whole, lambda t: F.array_contains("name_words", t)) & F.exists("name_words", lambda w: w.startswith(last))
        add(begun, F.lit(PREFIX_WEIGHT))
        out.name_word.append(lambda w: F.array_contains(whole, w) | w.startswith(last))

    if SKU_PREFIX.fullmatch(text):
        starts = F.lower("sku").startswith(text.lower())
        add(starts, F.lit(SKU_PREFIX_WEIGHT))
        out.sku.append(starts)
    for code in SKU_INSIDE.findall(text):
        out.sku.append(F.lower("sku") == code.lower())
        add(out.sku[-1], F.lit(CODE_WEIGHT))
    for code in EAN_INSIDE.findall(text):
        out.ean.append(F.col("ean") == code)
        add(out.ean[-1], F.lit(CODE_WEIGHT))
    return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def highlight(clauses: TextClauses) -> Column:
    """map of field to marked fragments; fields without a mark have no key."""
    stem_hit = lambda w: F.exists(stems(w), lambda s: F.exists(clauses.stem_terms, lambda t: within_edits(t, s)))
    name_hit = lambda w: stem_hit(w) | _any([rule(fold(F.lower(w))) for rule in clauses.name_word])
    whole = lambda column, rules: F.when(_any(rules), F.concat(F.lit("<mark>"), html_escaped(F.col(column)), F.lit("</mark>")))
    fields = {"name": marked(F.col("name"), name_hit), "description": marked(F.col("description"), stem_hit), "sku": whole("sku", clauses.sku), "ean": whole("ean", clauses.ean)}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.array(v).alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"][0].isNotNull()))


def base(documents: DataFrame, request: SearchRequest, index: TextIndex | None = None) -> DataFrame:
    """The documents that the query itself finds, with their score; selections come later."""
    found = documents.where("visible")
    if request.price_from is not None:
        found = found.where(F.col("price") >= request.price_from)
    if request.price_to is not None:
        found = found.where(F.col("price") <= request.price_to)
    if request.words is None:
        return found.withColumn("score", F.lit(0.0))
    if index is not None:
        return found.join(index.matches(request.words), "id")
    clauses = text_clauses(request.words)
    score = sum(clauses.scores[1:], clauses.scores[0])
    return found.where(_any(clauses.matches)).withColumn("score", score)


def selected(found: DataFrame, request: SearchRequest) -> DataFrame:
    chosen = selections(request.brands, request.category, request.availability)
    return found.where(chosen["brand"] & chosen["category"] & chosen["availability"])


def order(request: SearchRequest) -> list[Column]:
    first = {"relevance": F.desc("score"), "price_asc": F.asc("price"), "price_desc": F.desc("price")}[request.sort]
    return [first, F.asc("sku")]


def hits(documents: DataFrame, request: SearchRequest, index: TextIndex | None = None) -> DataFrame:
    """The page's hits in order: (place, id, sku, name, brand, category_path, price, stock_quantity, ean, updated_at, score, highlight)."""
    offset = request.offset
    page = selected(base(documents, request, index), request).orderBy(*order(request)).offset(offset).limit(request.size)
    if index is not None and request.words:
        # the order is lost in the join
        page = page.join(index.highlights(request.words, page), "id").orderBy(*order(request))
        marks = F.col("highlight")
    else:
        marks = highlight(text_clauses(request.words)) if request.words else F.create_map().cast("map<string,array<string>>")
    return page.select("id", "sku", "name", "brand", F.element_at("category.path", -1).alias("category_path"), "price", "stock_quantity", "ean", F.col("product_updated_at").alias("updated_at"), "score", marks.alias("highlight"))


def total(documents: DataFrame, request: SearchRequest, index: TextIndex | None = None) -> int:
    return selected(base(documents, request, index), request).count()


@dataclass
class SearchResult:
    total: int
    elapsed_milliseconds: int
    hits: list
    facets: dict[str, list[tuple[str, int]]]

    def to_json(self) -> str:
        """The whole result; times in ISO form, prices as numbers."""
        rows = [hit.asDict(recursive=True) for hit in self.hits]
        facets = {name: [{"value": value, "count": n} for value, n in values] for name, values in self.facets.items()}
        plain = lambda x: float(x) if isinstance(x, Decimal) else x.isoformat()
        return json.dumps({"total": self.total, "elapsed_milliseconds": self.elapsed_milliseconds, "hits": rows, "facets": facets}, default=plain, ensure_ascii=False)


def search(documents: DataFrame | None, request: SearchRequest, index: TextIndex | None = None) -> SearchResult:
    """Run the whole request; None stands for an index that doesn't exist."""
    if documents is None:
        raise SearchUnavailable("there is no index")
    began = time.monotonic_ns()
    rows = hits(documents, request, index).collect()
    count = total(documents, request, index)
    facets: dict[str, list[tuple[str, int]]] = {"brand": [], "category": [], "availability": []}
    for row in facet_counts(base(documents, request, index), request.brands, request.category, request.availability).orderBy("dimension", "place").collect():
        facets[row["dimension"]].append((row["value"], row["n"]))
    return SearchResult(count, (time.monotonic_ns() - began) // 1_000_000, rows, facets)
