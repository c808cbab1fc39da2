"""An inverted index of the documents' texts, kept in the layers of a Store beside them.

postings   a row for each term, field and document: occurrences, the field's length, and where they stand
terms      documents and occurrences of each term of a field; changes add to it or take from it
neighbours forms of each stem, by which stems within two edits of a word are found by equality
lengths    documents with text, and the sum of their lengths, by field

A search reads the postings of its own terms alone: they lie in folders by their first two letters, sorted by
term, so that the beginning of a word lies in one folder too. Scores are BM25 sums by clause, a misspelt term
counting less with each edit; highlights are cut from the text at the stored places, without analysing it again.

A word is a run of letters, digits and _ in the text as it stands, lower-cased after that.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.codes import EAN_INSIDE, SKU_INSIDE, SKU_PREFIX
from larder.functions.text import analysed_word, edits, html_escaped, within_edits
from larder.operators.store import Change, Store, Table

#: The fields' weights, and how the two code clauses and the beginning of a code weigh.
NAME_WEIGHT, DESCRIPTION_WEIGHT, PREFIX_WEIGHT, SKU_PREFIX_WEIGHT, CODE_WEIGHT = 3.0, 1.0, 1.5, 20.0, 10.0
#: Fixed values of BM25.
K1, B = 1.2, 0.75
NAME, DESCRIPTION, NAME_WORDS, SKU, EAN = "name", "description", "name.words", "sku", "ean"
#: Folders of the postings.
BUCKETS = 64
#: Stems of more than SHORT letters are found by the shortened forms of their halves, those of more than LONG by their parts;
#: queries have at most LONGEST letters.
SHORT, LONG, LONGEST, PARTS = 7, 24, 200, 5
#: Terms that a search may name in its filters; with more of them it joins instead.
NAMED = 1000
WORD = regex.compile(r"[\p{L}\p{N}_]+").finditer
CUT, ASCII_CUT = regex.compile(r"([\p{L}\p{N}_]+)"), re.compile(r"(\w+)", re.ASCII)
#: Places of terms that are gathered, a text's at least, before they are passed on; words whose terms a task remembers.
SPOTS, KNOWN = 100_000, 1 << 18

TABLES = {
    "postings": Table(("id",), partition="bucket"),
    "terms": Table(fold=lambda df: df.groupBy("field", "term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))),
    "neighbours": Table(partition="bucket", fold=lambda df: df.distinct()),
    "lengths": Table(fold=lambda df: df.groupBy("field").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))),
}


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(BUCKETS)).cast("int")


def dealt(rows: DataFrame, column: str) -> DataFrame:
    """rows by the hash of a column, in parts that aren't joined by their bytes: few bytes may be much work."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), column)


class _Codes(dict):
    """Numbers of words: equal ones for words of equal terms, -1 for those without one; terms: by number."""

    def __init__(self, term_of: Callable[[str], str | None]):
        self.term_of, self.terms, self.numbers = term_of, [], {}

    def __missing__(self, word: str) -> int:
        term = self.term_of(word)
        code = -1 if term is None else self.numbers.setdefault(term, len(self.terms))
        if code == len(self.terms):
            self.terms.append(term)
        self[word] = code
        return code

    def bound(self) -> None:
        """Forget all words where they have become too many; numbers given before are void then."""
        if len(self) > KNOWN:
            self.clear()
            self.terms, self.numbers = [], {}


def _words(value: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of a text, and from and to which characters they stand."""
    pieces = (ASCII_CUT if value.isascii() else CUT).split(value)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int32, len(pieces)), dtype=np.int32)
    return pieces[1::2], ends[:-1:2], ends[1::2]


def postings(documents: DataFrame) -> DataFrame:
    """(bucket, field, term, id, n, size, leads, spots) as in flat_postings, each spot as (place, start, stop)."""
    return flat_postings(documents).withColumn("spots", spots())


def spots() -> Column:
    """The spots of a stored posting, as (place, start, stop)."""
    at = lambda k: F.get(F.col("spots"), k).alias
    return F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(at(k * 3)("place"), at(k * 3 + 1)("start"), at(k * 3 + 2)("stop")))


def flat_postings(documents: DataFrame) -> DataFrame:
    """(bucket, field, term, id, n, size, leads, spots): size: terms of the field; leads marks the posting of the first term of each document's field.

    A document's terms are gathered where its text is read, so that only finished postings are shuffled. spots holds
    three numbers for each word: its place, and those of the characters from which to which it stands, one after another
    lest each be a row within the row. Words of the stop list have no stem.
    """
    schema = T.StructType([*T.StructType.fromDDL("field string, term string"), documents.schema["id"], *T.StructType.fromDDL("n int, size int, leads boolean, spots array<int>")])

    def packed(ids: pa.Array, field: str, terms: list[str], row: np.ndarray, code: np.ndarray, spots: list[np.ndarray]) -> pa.RecordBatch:
        """Postings of the words of some texts, in order: each with its text's row, its code and its spot."""
        has = code >= 0
        row, code, spots = row[has], code[has], [s[has] for s in spots]
        sizes, heads = np.bincount(row), np.diff(row, prepend=-1) != 0
        order = np.argsort(row.astype(np.int64) * len(terms) + code, kind="stable")  # places keep their order
        by_row, by_code = row[order], code[order]
        first = np.flatnonzero((np.diff(by_row, prepend=-1) != 0) | (np.diff(by_code, prepend=-1) != 0))
        ends = np.append(first, len(order)).astype(np.int32)
        used, at = np.unique(by_code[first], return_inverse=True)
        places = pa.array(np.stack([s[order] for s in spots], axis=1).astype(np.int32).ravel())
        term = pa.array([terms[c] for c in used.tolist()], pa.string()).take(pa.array(at))
        columns = [pa.repeat(field, len(first)), term, ids.take(pa.array(by_row[first])), pa.array(np.diff(ends), pa.int32()), pa.array(sizes[by_row[first]], pa.int32()), pa.array(heads[order[first]]), pa.ListArray.from_arrays(pa.array(ends * 3), places)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a word is looked up here once, so that the function's own memory of words is passed by
        analysed = analysed_word.__wrapped__
        stems, folded = _Codes(lambda w: analysed(w)[0]), _Codes(lambda w: analysed(w)[1])
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = batch.column("id")
                for column in (NAME, DESCRIPTION):
                    kinds = [(NAME, stems), (NAME_WORDS, folded)] if column == NAME else [(DESCRIPTION, stems)]
                    rows, held = [], 0
                    values = batch.column(column).to_pylist()
                    for row, value in enumerate(values):
                        if value:
                            words, start, stop = _words(value)
                            if words:
                                rows.append((np.full(len(words), row), np.arange(len(words)), start, stop, *(np.fromiter(map(c.__getitem__, words), np.int64, len(words)) for _, c in kinds)))
                                held += len(words)
                        if rows and (held >= SPOTS or row == len(values) - 1):
                            of, place, start, stop, *codes = map(np.concatenate, zip(*rows, strict=True))
                            for (field, known), code in zip(kinds, codes, strict=True):
                                yield packed(ids, field, known.terms, of, code, [place, start, stop])
                                known.bound()
                            rows, held = [], 0
                for column in (SKU, EAN):
                    found = [(row, value) for row, value in enumerate(batch.column(column).to_pylist()) if value is not None]
                    if found:
                        each, none = np.arange(len(found)), np.zeros(len(found), np.int32)
                        yield packed(ids, column, [v.lower() if column == SKU else v for _, v in found], np.array([r for r, _ in found]), each, [none, none, np.array([len(v) for _, v in found])])

    # by id, as a file may come as one partition
    found = dealt(documents.select("id", NAME, DESCRIPTION, SKU, EAN), "id").mapInArrow(run, schema)
    return found.select(bucket(F.col("term")).alias("bucket"), *schema.names)


def laid_out(rows: DataFrame) -> DataFrame:
    """Postings by folder, sorted by term; Spark splits a folder of many rows between tasks and joins small ones."""
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "field", "term", "id")


def shortened(term: str, most: int) -> dict[str, int]:
    """The forms of a term without up to so many of its letters, and how many are left out at least."""
    forms, last = {term: 0}, [term]
    for deleted in range(1, most + 1):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))} - forms.keys()
        forms |= dict.fromkeys(last, deleted)
    return forms


def parts_of(size: int) -> list[tuple[int, int]]:
    """Where the PARTS of a term of that size begin and end: two edits touch four of them at most, a swap two."""
    cuts = [size * k // PARTS for k in range(PARTS + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def halves_of(size: int, left: str, right: str) -> Iterator[str]:
    """Forms of the halves of a term of that size: as they are, and without one of their letters.

    Two edits leave one half with one at most: what crosses the middle, a swap or a swap around an edit, is three
    edits of the halves together.
    """
    for side, half in (("l", left), ("r", right)):
        for form in shortened(half, 1):
            yield f"{size}{side}{form}"


def forms_of_stem(term: str) -> list[tuple[str, int]]:
    """What the index holds of a stem: (form, letters left out)."""
    if len(term) <= SHORT:
        return list(shortened(term, 2).items())
    if len(term) <= LONG:
        half = len(term) // 2
        return [(form, 0) for form in halves_of(len(term), term[:half], term[half:])]
    if len(term) > LONGEST + 2:
        return []
    return [(f"{len(term)}:{k}:{term[a:b]}", 0) for k, (a, b) in enumerate(parts_of(len(term)))]


def forms_of_query(term: str) -> list[tuple[str, int]]:
    """What a search looks up for a term: every stem within its edits has one of these forms, with no more letters left out."""
    most = 0 if len(term) < 3 else 1 if len(term) <= 5 else 2
    found = []
    if len(term) <= SHORT + most:
        found += [(form, most) for form in shortened(term, most)]
    for size in range(max(SHORT + 1, len(term) - most), min(LONG, len(term) + most) + 1):
        half = size // 2
        found += {(form, 0) for k in (-1, 0, 1) for form in halves_of(size, term[: half + k], term[len(term) - (size - half) + k :])}
    for size in range(max(LONG + 1, len(term) - most), len(term) + most + 1):
        for k, (a, b) in enumerate(parts_of(size)):
            found += {(f"{size}:{k}:{term[a + shift : b + shift]}", 0) for shift in range(-most, most + 1) if a + shift >= 0}
    return found


def neighbours(terms: DataFrame) -> DataFrame:
    """(bucket, form, deleted, term) of the distinct stems (term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.column("term").slice(at, 256)
                found = [forms_of_stem(term) for term in some.to_pylist()]
                of = pa.array([k for k, forms in enumerate(found) for _ in forms], pa.int64())
                form, deleted = (pa.array([f[k] for forms in found for f in forms], t) for k, t in enumerate((pa.string(), pa.int32())))
                yield pa.RecordBatch.from_arrays([form, deleted, some.take(of)], names=["form", "deleted", "term"])

    rows = dealt(terms.select("term"), "term").mapInArrow(run, "form string, deleted int, term string")
    rows = rows.select(F.pmod(F.xxhash64("form"), F.lit(BUCKETS)).cast("int").alias("bucket"), "form", "deleted", "term")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "form")


def term_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("field", "term").agg(F.count("*").alias("documents"), F.sum("n").cast("bigint").alias("occurrences"))


def field_lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("field").agg(F.count_if("leads").alias("documents"), F.sum("n").cast("bigint").alias("occurrences"))


def bm25(n: Column, size: Column, mean: Column, documents: Column, having: Column, norm: bool = True) -> Column:
    """The score of a term that stands n times in a field of that size; having: the documents that have it."""
    rarity = F.log(F.lit(1.0) + (documents - having + F.lit(0.5)) / (having + F.lit(0.5)))
    length = F.lit(1 - B) + F.lit(B) * size / mean if norm else F.lit(1.0)
    return rarity * n / (n + F.lit(K1) * length)


def query_terms(spark: SparkSession, text: str) -> tuple[list[str], list[str]]:
    """The stems and the folded words of a text, in order."""
    found = [analysed_word(m[0]) for m in WORD(text)]
    return [stem for stem, _ in found if stem is not None], [word for _, word in found]


@dataclass
class Asked:
    """stems and words of a text; begins: whether its last word may be a beginning.

    frame: (query, field, term, edits, begins) for each term to look up; rows: the same as a list, where NAMED allows it.
    """

    stems: list[str]
    words: list[str]
    begins: bool
    frame: DataFrame
    rows: list[tuple] | None


class TextIndex:
    """Writes and searches the text tables of a store.

    apart: letters may be swapped around an edit, see within_edits; forms with two letters left out and parts
    find these terms as well.
    """

    def __init__(self, store: Store, apart: bool = False):
        self.store, self.spark, self.apart = store, store.spark, apart

    # writing

    def fill(self, change: Change, documents: DataFrame) -> None:
        """Index all documents anew."""
        rows = self._laid(change, laid_out(flat_postings(documents)), True)
        change.replace("terms", term_counts(rows).repartitionByRange("field", "term").sortWithinPartitions("field", "term"))
        change.replace("lengths", field_lengths(rows))
        counted = self.store._read(change.layers["terms"][-1]["rows"])
        change.replace("neighbours", neighbours(counted.where(F.col("field").isin(NAME, DESCRIPTION)).select("term").distinct()))

    def update(self, change: Change, before: DataFrame, after: DataFrame) -> None:
        """Index changed documents: before as they were (none of the new ones), after as they are (none of the deleted ones)."""
        old, rows = flat_postings(before), self._laid(change, laid_out(flat_postings(after)), False, before.select("id"))
        signed = lambda counts, sign: counts.withColumns({c: F.col(c) * sign for c in ("documents", "occurrences")})
        for name, count in (("terms", term_counts), ("lengths", field_lengths)):
            change.put(name, signed(count(rows), 1).unionByName(signed(count(old), -1)))
        change.put("neighbours", neighbours(rows.where(F.col("field").isin(NAME, DESCRIPTION)).select("term").distinct()))

    def _laid(self, change: Change, rows: DataFrame, anew: bool, gone: DataFrame | None = None) -> DataFrame:
        """Write postings to the change; returns them as they were written."""
        if anew:
            change.replace("postings", rows)
        else:
            change.put("postings", rows, gone)
        return self.store._read(change.layers["postings"][-1]["rows"])

    # searching

    def expansions(self, terms: list[str]) -> DataFrame:
        """(query, term, edits): the stems that the index holds within the allowed edits of each of the terms."""
        forms = [(t, form, most) for t in dict.fromkeys(terms) for form, most in forms_of_query(t)]
        asked = self.spark.createDataFrame(forms or [("", "", -1)], "query string, form string, most int")
        asked = asked.withColumn("bucket", F.pmod(F.xxhash64("form"), F.lit(BUCKETS)).cast("int"))
        near = self.store.read("neighbours", folded=False).join(F.broadcast(asked), ["bucket", "form"]).where("deleted <= most")  # at most 200 letters' forms
        found = near.select("query", "term").distinct()
        return found.where(within_edits(F.col("query"), F.col("term"), self.apart)).withColumn("edits", edits(F.col("query"), F.col("term")))

    def _asked(self, text: str) -> Asked:
        """What a text asks of the index."""
        stems, folded = query_terms(self.spark, text)
        rows = []
        begins = len(text.split(" ")[-1]) >= 2 and bool(folded)
        if begins:
            rows += [(w, NAME_WORDS, w, 0, False) for w in dict.fromkeys(folded[:-1])] + [("", NAME_WORDS, folded[-1], 0, True)]
        rows += [("", SKU, text.lower(), 0, True)] if SKU_PREFIX.fullmatch(text) else []
        rows += [(code.lower(), SKU, code.lower(), 0, False) for code in dict.fromkeys(SKU_INSIDE.findall(text))]
        rows += [(code, EAN, code, 0, False) for code in dict.fromkeys(EAN_INSIDE.findall(text))]
        schema, near = "query string, field string, term string, edits int, begins boolean", None
        if stems:
            near = self.expansions(stems).select("query", F.explode(F.array(F.lit(NAME), F.lit(DESCRIPTION))).alias("field"), "term", "edits", F.lit(False).alias("begins"))
            some = near.limit(NAMED + 1).collect()
            if len(some) <= NAMED:
                rows, near = rows + [tuple(r) for r in some], None
        frame = self.spark.createDataFrame(rows, schema)
        if near is not None:
            frame, rows = near.unionByName(frame), None
        return Asked(stems, folded, begins, frame, rows)

    def _read(self, asked: Asked) -> DataFrame:
        """Postings of what is asked for, with query, edits and begins: read by folder and term where these can be named."""
        held = self.store.read("postings")
        if asked.rows is not None:
            folders = self.spark.createDataFrame([(r[2],) for r in asked.rows], "term string").select("term", bucket(F.col("term")).alias("bucket"))
            folder = {r["term"]: r["bucket"] for r in folders.collect()}
            some = F.lit(False)
            if exact := {r[2] for r in asked.rows if not r[4]}:
                some = F.col("term").isin(sorted(exact))
            for _, field, term, _, begins in asked.rows:
                if begins:
                    some = some | (F.col("term").startswith(term) & (F.col("field") == field))
            # one letter begins terms of many folders
            if all(len(r[2]) > 1 or not r[4] for r in asked.rows):
                held = held.where(F.col("bucket").isin(sorted(set(folder.values()))))
            held = held.where(some)
        a, p = asked.frame.alias("a"), held.alias("p")
        whole = p.join(a.where("not begins"), (F.col("a.field") == F.col("p.field")) & (F.col("a.term") == F.col("p.term")))
        starts = p.join(F.broadcast(a.where("begins")), (F.col("a.field") == F.col("p.field")) & F.col("p.term").startswith(F.col("a.term")))  # two rows at most
        columns = ["p.field", "p.term", "p.id", "p.n", "p.size", "p.spots", "a.query", "a.edits", "a.begins"]
        return whole.select(*columns).unionByName(starts.select(*columns))

    def matches(self, text: str) -> DataFrame:
        """(id, score) of the documents that a text finds.

        Clauses: all stems within their edits in one field (the better of name and description), all words in the
        name of which the last may be a beginning, a code's beginning, and each whole code.
        """
        asked = self._asked(text)
        counts, known = self.store.read("terms"), asked.frame.where("not begins").select("field", "query", "term")
        if asked.rows is not None:
            counts = counts.where(F.col("term").isin(sorted({r[2] for r in asked.rows if not r[4]})))
        # of a word and its misspellings, the most frequent one says how rare the word is
        having = counts.join(known, ["field", "term"]).groupBy("field", "query").agg(F.max("documents").alias("having"))
        lengths = self.store.read("lengths").select("field", F.col("documents").alias("all"), (F.col("occurrences") / F.col("documents")).alias("mean"))
        # having has a row for each of the text's terms and fields, lengths one for each field
        scored = self._read(asked).join(F.broadcast(having), ["field", "query"], "left").join(F.broadcast(lengths), "field")
        near = F.lit(1.0) - F.col("edits") / F.least(F.char_length("query"), F.char_length("term"))
        in_text = near * bm25(F.col("n"), F.col("size"), F.col("mean"), F.col("all"), F.col("having"))
        whole_code = bm25(F.lit(1), F.lit(1), F.lit(1), F.col("all"), F.col("having"), norm=False)
        value = F.when(F.col("begins"), F.lit(1.0)).when(F.col("field").isin(SKU, EAN), whole_code).otherwise(in_text)
        columns: list[Column] = []

        def best(field: str, query: str, begins: bool = False) -> Column:
            """The best value of a term in the field, null without one."""
            own = (F.col("field") == field) & (F.col("query") == query) & (F.col("begins") == begins)
            columns.append(F.max(F.when(own, F.col("value"))).alias(f"value_{len(columns)}"))
            return F.col(f"value_{len(columns) - 1}")

        def all_of(field: str, terms: list[str], more: Column | None = None) -> Column:
            """The sum of the terms' values in the field; null unless all are there."""
            each = [best(field, t) for t in terms] + ([more] if more is not None else [])
            return sum(each[1:], each[0])

        clauses = []
        if asked.stems:
            clauses.append(F.greatest(NAME_WEIGHT * all_of(NAME, asked.stems), DESCRIPTION_WEIGHT * all_of(DESCRIPTION, asked.stems)))
        if asked.begins:
            clauses.append(PREFIX_WEIGHT * all_of(NAME_WORDS, asked.words[:-1], best(NAME_WORDS, "", True)))
        if SKU_PREFIX.fullmatch(text):
            clauses.append(SKU_PREFIX_WEIGHT * best(SKU, "", True))
        clauses += [CODE_WEIGHT * best(SKU, code.lower()) for code in SKU_INSIDE.findall(text)]
        clauses += [CODE_WEIGHT * best(EAN, code) for code in EAN_INSIDE.findall(text)]
        scored = scored.select("id", "field", "query", "begins", value.alias("value"))
        if not clauses:
            return scored.where("false").select("id", F.lit(0.0).alias("score"))
        matched, score = F.lit(False), F.lit(0.0)
        for clause in clauses:
            matched, score = matched | clause.isNotNull(), score + F.coalesce(clause, F.lit(0.0))
        return scored.groupBy("id").agg(*columns).where(matched).select("id", score.alias("score"))

    def highlights(self, text: str, documents: DataFrame) -> DataFrame:
        """(id, highlight) of the documents (a page of them): marked texts by field, cut at the stored places."""
        found = self._read(self._asked(text)).join(F.broadcast(documents.select("id")), "id", "left_semi")  # a page
        shown = F.when(F.col("field") == NAME_WORDS, NAME).otherwise(F.col("field"))
        marks = found.select("id", shown.alias("field"), F.explode(spots()).alias("s")).groupBy("id").agg(F.collect_set(F.struct("field", "s.start", "s.stop")).alias("marks"))
        marked = documents.join(marks, "id", "left")
        none = F.array().cast("array<struct<field:string,start:int,stop:int>>")

        def entry(name: str) -> Column:
            own = F.filter(F.coalesce("marks", none), lambda m: m["field"] == name)
            return F.struct(F.lit(name).alias("key"), F.array(cut(F.col(name), F.array_sort(F.transform(own, lambda m: m.dropFields("field"))))).alias("value"))

        entries = [entry(name) for name in (NAME, DESCRIPTION, SKU, EAN)]
        whole = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"][0].isNotNull()))
        return marked.select("id", whole.alias("highlight"))


def cut(text: Column, marks: Column) -> Column:
    """The escaped text with <mark> around the marks (start, stop) in order; null where there are none."""
    piece = lambda start, stop: html_escaped(F.substring(text, start + 1, stop - start))
    before = lambda i: F.when(i > 0, F.get(marks, i - 1)["stop"]).otherwise(0)
    each = F.transform(marks, lambda m, i: F.concat(piece(before(i), m["start"]), F.lit("<mark>"), piece(m["start"], m["stop"]), F.lit("</mark>")))
    rest = piece(F.get(marks, F.size(marks) - 1)["stop"], F.char_length(text))
    return F.when(F.size(marks) > 0, F.concat(F.array_join(each, ""), rest))
