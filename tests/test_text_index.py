"""The stored text index: goldens of the search, scores by plain arithmetic, fuzzy terms, changes, plans."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_search import ROWS

from larder.functions import text
from larder.operators import text_index
from larder.operators.documents import build_documents
from larder.operators.search import SearchRequest, hits, search
from larder.operators.store import Change, Store, Table
from larder.operators.text_index import TextIndex

PRODUCT = "sku string, name string, brand string, slug_path string, stock_quantity int, visible boolean, ean string"


def documents(spark, rows):
    made = spark.createDataFrame(rows, PRODUCT)
    return build_documents(made.withColumns({"id": F.col("sku"), "description": F.lit("Popis produktu."), "price_in_minor_units": F.lit(19990), "updated_at": F.lit("2026-09-01 10:00:00").cast("timestamp")}))


def filled(spark, root, docs):
    store = Store(spark, f"file://{root}", text_index.TABLES | {"documents": Table(("id",))})
    lease = store.take("test", 600)
    index, change = TextIndex(store), Change(store, lease)
    change.replace("documents", docs)
    index.fill(change, docs)
    change.commit()
    return index, lease


@pytest.fixture(scope="module", autouse=True)
def few_folders():
    before, text_index.BUCKETS = text_index.BUCKETS, 4
    yield
    text_index.BUCKETS = before


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    index, lease = filled(spark, tmp_path_factory.mktemp("shop"), documents(spark, ROWS))
    index.store.release(lease)
    return index.store.read("documents"), index


def ask(shop, **request):
    return search(shop[0], SearchRequest(**request), shop[1])


GOLDEN = [("prikelpovy", 1), ("EAN8590000000002", 1), ("85900000000025", 0), ("hadice mak-0000004", 1), ("sr", 1), ("s", 0), ("makita kladivo", 0), ("kladiva", 1)]


def test_hit_counts(shop):
    visible = {r["id"] for r in shop[0].where("visible").collect()}
    assert [(words, len(visible & {r["id"] for r in shop[1].matches(words).collect()})) for words, _ in GOLDEN] == GOLDEN
    assert shop[1].matches("!!").collect() == []


def test_the_whole_request(shop):
    found = ask(shop, text="makita sroub")
    assert (found.total, found.hits[0]["sku"], found.facets["brand"]) == (1, "MAK-DHP484Z", [("Makita", 1)])
    assert found.hits[0]["highlight"] == {"name": ["<mark>Makita</mark> DHP484Z příklepový <mark>šroubovák</mark>"]}


def test_highlights_are_cut_from_stored_places(shop):
    marks = {
        "kladivo": {"name": ["Narex <mark>kladivo</mark> &lt;300 g&gt;"]},
        "MAK-0000": {"sku": ["<mark>MAK-0000004</mark>"]},
        "GWS-18": {"name": ["Bosch <mark>GWS</mark> <mark>18V</mark>-10 úhlová bruska"]},
    }
    for words, want in marks.items():
        page = shop[0].join(shop[1].matches(words).select("id"), "id", "left_semi").where("visible")
        assert [r["highlight"] for r in shop[1].highlights(words, page).collect()] == [want], words


def test_a_search_reads_its_folders_of_postings_only(shop):
    plan = shop[1].matches("makita sroub")._jdf.queryExecution().executedPlan().toString()
    postings = [line for line in plan.splitlines() if "FileScan" in line and "postings" in line]
    assert postings and all("PartitionFilters: [bucket" in line or "bucket#" in line.split("PartitionFilters: [")[1].split("]")[0] for line in postings)
    assert all("In(term" in line or "StringStartsWith" in line or "term" in line.split("PushedFilters: [")[1] for line in postings)
    assert "documents-" not in plan and "name#" not in plan  # no scan of the catalogue


def osa(a, b):
    """Optimal alignment distance."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_fuzzy_terms_equal_all_pairs(spark, tmp_path):
    """Random words over few letters, with swaps, and words on both sides of the length from which parts are used."""
    rng = random.Random(5)
    stems = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(250)}
    for _ in range(25):
        long = "".join(rng.choice("abcdef") for _ in range(rng.randint(21, 34)))
        stems.add(long)
        for _ in range(4):
            own, at = list(long), rng.randrange(len(long) - 1)
            own[at : at + 2] = rng.choice([own[at : at + 2][::-1], ["x", own[at + 1]], [own[at]], [*own[at : at + 2], "y"]])
            at = rng.randrange(len(own) - 1)
            own[at : at + 2] = rng.choice([own[at : at + 2][::-1], own[at : at + 2], ["z"]])
            stems.add("".join(own))
    names = sorted(stems)
    rows = [(f"SKU-{k}", n, "B", "a/b", 1, True, "") for k, n in enumerate(names)]
    store = Store(spark, f"file://{tmp_path}", text_index.TABLES)
    change = Change(store, store.take("test", 60))
    change.replace("neighbours", text_index.neighbours(spark.createDataFrame([(n,) for n in names], "term string")))
    change.commit()
    asked = rng.sample(names, 60) + [n for n in names if len(n) > 20]
    got = {(r["query"], r["term"], r["edits"]) for r in TextIndex(store).expansions(asked).collect()}
    allowed = lambda t: 0 if len(t) < 3 else 1 if len(t) <= 5 else 2
    want = {(q, n, osa(q, n)) for q in asked for n in names if osa(q, n) <= allowed(q)}
    assert got == want and len(rows) == len(names)


def analysed_words(spark, rows):
    """{id: [stems of the name, stems of the description, folded words of the name]}, a word at a time."""
    words = [(key, field, k, w.lower()) for key, *texts in rows for field, value in enumerate(texts) for k, w in enumerate(re.findall(r"\w+", value))]
    out = {key: [[], [], []] for key, *_ in rows}
    frame = spark.createDataFrame(words, "id string, field int, k int, word string").coalesce(1).orderBy("id", "field", "k")
    for r in frame.select("id", "field", text.stem(F.col("word")).alias("stem"), text.fold(F.col("word")).alias("folded")).collect():
        out[r["id"]][r["field"]] += [r["stem"]] if r["stem"] is not None else []
        out[r["id"]][2] += [r["folded"]] if r["field"] == 0 else []
    return out


def plain_scores(spark, analysed, words):
    """BM25 of the two text clauses."""
    stems, folded = text_index.query_terms(spark, words)
    allowed = lambda t: 0 if len(t) < 3 else 1 if len(t) <= 5 else 2

    def best(field, term, key, fuzzy):
        every = [a[field] for a in analysed.values() if a[field]]
        near = {w: osa(term, w) for a in every for w in a if (osa(term, w) <= allowed(term) if fuzzy else w == term)}
        own, mean = analysed[key][field], sum(map(len, every)) / len(every)
        having = max((sum(w in a for a in every) for w in near), default=0)
        counts = Counter(own)
        idf = math.log(1 + (len(every) - having + 0.5) / (having + 0.5))
        values = [(1 - e / min(len(term), len(w))) * idf * counts[w] / (counts[w] + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, e in near.items() if counts[w]]
        return max(values, default=None)

    out = {}
    for key in analysed:
        clauses = []
        if stems:
            sides = [(weight, [best(field, t, key, True) for t in stems]) for field, weight in ((0, 3.0), (1, 1.0))]
            clauses.append(max((w * sum(v) for w, v in sides if None not in v), default=None))
        if len(words.split(" ")[-1]) >= 2 and folded:
            begun = [1.0] if any(w.startswith(folded[-1]) for w in analysed[key][2]) else [None]
            each = [best(2, t, key, False) for t in folded[:-1]] + begun
            clauses.append(1.5 * sum(each) if None not in each else None)
        if any(c is not None for c in clauses):
            out[key] = sum(c for c in clauses if c is not None)
    return out


SHELF = [
    ("a", "red widget widget", "a large red widget for the wall"),
    ("b", "red wigdet", "small"),
    ("c", "blue widget", "red red red"),
    ("d", "widgets and gears of red steel with a very long name indeed", ""),
    ("e", "Kladivo kladiva", "kladivo na zeď"),
    ("f", "Wid", "widget red"),
]


def test_scores_equal_plain_arithmetic(spark, tmp_path):
    rows = [(k, n, "B", "a/b", 1, True, "8590000000001") for k, n, _ in SHELF]
    own = spark.createDataFrame([(k, d) for k, _, d in SHELF], "id string, d string")
    docs = documents(spark, rows).join(own, "id").withColumn("description", F.col("d")).drop("d")
    index, _ = filled(spark, tmp_path, docs)
    analysed = analysed_words(spark, SHELF)
    for words in ("red widget", "kladivo", "red wid", "wigdet red red"):
        got = {r["id"]: r["score"] for r in index.matches(words).collect()}
        want = plain_scores(spark, analysed, words)
        assert got == pytest.approx(want) and want
    # the order of scores that aren't zero
    ordered = [r["sku"] for r in hits(index.store.read("documents"), SearchRequest(text="wigdet red red"), index).collect()]
    assert ordered == sorted(want, key=lambda k: (-round(want[k], 9), k)) and len(ordered) > 2


def test_changes_give_what_filling_anew_gives(spark, tmp_path):
    before = documents(spark, ROWS)
    index, lease = filled(spark, tmp_path / "one", before)
    changed = [(ROWS[0][0], "Makita nové kladivo", *ROWS[0][2:]), ("NEW-0000009", "Úplně nová hadice", "Narex", "a/b", 1, True, "8590000000009")]
    gone = {ROWS[0][0], ROWS[3][0]}
    change = Change(index.store, lease)
    index.update(change, before.where(F.col("id").isin(*gone)), documents(spark, changed))
    change.commit()
    anew, _ = filled(spark, tmp_path / "two", documents(spark, [r for r in ROWS if r[0] not in gone] + changed))
    for name in ("postings", "terms", "lengths"):
        rows = lambda i: sorted(map(str, i.store.read(name).where("documents > 0" if name != "postings" else "true").select(*sorted(anew.store.read(name).columns)).collect()))  # noqa: B023, E731
        assert rows(index) == rows(anew), name
    for words in ("kladivo", "nova hadice"):
        scores = lambda i: {r["id"]: round(r["score"], 9) for r in i.matches(words).collect()}  # noqa: B023, E731
        assert scores(index) == scores(anew), words
    assert [len(index.store.size(n)) for n in ("postings", "terms")] == [2, 2]


def test_many_expansions_are_joined(spark, shop, monkeypatch):
    want = shop[1].matches("makita sroub").collect()
    monkeypatch.setattr(text_index, "NAMED", 0)
    assert shop[1].matches("makita sroub").collect() == want and want[0]["id"] == "MAK-DHP484Z"


def test_long_empty_and_null_texts(spark, tmp_path):
    long = " ".join(f"slovo{k}" for k in range(20_000)) + " " + "x" * 5000
    rows = [("A", long, "B", "a/b", 1, True, None), ("B", "", "B", "a/b", 1, True, "1"), ("C", None, "B", "a/b", 1, True, "2")]
    index, _ = filled(spark, tmp_path, documents(spark, rows))
    assert [r["id"] for r in index.matches("slovo19999").collect()] == ["A"]
    assert index.store.read("lengths").where("field = 'name'").first()["documents"] == 1
    empty, _ = filled(spark, tmp_path / "empty", documents(spark, rows[:0]))
    assert empty.matches("slovo").collect() == []


def test_fields_that_no_request_reads_are_reported(shop):
    from larder.operators.field_use import unused_fields

    assert unused_fields(shop[1].store) == []
    store = shop[1].store
    lease = store.take("later", 60)
    change = Change(store, lease)
    change.replace("documents", shop[0].withColumn("colour", F.lit("red")))
    change.commit()
    assert unused_fields(store) == ["colour"]


def test_one_analysis_of_words(spark):
    """The index's word by word analysis and the columns' give the same stems and folded words."""
    endings = ["", *text.CASE_ENDINGS, *text.POSSESSIVES]
    words = [chr(k) for k in range(0x30, 0x250)] + [b + m + e for b in ("a", "ko", "bruš", "Žluť", "dům") for m in ("", "k", "čt", "št", "c", "z", "ž", "en", "ůl", "ß") for e in endings] + [*text.STOPWORDS, "ŘEŘICHA", "Ἀθῆναι", "18v", "x" * 300]
    words = [w for w in words if re.fullmatch(r"\w+", w)]
    lower = F.lower(F.col("word"))
    rows = spark.createDataFrame([(w,) for w in words], "word string").withColumn("lower", lower).select("word", text.stem(F.col("lower")).alias("stem"), text.fold(F.col("lower")).alias("folded"), text.stems(F.col("word")).alias("stems")).collect()
    assert {r["word"]: (r["stem"], r["folded"]) for r in rows} == {w: text.analysed_word(w) for w in words}
    assert all(r["stems"] == ([] if r["stem"] is None else [r["stem"]]) for r in rows if r["word"] not in ("İ",))


def test_postings_are_shuffled_whole(spark):
    """A document's terms are gathered with its text: nothing is grouped after it, occurrence by occurrence."""
    plan = text_index.postings(documents(spark, ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and len(plan) < 20_000
    own = spark.createDataFrame([("SKU", "Kladivo a kladiva, zeď", "", None, None)], "id string, name string, description string, sku string, ean string")
    found = {(r["field"], r["term"]): (r["n"], r["size"], r["leads"], [tuple(s) for s in r["spots"]]) for r in text_index.postings(own).collect()}
    assert found[("name", "kladiv")] == (2, 3, True, [(0, 0, 7), (2, 10, 17)])
    assert found[("name.words", "a")] == (1, 4, False, [(1, 8, 9)]) and ("name", "a") not in found and len(found) == 6


def unrestricted(a, b):
    """Edits by a breadth-first walk over all words that one edit gives; a swap may be edited again."""
    near, letters = {a}, set(a + b)
    for k in range(3):
        if b in near:
            return k
        near |= {v for w in near for i in range(len(w) + 1) for v in [w[:i] + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :], *(w[:i] + c + w[i + x :] for c in letters for x in (0, 1))]}
    return 3


def test_letters_swapped_around_an_edit(spark, tmp_path):
    """What the SQL's distance counts as two edits and optimal alignment as three."""
    rng = random.Random(7)
    stems = {"eroutin", "erortin", "athtion", "ertoin", "hation"} | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(120)}
    long = "abcdefghijklmnopqrstuvwxyz"
    stems |= {long, long[:9] + "kxj" + long[11:], long[:9] + "lj" + long[12:], long[::-1]}
    store = Store(spark, f"file://{tmp_path}", text_index.TABLES)
    change = Change(store, store.take("test", 60))
    change.replace("neighbours", text_index.neighbours(spark.createDataFrame([(n,) for n in sorted(stems)], "term string")))
    change.commit()
    asked = ["ertoin", "hation", long, *rng.sample(sorted(n for n in stems if len(n) < 9), 15)]
    got = {(r["query"], r["term"], r["edits"]) for r in TextIndex(store, apart=True).expansions(asked).collect()}
    allowed = lambda t: 0 if len(t) < 3 else 1 if len(t) <= 5 else 2
    short = [q for q in asked if len(q) < 9]
    assert {g for g in got if g[0] != long} == {(q, n, d) for q in short for n in stems if abs(len(q) - len(n)) < 3 and (d := unrestricted(q, n)) <= allowed(q)}
    assert {t for q, t, _ in got if q == long} == stems & {long, long[:9] + "kxj" + long[11:], long[:9] + "lj" + long[12:]}
    assert {("ertoin", "eroutin", 2), ("ertoin", "erortin", 2), ("hation", "athtion", 2)} <= got


def test_work_of_the_index_is_dealt_and_bounded(spark, monkeypatch):
    """Few bytes may be much work: analysis and forms get parts of their own; a stem has about as many forms as letters."""
    own = spark.createDataFrame([("SKU", "Kladivo", "", None, None)], "id string, name string, description string, sku string, ean string").coalesce(1)
    least = 4 * spark.sparkContext.defaultParallelism
    assert text_index.postings(own).rdd.getNumPartitions() >= least
    assert text_index.dealt(own.select(F.col("name").alias("term")), "term").rdd.getNumPartitions() >= least
    assert all(len(text_index.forms_of_stem("abcdefghijklmnopqrstuvwxyz"[:n])) <= 29 for n in range(1, 27))
    # words that are forgotten between texts are numbered anew
    rows = [(str(k), f"alfa{k} beta{k} alfa{k} beta", "", None, None) for k in range(40)]
    texts = spark.createDataFrame(rows, "id string, name string, description string, sku string, ean string").coalesce(1)
    want = sorted(map(str, text_index.postings(texts).collect()))
    monkeypatch.setattr(text_index, "KNOWN", 3)
    monkeypatch.setattr(text_index, "SPOTS", 8)
    assert sorted(map(str, text_index.postings(texts).collect())) == want and len(want) == 40 * 6


def test_two_edits_leave_a_half_with_one_at_most(spark, tmp_path):
    """All kinds of two edits, of stems whose halves are indexed, at every place; and swaps around an edit."""
    rng = random.Random(11)
    once = lambda w: [w[:i] + x for i in range(len(w) + 1) for x in (w[i + 1 :], "q" + w[i:], "q" + w[i + 1 :], w[i : i + 2][::-1] + w[i + 2 :])]
    for n in (6, 8, 9, 13, 23, 24, 25):
        word = "".join(rng.sample("abcdefghijklmnoprstuvwxyz", n))
        asked = {form for form, _ in text_index.forms_of_query(word)}
        apart = [word[:i] + word[i + 1] + "q" + word[i] + word[i + 2 :] for i in range(n - 1)] + [word[:i] + word[i + 2] + word[i] + word[i + 3 :] for i in range(n - 2)]
        for near in {v for w in once(word) for v in once(w)} | set(apart):
            assert asked & {form for form, _ in text_index.forms_of_stem(near)}, (word, near)
