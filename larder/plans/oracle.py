"""SQL that gives the rows of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from larder.functions import text

#: What the text queries ask for: two words of the test documents, one misspelt; words as they might be typed.
DOCUMENT_WORDS = "thtoin eriner"
TYPED = ["a", "th", "teh", "fro", "hation", "ertoin", "inging", "enheti", "thanedbleinre"]

_EAN = "'859' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')"
PRODUCT = f"""
    product AS (
        SELECT p_partkey AS id, 'PRT-' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS sku, p_name AS name,
               p_name || ' by ' || p_brand AS description, p_brand AS brand,
               lower(p_type) || '/' || split_part(p_name, ' ', 2) || '/' || split_part(p_name, ' ', 1) AS slug_path,
               lower(p_type) AS l1, lower(p_type) || '/' || split_part(p_name, ' ', 2) AS l2,
               CAST(round(p_retailprice * 100) AS INTEGER) AS price_in_minor_units,
               CAST(round(p_retailprice * 100) AS INTEGER) / 100.0::DOUBLE AS price,
               CAST(CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE 1 + p_partkey * 37 % 400 END AS INTEGER) AS stock_quantity,
               p_partkey % 50 <> 0 AS visible,
               {_EAN} || CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({_EAN}, i, 1) AS INTEGER)
                   * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS VARCHAR) AS ean,
               CAST(DATE '2001-11-04' - CAST(p_partkey % 400 AS INTEGER) AS TIMESTAMP) AS updated_at
        FROM part)
"""
SALES = """
    sales AS (
        SELECT s_nationkey AS store_number, l_partkey AS product_id, CAST(l_shipdate AS DATE) AS sales_date,
               CAST(sum(l_quantity) AS BIGINT) AS quantity
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
"""
STOCK = """
    stock AS (
        SELECT DISTINCT store_number, product_id,
               CAST(1 + (store_number * 31 + product_id * 17) % 40 AS BIGINT) AS quantity_on_hand,
               CAST(CASE WHEN (store_number * 7 + product_id) % 4 = 0 THEN 10 ELSE 0 END AS BIGINT) AS quantity_on_order
        FROM sales WHERE (store_number + product_id) % 5 <> 0)
"""


def totals(last: str = "2001-11-04") -> str:
    return f"""
        SELECT store_number, product_id, CAST(sum(quantity) AS BIGINT) AS total,
               CAST(sum(quantity * quantity) AS BIGINT) AS total_squares
        FROM sales WHERE sales_date BETWEEN DATE '{last}' - 27 AND DATE '{last}' GROUP BY ALL"""


EVENTS = """
    marks AS (
        SELECT 'products' AS index_name, user_id AS product_id,
               CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS mask,
               CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS op,
               CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS marked, event_id AS seq
        FROM events)
"""
FOLD = "SELECT index_name, product_id, CAST(bit_or(mask) AS INTEGER) AS scope_mask, arg_max(op, seq) AS operation, arg_max(marked, seq) AS marked_at FROM marks GROUP BY ALL"
HITS = "id, sku, name, brand, slug_path AS category_path, price, stock_quantity, ean"
SCORED = "id, sku, price, stock_quantity, 0.0::DOUBLE AS score"

INDEX = """
    idx AS (
        SELECT id, CASE WHEN id % 6 = 0 THEN name || ' old' ELSE name END AS name,
               CASE WHEN id % 4 = 0 THEN price + 1 ELSE price END AS price, stock_quantity
        FROM product WHERE id % 10 <> 3)
"""
PLAN = f"""
    o AS ({FOLD.replace("FROM marks", "FROM marks WHERE CAST(marked AS DATE) = (SELECT max(CAST(marked AS DATE)) FROM marks)")}),
    every AS ({FOLD}),
    j AS (
        SELECT o.product_id, o.scope_mask, p.id IS NOT NULL AS has_new, i.id IS NOT NULL AS has_old,
               p.name AS new_name, p.price AS new_price, p.stock_quantity AS new_stock,
               i.name AS old_name, i.price AS old_price, i.stock_quantity AS old_stock,
               CASE WHEN o.operation = 'delete' OR p.id IS NULL THEN 'delete' WHEN i.id IS NULL THEN 'insert'
                    WHEN o.scope_mask & 4 <> 0 THEN 'replace' ELSE 'update' END AS action
        FROM o LEFT JOIN (SELECT * FROM product WHERE id % 7 <> 0) p ON p.id = o.product_id
               LEFT JOIN idx i ON i.id = o.product_id),
    d AS (
        SELECT product_id, scope_mask, action, has_old, old_name, old_price, old_stock,
               CASE action WHEN 'delete' THEN NULL WHEN 'update' THEN old_name ELSE new_name END AS name,
               CASE WHEN action = 'delete' THEN NULL WHEN action = 'update' AND scope_mask & 1 = 0 THEN old_price ELSE new_price END AS price,
               CASE WHEN action = 'delete' THEN NULL WHEN action = 'update' AND scope_mask & 2 = 0 THEN old_stock ELSE new_stock END AS stock_quantity
        FROM j),
    plan AS (
        SELECT *, CASE WHEN action = 'delete' THEN CASE WHEN has_old THEN 'deleted' ELSE 'not_found' END
                       WHEN action = 'insert' THEN 'created'
                       WHEN name = old_name AND price = old_price AND stock_quantity = old_stock THEN 'noop' ELSE 'updated' END AS outcome
        FROM d)
"""
CHANGED = """
    changed AS (
        SELECT id FROM product
        WHERE updated_at >= TIMESTAMP '2001-11-01'
           OR CAST(DATE '2001-11-04' - CAST(CAST(split_part(brand, '#', 2) AS INTEGER) * 7 % 90 AS INTEGER) AS TIMESTAMP) >= TIMESTAMP '2001-11-01'
           OR CAST(DATE '2001-11-04' - CAST(length(slug_path) * 11 % 120 AS INTEGER) AS TIMESTAMP) >= TIMESTAMP '2001-11-01'),
    gone AS (
        SELECT id FROM product
        WHERE id % 97 = 0 AND CAST(DATE '2001-11-04' - CAST(id % 30 AS INTEGER) AS TIMESTAMP) >= TIMESTAMP '2001-11-01')
"""
DRIFTED = "p.id % 10 = 3 OR p.id % 4 = 0 OR p.id % 6 = 0"


def _facet(dimension: str, rows: str) -> str:
    return f"""
        SELECT '{dimension}' AS dimension, value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS place
        FROM (SELECT value, count(*) AS n FROM ({rows}) GROUP BY value)
        QUALIFY row_number() OVER (ORDER BY n DESC, value) <= 20"""


def _availability(where: str) -> str:
    return f"""
        SELECT 'availability' AS dimension, value, n, place FROM (
            SELECT 'in_stock' AS value, count(*) FILTER (stock_quantity > 0) AS n, 1 AS place FROM product WHERE visible AND {where}
            UNION ALL SELECT 'out_of_stock', count(*) FILTER (stock_quantity = 0), 2 FROM product WHERE visible AND {where})"""


def _folded(word: str) -> str:
    out = f"translate({word}, '{text.ACCENTED}', '{text.PLAIN}')"
    for letter, two in text.DOUBLE.items():
        out = f"replace({out}, '{letter}', '{two}')"
    return out


def _stem_list(value: str) -> str:
    """The stems of a text in order."""
    q = lambda words: "|".join(words)
    stop = ", ".join(f"'{w}'" for w in text.STOPWORDS)
    steps = [
        f"regexp_replace(x, '^(.{{3,}}?)(?:{q(text.CASE_ENDINGS)})$', '\\1')",
        f"regexp_replace(x, '^(.{{4,}})(?:{q(text.POSSESSIVES)})$', '\\1')",
        "CASE WHEN x LIKE '%čt' THEN regexp_replace(x, 'čt$', 'ck') WHEN x LIKE '%št' THEN regexp_replace(x, 'št$', 'sk')"
        " WHEN regexp_matches(x, '[cč]$') THEN regexp_replace(x, '[cč]$', 'k') WHEN regexp_matches(x, '[zž]$') THEN regexp_replace(x, '[zž]$', 'h')"
        " WHEN regexp_matches(x, 'e.$') THEN regexp_replace(x, 'e(.)$', '\\1') WHEN regexp_matches(x, '.ů.$') THEN regexp_replace(x, 'ů(.)$', 'o\\1') ELSE x END",
        _folded("x"),
    ]
    out = f"list_filter(string_split_regex(lower(coalesce({value}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '' AND x NOT IN ({stop}))"
    for step in steps:
        out = f"list_transform({out}, lambda x: {step})"
    return out


def _stems() -> str:
    return f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_stems, md5(array_to_string(s, ' ')) AS stems_md5 FROM (SELECT doc_id, {_stem_list('text')} AS s FROM documents)"


def _clause(fields: str, words: str) -> str:
    """Tables up to sides(id, field, value): what all stems of the words, within their edits, score in a field; fields: SQL for (id, field, s)."""
    return f"""
        f AS ({fields}),
        l AS (SELECT id, field, s, len(s) AS size FROM f WHERE len(s) > 0),
        tf AS (SELECT id, field, term, count(*) AS n FROM (SELECT id, field, unnest(s) AS term FROM l) GROUP BY ALL),
        df AS (SELECT field, term, count(*) AS has FROM tf GROUP BY ALL),
        q AS (SELECT unnest({_stem_list(f"'{words}'")}) AS query),
        e AS (
            SELECT field, query, term, has, damerau_levenshtein(query, term) AS edits FROM q, df
            WHERE abs(length(query) - length(term)) <= 2
              AND damerau_levenshtein(query, term) <= CASE WHEN length(query) < 3 THEN 0 WHEN length(query) <= 5 THEN 1 ELSE 2 END),
        h AS (SELECT field, query, max(has) AS has FROM e GROUP BY ALL),
        m AS (SELECT field, CAST(count(*) AS DOUBLE) AS docs, sum(size) / CAST(count(*) AS DOUBLE) AS mean FROM l GROUP BY ALL),
        v AS (
            SELECT id, field, query, max((1 - edits / least(length(query), length(term)))
                   * ln(1 + (docs - h.has + 0.5::DOUBLE) / (h.has + 0.5::DOUBLE)) * n / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS value
            FROM tf JOIN e USING (field, term) JOIN h USING (field, query) JOIN l USING (id, field) JOIN m USING (field) GROUP BY ALL),
        sides AS (SELECT id, field, sum(value) AS value FROM v GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM q))"""


def _page(where: str = "TRUE", order: str = "sku", limit: int = 24, offset: int = 0) -> str:
    return f"WITH {PRODUCT} SELECT {HITS} FROM product WHERE visible AND {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"


def _all(where: str, columns: str = SCORED) -> str:
    return f"WITH {PRODUCT} SELECT {columns} FROM product WHERE visible AND {where}"


_hash = lambda salt: f"((id * 7919 + {salt} * 104729) % 100003)"

DRAINED = f"""
        WITH {PRODUCT}, {EVENTS}, {INDEX}, {PLAN}
        SELECT id, name, price, stock_quantity FROM idx WHERE id NOT IN (SELECT product_id FROM plan)
        UNION ALL SELECT product_id, name, price, stock_quantity FROM plan WHERE action <> 'delete'"""

ORACLE_SQL = {
    "replenishment_suggestions": f"""
        WITH {PRODUCT}, {SALES}, {STOCK}, t AS ({totals()}),
        m AS (
            SELECT t.store_number, sku, total / 28.0::DOUBLE AS average_daily_demand, total, total_squares,
                   coalesce(quantity_on_hand, 0) AS quantity_on_hand, coalesce(quantity_on_order, 0) AS quantity_on_order
            FROM t JOIN product ON product.id = t.product_id LEFT JOIN stock USING (store_number, product_id)),
        s AS (
            SELECT *, CAST(1.65 AS DOUBLE) * sqrt(CAST(14 AS DOUBLE)) * sqrt(greatest(CAST(0 AS DOUBLE),
                   (total_squares - total * average_daily_demand) / CAST(27 AS DOUBLE))) AS safety_stock FROM m),
        q AS (
            SELECT *, CAST(ceil(average_daily_demand * CAST(14 AS DOUBLE) + safety_stock - quantity_on_hand - quantity_on_order) AS BIGINT) AS order_quantity FROM s)
        SELECT store_number, sku, average_daily_demand, safety_stock, quantity_on_hand, quantity_on_order, order_quantity
        FROM q WHERE order_quantity > 0 ORDER BY store_number, sku""",
    "sales_window_totals": f"WITH {SALES} {totals()}",
    "last_sales_date": "SELECT max(CAST(l_shipdate AS DATE)) AS last_sales_date FROM lineitem",
    "sales_preconditions": f"WITH {SALES} SELECT bool_or(sales_date = DATE '2001-11-04') AS has_day, bool_or(sales_date <= DATE '2001-11-04' - 27) AS reaches_start FROM sales",
    "stock_driven_totals": f"""
        WITH {SALES}, {STOCK}
        SELECT k.store_number, k.product_id, CAST(sum(quantity) AS BIGINT) AS total, CAST(sum(quantity * quantity) AS BIGINT) AS total_squares
        FROM stock k LEFT JOIN sales s ON s.store_number = k.store_number AND s.product_id = k.product_id
             AND sales_date BETWEEN DATE '2001-11-04' - 27 AND DATE '2001-11-04' GROUP BY ALL""",
    "window_pair_count": f"WITH {SALES} SELECT count(*) AS pairs FROM ({totals()})",
    "rolling_28d_increment": f"WITH {SALES} {totals()}",
    "product_documents": f"""
        WITH {PRODUCT} SELECT id, sku, name, description, brand, l1 || '|' || l2 || '|' || slug_path AS category_paths, price,
        stock_quantity, ean, visible, updated_at AS product_updated_at FROM product""",
    "category_ancestors": f"""
        WITH {PRODUCT}, c AS (SELECT DISTINCT slug_path, l1, l2 FROM product)
        SELECT slug_path, l1 AS path, 1 AS level FROM c UNION ALL SELECT slug_path, l2, 2 FROM c UNION ALL SELECT slug_path, slug_path, 3 FROM c""",
    "search_all": _page(),
    "search_brand": _all("brand IN ('Brand#1', 'Brand#7')"),
    "search_category_subtree": _all("l2 = 'economy/ring'"),
    "search_availability": _all("stock_quantity = 0"),
    "search_price_range": _all("price BETWEEN 950 AND 1100"),
    "search_totals": f"""
        WITH {PRODUCT}, v AS (SELECT * FROM product WHERE visible)
        SELECT 'all' AS request, count(*) AS total FROM v UNION ALL SELECT 'brand', count(*) FROM v WHERE brand = 'Brand#7'
        UNION ALL SELECT 'category', count(*) FROM v WHERE l2 = 'economy/ring'
        UNION ALL SELECT 'in_stock', count(*) FROM v WHERE stock_quantity > 0
        UNION ALL SELECT 'price', count(*) FROM v WHERE price BETWEEN 950 AND 1100""",
    "search_sort_price_asc": _page(order="price, sku", limit=50),
    "search_sort_price_desc": _page(order="price DESC, sku", limit=50),
    "search_page_3": _page(limit=20, offset=40),
    "search_sku_prefix": _all("starts_with(lower(sku), 'prt-00000')", "id, sku, price, stock_quantity, 20.0::DOUBLE AS score"),
    "search_exact_codes": _all("(sku = 'PRT-0000007' OR ean = '8590000000091')", "id, sku, price, stock_quantity, 10.0::DOUBLE AS score"),
    "search_prefix_words": _all("list_contains(string_split(name, ' '), 'small') AND len(list_filter(string_split(name, ' '), lambda w: starts_with(w, 'wid'))) > 0", "id, sku, name"),
    "search_all_words": _all("list_has_all(string_split(name, ' '), ['ring', 'small'])", "id, sku, name"),
    "search_fuzzy": f"""
        WITH {PRODUCT} SELECT id, name FROM product
        WHERE len(list_filter(string_split(name, ' '), lambda w: damerau_levenshtein('wigdet', w) <= 2)) > 0
          AND len(list_filter(string_split(name, ' '), lambda w: damerau_levenshtein('colt', w) <= 1)) > 0""",
    "stem_analyzer": _stems(),
    "search_text": f"""
        WITH {PRODUCT}, {_clause(f"SELECT id, 'name' AS field, {_stem_list('name')} AS s FROM product UNION ALL SELECT id, 'description', {_stem_list('description')} FROM product", "smal widget")}
        SELECT id, sku, round(max(CASE field WHEN 'name' THEN 3 ELSE 1 END * value), 6) AS score
        FROM sides JOIN product USING (id) WHERE visible GROUP BY ALL""",
    "document_scores": f"""
        WITH {_clause(f"SELECT doc_id AS id, 'description' AS field, {_stem_list('text')} AS s FROM documents", DOCUMENT_WORDS)}
        SELECT id, round(value, 6) AS score FROM sides""",
    "fuzzy_terms": f"""
        WITH t AS (SELECT DISTINCT unnest({_stem_list('text')}) AS term FROM documents), q AS (SELECT unnest({TYPED}) AS query)
        SELECT query, term, CAST(damerau_levenshtein(query, term) AS INTEGER) AS edits FROM q, t
        WHERE abs(length(query) - length(term)) <= 2
          AND damerau_levenshtein(query, term) <= CASE WHEN length(query) < 3 THEN 0 WHEN length(query) <= 5 THEN 1 ELSE 2 END""",
    "text_index_terms": f"""
        WITH {PRODUCT}, f AS (
            SELECT id, 'name' AS field, unnest({_stem_list('name')}) AS term FROM product
            UNION ALL SELECT id, 'description', unnest({_stem_list('description')}) FROM product
            UNION ALL SELECT id, 'name.words', unnest(string_split(lower(name), ' ')) FROM product
            UNION ALL SELECT id, 'sku', lower(sku) FROM product UNION ALL SELECT id, 'ean', ean FROM product)
        SELECT field, term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM f GROUP BY ALL""",
    "highlights": f"""
        WITH {PRODUCT}, p AS (SELECT *, string_split(name, ' ') AS w FROM product),
        r AS (SELECT ln(1 + (count(*) - count(*) FILTER (list_contains(w, 'small')) + 0.5::DOUBLE) / (count(*) FILTER (list_contains(w, 'small')) + 0.5::DOUBLE)) AS rarity FROM p)
        SELECT sku, name, '{{"name":["<mark>small</mark> <mark>' || w[2] || '</mark>"],"description":["<mark>small</mark> ' || substr(description, 7) || '"]}}' AS highlight,
               round(1.5::DOUBLE * (rarity / 2.2::DOUBLE + 1), 6) AS score
        FROM p, r WHERE visible AND w[1] = 'small' AND starts_with(w[2], 'wid') ORDER BY sku LIMIT 100""",
    "facet_brand": f"WITH {PRODUCT} {_facet('brand', 'SELECT brand AS value FROM product WHERE visible')}",
    "facet_category_root": f"WITH {PRODUCT} {_facet('category', 'SELECT l1 AS value FROM product WHERE visible')}",
    "facet_category_child": f"WITH {PRODUCT} {_facet('category', 'SELECT l2 AS value FROM product WHERE visible AND l1 = ' + chr(39) + 'economy' + chr(39))}",
    "facet_availability": f"WITH {PRODUCT} {_availability('TRUE')}",
    "facets_single_scan": f"""
        WITH {PRODUCT}
        SELECT * FROM ({_facet("brand", "SELECT brand AS value FROM product WHERE visible AND price >= 900 AND l1 = 'economy' AND stock_quantity > 0")})
        UNION ALL
        SELECT * FROM ({_facet("category", "SELECT l2 AS value FROM product WHERE visible AND price >= 900 AND l1 = 'economy' AND brand IN ('Brand#1', 'Brand#2') AND stock_quantity > 0")})
        UNION ALL
        SELECT * FROM ({_availability("price >= 900 AND l1 = 'economy' AND brand IN ('Brand#1', 'Brand#2')")})""",
    "outbox_fold": f"WITH {EVENTS} {FOLD}",
    "outbox_stream": f"WITH {EVENTS} {FOLD}",
    "pending_batch": f"WITH {EVENTS} {FOLD} ORDER BY marked_at, product_id LIMIT 100",
    "queue_depth": f"WITH {EVENTS} SELECT index_name, count(*) AS pending FROM ({FOLD}) GROUP BY ALL",
    "outbox_release": f"""
        WITH {EVENTS}, o AS ({FOLD}), b AS (SELECT * FROM o ORDER BY marked_at, product_id LIMIT 100),
        again AS (SELECT * REPLACE (CASE WHEN product_id % 2 = 0 THEN marked_at + INTERVAL 5 MILLISECOND ELSE marked_at END AS marked_at) FROM o)
        SELECT a.* FROM again a ANTI JOIN b ON a.index_name = b.index_name AND a.product_id = b.product_id AND a.marked_at = b.marked_at""",
    "drain_plan_whole_queue": f"WITH {PRODUCT}, {EVENTS}, {INDEX}, {PLAN.replace('FROM o LEFT', 'FROM every o LEFT')} SELECT product_id, scope_mask, action, outcome, name, price FROM plan",
    "drain_plan": f"WITH {PRODUCT}, {EVENTS}, {INDEX}, {PLAN} SELECT product_id, scope_mask, action, outcome, name, price FROM plan",
    "drain_outcome_counts": f"""
        WITH {PRODUCT}, {EVENTS}, {INDEX}, {PLAN}
        SELECT count(*) FILTER (outcome IN ('created', 'updated')) AS written, count(*) FILTER (outcome = 'noop') AS unchanged,
               count(*) FILTER (outcome = 'deleted') AS deleted, 0::BIGINT AS conflicts, 0::BIGINT AS failures FROM plan""",
    "drained_index": DRAINED,
    "drained_store": DRAINED,
    "drain_outcome_counts_whole_queue": f"""
        WITH {PRODUCT}, {EVENTS}, {INDEX}, {PLAN.replace('FROM o LEFT', 'FROM every o LEFT')}
        SELECT count(*) FILTER (outcome IN ('created', 'updated')) AS written, count(*) FILTER (outcome = 'noop') AS unchanged,
               count(*) FILTER (outcome = 'deleted') AS deleted, 0::BIGINT AS conflicts, 0::BIGINT AS failures FROM plan""",
    "drained_index_whole_queue": DRAINED.replace('FROM o LEFT', 'FROM every o LEFT'),
    "feed_marks": f"""
        WITH {PRODUCT}
        SELECT 'products' AS index_name, id AS product_id, CASE WHEN {_hash(307)} % 50 = 0 THEN 4 ELSE 3 END AS scope_mask,
               CASE WHEN {_hash(307)} % 50 = 0 THEN 'delete' ELSE 'write' END AS operation, TIMESTAMP '2001-11-05' AS marked_at
        FROM product WHERE id IN (SELECT l_partkey FROM lineitem)""",
    "changed_since": f"WITH {PRODUCT}, {CHANGED} SELECT id FROM changed",
    "tombstone_catchup": f"WITH {PRODUCT}, {CHANGED} SELECT id FROM gone",
    "reindex_result": f"""
        WITH {PRODUCT}, {INDEX}, {CHANGED}
        SELECT id, name, price FROM idx WHERE id NOT IN (SELECT id FROM gone) AND id NOT IN (SELECT id FROM changed)
        UNION ALL SELECT id, name, price FROM product WHERE id IN (SELECT id FROM changed) AND id NOT IN (SELECT id FROM gone)""",
    "catch_up_deleted": f"WITH {PRODUCT}, {INDEX}, {CHANGED} SELECT count(*) AS deleted FROM idx WHERE id IN (SELECT id FROM gone)",
    "drift_ids": f"WITH {PRODUCT} SELECT p.id FROM product p WHERE {DRIFTED}",
    "drift_sample": f"""
        WITH {PRODUCT}, s AS (SELECT id FROM product ORDER BY updated_at DESC, id LIMIT 200)
        SELECT count(*) AS drifted FROM s p WHERE {DRIFTED}""",
    "surplus_documents": f"WITH {PRODUCT}, {INDEX} SELECT (SELECT count(*) FROM idx) - (SELECT count(*) FROM product) AS surplus",
    "recently_changed": f"WITH {PRODUCT} SELECT id, updated_at FROM product ORDER BY updated_at DESC, id LIMIT 50",
    "feed_apply": f"""
        WITH {PRODUCT}
        SELECT id, CASE WHEN {_hash(11)} % 100 < 15 THEN CAST(least(1999900, greatest(100, round(price_in_minor_units * (85 + {_hash(101)} % 31) / 100.0::DOUBLE))) AS INTEGER)
                        ELSE price_in_minor_units END AS price_in_minor_units,
               CASE WHEN {_hash(11)} % 100 < 15 THEN CAST({_hash(211)} % 400 AS INTEGER) ELSE stock_quantity END AS stock_quantity,
               CASE WHEN {_hash(11)} % 100 < 15 THEN TIMESTAMP '2001-11-05' ELSE updated_at END AS updated_at
        FROM product""",
}
