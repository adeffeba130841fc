"""Independent DuckDB SQL for the staging audits (see plans/audits.py)."""

_WORDS = """
words AS (SELECT w AS word FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS w
                                 FROM documents) WHERE w <> '')
"""
_LOADED = "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01')"
_CAT = "(SELECT * FROM part WHERE p_size <= 40)"

SQL = {
"normalize_customers": """
SELECT c_custkey, NULLIF(trim(c_name), '') AS c_name, c_nationkey, c_acctbal,
       NULLIF(lower(trim(c_mktsegment)), '') AS c_mktsegment
FROM customer""",
"zero_to_null": """
SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0) AS l_discount, NULLIF(l_tax, 0) AS l_tax
FROM lineitem""",
"duplicate_line_keys": """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
"duplicate_document_texts": """
WITH d AS (SELECT text, COUNT(*) AS n FROM documents GROUP BY text HAVING COUNT(*) > 1)
SELECT md5(text) AS text_md5, CAST(g.row_num AS INTEGER) AS row_num
FROM d, LATERAL (SELECT unnest(range(2, n + 1)) AS row_num) g""",
"dedup_documents": """
SELECT min(doc_id) AS doc_id, md5(text) AS text_md5, lang FROM documents GROUP BY text, lang""",
"dedup_keep_last_customer": """
SELECT customer_id, customer_unique_id, c_name FROM (
  SELECT c_custkey AS customer_id, lower(c_mktsegment) || '-' || CAST(c_nationkey AS VARCHAR)
           AS customer_unique_id, c_name,
         row_number() OVER (PARTITION BY lower(c_mktsegment) || '-' || CAST(c_nationkey AS VARCHAR)
                            ORDER BY c_custkey DESC) AS rn
  FROM customer) WHERE rn = 1""",
"dedup_reconcile": """
SELECT (SELECT COUNT(*) FROM customer) AS before_rows,
       (SELECT COUNT(DISTINCT lower(c_mktsegment) || '-' || CAST(c_nationkey AS VARCHAR)) FROM customer) AS after_rows,
       (SELECT COUNT(*) FROM customer) -
       (SELECT COUNT(DISTINCT lower(c_mktsegment) || '-' || CAST(c_nationkey AS VARCHAR)) FROM customer) AS removed_rows""",
"orphan_lines": f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey
FROM lineitem l LEFT JOIN {_LOADED} o ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderkey IS NULL""",
"orphan_lines_labelled": f"""
SELECT l.l_orderkey AS order_id, l.l_partkey AS product_id,
       CASE WHEN o.o_orderkey IS NULL THEN 'Missing Order'
            WHEN p.p_partkey IS NULL THEN 'Missing Product' END AS orphan_type
FROM lineitem l
LEFT JOIN {_LOADED} o ON l.l_orderkey = o.o_orderkey
LEFT JOIN {_CAT} p ON l.l_partkey = p.p_partkey
WHERE o.o_orderkey IS NULL OR p.p_partkey IS NULL""",
"missing_catalogue_parts": f"""
SELECT DISTINCT l_partkey AS product_id FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM {_CAT})""",
"complete_catalogue": f"""
SELECT p_partkey AS product_id, p_name AS product_label FROM {_CAT}
UNION ALL
SELECT DISTINCT l_partkey, CAST(l_partkey AS VARCHAR) FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM {_CAT})""",
"ship_before_order": """
SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate, o.o_orderdate, 'shipped_before_order' AS rule
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_shipdate < o.o_orderdate""",
"part_range_check": """
SELECT p_partkey, 'size_over_45' AS rule FROM part WHERE p_size > 45
UNION ALL SELECT p_partkey, 'price_over_1900' FROM part WHERE p_retailprice > 1900
UNION ALL SELECT p_partkey, 'size_not_positive' FROM part WHERE p_size <= 0""",
"inconsistent_line_flags": """
SELECT l_orderkey, COUNT(DISTINCT l_returnflag) AS n_l_returnflag,
       COUNT(DISTINCT l_linestatus) AS n_l_linestatus
FROM lineitem GROUP BY l_orderkey
HAVING COUNT(DISTINCT l_returnflag) > 1 OR COUNT(DISTINCT l_linestatus) > 1""",
"null_audit_catalogue": f"""
SELECT COUNT(*) AS total_rows,
       COUNT(*) FILTER (WHERE p.p_name IS NULL) AS missing_p_name,
       COUNT(*) FILTER (WHERE p.p_brand IS NULL) AS missing_p_brand,
       COUNT(*) FILTER (WHERE p.p_type IS NULL) AS missing_p_type
FROM lineitem l LEFT JOIN {_CAT} p ON l.l_partkey = p.p_partkey""",
"non_ascii_words": "WITH " + _WORDS + """
SELECT DISTINCT word FROM words WHERE regexp_matches(word, '[^\\x00-\\x7F]')""",
"digit_words": "WITH " + _WORDS + """
SELECT DISTINCT word FROM words WHERE regexp_matches(word, '[0-9]')""",
"customer_zip": """
SELECT c_custkey AS customer_id, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS customer_zip_code_prefix
FROM customer""",
"nation_centroid": """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip_code_prefix,
       CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / COUNT(c_acctbal) AS mean_acctbal,
       MAX(c_mktsegment) AS max_segment, MAX(c_name) AS max_name
FROM customer GROUP BY 1""",
"accent_fold_documents": """
SELECT doc_id, md5(lower(strip_accents(replace(replace(replace(translate(trim(text), 'ØøŁłĐđ', 'OoLlDd'), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')))) AS folded_md5,
       CAST(length(lower(strip_accents(replace(replace(replace(translate(trim(text), 'ØøŁłĐđ', 'OoLlDd'), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')))) AS INTEGER) AS folded_chars
FROM documents""",
"segment_histogram": """
SELECT c_mktsegment, COUNT(c_mktsegment) AS n FROM customer GROUP BY c_mktsegment""",
}

_SHOP_RAW = """
rc AS (
  SELECT ' ' || CAST(c.c_custkey AS VARCHAR) || ' ' AS customer_id,
         lower(c.c_mktsegment) || '-' || CAST(c.c_nationkey AS VARCHAR) AS customer_unique_id,
         c.c_nationkey AS customer_zip_code_prefix, n.n_name || ' ' AS customer_city,
         r.r_name AS customer_state
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
rp AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
         CASE WHEN p_size > 45 THEN ' ' ELSE lower(p_type) END AS product_category_name,
         p_size - 1 AS product_weight_g
  FROM part),
sp AS (
  SELECT trim(product_id) AS product_id, NULLIF(trim(product_category_name), '') AS product_category_name,
         NULLIF(product_weight_g, 0) AS product_weight_g FROM rp),
rt AS (SELECT DISTINCT lower(p_type) AS product_category_name, p_type AS product_category_name_english
       FROM part WHERE p_size <= 5)
"""

SQL.update({
"staging_customers": "WITH " + _SHOP_RAW + """
SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state FROM (
  SELECT trim(customer_id) AS customer_id, trim(customer_unique_id) AS customer_unique_id,
         customer_zip_code_prefix, trim(customer_city) AS customer_city,
         trim(customer_state) AS customer_state,
         row_number() OVER (PARTITION BY trim(customer_unique_id) ORDER BY trim(customer_id) DESC) AS rn
  FROM rc) WHERE rn = 1""",
"staging_products": "WITH " + _SHOP_RAW + "SELECT * FROM sp",
"staging_categories": "WITH " + _SHOP_RAW + """
SELECT trim(product_category_name) AS product_category_name,
       trim(product_category_name_english) AS product_category_name_english FROM rt
UNION ALL
SELECT DISTINCT product_category_name, product_category_name FROM sp
WHERE product_category_name IS NOT NULL
  AND product_category_name NOT IN (SELECT trim(product_category_name) FROM rt)""",
})
