"""The extended queries as plain SQL, to compare results with."""

from __future__ import annotations

from stratalake.plans.twins import FAULTY_SALES, NULLED_SALES, SILVER_SALES, VERSIONS

CORRECTED = """
corrected AS (
  SELECT * REPLACE (o_totalprice + CASE WHEN o_orderkey % 997 = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_totalprice)
  FROM orders WHERE o_orderkey % 997 <> 5
  UNION ALL
  SELECT * REPLACE (o_orderkey + 1000000000 AS o_orderkey) FROM orders WHERE o_orderkey % 997 = 11)"""

SAMPLED = ["txn_id", "category", "quantity", "payment_method"]
# The suite's checks: name, kind, severity, and which rows break them.
ROW_CHECKS = [
    ("txn_id_not_null", "not_null", "error", "txn_id IS NULL"),
    ("category_not_null", "not_null", "error", "category IS NULL"),
    ("quantity_positive", "positive", "error", "quantity <= 0"),
    ("unit_price_positive", "positive", "error", "unit_price <= 0"),
    ("payment_method_accepted_values", "accepted_values", "error", "payment_method NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"),
    ("quantity_min", "min", "error", "quantity < 2"),
    ("quantity_max", "max", "error", "quantity > 40"),
    ("positive_quantities", "rule", "error", "NOT (quantity > 0)"),
    ("positive_prices", "rule", "error", "NOT (unit_price > 0)"),
    ("valid_total", "rule", "error", "NOT (abs(total_amount - quantity * unit_price) <= 0.01)"),
    ("required_txn_id", "rule", "error", "txn_id IS NULL"),
    ("no_null_category", "rule", "warn", "category IS NULL"),
    ("few_null_ids", "rule", "error", "txn_id IS NULL"),
]


def _digest(names: list[str]) -> str:
    parts = [f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in names]
    return f"md5(concat_ws(',', {', '.join(parts)}))"


def _samples() -> str:
    broken = [
        f"SELECT {i} AS i, '{name}' AS \"check\", '{kind}' AS kind, '{severity}' AS severity, h, txn_id, category, quantity, payment_method FROM hashed WHERE {broken}"
        for i, (name, kind, severity, broken) in enumerate(ROW_CHECKS)
    ]
    places = f"""
    SELECT "check", kind, severity, CAST(row_number() OVER (PARTITION BY i ORDER BY h) AS INTEGER) AS position, CAST(NULL AS BIGINT) AS occurrences,
           r.txn_id AS txn_id, r.category AS category, CAST(r.quantity AS VARCHAR) AS quantity, r.payment_method AS payment_method
    FROM (SELECT i, "check", kind, severity, min(h) AS h,
                 arg_min(struct_pack(txn_id := txn_id, category := category, quantity := quantity, payment_method := payment_method), h) AS r
          FROM ({" UNION ALL ".join(broken)}) GROUP BY i, "check", kind, severity, right(h, 4))"""
    unique = [
        f"""
    SELECT 'txn_id_unique', 'unique', '{severity}', CAST(row_number() OVER (ORDER BY h) AS INTEGER) AS position, n, txn_id, NULL, NULL, NULL
    FROM (SELECT txn_id, {_digest(["txn_id"])} AS h, count(*) AS n FROM faulty {where} GROUP BY txn_id HAVING count(*) > 1)"""
        for severity, where in (("error", "WHERE txn_id IS NOT NULL"), ("warn", ""))
    ]
    hashed = f"hashed AS (SELECT *, {_digest(SAMPLED)} AS h FROM faulty)"
    return f"WITH {FAULTY_SALES}, {hashed} SELECT * FROM ({places} UNION ALL {' UNION ALL '.join(unique)}) WHERE position <= 5"


def _quantiles(source: str, columns: list[str], shares: list[float]) -> str:
    one = """
    SELECT '{c}' AS "column", CAST({s} AS DOUBLE) AS share, CAST(min(v) AS DOUBLE) AS value
    FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n FROM {source} WHERE {c} IS NOT NULL)
    WHERE rn >= {s} * n - 1e-9"""
    return " UNION ALL ".join(one.format(c=c, s=s, source=source) for c in columns for s in shares)


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

#: The fields of every product version as rows, by the rule that makes its schema.
TREES = f"""
{VERSIONS},
v AS (SELECT product_name, version, code, code // 1000000 AS major, code // 1000 % 1000 AS minor, code % 1000 AS patch FROM parsed),
tree AS (
  SELECT product_name, version, 'id' AS path, CASE WHEN major = 1 THEN 'integer' ELSE 'long' END AS type, false AS nullable FROM v
  UNION ALL SELECT product_name, version, 'price', CASE WHEN minor % 2 = 0 THEN 'decimal(10,2)' ELSE 'decimal(12,2)' END, true FROM v
  UNION ALL SELECT product_name, version, 'place', 'struct', true FROM v
  UNION ALL SELECT product_name, version, 'place.city', 'string', true FROM v
  UNION ALL SELECT product_name, version, 'place.zone', CASE WHEN patch % 2 = 0 THEN 'integer' ELSE 'long' END, true FROM v
  UNION ALL SELECT product_name, version, 'tags', 'array', true FROM v
  UNION ALL SELECT product_name, version, 'tags.element', CASE WHEN minor % 3 = 0 THEN 'integer' ELSE 'string' END, true FROM v
  UNION ALL SELECT product_name, version, concat('extra_', patch % 3), 'double', patch > 1 FROM v),
pairs AS (SELECT * FROM (SELECT product_name, version, code, lag(version) OVER w AS previous, lag(code) OVER w AS previous_code
    FROM v WINDOW w AS (PARTITION BY product_name ORDER BY code)) WHERE previous IS NOT NULL),
both_sides AS (
  SELECT p.product_name, p.version, p.previous, coalesce(o.path, n.path) AS path, o.type AS old_type, n.type AS new_type,
         o.nullable AS old_null, n.nullable AS new_null
  FROM pairs p, LATERAL (SELECT DISTINCT path FROM tree t WHERE t.product_name = p.product_name AND t.version IN (p.version, p.previous)) paths
  LEFT JOIN tree o ON o.product_name = p.product_name AND o.version = p.previous AND o.path = paths.path
  LEFT JOIN tree n ON n.product_name = p.product_name AND n.version = p.version AND n.path = paths.path),
wide(a, b) AS (VALUES ('integer', 'long'), ('decimal(10,2)', 'decimal(12,2)')),
changes AS (SELECT * FROM (
  SELECT *, CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed'
                 WHEN old_type <> new_type AND (old_type, new_type) IN (SELECT (a, b) FROM wide) THEN 'widened'
                 WHEN old_type <> new_type AND (new_type, old_type) IN (SELECT (a, b) FROM wide) THEN 'narrowed'
                 WHEN old_type <> new_type THEN 'retyped' WHEN NOT old_null AND new_null THEN 'loosened'
                 WHEN old_null AND NOT new_null THEN 'tightened' END AS change FROM both_sides) WHERE change IS NOT NULL),
levels AS (SELECT *, CASE WHEN change IN ('added', 'widened', 'loosened') THEN 'minor' WHEN change = 'tightened' THEN 'patch' ELSE 'major' END AS level FROM changes)"""

MONTHLY = f"""
WITH {SILVER_SALES}
SELECT store_id, CAST(date_trunc('month', _date) AS DATE) AS month, count(DISTINCT customer_id) AS customers, true AS within
FROM sales GROUP BY 1, 2"""

#: Product versions come with a lateral join that DuckDB plans best over few rows.
TWINS: dict[str, str] = {
    "checksum_diff": f"""
WITH {CORRECTED}
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
       CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
            WHEN a.o_totalprice <> b.o_totalprice THEN 'changed' ELSE 'unchanged' END AS status
FROM orders a FULL JOIN corrected b ON a.o_orderkey = b.o_orderkey""",
    "checksum_nodes": "SELECT * FROM (VALUES ('copy', true, true), ('corrected', false, false)) t(\"table\", equal, root_equal)",
    "bucketed_upsert": """
WITH added AS (SELECT * REPLACE (l_orderkey + 1000000000 AS l_orderkey) FROM lineitem WHERE l_orderkey < 5),
last AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
           l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn
         FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM added)),
rows AS (SELECT * EXCLUDE (rn) REPLACE (CASE WHEN l_orderkey < 10 THEN 'X' ELSE l_linestatus END AS l_linestatus) FROM last WHERE rn = 1)
SELECT *, (SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM added) AS inserted,
       (SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem WHERE l_orderkey < 10) AS updated, true AS in_part
FROM rows""",
    "rebucketed_table": """
SELECT * REPLACE (CASE WHEN o_orderkey < 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus), CAST(16 AS BIGINT) AS buckets FROM orders
UNION ALL SELECT * REPLACE (o_orderkey + 1000000000 AS o_orderkey), 16 FROM orders WHERE o_orderkey < 50""",
    "clustered_table": "SELECT *, true AS skips_by_date, true AS skips_by_price FROM lineitem",
    "monthly_distinct_customers": MONTHLY,
    "mode_by_candidates": f"""
WITH {SILVER_SALES}
SELECT store_id, category AS top_category FROM (
  SELECT store_id, category, row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, category) AS rn
  FROM sales WHERE category IS NOT NULL GROUP BY store_id, category) WHERE rn = 1""",
    "mode_of_many_values": """
SELECT l_returnflag, l_partkey AS top_part FROM (
  SELECT l_returnflag, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_partkey) AS rn
  FROM lineitem GROUP BY l_returnflag, l_partkey) WHERE rn = 1""",
    "failing_samples": _samples(),
    "failing_first_rows": f"WITH {FAULTY_SALES} SELECT txn_id, quantity FROM faulty WHERE quantity <= 0 ORDER BY txn_id NULLS FIRST LIMIT 20",
    "table_quantiles": _quantiles("lineitem", NUMBERS, [0.25, 0.5, 0.75]),
    "money_quantiles": f"""
WITH {NULLED_SALES}, t AS (SELECT CASE WHEN category IS NOT NULL THEN unit_price END AS unit_price, -quantity AS returned FROM nulled)
{_quantiles("t", ["unit_price", "returned"], [0.1, 0.9, 1.0])}""",
    "sketched_quantiles": "SELECT CAST(share AS DOUBLE) AS share, true AS near FROM (VALUES (0.25), (0.5), (0.75)) t(share)",
    "schema_changes": f"WITH {TREES} SELECT product_name, version, previous, path, old_type, new_type, change, level FROM levels",
    "schema_steps": f"""
WITH {TREES},
needed AS (SELECT product_name, version, max(CASE level WHEN 'major' THEN 3 WHEN 'minor' THEN 2 ELSE 1 END) AS needed, count(*) AS n FROM levels GROUP BY ALL),
declared AS (SELECT *, CASE WHEN code // 1000000 <> previous_code // 1000000 THEN 3 WHEN code // 1000 <> previous_code // 1000 THEN 2 ELSE 1 END AS d FROM pairs)
SELECT d.product_name, d.version, previous, ['none', 'patch', 'minor', 'major'][d + 1] AS declared,
       ['none', 'patch', 'minor', 'major'][coalesce(needed, 0) + 1] AS needed, coalesce(n, 0) AS changes, d >= coalesce(needed, 0) AS honest
FROM declared d LEFT JOIN needed USING (product_name, version)""",
    "widened_table": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 5000000000 ELSE o_custkey END AS o_custkey FROM orders",
    "parsed_large_files": "SELECT page_id, url, html, true AS placed FROM pages",
    "parsed_large_stream": "SELECT page_id, url, html FROM pages",
    "stream_first_per_key": """
WITH e AS (SELECT event_id, ts, user_id, event_type, ts <= TIMESTAMP '2024-01-10 00:00:00' AS early FROM events)
SELECT event_id, ts, user_id, event_type, 'first' AS kind FROM e WHERE NOT (early AND event_id % 7 = 0)
UNION ALL SELECT event_id, ts, user_id, event_type, 'late' FROM e WHERE early AND (event_id % 7 = 0 OR event_id % 11 = 0)""",
    "stream_silence": """
WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events WHERE ts IS NOT NULL)
SELECT user_id, ts AS last_seen, ts + INTERVAL 2 DAY AS silent_from FROM g
WHERE coalesce(next, (SELECT max(ts) - INTERVAL 6 HOUR FROM events)) > ts + INTERVAL 2 DAY""",
    "appended_stream": "SELECT event_id, user_id, event_type FROM events",
    "bucketed_stream_upsert": """
SELECT event_id, ts, user_id FROM (SELECT event_id, ts, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""",
    "watermark_history": """
WITH c AS (SELECT event_id, ts, concat('column_', user_id % 10) AS "column", event_id % 11 = 0 AS is_reset FROM events WHERE event_type = 'click'),
last AS (SELECT "column", event_id, is_reset FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY ts DESC, event_id DESC) = 1),
jobs AS (SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS jobs FROM (
  SELECT event_type, event_id % 11 = 0 AS is_reset FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY ts DESC, event_id DESC) = 1) WHERE NOT is_reset)
SELECT c."column", ts AS updated_at, c.event_id AS value, CASE WHEN NOT last.is_reset AND c."column" <> 'column_3' THEN last.event_id END AS current, jobs
FROM c JOIN last USING ("column"), jobs""",
    "hashed_files": """
SELECT o_orderstatus, md5(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey) || chr(10)) AS file_hash,
       CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS length
FROM orders GROUP BY o_orderstatus""",
    "filename_fields": """
SELECT o_orderkey AS order_id, o_custkey, 'part' AS prefix, o_orderstatus AS status, 'landing' AS _source, TIMESTAMP '2024-01-31 00:00:00' AS _ingested_at
FROM orders""",
    "contract_with_nulls": """
SELECT * FROM (VALUES ('l_orderkey', 'bigint', 'bigint', 'ok', CAST(0 AS BIGINT)), ('l_quantity', 'int', 'double', 'mistyped', 0),
  ('l_comment', 'string', NULL, 'missing', NULL), ('l_shipdate', NULL, 'timestamp_ntz', 'extra', 0)) t("column", declared, actual, status, nulls)
UNION ALL SELECT 'l_returnflag', 'string', 'string', 'nullable', count(*) FROM lineitem WHERE l_returnflag = 'A'""",
    "described_tables": " UNION ALL ".join(
        f"""
SELECT '{name}' AS name, (SELECT count(*) FROM {name}) AS row_count, {len(columns)} AS column_count, c AS "column", p AS position, t AS type
FROM (VALUES {", ".join(f"('{c}', {p}, '{t}')" for p, (c, t) in enumerate(columns))}) v(c, p, t)"""
        for name, columns in {
            "orders": [
                ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
                ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
            ],
            "lineitem": [
                ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
                ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                ("l_shipdate", "timestamp_ntz"),
            ],
            "events": [
                ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"),
                ("props", "string"),
            ],
        }.items()
    ),
}
