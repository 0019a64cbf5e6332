"""The queries of the catalogue as plain SQL, to compare results with.

Money is decimal and becomes double only in the output. Averages are rounded
half up from integers, as decimals are.
"""

from __future__ import annotations

RAW_SALES = """
raw_sales AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber) AS txn_id,
         CAST(l_suppkey AS VARCHAR) AS store_id,
         CAST(l_partkey AS VARCHAR) AS product_id,
         p_name AS product_name, p_type AS category,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price,
         o_orderpriority AS payment_method,
         CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
         o_orderdate AS transaction_time, l_shipdate AS _ingested_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

SILVER_SALES = (
    RAW_SALES
    + """,
sales AS (
  SELECT txn_id, store_id, product_id, upper(product_name) AS product_name, upper(category) AS category,
         quantity, unit_price, CAST(round(quantity * unit_price, 2) AS DECIMAL(18,2)) AS total_amount,
         upper(payment_method) AS payment_method, customer_id, transaction_time,
         CAST(transaction_time AS DATE) AS _date, _ingested_at
  FROM raw_sales WHERE quantity > 0 AND unit_price > 0 AND txn_id IS NOT NULL)"""
)

SILVER_EVENTS = """
raw_events AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
         concat_ws('-', user_id, CAST(ts AS DATE)) AS session_id,
         CASE WHEN event_type = 'view' THEN 'pageview' ELSE event_type END AS event_type,
         concat('/p', user_id % 7) AS page_url,
         CASE WHEN event_id % 3 <> 0 THEN concat('/p', event_id % 5) END AS referrer,
         ts AS "timestamp",
         CASE user_id % 3 WHEN 0 THEN 'Desktop' WHEN 1 THEN 'Mobile' ELSE 'Tablet' END AS device,
         CASE event_id % 4 WHEN 0 THEN 'chrome' WHEN 1 THEN 'firefox' WHEN 2 THEN 'safari' ELSE 'edge' END AS browser,
         CASE user_id % 8 WHEN 0 THEN 'us' WHEN 1 THEN 'gb' WHEN 2 THEN 'de' WHEN 3 THEN 'fr'
                          WHEN 4 THEN 'ca' WHEN 5 THEN 'jp' WHEN 6 THEN 'br' ELSE 'in' END AS country,
         CAST(value AS DECIMAL(12,2)) AS session_duration_sec, ts AS _ingested_at
  FROM events),
ev AS (
  SELECT event_id, user_id, session_id, upper(event_type) AS event_type, page_url, referrer,
         "timestamp" AS event_timestamp, CAST("timestamp" AS DATE) AS _date, lower(device) AS device, browser,
         upper(country) AS country, session_duration_sec, _ingested_at
  FROM raw_events
  WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND "timestamp" <= TIMESTAMP '2024-01-31 00:00:00')"""

NULLED_SALES = (
    RAW_SALES
    + """,
nulled AS (
  SELECT * REPLACE (CASE WHEN CAST(product_id AS BIGINT) % 10 <> 3 THEN category END AS category,
                    CASE WHEN CAST(product_id AS BIGINT) % 7 <> 0 THEN payment_method END AS payment_method)
  FROM raw_sales)"""
)

FAULTY_SALES = (
    SILVER_SALES
    + """,
faulty AS (
  SELECT CASE WHEN CAST(split_part(txn_id, '-', 1) AS BIGINT) % 200 <> 7 THEN txn_id END AS txn_id,
         CASE WHEN CAST(product_id AS BIGINT) % 10 <> 3 THEN category END AS category,
         CASE WHEN CAST(product_id AS BIGINT) % 97 = 0 THEN 0 WHEN CAST(product_id AS BIGINT) % 97 = 1 THEN -1
              ELSE quantity END AS quantity,
         unit_price,
         CAST(total_amount + CASE WHEN CAST(split_part(txn_id, '-', 1) AS BIGINT) % 50 = 0 THEN 1 ELSE 0 END
              AS DECIMAL(18,2)) AS total_amount,
         payment_method
  FROM sales)"""
)

EDITED_ORDERS = """
edited AS (
  SELECT * REPLACE (o_totalprice + CASE WHEN o_orderkey % 50 = 0 THEN CAST(1.0 AS DOUBLE)
                                        WHEN o_orderkey % 3 = 0 THEN CAST(0.005 AS DOUBLE)
                                        ELSE CAST(0.0 AS DOUBLE) END AS o_totalprice)
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT * REPLACE (o_orderkey + 1000000000 AS o_orderkey) FROM orders WHERE o_orderkey % 89 = 0)"""

LANDING = """
landing AS (
  SELECT concat('landing/', source, '/', doc_id, '.txt') AS file_path, md5(text) AS file_hash FROM documents),
registry AS (
  SELECT concat('landing/', source, '/', doc_id, '.txt') AS file_path,
         CASE WHEN doc_id % 5 = 0 THEN 'changed since' ELSE md5(text) END AS file_hash,
         concat('bronze.', lang) AS target_table, n_chars AS rows_ingested,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ingested_at,
         CASE doc_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'success' END AS status
  FROM documents)"""

PRODUCTS = """
products AS (
  SELECT lower(replace(p_brand, '#', '-')) AS name, concat('team-', min(p_partkey) % 5) AS owner_workspace,
         concat('Parts of ', min(p_brand)) AS description, [lower(min(p_type)), lower(max(p_name))] AS tags,
         CAST(count(*) % 48 + 12 AS INTEGER) AS sla_freshness_hours, min(p_partkey) % 7 = 3 AS is_deprecated
  FROM part GROUP BY 1)"""

VERSIONS = """
versions AS (
  SELECT lower(replace(p_brand, '#', '-')) AS product_name,
         concat_ws('.', p_partkey % 3 + 1, p_size, p_partkey % 5) AS version, count(*) AS row_count,
         max(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey % 700 * 60)) AS published_at
  FROM part GROUP BY 1, 2),
parsed AS (
  SELECT *, CAST(split_part(version, '.', 1) AS BIGINT) * 1000000 + CAST(split_part(version, '.', 2) AS BIGINT) * 1000
            + CAST(split_part(version, '.', 3) AS BIGINT) AS code
  FROM versions),
latest AS (
  SELECT product_name, version, row_count, published_at
  FROM (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY code DESC) AS rn FROM parsed) WHERE rn = 1)"""

ACCESS = """
rule_events AS (
  SELECT product_name,
         CASE WHEN p_partkey % 211 = 0 THEN '*'
              WHEN p_partkey % 3 = 0 THEN concat(segment, '-', (p_partkey // 5) % 3, '*')
              WHEN p_partkey % 31 = 1 THEN concat(segment[1:4], '*')
              ELSE concat(segment, '-', (p_partkey // 5) % 25) END AS workspace_pattern,
         CASE p_size % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'admin' END AS access_level,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey) AS granted_at, 'system' AS granted_by,
         p_size > 12 AS is_revoked
  FROM (SELECT *, lower(replace(p_brand, '#', '-')) AS product_name,
               CASE p_partkey % 5 WHEN 0 THEN 'automobile' WHEN 1 THEN 'building' WHEN 2 THEN 'furniture'
                                  WHEN 3 THEN 'machinery' ELSE 'household' END AS segment FROM part)),
rules AS (
  SELECT product_name, workspace_pattern, access_level, granted_at, granted_by
  FROM (SELECT *, row_number() OVER (PARTITION BY product_name, workspace_pattern ORDER BY granted_at DESC) AS rn
        FROM rule_events) WHERE rn = 1 AND NOT is_revoked),
ranked AS (
  SELECT *, CASE access_level WHEN 'read' THEN 1 WHEN 'write' THEN 2 ELSE 3 END AS rank FROM rules)"""


def _matches(workspace: str) -> str:
    return (
        f"CASE WHEN workspace_pattern LIKE '%*' THEN starts_with({workspace}, "
        f"workspace_pattern[1:length(workspace_pattern) - 1]) ELSE workspace_pattern = {workspace} END"
    )


def _levels_for(workspace: str) -> str:
    return (
        ACCESS
        + f""",
levels AS (SELECT product_name, max(rank) AS rank FROM ranked WHERE {_matches(f"'{workspace}'")} GROUP BY 1)"""
    )


SUBSCRIPTIONS = """
asked AS (
  SELECT *, concat_ws('.', c_custkey % 3 + 1, (c_custkey // 10) % 50 + 1, (c_custkey // 7) % 5) AS full_version,
         c_custkey % 3 + 1 AS a, (c_custkey // 10) % 50 + 1 AS b, (c_custkey // 7) % 5 AS c FROM customer),
subscription_events AS (
  SELECT concat('brand-', c_custkey % 25 + 1) AS product_name,
         concat(lower(c_mktsegment), '-', c_nationkey) AS consumer_workspace,
         CASE c_custkey % 10 WHEN 0 THEN 'latest' WHEN 1 THEN full_version WHEN 2 THEN concat('^', full_version)
              WHEN 3 THEN concat('~', full_version) WHEN 4 THEN concat(a, '.x') WHEN 5 THEN concat(a, '.', b, '.x')
              WHEN 6 THEN concat('>=', full_version) WHEN 7 THEN concat('>', full_version)
              WHEN 8 THEN concat('<=', full_version) ELSE concat('<', full_version) END AS version_constraint,
         concat('p', c_custkey) AS local_alias,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey) AS subscribed_at, c_acctbal < 0 AS is_cancelled,
         c_custkey % 10 AS form, a * 1000000 + b * 1000 + c AS bound, a AS c_major, a * 1000 + b AS c_minor
  FROM asked),
subscriptions AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_name, consumer_workspace ORDER BY subscribed_at DESC) AS rn
                 FROM subscription_events) WHERE rn = 1 AND NOT is_cancelled)"""


def _resolved(source: str, columns: str) -> str:
    """Best version per row of ``source``, by trying every version of the product."""
    return f"""
WITH {VERSIONS}, {SUBSCRIPTIONS},
numbered AS (SELECT *, row_number() OVER () AS id FROM {source}),
matching AS (
  SELECT n.id, max(p.code) AS code
  FROM numbered n JOIN parsed p ON n.product_name = p.product_name
  WHERE CASE form WHEN 0 THEN true WHEN 1 THEN code = bound
                  WHEN 2 THEN code >= bound AND code // 1000000 = c_major
                  WHEN 3 THEN code >= bound AND code // 1000 = c_minor
                  WHEN 4 THEN code // 1000000 = c_major WHEN 5 THEN code // 1000 = c_minor
                  WHEN 6 THEN code >= bound WHEN 7 THEN code > bound
                  WHEN 8 THEN code <= bound ELSE code < bound END
  GROUP BY n.id)
SELECT {columns}, p.version AS resolved_version
FROM numbered n LEFT JOIN matching m ON n.id = m.id
LEFT JOIN parsed p ON p.product_name = n.product_name AND p.code = m.code"""


def _half_up(total: str, count: str, scale: int) -> str:
    """Rounded quotient of integers, half up: floor((2t + c) / 2c), with ``scale`` digits taken out of ``total``."""
    return f"CAST((2 * ({total}) + ({count})) // (2 * nullif({count}, 0)) AS DOUBLE) / {10**scale}"


LINE_ORDER = (
    "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, "
    "l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC"
)
LINE_COLUMNS = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)
MERGED = f"""
merged AS (
  SELECT {LINE_COLUMNS} FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                 ORDER BY CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END DESC, {LINE_ORDER}) AS rn
    FROM lineitem) WHERE rn = 1)"""

MONEY = "CAST(CAST(sum(CAST({} AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS DOUBLE)"


def _check_rows(source: str, checks: list[tuple[str, str]]) -> str:
    rows = [
        f"SELECT '{name}' AS \"check\", CAST(count(*) FILTER (WHERE {broken}) AS BIGINT) AS violations, count(*) AS total FROM {source}"
        for name, broken in checks
    ]
    return " UNION ALL ".join(rows)


def _with_status(rows: str, severity: str = "failed") -> str:
    return f"SELECT *, CASE WHEN violations = 0 THEN 'passed' ELSE '{severity}' END AS status FROM ({rows})"


DIFFERENCE = "abs(total_amount - quantity * unit_price)"
UNIQUE_KNOWN = 'SELECT \'txn_id_unique\' AS "check", count(txn_id) - count(DISTINCT txn_id) AS violations, count(*) AS total FROM faulty'
COLUMN_CHECKS = {
    "ct_not_null": _check_rows("faulty", [("txn_id_not_null", "txn_id IS NULL"), ("category_not_null", "category IS NULL")]),
    "ct_unique": UNIQUE_KNOWN,
    "ct_positive": _check_rows("faulty", [("quantity_positive", "quantity <= 0"), ("unit_price_positive", "unit_price <= 0")]),
    "ct_accepted_values": _check_rows(
        "faulty", [("payment_method_accepted_values", "payment_method NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")]
    ),
    "ct_min_max": _check_rows("faulty", [("quantity_min", "quantity < 2"), ("quantity_max", "quantity > 40")]),
}
RULES = _check_rows(
    "faulty",
    [
        ("positive_quantities", "NOT (quantity > 0)"),
        ("positive_prices", "NOT (unit_price > 0)"),
        ("valid_total", f"NOT ({DIFFERENCE} <= 0.01)"),
        ("required_txn_id", "NOT (txn_id IS NOT NULL)"),
    ],
)
SUITE = " UNION ALL ".join(
    [f"SELECT *, 'error' AS severity, CAST(0 AS DOUBLE) AS tolerance FROM ({rows})" for rows in COLUMN_CHECKS.values()]
    + [
        f"SELECT *, 'error' AS severity, CASE \"check\" WHEN 'valid_total' THEN 0.01 ELSE 0 END AS tolerance FROM ({RULES})",
        f"SELECT *, 'warn', 0 FROM ({_check_rows('faulty', [('no_null_category', 'category IS NULL')])})",
        f"SELECT *, 'error', 0.01 FROM ({_check_rows('faulty', [('few_null_ids', 'txn_id IS NULL')])})",
        """SELECT 'txn_id_unique', CAST(sum(n - 1) AS BIGINT), CAST(sum(n) AS BIGINT), 'warn', 0
           FROM (SELECT count(*) AS n FROM faulty GROUP BY txn_id)""",
        "SELECT 'not_empty', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END, count(*), 'error', 0 FROM faulty",
    ]
)


def _by_column(source: str, columns: list[str], fields: str) -> str:
    """One SELECT per column, ``{c}`` standing for it."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {fields.format(c=c)} FROM {source}" for c in columns)


SALES_COLUMNS = [
    "txn_id", "store_id", "product_id", "product_name", "category", "quantity", "unit_price",
    "payment_method", "customer_id", "transaction_time", "_ingested_at",
]

TWINS: dict[str, str] = {
    "scan_project_filter": """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'""",
    "partitioned_roundtrip": f"""
SELECT l_linestatus, count(*) AS n, {MONEY.format("l_extendedprice")} AS total
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""",
    "table_filter": "SELECT * FROM events WHERE event_type = 'click' AND value > 10",
    "table_count": "SELECT count(*) AS n FROM events",
    "table_category_agg": f"""
SELECT event_type, count(*) AS n, {MONEY.format("value")} AS total,
       {_half_up("CAST(sum(CAST(value AS DECIMAL(18,2))) * 100 AS HUGEINT) * 10000", "count(*)", 6)} AS average
FROM events GROUP BY 1""",
    "append_union": """
SELECT event_id, ts, user_id, event_type, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'old' ELSE 'new' END AS part
FROM events""",
    "dedup_keep_last": f"""
SELECT {LINE_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) AS rn FROM lineitem)
WHERE rn = 1""",
    "merge_upsert": f"WITH {MERGED} SELECT * FROM merged",
    "merge_upsert_unique": f"WITH {MERGED} SELECT * FROM merged",
    "merge_stats": """
WITH batch AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 3 = 0),
existing AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 3 <> 0)
SELECT (SELECT count(*) FROM batch b ANTI JOIN existing e USING (l_orderkey, l_linenumber)) AS inserted,
       (SELECT count(*) FROM batch b SEMI JOIN existing e USING (l_orderkey, l_linenumber)) AS updated""",
    "incremental_merge": f"""
WITH {MERGED} SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS n, {MONEY.format("l_extendedprice")} AS total
FROM merged GROUP BY 1""",
    "incremental_filter": "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'",
    "incremental_filter_id": "SELECT * FROM events WHERE event_id > 5000",
    "incremental_filter_compound": """
SELECT * FROM events WHERE event_type > 'error' OR (event_type = 'error' AND ts > TIMESTAMP '2024-01-15 00:00:00')""",
    "incremental_lookback": "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 2 DAY",
    "incremental_silver_events": f"WITH {SILVER_EVENTS} SELECT * REPLACE (CAST(session_duration_sec AS DOUBLE) AS session_duration_sec) FROM ev",
    "watermark_value": "SELECT event_type, max(ts) AS newest, min(ts) AS oldest FROM events GROUP BY 1",
    "watermark_state_latest": """
SELECT event_type AS pipeline, concat('column_', user_id % 10) AS "column",
       CAST(arg_max(event_id, ts) AS VARCHAR) AS value, 'bigint' AS value_type, max(ts) AS updated_at,
       arg_max(user_id, ts) AS row_count
FROM events GROUP BY 1, 2 HAVING arg_max(event_id, ts) % 11 <> 0""",
    "retention_filter": """
SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= DATE '2001-11-04' - INTERVAL 365 DAY""",
    "files_pending": f"""
WITH {LANDING} SELECT * FROM landing l
WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.file_path = l.file_path AND r.file_hash = l.file_hash AND status = 'success')""",
    "files_pending_by_path": f"""
WITH {LANDING} SELECT * FROM landing l
WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.file_path = l.file_path AND status = 'success')""",
    "ingestion_history": f"WITH {LANDING} SELECT * FROM registry WHERE target_table = 'bronze.en' ORDER BY ingested_at DESC, file_path",
    "silver_sales": f"""
WITH {SILVER_SALES} SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price, CAST(total_amount AS DOUBLE) AS total_amount)
FROM sales""",
    "silver_events": f"WITH {SILVER_EVENTS} SELECT * REPLACE (CAST(session_duration_sec AS DOUBLE) AS session_duration_sec) FROM ev",
    "silver_orders": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date, o_totalprice AS total_amount
FROM orders WHERE o_totalprice > 0""",
    "silver_sales_enriched": f"""
WITH {RAW_SALES}
SELECT s.txn_id, s.store_id, s.product_id, s.quantity, s.customer_id, s.transaction_time,
       p.p_name AS product_name, p.p_type AS category, c.c_name AS customer_name
FROM raw_sales s LEFT JOIN part p ON s.product_id = CAST(p.p_partkey AS VARCHAR)
LEFT JOIN customer c ON s.customer_id = CAST(c.c_custkey AS VARCHAR)""",
    "gold_daily_sales": f"""
WITH {SILVER_SALES},
top AS (
  SELECT _date, store_id, category,
         row_number() OVER (PARTITION BY _date, store_id ORDER BY count(*) DESC, category) AS rn
  FROM sales WHERE category IS NOT NULL GROUP BY 1, 2, 3),
base AS (
  SELECT _date, store_id, count(*) AS total_transactions, CAST(sum(quantity) AS BIGINT) AS total_items_sold,
         CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
         {_half_up("CAST(sum(total_amount) * 100 AS HUGEINT)", "count(total_amount)", 2)} AS avg_transaction_value,
         count(DISTINCT customer_id) AS unique_customers, count(DISTINCT product_id) AS unique_products
  FROM sales GROUP BY 1, 2)
SELECT base._date AS sale_date, base.store_id, total_transactions, total_items_sold, total_revenue,
       avg_transaction_value, unique_customers, unique_products, top.category AS top_category
FROM base LEFT JOIN top ON base._date = top._date AND base.store_id = top.store_id AND rn = 1
ORDER BY sale_date DESC, total_revenue DESC""",
    "gold_device_metrics": f"""
WITH {SILVER_EVENTS},
top AS (
  SELECT device, browser, row_number() OVER (PARTITION BY device ORDER BY count(*) DESC, browser) AS rn
  FROM ev GROUP BY 1, 2),
base AS (
  SELECT device, count(*) AS total_events, count(DISTINCT user_id) AS unique_users,
         count(DISTINCT session_id) AS unique_sessions, count(*) FILTER (WHERE event_type = 'PURCHASE') AS purchases,
         {_half_up("10000 * count(*) FILTER (WHERE event_type = 'PURCHASE')", "count(*)", 2)} AS conversion_rate,
         {_half_up("CAST(sum(session_duration_sec) * 10 * 100 AS HUGEINT)", "100 * count(session_duration_sec)", 1)}
           AS avg_session_duration,
         count(DISTINCT country) AS countries_reached
  FROM ev GROUP BY 1)
SELECT base.*, browser AS top_browser FROM base LEFT JOIN top ON base.device = top.device AND rn = 1
ORDER BY total_events DESC""",
    "gold_page_metrics": f"""
WITH {SILVER_EVENTS}
SELECT page_url, count(*) AS total_events, count(DISTINCT user_id) AS unique_users,
       count(DISTINCT session_id) AS unique_sessions,
       count(*) FILTER (WHERE event_type = 'PAGEVIEW') AS pageviews,
       count(*) FILTER (WHERE event_type = 'CLICK') AS clicks,
       count(*) FILTER (WHERE event_type = 'PURCHASE') AS purchases,
       {_half_up("CAST(sum(session_duration_sec) * 10 * 100 AS HUGEINT)", "100 * count(session_duration_sec)", 1)}
         AS avg_session_duration,
       {_half_up("10000 * count(*) FILTER (WHERE event_type = 'PURCHASE')", "count(*) FILTER (WHERE event_type = 'PAGEVIEW')", 2)}
         AS conversion_rate,
       min(_date) AS first_event_date, max(_date) AS last_event_date
FROM ev GROUP BY 1 ORDER BY total_events DESC""",
    "docs_daily_sales": f"""
WITH {SILVER_SALES}
SELECT CAST(transaction_time AS DATE) AS date, product_id, count(*) AS num_transactions,
       CAST(sum(quantity) AS BIGINT) AS total_quantity, CAST(sum(total_amount) AS DOUBLE) AS revenue
FROM sales GROUP BY 1, 2""",
    "product_rollup": f"""
WITH {SILVER_SALES} SELECT product_name, CAST(sum(quantity) AS BIGINT) AS total_quantity FROM sales GROUP BY 1""",
    "mode_top_category": f"""
WITH {SILVER_SALES} SELECT store_id, category AS top_category FROM (
  SELECT store_id, category, row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, category) AS rn
  FROM sales GROUP BY 1, 2) WHERE rn = 1""",
    "exec_dashboard": f"""
WITH {SILVER_SALES},
revenue AS (SELECT _date AS sale_date, store_id, CAST(sum(total_amount) AS DOUBLE) AS total_revenue FROM sales GROUP BY 1, 2),
stock AS (SELECT CAST(s_suppkey AS VARCHAR) AS store_id, CAST(floor(s_acctbal) AS INTEGER) AS stock_level
          FROM supplier WHERE s_acctbal > 0)
SELECT sale_date, r.store_id, total_revenue, stock_level FROM revenue r LEFT JOIN stock i ON r.store_id = i.store_id""",
    "join_inner": """
SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, p_name, p_type, l_extendedprice
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "predicate_suite": " UNION ALL ".join(
        f"SELECT '{name}' AS predicate, count(*) AS n FROM {source} WHERE {predicate}"
        for name, source, predicate in [
            ("equal", "orders", "o_orderstatus = 'F'"),
            ("not_equal", "orders", "o_orderstatus != 'F'"),
            ("less", "orders", "o_totalprice < 100000"),
            ("less_equal", "orders", "o_orderdate <= TIMESTAMP '1996-06-30 00:00:00'"),
            ("greater", "orders", "o_totalprice > 250000"),
            ("greater_equal", "orders", "o_custkey >= 100"),
            ("is_null", "orders", "nullif(o_custkey % 10, 0) IS NULL"),
            ("is_not_null", "orders", "nullif(o_custkey % 10, 0) IS NOT NULL"),
            ("and_or", "orders", "(o_orderstatus = 'O' AND o_totalprice > 200000) OR o_custkey = 1"),
            ("in", "orders", "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
            ("not_in", "orders", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
            ("between", "orders", "o_totalprice BETWEEN 50000 AND 150000"),
            ("like", "part", "p_name LIKE '%ring%'"),
            ("like_prefix", "part", "p_type LIKE 'S%'"),
            ("not_like", "part", "p_brand NOT LIKE 'Brand#1%'"),
        ]
    ),
    "range_mod_sum": """
SELECT CAST(n % 3 AS INTEGER) AS remainder, CAST(sum(n) AS BIGINT) AS total
FROM (SELECT unnest(range(1, CAST(l_quantity AS BIGINT) + 1)) AS n FROM lineitem) GROUP BY 1""",
    "preview_topn": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "latest_per_customer": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1""",
    "stale_rows": """
SELECT user_id, count(*) AS stale, max(ts) AS newest
FROM events WHERE ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR GROUP BY 1""",
    "clean_null_strings": """
WITH spelled AS (
  SELECT p_partkey,
         CASE p_partkey % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN ' - ' WHEN 2 THEN concat(chr(9), 'null', chr(10)) ELSE p_name END AS p_name,
         CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat(' ', p_brand) END AS p_brand
  FROM part)
SELECT p_partkey,
       CASE WHEN trim(p_name, concat(' ', chr(9), chr(10))) IN ('', 'null', 'N/A', '-') THEN NULL ELSE p_name END AS p_name,
       CASE WHEN trim(p_brand) IN ('', 'null', 'N/A', '-') THEN NULL ELSE p_brand END AS p_brand
FROM spelled""",
    "null_report": f"""
WITH {NULLED_SALES}, counted AS (
{_by_column("nulled", SALES_COLUMNS, "count(*) - count({c}) AS nulls, count(*) AS rows")})
SELECT *, {_half_up("10000 * nulls", "rows", 2)} AS pct FROM counted""",
    "null_totals": f"""
WITH {NULLED_SALES}, counted AS (
{_by_column("nulled", SALES_COLUMNS, "count(*) - count({c}) AS nulls, count(*) AS rows")}),
total AS (SELECT CAST(sum(nulls) AS BIGINT) AS total_nulls, CAST(sum(rows) AS BIGINT) AS total_cells FROM counted)
SELECT *, {_half_up("10000 * total_nulls", "total_cells", 2)} AS pct FROM total""",
    "table_profile": f"""
WITH {NULLED_SALES}
{
        _by_column(
            "nulled",
            SALES_COLUMNS,
            "count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, "
            'count(*) AS rows, count(DISTINCT {c}) AS "distinct"',
        )
    }""",
    "qt_no_null_category": f"WITH {FAULTY_SALES} SELECT txn_id, category FROM faulty WHERE category IS NULL",
    "qt_positive_amounts": f"""
WITH {FAULTY_SALES}
SELECT txn_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price, CAST(total_amount AS DOUBLE) AS total_amount,
       CASE WHEN quantity <= 0 THEN 'quantity <= 0' WHEN unit_price <= 0 THEN 'unit_price <= 0'
            WHEN total_amount <= 0 THEN 'total_amount <= 0' END AS reason
FROM faulty WHERE quantity <= 0 OR unit_price <= 0 OR total_amount <= 0""",
    "qt_total_calculation": f"""
WITH {FAULTY_SALES}
SELECT txn_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price, CAST(total_amount AS DOUBLE) AS total_amount,
       CAST(round(quantity * unit_price, 2) AS DOUBLE) AS expected_total, CAST({DIFFERENCE} AS DOUBLE) AS difference
FROM faulty WHERE {DIFFERENCE} > 0.01""",
    "qt_unique_txn": f"WITH {FAULTY_SALES} SELECT txn_id, count(*) AS occurrences FROM faulty GROUP BY 1 HAVING count(*) > 1",
    **{name: f"WITH {FAULTY_SALES} {_with_status(rows)}" for name, rows in COLUMN_CHECKS.items()},
    "custom_total_check": f"""
WITH {FAULTY_SALES}, counted AS (SELECT count(*) AS violations FROM faulty WHERE {DIFFERENCE} > 0.01)
SELECT 'total_equals_qty_times_price' AS "check", violations, CASE WHEN violations = 0 THEN 'passed' ELSE 'failed' END AS status
FROM counted""",
    "business_rules_report": f"WITH {FAULTY_SALES} {_with_status(RULES)}",
    "quality_suite_summary": f"""
WITH {FAULTY_SALES}, results AS (
  SELECT *, CASE WHEN violations = 0 OR violations / total <= tolerance THEN 'passed'
                 WHEN severity = 'warn' THEN 'warned' ELSE 'failed' END AS status FROM ({SUITE}))
SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'passed') AS passed,
       count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'warned') AS warned,
       count(*) FILTER (WHERE status = 'skipped') AS skipped, CAST(0 AS BIGINT) AS errored, count(*) FILTER (WHERE status = 'failed') = 0 AS success
FROM results""",
    "freshness_status": """
SELECT event_type, user_id, max(ts) AS newest,
       CASE WHEN max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 120 HOUR THEN 'error'
            WHEN max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOUR THEN 'warn' ELSE 'pass' END AS status
FROM events GROUP BY 1, 2""",
    "symmetric_diff": f"""
WITH {EDITED_ORDERS}, counted AS (
  SELECT (SELECT count(*) FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM edited)) AS only_left,
         (SELECT count(*) FROM (SELECT * FROM edited EXCEPT ALL SELECT * FROM orders)) AS only_right)
SELECT *, only_left + only_right AS differences FROM counted""",
    "symmetric_diff_distinct": f"""
WITH {EDITED_ORDERS},
l AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders),
r AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM edited),
counted AS (
  SELECT (SELECT count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM r)) AS only_left,
         (SELECT count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM l)) AS only_right)
SELECT *, only_left + only_right AS differences FROM counted""",
    "table_diff": f"""
WITH {EDITED_ORDERS}
SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey,
       CASE WHEN l.o_orderkey IS NULL THEN 'added' WHEN r.o_orderkey IS NULL THEN 'removed'
            WHEN (l.o_custkey, l.o_orderstatus, l.o_totalprice, l.o_orderdate, l.o_orderpriority) IS DISTINCT FROM
                 (r.o_custkey, r.o_orderstatus, r.o_totalprice, r.o_orderdate, r.o_orderpriority) THEN 'changed'
            ELSE 'unchanged' END AS status
FROM orders l FULL JOIN edited r ON l.o_orderkey = r.o_orderkey""",
    "tolerance_diff": f"""
WITH {EDITED_ORDERS}
SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey,
       CASE WHEN l.o_orderkey IS NULL THEN 'missing_left' WHEN r.o_orderkey IS NULL THEN 'missing_right'
            ELSE 'different' END AS status,
       l.o_totalprice AS o_totalprice_left, r.o_totalprice AS o_totalprice_right
FROM orders l FULL JOIN edited r ON l.o_orderkey = r.o_orderkey
WHERE l.o_orderkey IS NULL OR r.o_orderkey IS NULL OR abs(l.o_totalprice - r.o_totalprice) > CAST(0.01 AS DOUBLE)""",
    "latest_version": f"WITH {VERSIONS} SELECT * FROM latest",
    "resolve_versions": _resolved("subscription_events", "n.local_alias, n.product_name, n.version_constraint"),
    "refresh_subscriptions": _resolved("subscriptions", "n.consumer_workspace, n.product_name, n.version_constraint"),
    "current_access_rules": f"WITH {ACCESS} SELECT * FROM rules",
    "access_matrix": f"""
WITH {ACCESS},
requests AS (
  SELECT DISTINCT concat(lower(c_mktsegment), '-', c_nationkey) AS workspace, concat('brand-', o_orderkey % 25 + 1) AS product_name,
         CASE (o_orderkey // 25) % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'admin' END AS requested_level
  FROM orders JOIN customer ON o_custkey = c_custkey),
hits AS (
  SELECT q.workspace, q.product_name, access_level, rank, workspace_pattern,
         row_number() OVER (PARTITION BY q.workspace, q.product_name
                            ORDER BY rank DESC, workspace_pattern LIKE '%*', length(workspace_pattern) DESC) AS rn
  FROM (SELECT DISTINCT workspace, product_name FROM requests) q
  JOIN ranked r ON q.product_name = r.product_name AND {_matches("q.workspace")})
SELECT q.workspace, q.product_name, requested_level, access_level AS effective_level, workspace_pattern AS matching_rule,
       coalesce(rank, 0) >= CASE requested_level WHEN 'read' THEN 1 WHEN 'write' THEN 2 ELSE 3 END AS granted
FROM requests q LEFT JOIN hits h ON q.workspace = h.workspace AND q.product_name = h.product_name AND rn = 1""",
    "accessible_products": f"""
WITH {PRODUCTS}, {_levels_for("machinery-12")}
SELECT name AS product_name FROM products JOIN levels ON name = product_name WHERE rank >= 2 AND NOT is_deprecated""",
    "available_products": f"""
WITH {PRODUCTS}, {VERSIONS}, {_levels_for("building-12")}
SELECT name, owner_workspace AS owner, description, version AS latest_version, coalesce(row_count, 0) AS row_count,
       CASE rank WHEN 1 THEN 'read' WHEN 2 THEN 'write' ELSE 'admin' END AS access_level, sla_freshness_hours
FROM products JOIN levels ON name = levels.product_name LEFT JOIN latest ON name = latest.product_name
WHERE NOT is_deprecated""",
    "subscriptions_view": f"""
WITH {PRODUCTS}, {SUBSCRIPTIONS}
SELECT consumer_workspace, product_name, version_constraint, local_alias, subscribed_at, owner_workspace, description,
       sla_freshness_hours
FROM subscriptions JOIN products ON product_name = name""",
    "list_products_by_tag": f"""
WITH {PRODUCTS} SELECT name, owner_workspace, description, sla_freshness_hours, is_deprecated
FROM products WHERE list_contains(tags, 'economy') AND NOT is_deprecated ORDER BY name""",
    "missing_columns": """
WITH snapshots AS (
  SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS product_name, p_partkey % 3 + 1 AS major,
         concat_ws('_', lower(p_type), p_size) AS "column" FROM part)
SELECT DISTINCT product_name, "column" FROM snapshots e
WHERE major > 1 AND NOT EXISTS (
  SELECT 1 FROM snapshots s WHERE s.major = 1 AND s.product_name = e.product_name AND s."column" = e."column")""",
    "product_sla_status": f"""
WITH {PRODUCTS}, {VERSIONS}
SELECT name, version, published_at,
       CASE WHEN published_at IS NULL OR published_at < TIMESTAMP '2024-01-31 00:00:00' - to_hours(2 * sla_freshness_hours) THEN 'error'
            WHEN published_at < TIMESTAMP '2024-01-31 00:00:00' - to_hours(sla_freshness_hours) THEN 'warn' ELSE 'pass' END AS status
FROM products LEFT JOIN latest ON name = product_name""",
    "stored_upsert": f"WITH {MERGED} SELECT *, CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM merged",
    "read_snapshot": "SELECT * FROM orders",
    "read_overwritten": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "table_history": """
SELECT 'create' AS operation, count(*) AS row_count, CAST(3 AS BIGINT) AS files FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'
UNION ALL SELECT 'append', count(*), CAST(2 AS BIGINT) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'""",
    "incremental_runs": f"WITH {SILVER_EVENTS} SELECT * REPLACE (CAST(session_duration_sec AS DOUBLE) AS session_duration_sec) FROM ev",
    "stream_upsert": """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""",
    "published_product": """
SELECT l_suppkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1""",
    "lookback_runs": f"""
WITH {SILVER_EVENTS}
SELECT event_id, event_type, (SELECT max(_ingested_at) FROM raw_events) AS high FROM raw_events""",
    "full_refresh_run": "SELECT * FROM orders WHERE o_orderstatus <> 'F'",
    "compacted_table": "SELECT l_returnflag, count(*) AS n, CAST(2 AS BIGINT) AS files FROM lineitem GROUP BY 1",
    "promoted_table": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderkey % 3 = 0 THEN 'NEW' ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""",
    "retained_partitions": """
SELECT event_id, day FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(ts AS DATE) END AS day FROM events)
WHERE day IS NULL OR day >= DATE '2024-01-21'""",
    "lake_tables": """
SELECT 'bronze_orders' AS "view", 'bronze' AS layer, 'orders' AS name, true AS stored, count(*) AS n_rows FROM orders
UNION ALL SELECT 'bronze_events', 'bronze', 'events', true, count(*) FROM events
UNION ALL SELECT 'gold_orders', 'gold', 'orders', true, count(*) FROM orders WHERE o_orderstatus = 'P'""",
    "file_inventory": "SELECT DISTINCT l_linestatus, 'parquet' AS extension FROM lineitem",
    "landing_csv": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "landing_json": "SELECT * FROM conversations",
    "parsed_pages": "SELECT page_id, url, html FROM pages",
    "table_fixtures": """
SELECT kind, o_orderkey, o_custkey, o_orderstatus FROM orders, (VALUES ('csv'), ('parquet'), ('json')) kinds(kind)""",
    "consumed_view": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1",
    "count_checks": """
WITH n AS (SELECT count(*) AS n FROM lineitem)
SELECT 'expect_count' AS "check", abs(n - 100) AS violations, CASE WHEN n = 100 THEN 'passed' ELSE 'failed' END AS status FROM n
UNION ALL SELECT 'not_empty', CASE WHEN n > 0 THEN 0 ELSE 1 END, CASE WHEN n > 0 THEN 'passed' ELSE 'failed' END FROM n
UNION ALL SELECT 'fraction_is_zero', 1, 'failed' UNION ALL SELECT 'fraction', 0, 'passed'""",
    "nanos_as_timestamps": "SELECT event_id, ts AS at FROM events",
    "close_numbers": "SELECT o_orderkey, 'different' AS status FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0",
    "retention_unknown_dates": """
SELECT * FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 <> 0 THEN l_shipdate END AS l_shipdate FROM lineitem)
WHERE l_shipdate IS NULL OR l_shipdate >= DATE '1997-06-01' - INTERVAL 365 DAY""",
}

# The twins of the extended queries share the tables defined above.
from stratalake.plans import extended_twins as _extended  # noqa: E402

TWINS |= _extended.TWINS
