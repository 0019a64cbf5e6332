"""Every operator as a query over the given tables: ``(spark, path) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.functions.cleaning import clean_null_strings, nanos_to_timestamps
from stratalake.functions.columns import decimals_to_double
from stratalake.operators import access, diff, incremental, products, profile, quality, registry
from stratalake.operators.aggregates import mode_by
from stratalake.operators.retention import retain
from stratalake.operators.upsert import keep_last, merge, merge_stats
from stratalake.plans import marts, raw
from stratalake.plans.raw import table
from stratalake.session import shared_dir
from stratalake.sources.files import (
    csv_fixture,
    inventory,
    json_fixture,
    parquet_fixture,
    read_landing,
    read_parquet,
    register_parser,
    write_parquet,
)
from stratalake.sources.products import ProductCatalog
from stratalake.sources.tables import Lake
from stratalake.streaming.ingest import merge_stream, stream_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EVENTS_CUT = "2024-01-15 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def query(function: Query) -> Query:
    def run(spark: SparkSession, path: str) -> DataFrame:
        return decimals_to_double(function(spark, path))

    QUERIES[function.__name__] = run
    return function


def money(column: str):
    return F.col(column).cast("decimal(18,2)")


# --- scans and tables -------------------------------------------------------


@query
def scan_project_filter(spark, path):
    return read_parquet(
        spark,
        f"{path}/lineitem.parquet",
        ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"],
        (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"),
    )


@query
def partitioned_roundtrip(spark, path):
    """Write by return flag, read one partition back."""
    copy = shared_dir(spark, "partitioned-roundtrip")
    lines = table(spark, path, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    write_parquet(lines.hint("rebalance", "l_returnflag"), copy, ["l_returnflag"])
    return (
        read_parquet(spark, copy, where="l_returnflag = 'R'")
        .groupBy("l_linestatus")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).alias("total"))
    )


@query
def table_filter(spark, path):
    return table(spark, path, "events").where((F.col("event_type") == "click") & (F.col("value") > 10))


@query
def table_count(spark, path):
    return table(spark, path, "events").agg(F.count(F.lit(1)).alias("n"))


@query
def table_category_agg(spark, path):
    return (
        table(spark, path, "events")
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(money("value")).alias("total"), F.avg(money("value")).alias("average"))
    )


@query
def append_union(spark, path):
    events = table(spark, path, "events").select("event_id", "ts", "user_id", "event_type")
    cut = F.lit(EVENTS_CUT).cast("timestamp_ntz")
    old = events.where(F.col("ts") < cut).withColumn("part", F.lit("old"))
    new = events.where(F.col("ts") >= cut).withColumn("part", F.lit("new"))
    return old.unionByName(new, allowMissingColumns=True)


# --- upsert -----------------------------------------------------------------


def _existing(spark, path):
    return table(spark, path, "lineitem").where(F.col("l_partkey") % 3 != 0)


def _batch(spark, path):
    return table(spark, path, "lineitem").where(F.col("l_partkey") % 3 == 0)


@query
def dedup_keep_last(spark, path):
    return keep_last(table(spark, path, "lineitem"), LINE_KEYS, LINE_ORDER)


@query
def merge_upsert(spark, path):
    return merge(_existing(spark, path), _batch(spark, path), LINE_KEYS, LINE_ORDER)


@query
def merge_upsert_unique(spark, path):
    """The same upsert into a table that holds every key once."""
    existing = keep_last(_existing(spark, path), LINE_KEYS, LINE_ORDER)
    return merge(existing, _batch(spark, path), LINE_KEYS, LINE_ORDER, existing_unique=True)


@query
def merge_counts(spark, path):
    return merge_stats(_existing(spark, path), _batch(spark, path), LINE_KEYS)


QUERIES["merge_stats"] = QUERIES.pop("merge_counts")


@query
def incremental_merge(spark, path):
    merged = merge(_existing(spark, path), _batch(spark, path), LINE_KEYS, LINE_ORDER)
    return merged.groupBy(F.year("l_shipdate").alias("ship_year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).alias("total")
    )


# --- incremental reads ------------------------------------------------------


@query
def incremental_filter(spark, path):
    return incremental.newer_than(table(spark, path, "events"), "ts", EVENTS_CUT)


@query
def incremental_filter_id(spark, path):
    return incremental.newer_than(table(spark, path, "events"), "event_id", 5000)


@query
def incremental_filter_compound(spark, path):
    return incremental.newer_than_all(table(spark, path, "events"), {"event_type": "error", "ts": EVENTS_CUT})


@query
def incremental_lookback(spark, path):
    return incremental.newer_than(table(spark, path, "events"), "ts", EVENTS_CUT, timedelta(days=2))


@query
def incremental_silver_events(spark, path):
    """A first batch, then a second one that looks back two days: the same as one full run."""
    events = raw.raw_events(spark, path)
    first = events.where(F.col("_ingested_at") <= F.lit(EVENTS_CUT).cast("timestamp_ntz"))
    second = incremental.newer_than(events, "_ingested_at", EVENTS_CUT, timedelta(days=2))
    return merge(
        marts.silver_events(first, EVENTS_AS_OF),
        marts.silver_events(second, EVENTS_AS_OF),
        ["event_id"],
        ["_ingested_at"],
        existing_unique=True,
    )


@query
def watermark_value(spark, path):
    return incremental.compute_watermarks(table(spark, path, "events"), "ts", {"newest": "max", "oldest": "min"}, ["event_type"])


def _state_log(spark, path):
    return table(spark, path, "events").select(
        F.col("event_type").alias("pipeline"),
        F.concat(F.lit("column_"), F.col("user_id") % 10).alias("column"),
        raw.text("event_id").alias("value"),
        F.lit("bigint").alias("value_type"),
        F.col("ts").alias("updated_at"),
        F.col("user_id").alias("row_count"),
        (F.col("event_id") % 11 == 0).alias("is_reset"),
    )


@query
def watermark_state_latest(spark, path):
    return incremental.current_state(_state_log(spark, path))


@query
def retention_filter(spark, path):
    return retain(table(spark, path, "lineitem"), "l_shipdate", "2001-11-04", 365).select(
        "l_orderkey", "l_linenumber", "l_shipdate"
    )


@query
def files_pending(spark, path):
    return registry.pending_files(raw.landing_files(spark, path), raw.file_registry(spark, path))


@query
def files_pending_by_path(spark, path):
    return registry.pending_files(raw.landing_files(spark, path), raw.file_registry(spark, path), by_hash=False)


@query
def ingestion_history(spark, path):
    return registry.ingestion_history(raw.file_registry(spark, path), "bronze.en")


# --- silver and gold --------------------------------------------------------


def _sales(spark, path):
    return marts.silver_sales(raw.raw_sales(spark, path))


def _events(spark, path):
    return marts.silver_events(raw.raw_events(spark, path), EVENTS_AS_OF)


@query
def silver_sales(spark, path):
    return _sales(spark, path)


@query
def silver_events(spark, path):
    return _events(spark, path)


@query
def silver_orders(spark, path):
    return marts.silver_orders(raw.raw_orders(spark, path))


@query
def silver_sales_enriched(spark, path):
    sales = raw.raw_sales(spark, path).select("txn_id", "store_id", "product_id", "quantity", "customer_id", "transaction_time")
    parts = table(spark, path, "part").select(
        raw.text("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category")
    )
    customers = table(spark, path, "customer").select(
        raw.text("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name")
    )
    return marts.silver_sales_enriched(sales, parts, customers)


@query
def gold_daily_sales(spark, path):
    return marts.gold_daily_sales(_sales(spark, path), one_pass=True)


@query
def gold_device_metrics(spark, path):
    return marts.gold_device_metrics(_events(spark, path))


@query
def gold_page_metrics(spark, path):
    return marts.gold_page_metrics(_events(spark, path))


@query
def docs_daily_sales(spark, path):
    return marts.product_daily_sales(_sales(spark, path))


@query
def product_rollup(spark, path):
    return marts.product_rollup(_sales(spark, path))


@query
def mode_top_category(spark, path):
    return mode_by(_sales(spark, path), ["store_id"], "category", "top_category")


@query
def exec_dashboard(spark, path):
    stock = table(spark, path, "supplier").where(F.col("s_acctbal") > 0).select(
        raw.text("s_suppkey").alias("store_id"), F.floor("s_acctbal").cast("int").alias("stock_level")
    )
    return marts.exec_dashboard(marts.daily_revenue(_sales(spark, path)), stock)


@query
def join_inner(spark, path):
    lines, parts = table(spark, path, "lineitem"), table(spark, path, "part")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "p_name", "p_type", "l_extendedprice"
    )


@query
def predicate_suite(spark, path):
    """How many rows meet each form of predicate."""
    forms = {
        "orders": {
            "equal": "o_orderstatus = 'F'",
            "not_equal": "o_orderstatus <> 'F'",
            "less": "o_totalprice < 100000",
            "less_equal": "o_orderdate <= timestamp_ntz '1996-06-30 00:00:00'",
            "greater": "o_totalprice > 250000",
            "greater_equal": "o_custkey >= 100",
            "is_null": "nullif(o_custkey % 10, 0) is null",
            "is_not_null": "nullif(o_custkey % 10, 0) is not null",
            "and_or": "(o_orderstatus = 'O' and o_totalprice > 200000) or o_custkey = 1",
            "in": "o_orderpriority in ('1-URGENT', '2-HIGH')",
            "not_in": "o_orderpriority not in ('1-URGENT', '2-HIGH')",
            "between": "o_totalprice between 50000 and 150000",
        },
        "part": {"like": "p_name like '%ring%'", "like_prefix": "p_type like 'S%'", "not_like": "p_brand not like 'Brand#1%'"},
    }
    counted = []
    for name, predicates in forms.items():
        wide = table(spark, path, name).agg(*[F.count_if(F.expr(p)).alias(k) for k, p in predicates.items()])
        counted.append(wide.unpivot([], list(predicates), "predicate", "n"))
    return counted[0].unionByName(counted[1])


@query
def range_mod_sum(spark, path):
    """The numbers 1 to quantity of every line, summed by their remainder."""
    numbers = table(spark, path, "lineitem").select(
        F.explode(F.sequence(F.lit(1), F.col("l_quantity").cast("int"))).alias("n")
    )
    return numbers.groupBy((F.col("n") % 3).alias("remainder")).agg(F.sum("n").alias("total"))


@query
def preview_topn(spark, path):
    return profile.preview(
        table(spark, path, "orders"), 10, order_by=[F.desc("o_totalprice"), F.asc("o_orderkey")]
    )


@query
def latest_per_customer(spark, path):
    """Newest order of every customer."""
    return keep_last(table(spark, path, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query
def stale_rows(spark, path):
    limit = F.lit(EVENTS_AS_OF).cast("timestamp_ntz") - F.expr("interval 24 hours")
    old = table(spark, path, "events").where(F.col("ts") < limit)
    return old.groupBy("user_id").agg(F.count(F.lit(1)).alias("stale"), F.max("ts").alias("newest"))


# --- cleaning, profiles -----------------------------------------------------


@query
def clean_null_texts(spark, path):
    part = F.col("p_partkey")
    spelled = table(spark, path, "part").select(
        "p_partkey",
        F.when(part % 7 == 0, "N/A").when(part % 7 == 1, " - ").when(part % 7 == 2, "\tnull\n").otherwise(F.col("p_name")).alias("p_name"),
        F.when(part % 11 == 0, "").otherwise(F.concat(F.lit(" "), F.col("p_brand"))).alias("p_brand"),
    )
    return clean_null_strings(spelled)


QUERIES["clean_null_strings"] = QUERIES.pop("clean_null_texts")


@query
def null_report(spark, path):
    return profile.null_report(raw.raw_sales_with_nulls(spark, path))


@query
def null_totals(spark, path):
    return profile.null_totals(raw.raw_sales_with_nulls(spark, path))


@query
def table_profile(spark, path):
    return profile.table_profile(raw.raw_sales_with_nulls(spark, path))


# --- quality ----------------------------------------------------------------


def faulty_sales(spark, path):
    """Silver sales with faults of every kind put in."""
    product = F.col("product_id").cast("bigint")
    order = F.substring_index("txn_id", "-", 1).cast("bigint")
    return _sales(spark, path).select(
        F.when(order % 200 != 7, F.col("txn_id")).alias("txn_id"),
        F.when(product % 10 != 3, F.col("category")).alias("category"),
        F.when(product % 97 == 0, 0).when(product % 97 == 1, -1).otherwise(F.col("quantity")).alias("quantity"),
        "unit_price",
        (F.col("total_amount") + F.when(order % 50 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("total_amount"),
        "payment_method",
    )


def no_null_category(df):
    return df.where(F.col("category").isNull()).select("txn_id", "category")


def positive_amounts(df):
    """Amounts that are not positive, with the first reason."""
    named = [(F.col(c) <= 0, f"{c} <= 0") for c in ("quantity", "unit_price", "total_amount")]
    reason = F.when(named[0][0], named[0][1])
    for broken, label in named[1:]:
        reason = reason.when(broken, label)
    return df.select("txn_id", "quantity", "unit_price", "total_amount", reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def _difference():
    return F.abs(F.col("total_amount") - F.col("quantity") * F.col("unit_price"))


def total_calculation(df):
    expected = F.round(F.col("quantity") * F.col("unit_price"), 2)
    return df.where(_difference() > F.lit("0.01").cast("decimal(3,2)")).select(
        "txn_id", "quantity", "unit_price", "total_amount", expected.alias("expected_total"), _difference().alias("difference")
    )


@query
def qt_no_null_category(spark, path):
    return no_null_category(faulty_sales(spark, path))


@query
def qt_positive_amounts(spark, path):
    return positive_amounts(faulty_sales(spark, path))


@query
def qt_total_calculation(spark, path):
    return total_calculation(faulty_sales(spark, path))


@query
def qt_unique_txn(spark, path):
    return quality.failing_rows(faulty_sales(spark, path), quality.unique("txn_id", nulls_repeat=True))


METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
COLUMN_CHECKS = {
    "ct_not_null": lambda: [quality.not_null("txn_id"), quality.not_null("category")],
    "ct_unique": lambda: [quality.unique("txn_id")],
    "ct_positive": lambda: [quality.positive("quantity"), quality.positive("unit_price")],
    "ct_accepted_values": lambda: [quality.accepted_values("payment_method", METHODS)],
    "ct_min_max": lambda: [quality.minimum("quantity", 2), quality.maximum("quantity", 40)],
}


def _column_query(name: str) -> None:
    def run(spark, path):
        results = quality.run_checks(faulty_sales(spark, path), COLUMN_CHECKS[name]())
        return results.select("check", "violations", "total", "status")

    run.__name__ = name
    query(run)


for _name in COLUMN_CHECKS:
    _column_query(_name)


def wrong_totals(df):
    return df.agg(F.count_if(_difference() > F.lit("0.01").cast("decimal(3,2)")))


@query
def custom_total_check(spark, path):
    check = quality.scalar_query("total_equals_qty_times_price", wrong_totals, expect=0)
    return quality.run_checks(faulty_sales(spark, path), [check]).select("check", "violations", "status")


RULES = {
    "positive_quantities": "quantity > 0",
    "positive_prices": "unit_price > 0",
    "valid_total": "abs(total_amount - quantity * unit_price) <= 0.01",
    "required_txn_id": "txn_id is not null",
}


@query
def business_rules_report(spark, path):
    checks = [quality.rule(name, text) for name, text in RULES.items()]
    return quality.run_checks(faulty_sales(spark, path), checks).select("check", "violations", "total", "status")


def suite() -> list[quality.Check]:
    """All rules above; one percent of wrong totals and repeated ids is tolerated."""
    checks = [c for make in COLUMN_CHECKS.values() for c in make()]
    checks += [quality.rule(name, text, tolerance=0.01 if name == "valid_total" else 0.0) for name, text in RULES.items()]
    checks += [
        quality.rule("no_null_category", "category is not null", severity="warn"),
        quality.rule("few_null_ids", "txn_id is not null", tolerance=0.01),
        quality.unique("txn_id", nulls_repeat=True, severity="warn"),
        quality.not_empty(),
    ]
    return checks


@query
def quality_suite_summary(spark, path):
    return quality.summarize(quality.run_checks(faulty_sales(spark, path), suite()))


@query
def freshness_status(spark, path):
    return quality.freshness(
        table(spark, path, "events"), "ts", EVENTS_AS_OF, ["event_type", "user_id"], timedelta(hours=48), timedelta(hours=120)
    )


# --- diffs ------------------------------------------------------------------


def edited_orders(spark, path):
    """Orders with prices changed, rows removed and copies added under new keys."""
    orders, key = table(spark, path, "orders"), F.col("o_orderkey")
    step = F.when(key % 50 == 0, 1.0).when(key % 3 == 0, 0.005).otherwise(0.0)
    kept = orders.where(key % 97 != 0).withColumn("o_totalprice", F.col("o_totalprice") + step)
    added = orders.where(key % 89 == 0).withColumn("o_orderkey", key + 1_000_000_000)
    return kept.unionByName(added)


@query
def symmetric_diff(spark, path):
    return diff.diff_counts(table(spark, path, "orders"), edited_orders(spark, path))


@query
def symmetric_diff_distinct(spark, path):
    columns = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return diff.diff_counts(table(spark, path, "orders"), edited_orders(spark, path), columns, distinct=True)


@query
def table_diff(spark, path):
    return diff.table_diff(table(spark, path, "orders"), edited_orders(spark, path), ["o_orderkey"])


@query
def tolerance_diff(spark, path):
    return diff.tolerance_diff(table(spark, path, "orders"), edited_orders(spark, path), ["o_orderkey"], ["o_totalprice"])


# --- products ---------------------------------------------------------------


def _subscriptions(spark, path):
    return products.current_subscriptions(raw.subscription_events(spark, path))


@query
def latest_version(spark, path):
    return products.latest_versions(raw.product_versions(spark, path))


@query
def resolve_versions(spark, path):
    requests = raw.subscription_events(spark, path).select("local_alias", "product_name", "version_constraint")
    return products.resolve_versions(requests, raw.product_versions(spark, path))


@query
def refresh_subscriptions(spark, path):
    """Versions all current subscriptions resolve to."""
    mine = _subscriptions(spark, path).select("consumer_workspace", "product_name", "version_constraint")
    return products.resolve_versions(mine, raw.product_versions(spark, path))


@query
def current_access_rules(spark, path):
    return access.current_rules(raw.access_events(spark, path))


@query
def access_matrix(spark, path):
    return access.check_access(raw.access_requests(spark, path), access.current_rules(raw.access_events(spark, path)))


@query
def accessible_products(spark, path):
    rules = access.current_rules(raw.access_events(spark, path))
    return access.accessible_products(raw.products(spark, path), rules, "machinery-12", "write")


@query
def available_products(spark, path):
    rules = access.current_rules(raw.access_events(spark, path))
    versions = raw.product_versions(spark, path)
    return products.available_products(raw.products(spark, path), versions, rules, "building-12").drop("tags")


@query
def subscriptions_view(spark, path):
    return products.subscriptions_view(_subscriptions(spark, path), raw.products(spark, path))


@query
def list_products_by_tag(spark, path):
    return products.list_products(raw.products(spark, path), tag="economy").drop("tags")


@query
def missing_columns(spark, path):
    columns = raw.snapshot_columns(spark, path)
    expected = columns.where("major > 1").select("product_name", "column").distinct()
    return products.missing_columns(expected, columns.where("major = 1"), ["product_name"])


@query
def product_sla_status(spark, path):
    return products.sla_status(raw.products(spark, path), raw.product_versions(spark, path), EVENTS_AS_OF)


# --- stored tables: written to the shared folder and read back ----------------


@query
def stored_upsert(spark, path):
    """A table partitioned by ship year, loaded and then upserted."""
    lake, by_year = Lake(spark, shared_dir(spark, "stored-upsert")), {"ship_year": F.year("l_shipdate")}
    lake.merge("silver.lines", _existing(spark, path).withColumns(by_year), LINE_KEYS, LINE_ORDER, ["ship_year"])
    lake.merge("silver.lines", _batch(spark, path).withColumns(by_year), LINE_KEYS, LINE_ORDER)
    return lake.read("silver.lines")


def _written_orders(spark, path) -> Lake:
    lake, orders = Lake(spark, shared_dir(spark, "orders")), table(spark, path, "orders")
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    lake.create("bronze.orders", orders.where(F.col("o_orderdate") < cut))
    lake.append("bronze.orders", orders.where(F.col("o_orderdate") >= cut))
    lake.overwrite("bronze.orders", orders.where(F.col("o_orderstatus") == "F"))
    return lake


@query
def read_snapshot(spark, path):
    """The table as it was promoted into another workspace, before its last overwrite."""
    root, orders = shared_dir(spark, "orders"), table(spark, path, "orders")
    lake, before = Lake(spark, root), Lake(spark, root, "before")
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    lake.create("bronze.orders", orders.where(F.col("o_orderdate") < cut))
    lake.append("bronze.orders", orders.where(F.col("o_orderdate") >= cut))
    lake.promote("bronze.orders", before)
    lake.overwrite("bronze.orders", orders.where(F.col("o_orderstatus") == "F"))
    return before.read("bronze.orders")


@query
def read_overwritten(spark, path):
    return _written_orders(spark, path).read("bronze.orders")


@query
def table_history(spark, path):
    """What the stored files say of the writes that made a table: one full write, one append, one run of no rows."""
    lake, orders = Lake(spark, shared_dir(spark, "orders")), table(spark, path, "orders")
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    lake.create("bronze.orders", orders.where(F.col("o_orderdate") < cut).repartition(3))
    lake.append("bronze.orders", orders.where(F.col("o_orderdate") >= cut).repartition(2))
    lake.append("bronze.orders", orders.limit(0))
    kind = F.when(F.col("run") == "0", "create").otherwise("append")
    return lake.writes("bronze.orders").select(kind.alias("operation"), "row_count", "files")


@query
def incremental_runs(spark, path):
    """Two runs driven by the stored high-water value: the same as one full run."""
    lake, events = Lake(spark, shared_dir(spark, "incremental-runs")), raw.raw_events(spark, path)
    early = events.where(F.col("_ingested_at") <= F.lit(EVENTS_CUT).cast("timestamp_ntz"))
    for source in (early, events):
        lake.run(
            "silver.events",
            source,
            lambda df: marts.silver_events(df, EVENTS_AS_OF),
            unique_key=["event_id"],
            watermark="_ingested_at",
            order_by=["_ingested_at"],
            partition_by=["_date"],
        )
    return lake.read("silver.events")


@query
def stream_upsert(spark, path):
    """Events streamed into a table that keeps the last one per user and type.

    Two streams with a checkpoint of their own feed it, the one with the later
    events first, each in several micro-batches.
    """
    folder, events = shared_dir(spark, "stream-upsert"), table(spark, path, "events")
    lake, late = Lake(spark, folder), F.col("ts") > F.lit(EVENTS_CUT).cast("timestamp_ntz")
    for name, part in (("late", events.where(late)), ("early", events.where(~late | late.isNull()))):
        part.repartition(3, "event_id").write.parquet(f"{folder}/in/{name}")
        stream = stream_files(spark, f"{folder}/in/{name}", events.schema, pattern="*.parquet", max_files_per_trigger=1)
        merge_stream(stream, lake, "silver.last_event", ["user_id", "event_type"], ["ts"], f"{folder}/{name}").awaitTermination()
    return lake.read("silver.last_event")


@query
def published_product(spark, path):
    """Sales per store, published in three versions; a consumer reads within major version 1."""
    root = shared_dir(spark, "products")
    lake, catalog = Lake(spark, root, "sales"), ProductCatalog(spark, root)
    lines = table(spark, path, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag")
    lake.create("gold.lines", lines.where("l_returnflag = 'A'"))
    catalog.publish(lake, "lines", "gold.lines", "1.0.0", "Sold quantities")
    lake.append("gold.lines", lines.where("l_returnflag = 'N'"))
    catalog.publish(lake, "lines", "gold.lines", "1.10.0")
    lake.append("gold.lines", lines.where("l_returnflag = 'R'"))
    catalog.publish(lake, "lines", "gold.lines", "2.0.0")
    sql = "select l_suppkey, count(*) as n, cast(sum(l_quantity) as bigint) as quantity from {product} group by l_suppkey"
    return catalog.query("reporting", "lines", sql, "^1.2.0")


@query
def lookback_runs(spark, path):
    """Three runs, the last two looking back: late rows come in, none comes twice, the value does not move back."""
    lake, events = Lake(spark, shared_dir(spark, "lookback-runs")), raw.raw_events(spark, path)
    on_time = events.where(F.col("event_id").cast("bigint") % 3 != 0)
    early = F.col("_ingested_at") <= F.lit(EVENTS_CUT).cast("timestamp_ntz")
    for source, lookback in ((on_time.where(early), None), (events, timedelta(days=400)), (events.where(early), timedelta(days=400))):
        lake.run("silver.events", source, lambda df: df, ["event_id"], "_ingested_at", ["_ingested_at"], lookback=lookback)
    high = lake.state.get_text("silver.events", "_ingested_at")
    return lake.read("silver.events").select("event_id", "event_type", F.lit(high).cast("timestamp_ntz").alias("high"))


@query
def full_refresh_run(spark, path):
    """An incremental table built anew from a source that lost rows."""
    lake, orders = Lake(spark, shared_dir(spark, "full-refresh")), table(spark, path, "orders")
    lake.run("silver.orders", orders, lambda df: df, ["o_orderkey"], "o_orderdate")
    left = orders.where("o_orderstatus <> 'F'")
    lake.run("silver.orders", left, lambda df: df, ["o_orderkey"], "o_orderdate", full_refresh=True)
    return lake.read("silver.orders")


@query
def compacted_table(spark, path):
    """Many small files rewritten into few, and what the inventory says of them."""
    lake, lines = Lake(spark, shared_dir(spark, "compacted")), table(spark, path, "lineitem")
    lake.create("bronze.lines", lines.where("l_returnflag = 'A'").repartition(12, "l_orderkey"))
    lake.append("bronze.lines", lines.where("l_returnflag <> 'A'").repartition(12, "l_orderkey"))
    lake.compact("bronze.lines", 2)
    files = lake.tables("bronze").first()["files"]
    return lake.read("bronze.lines").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.lit(files).alias("files"))


@query
def promoted_table(spark, path):
    """A table promoted into another workspace, changed, and promoted again by key."""
    root, orders = shared_dir(spark, "promoted"), table(spark, path, "orders")
    dev, prod = Lake(spark, root, "dev"), Lake(spark, root, "prod")
    dev.create("gold.orders", orders.where("o_orderkey % 2 = 0"))
    dev.promote("gold.orders", prod)
    dev.create("gold.orders", orders.where("o_orderkey % 3 = 0").withColumn("o_orderpriority", F.lit("NEW")))
    dev.promote("gold.orders", prod, ["o_orderkey"])
    return prod.read("gold.orders")


@query
def retained_partitions(spark, path):
    """A table partitioned by date without its expired partitions; rows without a date stay."""
    lake = Lake(spark, shared_dir(spark, "retained"))
    day = F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("date")).alias("day")
    lake.create("bronze.events", table(spark, path, "events").select("event_id", day), ["day"])
    lake.retain("bronze.events", "day", EVENTS_AS_OF, 10)
    return lake.read("bronze.events")


@query
def lake_tables(spark, path):
    """Tables as views, after one was replaced and one dropped."""
    lake = Lake(spark, shared_dir(spark, "tables"))
    for name in ("orders", "events", "customer"):
        lake.create(f"bronze.{name}", table(spark, path, name).repartition(4))
    lake.create("gold.orders", table(spark, path, "orders").where("o_orderstatus = 'F'"))
    lake.overwrite("gold.orders", table(spark, path, "orders").where("o_orderstatus = 'P'"))
    lake.drop("bronze.customer")
    views = lake.register_views()
    counts = [spark.table(v).agg(F.count("*").alias("n_rows")).select(F.lit(v).alias("view"), "n_rows") for v in views]
    rows = counts[0]
    for other in counts[1:]:
        rows = rows.union(other)
    named = lake.tables().select(F.concat_ws("_", "layer", "name").alias("view"), "layer", "name", (F.col("files") >= 1).alias("stored"))
    return named.join(rows, "view")


@query
def file_inventory(spark, path):
    """Files of a partitioned copy, by what their paths say."""
    copy = shared_dir(spark, "inventory")
    write_parquet(table(spark, path, "lineitem").select("l_orderkey", "l_linestatus"), copy, ["l_linestatus"])
    files = inventory(spark, copy, "*.parquet")
    status = F.regexp_extract("path", "/l_linestatus=([^/]*)/", 1)
    return files.where("length > 0").select(status.alias("l_linestatus"), "extension").distinct()


@query
def landing_csv(spark, path):
    """Orders landed as CSV files, some with the extension in capitals."""
    folder, orders = shared_dir(spark, "landing-csv"), table(spark, path, "orders")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    for name, part in (("csv", orders.where("o_orderkey % 2 = 0")), ("CSV", orders.where("o_orderkey % 2 = 1"))):
        part.select(*columns).write.option("header", "true").option("extension", name).csv(f"{folder}/{name}")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return read_landing(spark, folder, "csv", schema).select(*columns)


@query
def landing_json(spark, path):
    """Conversations landed as JSON lines."""
    folder = shared_dir(spark, "landing-json")
    table(spark, path, "conversations").repartition(3, "conv_id").write.json(folder)
    schema = "conv_id bigint, turn bigint, role string, text string"
    return read_landing(spark, folder, "json", schema).drop("_source_file")


@query
def parsed_pages(spark, path):
    """Pages landed as files of any format, read by a registered parser on the executors."""
    folder = shared_dir(spark, "landing-pages")
    # A file reaches the parser as a whole: more pages make more files, not larger ones.
    table(spark, path, "pages").select("page_id", "url", "html").write.option("maxRecordsPerFile", 1000).json(folder)

    def parse(content, name):
        import json

        import pandas as pd

        rows = [json.loads(line) for line in content]
        return pd.DataFrame({c: [r.get(c) for r in rows] for c in ("page_id", "url", "html")})

    register_parser("page lines", parse, "page_id bigint, url string, html string")
    return read_landing(spark, folder, "json", parser="page lines").select("page_id", "url", "html")


@query
def table_fixtures(spark, path):
    """The same table as CSV, Parquet and JSON fixtures of several files each."""
    folder = shared_dir(spark, "fixtures")
    orders = table(spark, path, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition(4, "o_orderkey")
    orders.write.option("header", "true").csv(f"{folder}/orders.csv")
    orders.write.parquet(f"{folder}/orders.parquet")
    # A fixture file is one object that lists its rows: a thousand keys each.
    listed = orders.groupBy(F.floor(F.col("o_orderkey") / 1000)).agg(F.collect_list(F.struct(*orders.columns)).alias("rows"))
    listed.select(F.lit("bronze.orders").alias("table"), "rows").write.option("maxRecordsPerFile", 1).json(f"{folder}/json")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string"
    _, from_csv = csv_fixture(spark, f"{folder}/orders.csv", schema)
    _, from_parquet = parquet_fixture(spark, f"{folder}/orders.parquet")
    from_json = json_fixture(spark, f"{folder}/json", {"bronze_orders": schema})["bronze_orders"]
    kinds = (("csv", from_csv), ("parquet", from_parquet), ("json", from_json))
    out = [df.select(F.lit(kind).alias("kind"), *orders.columns) for kind, df in kinds]
    return out[0].union(out[1]).union(out[2])


@query
def consumed_view(spark, path):
    """A product that another workspace consumes as a view."""
    root = shared_dir(spark, "consumed")
    lake, catalog = Lake(spark, root, "sales"), ProductCatalog(spark, root)
    lake.create("gold.customers", table(spark, path, "customer"))
    catalog.publish(lake, "all-customers", "gold.customers", "1.0.0")
    taken = catalog.consume("reporting", "all-customers", "1.x", "consumed_customers")
    return spark.sql(f"select c_mktsegment, count(*) as n from {taken.view} group by c_mktsegment")


@query
def count_checks(spark, path):
    """Whether a table has as many rows as expected, and a query's number is the expected one."""
    lines = table(spark, path, "lineitem")
    share = lambda df: df.agg(F.count_if(F.col("l_linenumber") > 0) / F.count("*") - 0.6)
    checks = [
        quality.expect_count(100), quality.not_empty(), quality.scalar_query("fraction_is_zero", share), quality.scalar_query("fraction", share, 0.4)
    ]
    return quality.run_checks(lines, checks).select("check", "violations", "status")


@query
def nanos_as_timestamps(spark, path):
    """Event times as nanoseconds since the epoch, with a rest below a microsecond, read as timestamps."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, path, "events").select("event_id", (micros * 1000 + F.col("event_id") % 1000).alias("at"))
    return nanos_to_timestamps(events, ["at"]).select("event_id", F.col("at").cast("timestamp_ntz").alias("at"))


@query
def close_numbers(spark, path):
    """Differences that only a tolerance far below a cent tells, and values that are no numbers on both sides."""
    orders = table(spark, path, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") / 8).alias("x"))
    left = orders.withColumn("x", F.coalesce("x", F.lit(float("nan"))))
    key = F.col("o_orderkey")
    right = left.withColumn("x", F.col("x") + F.when(key % 3 == 0, 2e-6).when(key % 3 == 1, 1e-8).otherwise(0.0))
    return diff.tolerance_diff(left, right, ["o_orderkey"], ["x"], 1e-7).select("o_orderkey", "status")


@query
def retention_unknown_dates(spark, path):
    """Rows without a date are not known to be expired."""
    dated = F.when(F.col("l_orderkey") % 9 != 0, F.col("l_shipdate"))
    lines = table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", dated.alias("l_shipdate"))
    return retain(lines, "l_shipdate", "1997-06-01", 365)


# The queries of stored, sketched and streamed tables build on those above.
from stratalake.plans import extended as _extended  # noqa: E402, F401
