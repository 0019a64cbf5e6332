"""Bronze tables, projected from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def text(column: str) -> Column:
    return F.col(column).cast("string")


def pick(number: Column, *values: str | None) -> Column:
    """The value at position ``number`` modulo their count."""
    out = F.lit(values[-1]).cast("string")
    for i, value in enumerate(values[:-1]):
        out = F.when(number % len(values) == i, F.lit(value).cast("string")).otherwise(out)
    return out


def raw_sales(spark: SparkSession, path: str) -> DataFrame:
    """Point-of-sale lines; every tenth customer did not show a card."""
    lines = table(spark, path, "lineitem").join(
        table(spark, path, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return lines.join(table(spark, path, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("txn_id"),
        text("l_suppkey").alias("store_id"),
        text("l_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("unit_price"),
        F.col("o_orderpriority").alias("payment_method"),
        F.when(F.col("o_custkey") % 10 != 0, text("o_custkey")).alias("customer_id"),
        F.col("o_orderdate").alias("transaction_time"),
        F.col("l_shipdate").alias("_ingested_at"),
    )


def raw_sales_with_nulls(spark: SparkSession, path: str) -> DataFrame:
    """Raw sales in which some categories and payment methods were not recorded."""
    product = F.col("product_id").cast("bigint")
    return raw_sales(spark, path).withColumns(
        {
            "category": F.when(product % 10 != 3, F.col("category")),
            "payment_method": F.when(product % 7 != 0, F.col("payment_method")),
        }
    )


def raw_events(spark: SparkSession, path: str) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    return table(spark, path, "events").select(
        text("event_id").alias("event_id"),
        text("user_id").alias("user_id"),
        F.concat_ws("-", user, F.col("ts").cast("date")).alias("session_id"),
        F.when(F.col("event_type") == "view", "pageview").otherwise(F.col("event_type")).alias("event_type"),
        F.concat(F.lit("/p"), user % 7).alias("page_url"),
        F.when(event % 3 != 0, F.concat(F.lit("/p"), event % 5)).alias("referrer"),
        F.col("ts").alias("timestamp"),
        pick(user, "Desktop", "Mobile", "Tablet").alias("device"),
        pick(event, "chrome", "firefox", "safari", "edge").alias("browser"),
        pick(user, "us", "gb", "de", "fr", "ca", "jp", "br", "in").alias("country"),
        F.col("value").cast("decimal(12,2)").alias("session_duration_sec"),
        F.col("ts").alias("_ingested_at"),
    )


def raw_orders(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_totalprice").alias("total_amount"),
    )


# --- file and product registries, derived from the same tables --------------


def landing_files(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "documents").select(
        F.concat(F.lit("landing/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("file_path"),
        F.md5("text").alias("file_hash"),
    )


def file_registry(spark: SparkSession, path: str) -> DataFrame:
    """One registry row per document; some runs failed, some files changed since."""
    doc = F.col("doc_id")
    return table(spark, path, "documents").select(
        F.concat(F.lit("landing/"), F.col("source"), F.lit("/"), doc, F.lit(".txt")).alias("file_path"),
        F.when(doc % 5 == 0, "changed since").otherwise(F.md5("text")).alias("file_hash"),
        F.concat(F.lit("bronze."), F.col("lang")).alias("target_table"),
        F.col("n_chars").alias("rows_ingested"),
        minutes_after("2024-01-01 00:00:00", doc).alias("ingested_at"),
        F.when(doc % 7 == 0, "failed").when(doc % 7 == 1, "skipped").otherwise("success").alias("status"),
    )


def minutes_after(start: str, minutes: Column) -> Column:
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))


def _product() -> Column:
    return F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))


def products(spark: SparkSession, path: str) -> DataFrame:
    first = F.min("p_partkey")
    return (
        table(spark, path, "part")
        .groupBy(_product().alias("name"))
        .agg(
            F.concat(F.lit("team-"), first % 5).alias("owner_workspace"),
            F.concat(F.lit("Parts of "), F.min("p_brand")).alias("description"),
            F.array(F.lower(F.min("p_type")), F.lower(F.max("p_name"))).alias("tags"),
            (F.count(F.lit(1)) % 48 + 12).cast("int").alias("sla_freshness_hours"),
            (first % 7 == 3).alias("is_deprecated"),
        )
    )


def product_versions(spark: SparkSession, path: str) -> DataFrame:
    part = F.col("p_partkey")
    return (
        table(spark, path, "part")
        .groupBy(
            _product().alias("product_name"),
            F.concat_ws(".", part % 3 + 1, F.col("p_size"), part % 5).alias("version"),
        )
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.max(minutes_after("2024-01-01 00:00:00", part % 700 * 60)).alias("published_at"),
        )
    )


def snapshot_columns(spark: SparkSession, path: str) -> DataFrame:
    """Columns of the products' schema snapshots, per major version."""
    return (
        table(spark, path, "part")
        .select(
            _product().alias("product_name"),
            (F.col("p_partkey") % 3 + 1).alias("major"),
            F.concat_ws("_", F.lower("p_type"), F.col("p_size")).alias("column"),
        )
        .distinct()
    )


def access_events(spark: SparkSession, path: str) -> DataFrame:
    """Grants and revocations of rules in all three pattern forms."""
    part = F.col("p_partkey")
    segment = pick(part, "automobile", "building", "furniture", "machinery", "household")
    fifth = F.floor(part / 5)
    pattern = (
        F.when(part % 211 == 0, "*")
        .when(part % 3 == 0, F.concat(segment, F.lit("-"), fifth % 3, F.lit("*")))
        .when(part % 31 == 1, F.concat(F.substring(segment, 1, 4), F.lit("*")))
        .otherwise(F.concat(segment, F.lit("-"), fifth % 25))
    )
    return table(spark, path, "part").select(
        _product().alias("product_name"),
        pattern.alias("workspace_pattern"),
        pick(F.col("p_size"), "read", "write", "admin").alias("access_level"),
        minutes_after("2024-01-01 00:00:00", part).alias("granted_at"),
        F.lit("system").alias("granted_by"),
        (F.col("p_size") > 12).alias("is_revoked"),
    )


def _workspace() -> Column:
    return F.concat(F.lower("c_mktsegment"), F.lit("-"), F.col("c_nationkey"))


def subscription_events(spark: SparkSession, path: str) -> DataFrame:
    """Customers subscribing with every form of version constraint, some cancelling later."""
    cust = F.col("c_custkey")
    major, minor, patch = cust % 3 + 1, F.floor(cust / 10) % 50 + 1, F.floor(cust / 7) % 5
    full = F.concat_ws(".", major, minor, patch)
    constraint = F.when(cust % 10 == 0, "latest").when(cust % 10 == 1, full)
    for i, operator in ((2, "^"), (3, "~"), (6, ">="), (7, ">"), (8, "<="), (9, "<")):
        constraint = constraint.when(cust % 10 == i, F.concat(F.lit(operator), full))
    constraint = constraint.when(cust % 10 == 4, F.concat(major, F.lit(".x")))
    constraint = constraint.otherwise(F.concat(major, F.lit("."), minor, F.lit(".x")))
    return table(spark, path, "customer").select(
        F.concat(F.lit("brand-"), cust % 25 + 1).alias("product_name"),
        _workspace().alias("consumer_workspace"),
        constraint.alias("version_constraint"),
        F.concat(F.lit("p"), cust).alias("local_alias"),
        minutes_after("2024-01-01 00:00:00", cust).alias("subscribed_at"),
        (F.col("c_acctbal") < 0).alias("is_cancelled"),
    )


def access_requests(spark: SparkSession, path: str) -> DataFrame:
    """Which customer's workspace asked for which product at which level, from the orders."""
    order = F.col("o_orderkey")
    return (
        table(spark, path, "orders")
        .join(table(spark, path, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            _workspace().alias("workspace"),
            F.concat(F.lit("brand-"), order % 25 + 1).alias("product_name"),
            pick(F.floor(order / 25), "read", "write", "admin").alias("requested_level"),
        )
        .distinct()
    )
