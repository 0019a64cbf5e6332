"""Silver and gold tables: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.operators.aggregates import grouped_measures, percent
from stratalake.operators.joins import lookup


def silver_sales(raw: DataFrame) -> DataFrame:
    """Valid sales with upper-case texts, line total and date."""
    kept = raw.where((F.col("quantity") > 0) & (F.col("unit_price") > 0) & F.col("txn_id").isNotNull())
    return kept.select(
        "txn_id",
        "store_id",
        "product_id",
        F.upper("product_name").alias("product_name"),
        F.upper("category").alias("category"),
        "quantity",
        "unit_price",
        F.round(F.col("quantity") * F.col("unit_price"), 2).cast("decimal(18,2)").alias("total_amount"),
        F.upper("payment_method").alias("payment_method"),
        "customer_id",
        "transaction_time",
        F.col("transaction_time").cast("date").alias("_date"),
        "_ingested_at",
    )


def silver_events(raw: DataFrame, as_of: str) -> DataFrame:
    """Identified events up to ``as_of`` with uniform spelling."""
    not_future = F.col("timestamp") <= F.lit(as_of).cast(raw.schema["timestamp"].dataType)
    kept = raw.where(F.col("event_id").isNotNull() & F.col("user_id").isNotNull() & not_future)
    return kept.select(
        "event_id",
        "user_id",
        "session_id",
        F.upper("event_type").alias("event_type"),
        "page_url",
        "referrer",
        F.col("timestamp").alias("event_timestamp"),
        F.col("timestamp").cast("date").alias("_date"),
        F.lower("device").alias("device"),
        "browser",
        F.upper("country").alias("country"),
        "session_duration_sec",
        "_ingested_at",
    )


def silver_orders(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("total_amount") > 0).select("order_id", "customer_id", "order_date", "total_amount")


def silver_sales_enriched(sales: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """All sales, with product and customer details where known."""
    with_product = lookup(sales, products, "product_id", ["product_name", "category"])
    return lookup(with_product, customers, "customer_id", ["customer_name"])


def gold_daily_sales(sales: DataFrame, ordered: bool = True, one_pass: bool = False) -> DataFrame:
    """Sales figures per day and store, newest day and highest revenue first.

    Written tables keep no order: leave ``ordered`` out for them.
    """
    measures = grouped_measures(
        sales.withColumnRenamed("_date", "sale_date"),
        ["sale_date", "store_id"],
        sums={
            "total_transactions": F.lit(1),
            "total_items_sold": F.col("quantity"),
            "_revenue": F.col("total_amount"),
            "_priced": F.when(F.col("total_amount").isNotNull(), 1).otherwise(0),
        },
        distincts={"unique_customers": "customer_id", "unique_products": "product_id"},
        modes={"top_category": "category"},
        one_pass=one_pass,
    )
    out = measures.select(
        "sale_date",
        "store_id",
        "total_transactions",
        "total_items_sold",
        F.round("_revenue", 2).alias("total_revenue"),
        F.round(F.col("_revenue") / F.nullif("_priced", F.lit(0)), 2).alias("avg_transaction_value"),
        "unique_customers",
        "unique_products",
        "top_category",
    )
    return out.orderBy(F.desc("sale_date"), F.desc("total_revenue")) if ordered else out


def _event_counts(*names: str) -> dict:
    return {f"{name.lower()}s": F.when(F.col("event_type") == name, 1).otherwise(0) for name in names}


def _duration() -> dict:
    seconds = F.col("session_duration_sec")
    return {"_seconds": seconds, "_timed": F.when(seconds.isNotNull(), 1).otherwise(0)}


def _average_duration():
    return F.round(F.col("_seconds") / F.nullif("_timed", F.lit(0)), 1).alias("avg_session_duration")


def gold_device_metrics(events: DataFrame, ordered: bool = True, one_pass: bool = False) -> DataFrame:
    """Events, users and conversion per device type."""
    measures = grouped_measures(
        events,
        ["device"],
        sums={"total_events": F.lit(1), **_event_counts("PURCHASE"), **_duration()},
        distincts={"unique_users": "user_id", "unique_sessions": "session_id", "countries_reached": "country"},
        modes={"top_browser": "browser"},
        one_pass=one_pass,
    )
    out = measures.select(
        "device",
        "total_events",
        "unique_users",
        "unique_sessions",
        "purchases",
        percent(F.col("purchases"), F.col("total_events")).alias("conversion_rate"),
        _average_duration(),
        "countries_reached",
        "top_browser",
    )
    return out.orderBy(F.desc("total_events")) if ordered else out


def gold_page_metrics(events: DataFrame, ordered: bool = True, one_pass: bool = False) -> DataFrame:
    """Traffic and conversion per page."""
    measures = grouped_measures(
        events,
        ["page_url"],
        sums={"total_events": F.lit(1), **_event_counts("PAGEVIEW", "CLICK", "PURCHASE"), **_duration()},
        mins={"first_event_date": F.col("_date")},
        maxs={"last_event_date": F.col("_date")},
        distincts={"unique_users": "user_id", "unique_sessions": "session_id"},
        one_pass=one_pass,
    )
    out = measures.select(
        "page_url",
        "total_events",
        "unique_users",
        "unique_sessions",
        "pageviews",
        "clicks",
        "purchases",
        _average_duration(),
        percent(F.col("purchases"), F.col("pageviews")).alias("conversion_rate"),
        "first_event_date",
        "last_event_date",
    )
    return out.orderBy(F.desc("total_events")) if ordered else out


def product_daily_sales(sales: DataFrame) -> DataFrame:
    """Transactions, quantity and revenue per day and product."""
    return sales.groupBy(F.col("transaction_time").cast("date").alias("date"), "product_id").agg(
        F.count(F.lit(1)).alias("num_transactions"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("total_amount").alias("revenue"),
    )


def product_rollup(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_name").agg(F.sum("quantity").alias("total_quantity"))


def daily_revenue(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.col("_date").alias("sale_date"), "store_id").agg(
        F.round(F.sum("total_amount"), 2).alias("total_revenue")
    )


def exec_dashboard(revenue: DataFrame, stock: DataFrame) -> DataFrame:
    """Revenue per day and store next to the store's stock level, where known."""
    return lookup(revenue, stock, "store_id", ["stock_level"]).select(
        "sale_date", "store_id", "total_revenue", "stock_level"
    )
