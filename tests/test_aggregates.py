from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalake.operators.aggregates import grouped_measures, mode_by, percent
from stratalake.operators.joins import lookup
from stratalake.plans import marts

ROWS = [("a", "x", 1, 10), ("a", "x", 2, 20), ("a", "y", 2, 30), ("a", None, None, 5), (None, "z", 7, 1), (None, "z", 7, 2), ("b", None, None, 0)]


@pytest.mark.parametrize("one_pass", [False, True])
def test_measures_against_plain_python(spark, one_pass):
    df = spark.createDataFrame(ROWS, "g string, c string, u int, v int")
    got = grouped_measures(
        df, ["g"],
        sums={"n": F.lit(1), "total": F.col("v")}, mins={"lo": F.col("v")}, maxs={"hi": F.col("v")},
        distincts={"users": "u", "kinds": "c"}, modes={"top": "c"}, one_pass=one_pass,
    )
    result = {r["g"]: r.asDict() for r in got.collect()}
    for g in ("a", "b", None):
        part = [r for r in ROWS if r[0] == g]
        counts = Counter(r[1] for r in part if r[1] is not None)
        top = min(counts, key=lambda c: (-counts[c], c)) if counts else None
        assert result[g] == {
            "g": g, "n": len(part), "total": sum(r[3] for r in part), "lo": min(r[3] for r in part), "hi": max(r[3] for r in part),
            "users": len({r[2] for r in part} - {None}), "kinds": len({r[1] for r in part} - {None}), "top": top,
        }


def test_mode_takes_the_lowest_on_a_tie(spark, rows):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "g int, v string")
    assert rows(mode_by(df, ["g"], "v", "m")) == [(1, "a"), (2, "c")]


def test_percent_of_nothing_is_null(spark, rows):
    df = spark.createDataFrame([(1, 3), (1, 0)], "a bigint, b bigint")
    assert [r[0] if r[0] is None else float(r[0]) for r in df.select(percent(F.col("a"), F.col("b"))).collect()] == [33.33, None]


def test_lookup_keeps_facts_without_a_match(spark, rows):
    facts = spark.createDataFrame([(1, "p"), (None, "q"), (9, "r")], "k int, f string")
    dim = spark.createDataFrame([(1, "one"), (None, "never")], "k int, name string")
    assert rows(lookup(facts, dim, "k", ["name"])) == [(1, "p", "one"), (9, "r", None), (None, "q", None)]


def test_lookup_spreads_facts_without_a_key(spark):
    """Without a broadcast, rows with a null key do not meet in one partition."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        facts = spark.range(4000).select(F.lit(None).cast("bigint").alias("k"), F.col("id").alias("f"))
        dim = spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("name"))
        sizes = lookup(facts, dim, "k", ["name"]).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 4
        assert max(r["count"] for r in sizes) < 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_silver_sales_of_the_fixture(raw_sales, rows):
    """Two valid rows, upper-case texts, totals 20.00 and 76.50."""
    result = rows(marts.silver_sales(raw_sales), "txn_id", "product_name", "category", "total_amount", "payment_method")
    assert [(r[0], r[1], r[2], str(r[3]), r[4]) for r in result] == [
        ("T001", "WIDGET", "ELECTRONICS", "20.00", "CREDIT"),
        ("T002", "GADGET", "HOME", "76.50", "CASH"),
    ]


def test_gold_daily_sales_of_the_fixture(raw_sales):
    row = marts.gold_daily_sales(marts.silver_sales(raw_sales)).collect()
    assert len(row) == 1
    assert (row[0]["total_transactions"], row[0]["total_items_sold"]) == (2, 5)
    assert (float(row[0]["total_revenue"]), float(row[0]["avg_transaction_value"])) == (96.5, 48.25)
    assert (row[0]["unique_customers"], row[0]["unique_products"], row[0]["top_category"]) == (1, 2, "ELECTRONICS")
