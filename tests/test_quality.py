from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalake.operators import quality as q
from stratalake.plans import marts
from stratalake.plans.catalogue import no_null_category, positive_amounts, total_calculation


@pytest.fixture
def sales(spark):
    rows = [("t1", "a", 1), ("t2", None, 0), ("t2", "b", -3), (None, "c", None), (None, "a", 50)]
    return spark.createDataFrame(rows, "id string, kind string, n int")


def status(df, *checks):
    return {r["check"]: (r["violations"], r["total"], r["status"]) for r in q.run_checks(df, checks).collect()}


def test_column_kinds(sales):
    got = status(
        sales,
        *q.column_checks("id", ["not_null", "unique"]),
        *q.column_checks("kind", [{"accepted_values": ["a", "b"]}]),
        *q.column_checks("n", ["positive", {"min": 0}, {"max": 10}]),
    )
    assert got == {
        "id_not_null": (2, 5, "failed"),
        "id_unique": (1, 5, "failed"),
        "kind_accepted_values": (1, 5, "failed"),
        "n_positive": (2, 5, "failed"),
        "n_min": (1, 5, "failed"),
        "n_max": (1, 5, "failed"),
    }
    with pytest.raises(ValueError):
        q.column_checks("n", ["even"])


def test_grouped_uniqueness_counts_nulls(sales):
    assert status(sales, q.unique("id", nulls_repeat=True))["id_unique"] == (2, 5, "failed")


def test_severity_tolerance_and_skip(sales):
    got = status(
        sales,
        q.not_null("id", severity="warn"),
        q.rule("few", "n > -1", tolerance=0.2),
        q.rule("off", "n > 100", skip=True),
        q.not_empty(),
        q.expect_count(5),
        q.expect_count(7, severity="warn"),
    )
    assert got["id_not_null"][2] == "warned"
    assert got["few"] == (1, 5, "passed")
    assert got["off"] == (None, None, "skipped")
    assert got["not_empty"][2] == "passed"


def test_queries_and_scalars(sales):
    got = status(
        sales,
        q.violation_query("missing_kind", lambda df: df.where("kind is null")),
        q.scalar_query("negatives", lambda df: df.agg(F.count_if(F.col("n") < 0)), expect=0),
        q.scalar_query("rows", lambda df: df.agg(F.count(F.lit(1))), expect=5),
    )
    assert got["missing_kind"][0::2] == (1, "failed")
    assert got["negatives"][0::2] == (1, "failed")
    assert got["rows"][0::2] == (0, "passed")


def test_share_of_a_query(sales):
    one = lambda df: df.where("kind is null")
    got = status(sales, q.violation_query("some", one, tolerance=0.2), q.violation_query("few", one, tolerance=0.1))
    assert got == {"some": (1, 5, "passed"), "few": (1, 5, "failed")}


def test_a_check_that_does_not_fit_leaves_the_others_alone(sales):
    checks = [
        q.not_null("id"), q.rule("broken", "no_such_column > 1"), q.unique("nope"),
        q.violation_query("bad", lambda df: df.where("nope = 1"), severity="warn"),
    ]
    results = q.run_checks(sales, checks)
    assert {r["check"]: r["status"] for r in results.collect()} == {
        "id_not_null": "failed", "broken": "errored", "nope_unique": "errored", "bad": "errored",
    }
    assert q.summarize(results).first()["errored"] == 3
    with pytest.raises(q.QualityGateError, match="broken"):
        q.gate(results)


def test_empty_table(sales):
    none = sales.where("false")
    got = status(none, q.not_null("id"), q.unique("id"), q.not_empty())
    assert got["id_not_null"] == (0, 0, "passed")
    assert got["id_unique"] == (0, 0, "passed")
    assert got["not_empty"] == (1, 0, "failed")


def test_row_rules_share_one_scan(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet")
    checks = [q.rule(f"r{i}", f"l_quantity > {i}") for i in range(30)] + [q.not_null("l_orderkey")]
    plan = q.run_checks(df, checks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_summary_and_gate(sales):
    results = q.run_checks(sales, [q.not_null("id"), q.not_null("kind", severity="warn"), q.not_empty()])
    row = q.summarize(results).first()
    assert (row["checks"], row["passed"], row["failed"], row["warned"], row["success"]) == (3, 1, 1, 1, False)
    with pytest.raises(q.QualityGateError, match="id_not_null"):
        q.gate(results)
    fine = q.run_checks(sales, [q.not_null("kind", severity="warn")])
    assert q.gate(fine).collect() == fine.collect()


def test_fixture_passes_its_four_queries(raw_sales):
    silver = marts.silver_sales(raw_sales)
    for found in (no_null_category, positive_amounts, total_calculation):
        assert found(silver).isEmpty()
    assert q.failing_rows(silver, q.unique("txn_id", nulls_repeat=True)).isEmpty()


def test_null_category_is_a_warning(raw_sales):
    silver = marts.silver_sales(raw_sales.withColumn("category", F.when(F.col("txn_id") != "T002", F.col("category"))))
    check = q.violation_query("no_null_category", no_null_category, severity="warn")
    assert status(silver, check)["no_null_category"][0::2] == (1, "warned")


def test_failing_sample(sales):
    sample = q.failing_sample(sales, q.not_null("id"), ["kind"], 1).collect()
    assert [r["kind"] for r in sample] == ["a"]


def test_freshness(spark, rows):
    now = datetime(2024, 1, 10)
    df = spark.createDataFrame([("new", now), ("old", now - timedelta(hours=30)), ("dead", now - timedelta(days=9)), ("none", None)], "g string, ts timestamp")
    got = dict(rows(q.freshness(df, "ts", "2024-01-10 00:00:00", ["g"]), "g", "status"))
    assert got == {"new": "pass", "old": "warn", "dead": "error", "none": "error"}


def test_schema_contract(spark, rows):
    df = spark.createDataFrame([(1, "a", 1.0)], "id int, name string, extra double")
    got = dict(rows(q.schema_contract(df, [("id", "bigint", True), ("name", "string", False), ("ts", "datetime", True)]), "column", "status"))
    assert got == {"id": "mistyped", "name": "nullable", "ts": "missing", "extra": "extra"}
