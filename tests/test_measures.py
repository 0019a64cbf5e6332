"""Modes by candidates, failing samples, quantiles and schema changes."""

import json
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.operators import quality as q
from stratalake.operators import quantiles, schemas
from stratalake.operators.aggregates import _count_error, mode_by, mode_by_candidates
from stratalake.plans.catalogue import QUERIES, faulty_sales, suite


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- modes ----------------------------------------------------------------------


def test_candidates_equal_all_values(spark, rows):
    rng = random.Random(3)
    data = [("spread", f"v{rng.randrange(5000)}") for _ in range(4000)]
    data += [("busy", "top")] * 900 + [("busy", f"u{i}") for i in range(900)]
    data += [("tie", x) for x in ("b", "a", "b", "a", "c")] + [("nulls", None)] * 3 + [(None, "x"), (None, None), (None, "x")]
    df = spark.createDataFrame(data, "g string, v string").repartition(6)
    want = rows(mode_by(df, ["g"], "v", "m"))
    for tracked in (4, 16, 64):
        assert rows(mode_by_candidates(df, ["g"], "v", "m", tracked)) == want
    two = df.withColumn("h", F.length("v") % 2)
    assert rows(mode_by_candidates(two, ["g", "h"], "v", "m", 8)) == rows(mode_by(two, ["g", "h"], "v", "m"))
    assert mode_by_candidates(df.limit(0), ["g"], "v", "m").isEmpty()


def test_error_bound_of_the_sketch():
    assert _count_error(64) == 3.5 / 128 and _count_error(6) == 3.5 / 8 and _count_error(7) == 3.5 / 16


def test_only_unproven_groups_shuffle_all_values(spark):
    """Counters are aggregated before the shuffle; the present way runs behind an anti join."""
    df = spark.createDataFrame([("a", "x")], "g string, v string")
    text = plan(mode_by_candidates(df, ["g"], "v", "m"))
    assert "partial_approx_top_k" in text and "LeftAnti" in text


# --- failing samples --------------------------------------------------------------


def test_samples_of_all_checks_read_the_table_once(spark, data):
    found = q.failing_samples(faulty_sales(spark, data), suite(), ["txn_id", "quantity"])
    assert plan(found).count("lineitem.parquet") == 1


def test_samples_show_failing_rows_only(spark):
    rows = [(i, None if i % 10 == 0 else i % 7, f"id{i % 90}" if i % 13 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "n int, v int, k string")
    checks = [
        q.not_null("v"), q.positive("v"), q.unique("k"), q.unique("k", nulls_repeat=True, severity="warn"), q.rule("small", "n < 97"),
        q.rule("skipped", "n < 0", skip=True), q.rule("unknown", "nothing > 1"), q.violation_query("last", lambda d: d.where("n = 99").select("n")),
        q.scalar_query("count", lambda d: d.agg(F.count("*")), expect=100), q.not_empty(), q.rule("good", "n >= 0"),
    ]
    found = q.failing_samples(df, checks, ["n", "v"], 3).collect()
    by = {}
    for r in found:
        by.setdefault((r["check"], r["severity"]), []).append(r)
    assert set(by) == {("v_not_null", "error"), ("v_positive", "error"), ("k_unique", "error"), ("k_unique", "warn"), ("small", "error"), ("last", "error")}
    assert all(sorted(r["position"] for r in part) == list(range(1, len(part) + 1)) and len(part) <= 3 for part in by.values())
    assert all("v" not in r["row"] and int(r["row"]["n"]) % 10 == 0 for r in by["v_not_null", "error"])
    assert all(r["row"]["v"] == "0" for r in by["v_positive", "error"])
    assert sorted(r["row"]["n"] for r in by["small", "error"]) == ["97", "98", "99"]
    assert all(r["occurrences"] == 2 and set(r["row"]) == {"k"} for r in by["k_unique", "error"])
    assert by["last", "error"][0]["row"] == {"n": "99"}
    again = q.failing_samples(df.repartition(5), checks, ["n", "v"], 3).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_samples_without_failures(spark):
    df = spark.createDataFrame([(1,)], "n int")
    assert q.failing_samples(df, [q.positive("n")], ["n"]).isEmpty()
    assert q.failing_samples(df, [q.not_empty()], ["n"]).isEmpty()


def test_gate_evaluates_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(x):
        calls.add(1)
        return x

    df = spark.createDataFrame([(1,)], "n int").rdd.map(lambda r: (count(r[0]),)).toDF("n int")
    results = q.gate(q.run_checks(df, [q.positive("n")]))
    seen = calls.value
    assert [r["status"] for r in results.collect()] == ["passed"] and calls.value == seen


# --- quantiles ----------------------------------------------------------------------


def expected(values, share):
    known = sorted(v for v in values if v is not None)
    return known[max(1, math.ceil(round(share * len(known), 9))) - 1] if known else None


def test_exact_quantiles_of_every_kind(spark):
    rng = random.Random(8)
    doubles = [rng.choice([0.0, -0.0, 1.5, -2.25, 1e-300, -1e300, 5e-324, rng.uniform(-9, 9), rng.expovariate(1e-9), 2.0 ** rng.randrange(-60, 60), None]) for _ in range(500)]
    doubles += [float("inf"), float("-inf")]
    longs = [rng.choice([0, 1, -1, 2**63 - 1, -(2**63), rng.randrange(-(10**12), 10**12), None]) for _ in doubles]
    money = [None if rng.random() < 0.1 else Decimal(rng.randrange(-(10**6), 10**6)).scaleb(-2) for _ in doubles]
    small = [rng.randrange(-128, 128) for _ in doubles]
    df = spark.createDataFrame(list(zip(doubles, longs, money, small)), "d double, l long, m decimal(12,2), b byte")
    shares = [0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = {(r["column"], r["share"]): r["value"] for r in quantiles.table_quantiles(df.repartition(3), shares).collect()}
    for name, values, read in (("d", doubles, float), ("l", longs, int), ("m", money, Decimal), ("b", small, int)):
        for share in shares:
            assert read(found[name, share]) == expected(values, share), (name, share)


def test_keys_order_as_doubles_do(spark):
    values = [float("-inf"), -1e308, -3.0, -2.0, -1.9999999999999998, -5e-324, 0.0, 5e-324, 2.2250738585072014e-308, 0.1, 1.0, 1.0000000000000002, 1e308, float("inf"), float("nan")]
    field = T.StructField("x", T.DoubleType())
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i int")
    keys = [r[0] for r in quantiles.order_keys(df.coalesce(1).sortWithinPartitions("i"), [field]).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert [quantiles.from_key(k, T.DoubleType()) for k in keys[:-1]] == [repr(v) for v in values[:-1]]
    assert quantiles.from_key(keys[-1], T.DoubleType()) == "NaN"


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, "x")], "a int, t string")
    assert quantiles.table_quantiles(df).isEmpty()
    assert quantiles.table_quantiles(df.select("t")).isEmpty()
    with pytest.raises(TypeError):
        quantiles.table_quantiles(df, columns=["t"])
    with pytest.raises(ValueError):
        quantiles.table_quantiles(df, [0.0])


def test_quantiles_need_no_sort(spark, data):
    """Every scan is one aggregate with partial counts; the approximate form scans once."""
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    text = plan(quantiles.approximate_quantiles(lines))
    assert text.count("FileScan") == 1 and "Sort " not in text


# --- schemas --------------------------------------------------------------------------


def versions(spark, *snapshots):
    rows = [("p", v, T.StructType.fromDDL(ddl).json()) for v, ddl in snapshots]
    return spark.createDataFrame(rows, "product_name string, version string, schema_snapshot string")


def test_schema_tree_of_nested_types(spark):
    ddl = "a int not null, `b.c` struct<x: array<struct<y: map<string, decimal(10,2)>>>, z: string>, e array<array<date>>"
    tree = schemas.schema_tree(versions(spark, ("1.0.0", ddl)), ["version"])
    found = {r["path"]: (r["type"], r["nullable"]) for r in tree.collect()}
    assert found == {
        "a": ("integer", False), "`b.c`": ("struct", True), "`b.c`.x": ("array", True), "`b.c`.x.element": ("struct", True),
        "`b.c`.x.element.y": ("map", True), "`b.c`.x.element.y.key": ("string", False), "`b.c`.x.element.y.value": ("decimal(10,2)", True),
        "`b.c`.z": ("string", True), "e": ("array", True), "e.element": ("array", True), "e.element.element": ("date", True),
    }


def test_changes_and_their_levels(spark):
    known = versions(
        spark, ("1.0.0", "a int, b struct<x: int, y: string>, c date, d float not null"), ("1.0.1", "a int, b struct<x: int, y: string>, c date, d float not null"),
        ("1.2.0", "a bigint, b struct<x: int, y: string, z: int>, c timestamp_ntz, d double"), ("1.10.0", "a bigint, b struct<x: string>, c timestamp_ntz, d double"),
        ("bad", "a int"),
    )
    changes = schemas.schema_changes(known)
    found = {(r["version"], r["path"]): (r["previous"], r["change"], r["level"]) for r in changes.collect()}
    assert found == {
        ("1.2.0", "a"): ("1.0.1", "widened", "minor"), ("1.2.0", "b.z"): ("1.0.1", "added", "minor"), ("1.2.0", "c"): ("1.0.1", "widened", "minor"),
        ("1.2.0", "d"): ("1.0.1", "widened", "minor"), ("1.10.0", "b.x"): ("1.2.0", "retyped", "major"), ("1.10.0", "b.y"): ("1.2.0", "removed", "major"),
        ("1.10.0", "b.z"): ("1.2.0", "removed", "major"),
    }
    steps = {r["version"]: (r["declared"], r["needed"], r["changes"], r["honest"]) for r in schemas.version_steps(known, changes).collect()}
    assert steps == {"1.0.1": ("patch", "none", 0, True), "1.2.0": ("minor", "minor", 4, True), "1.10.0": ("minor", "major", 3, False)}


TYPES = ["byte", "short", "int", "bigint", "float", "double", "decimal(10,2)", "decimal(12,2)", "decimal(12,4)", "decimal(22,0)", "string", "date", "timestamp_ntz", "boolean"]


def test_lattice_is_an_order_and_both_forms_agree(spark):
    kinds = [T.DataType.fromDDL(t) for t in TYPES]
    names = [json.loads(k.json()) for k in kinds]
    pairs = [(i, j) for i in range(len(kinds)) for j in range(len(kinds))]
    df = spark.createDataFrame([(i, j, names[i], names[j]) for i, j in pairs], "i int, j int, a string, b string")
    told = {(r["i"], r["j"]): r["w"] for r in df.withColumn("w", schemas.widens(F.col("a"), F.col("b"))).collect()}
    below = {(i, j): schemas.is_wider(kinds[i], kinds[j]) for i, j in pairs}
    assert told == below
    for i, j in pairs:
        assert i == j or not (below[i, j] and below[j, i])
        for k in range(len(kinds)):
            assert not (below[i, j] and below[j, k]) or below[i, k] or TYPES[k] == "double", (TYPES[i], TYPES[j], TYPES[k])
    assert schemas.wider(T.DataType.fromDDL("struct<a: int, b: array<int>>"), T.DataType.fromDDL("struct<a: bigint, c: string>")) == T.DataType.fromDDL(
        "struct<a: bigint, b: array<int>, c: string>"
    )
    assert schemas.wider(T.StringType(), T.IntegerType()) is None


def test_queries_are_registered():
    for name in (
        "checksum_diff", "bucketed_upsert", "monthly_distinct_customers", "mode_by_candidates", "clustered_table", "failing_samples",
        "table_quantiles", "schema_changes", "parsed_large_files", "parsed_large_stream", "stream_first_per_key", "stream_silence",
    ):
        assert name in QUERIES
