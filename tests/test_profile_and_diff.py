import pytest

from stratalake.functions.cleaning import NULL_SPELLINGS, apply_types, clean_null_strings, nanos_to_timestamps
from stratalake.operators import diff, profile


@pytest.fixture
def mixed(spark):
    return spark.createDataFrame([(1, "a", None), (2, "a", 1.5), (3, None, 1.5), (None, "b", -2.0)], "i int, s string, d double")


def test_null_report(mixed, rows):
    assert rows(profile.null_report(mixed), "column", "nulls", "rows", "pct") == [("d", 1, 4, 25.0), ("i", 1, 4, 25.0), ("s", 1, 4, 25.0)]
    assert rows(profile.null_totals(mixed)) == [(3, 12, 25.0)]
    assert rows(profile.null_totals(mixed.where("false"))) == [(0, 0, 0.0)]


@pytest.mark.parametrize("approximate", [False, True])
def test_table_profile(mixed, rows, approximate):
    got = rows(profile.table_profile(mixed, approximate), "column", "rows", "nulls", "distinct", "min", "max")
    assert got == [("d", 4, 1, 2, "-2.0", "1.5"), ("i", 4, 1, 3, "1", "3"), ("s", 4, 1, 2, "a", "b")]


def test_profile_of_nested_columns(spark, rows):
    df = spark.createDataFrame([([1, 2], {"a": 1}), ([1, 2], {"b": 1})], "a array<int>, m map<string,int>")
    assert rows(profile.table_profile(df), "column", "distinct") == [("a", 1), ("m", 2)]


def test_schema_describe_preview(mixed, rows):
    assert rows(profile.schema_table(mixed), "column", "type") == [("d", "double"), ("i", "int"), ("s", "string")]
    assert rows(profile.describe(mixed, "silver.mixed"), "name", "row_count", "column_count") == [("silver.mixed", 4, 3)]
    assert rows(profile.preview(mixed, 1, ["i"], [mixed["i"].desc()])) == [(3,)]


def test_clean_null_strings(spark, rows):
    texts = [(i, f" {t}\t", float("nan")) for i, t in enumerate(NULL_SPELLINGS)] + [(99, " keep me ", 1.0)]
    cleaned = clean_null_strings(spark.createDataFrame(texts, "i int, t string, n double"))
    assert cleaned.where("t is null").count() == 16
    assert rows(cleaned.where("t is not null"), "t") == [(" keep me ",)]
    assert cleaned.where("isnan(n)").count() == 16


def test_apply_types(spark, rows):
    df = spark.createDataFrame([("1", "2.345", "x")], "a string, b string, c string")
    typed = apply_types(df, {"a": "int", "b": "decimal(10,2)", "c": "date"})
    assert [f.dataType.simpleString() for f in typed.schema] == ["int", "decimal(10,2)", "date"]
    assert [str(v) for v in typed.first()] == ["1", "2.35", "None"]
    with pytest.raises(ValueError):
        apply_types(df, {"b": "decimal"})


def test_nanoseconds(spark):
    df = spark.createDataFrame([(1_700_000_000_123_456_999,), (-1,)], "at bigint")
    got = nanos_to_timestamps(df, ["at"]).selectExpr("unix_micros(at)").collect()
    assert [r[0] for r in got] == [1_700_000_000_123_456, -1]


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.0), (3, None), (4, 4.0)], "k int, v double")
    right = spark.createDataFrame([(1, 1.005), (2, 2.0), (3, None), (5, 5.0)], "k int, v double")
    return left, right


def test_symmetric_diff(sides, rows):
    left, right = sides
    assert rows(diff.diff_counts(left, right)) == [(3, 2, 5)]
    assert rows(diff.diff_counts(left, right, distinct=True)) == [(2, 2, 4)]
    assert diff.symmetric_diff(left, left).isEmpty()


def test_diff_agrees_with_except_all(sides):
    left, right = sides
    counts = diff.diff_counts(left, right).first()
    assert counts["only_left"] == left.exceptAll(right).count()
    assert counts["only_right"] == right.exceptAll(left).count()


def test_table_diff(sides, rows):
    left, right = sides
    assert rows(diff.table_diff(left, right, ["k"])) == [
        (1, "changed"), (2, "changed"), (3, "unchanged"), (4, "removed"), (5, "added"),
    ]


def test_tolerance_diff(sides, rows):
    left, right = sides
    got = dict(rows(diff.tolerance_diff(left, right, ["k"], ["v"]), "k", "status"))
    assert got == {2: "repeated_key", 4: "missing_right", 5: "missing_left"}
    got = dict(rows(diff.tolerance_diff(left, right, ["k"], ["v"], 0.001), "k", "status"))
    assert got[1] == "different"


def test_matches_expected(spark):
    actual = spark.createDataFrame([(1, 1.004, "x")], "k int, v double, note string")
    expected = spark.createDataFrame([(1, 1.0)], "k int, v double")
    assert not diff.matches_expected(actual, expected)
    assert diff.matches_expected(actual, expected, keys=["k"], tolerance=0.01)
    assert diff.matches_expected(actual, expected, columns=["k"])
