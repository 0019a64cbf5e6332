from pyspark.sql import functions as F

from stratalake.operators.upsert import keep_last, merge, merge_stats


def frame(spark, ids, factor=10.5):
    return spark.createDataFrame([(i, f"n{i}", i * factor) for i in ids], "id bigint, name string, value double")


def test_merge_ten_and_three_gives_eleven(spark, rows):
    existing, batch = frame(spark, range(1, 11)), frame(spark, [1, 2, 100], 99.0)
    merged = merge(existing, batch, ["id"])
    assert merged.count() == 11
    assert rows(merged.where("id in (1, 2, 100)"), "id", "value") == [(1, 99.0), (100, 9900.0), (2, 198.0)]
    assert rows(merge_stats(existing, batch, ["id"])) == [(1, 2)]
    assert rows(merge(existing, batch, ["id"], existing_unique=True)) == rows(merged)


def test_merge_twice_changes_nothing(spark, rows):
    existing, batch = frame(spark, range(1, 11)), frame(spark, [1, 2, 100], 99.0)
    once = merge(existing, batch, ["id"])
    assert rows(merge(once, batch, ["id"])) == rows(once)


def test_null_keys_are_one_key(spark, rows):
    existing = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int")
    batch = spark.createDataFrame([(None, 2), (None, 3)], "k int, v int")
    expected = [(1, 1), (None, 3)]
    assert rows(merge(existing, batch, ["k"], ["v"])) == expected
    assert rows(merge(existing, batch, ["k"], ["v"], existing_unique=True)) == expected
    assert rows(merge_stats(existing, batch, ["k"])) == [(0, 1)]


def test_stats_ignore_duplicates(spark, rows):
    existing = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    batch = spark.createDataFrame([(1,), (1,), (3,), (3,)], "k int")
    assert rows(merge_stats(existing, batch, ["k"])) == [(1, 1)]


def test_batch_may_derive_from_the_table(spark, rows):
    table = frame(spark, range(1, 6))
    batch = table.where("id <= 2").withColumn("value", F.lit(0.0))
    expected = [(1, 0.0), (2, 0.0), (3, 31.5), (4, 42.0), (5, 52.5)]
    assert rows(merge(table, batch, ["id"], existing_unique=True), "id", "value") == expected
    assert rows(merge(table, batch, ["id"]), "id", "value") == expected


def test_new_and_missing_columns_become_null(spark, rows):
    existing = spark.createDataFrame([(1, "a")], "k int, x string")
    batch = spark.createDataFrame([(2, "b")], "k int, y string")
    assert rows(merge(existing, batch, ["k"])) == [(1, "a", None), (2, None, "b")]


def test_keep_last_orders_and_breaks_ties(spark, rows):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, None, "z"), (2, 0, "y")], "k int, t int, v string")
    assert rows(keep_last(df, ["k"], ["t"])) == [(1, 7, "c"), (2, 0, "y")]


def test_keep_last_with_maps(spark, rows):
    df = spark.createDataFrame([(1, 1, {"a": 1}), (1, 2, {"b": 2})], "k int, t int, m map<string,int>")
    assert rows(keep_last(df, ["k"], ["t"])) == [(1, 2, {"b": 2})]


def test_hot_key_leaves_its_partition_once(spark):
    """The maximum is taken before the shuffle."""
    df = spark.range(100_000, numPartitions=4).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    plan = keep_last(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_max")
    assert keep_last(df, ["k"], ["t"]).first()["t"] == 99_999
