"""Checksums, buckets, space-filling order and sketches."""

import re

import pytest
from pyspark.sql import functions as F

from stratalake.operators import checksums, layout, sketches
from stratalake.operators.diff import table_diff
from stratalake.operators.upsert import merge, merge_marked, merge_stats
from stratalake.session import path_exists
from stratalake.sources.files import inventory
from stratalake.sources.tables import Lake


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path), "one")


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return df._jdf.queryExecution().executedPlan().toString()


# --- checksums --------------------------------------------------------------


def leaves(df, keys, columns, **options):
    return sorted(tuple(r) for r in checksums.checksums(df, keys, columns, 8, 4, **options).collect())


def test_checksums_do_not_depend_on_order_but_on_every_value(spark):
    rows = [(i % 50, None if i % 7 == 0 else i, "x" * (i % 3), float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, a int, b string, c double")
    base = leaves(df, ["k"], ["a", "b", "c"])
    assert base == leaves(df.orderBy(F.desc("a")).repartition(5), ["k"], ["a", "b", "c"])
    assert sum(r[2] for r in base) == 300
    for change in (df.limit(299), df.union(df.limit(1)), df.withColumn("b", F.when(F.col("a") == 8, "q").otherwise(F.col("b")))):
        assert leaves(change, ["k"], ["a", "b", "c"]) != base


def test_nulls_move_between_columns_and_zeros(spark):
    one = spark.createDataFrame([(1, None, "a", 0.0)], "k int, x string, y string, z double")
    two = spark.createDataFrame([(1, "a", None, 0.0)], one.schema)
    zero = spark.createDataFrame([(1, None, "a", -0.0)], one.schema)
    columns = ["x", "y", "z"]
    assert leaves(one, ["k"], columns) != leaves(two, ["k"], columns)
    assert leaves(one, ["k"], columns) == leaves(zero, ["k"], columns)


def test_checksum_diff_gives_table_diff(spark, rows):
    before = spark.createDataFrame([(None if i == 9 else i, i % 3, f"v{i}") for i in range(500)] + [(3, 0, "v3")] * 2, "k int, a int, b string")
    after = before.where("k is null or k % 41 <> 5").withColumn("a", F.when(F.col("k") == 100, None).otherwise(F.col("a")))
    after = after.union(spark.createDataFrame([(9000, 1, "n"), (3, 0, "v3")], before.schema))
    want = rows(table_diff(before, after, ["k"]))
    for buckets, parts in ((256, 64), (4, 2), (1, 1)):
        assert rows(checksums.checksum_diff(before, after, ["k"], buckets=buckets, parts=parts)) == want
    changed = rows(checksums.checksum_diff(before, after, ["k"], unchanged=False, parts=4))
    assert [r for r in want if r[1] != "unchanged"] == [r for r in changed if r[1] != "unchanged"]
    same = checksums.checksum_diff(before, before.repartition(3), ["k"])
    assert {r["status"] for r in same.collect()} == {"unchanged"}
    assert checksums.checksum_diff(before, before, ["k"], unchanged=False).isEmpty()


def test_types_that_differ_fall_back_to_comparing_all(spark, rows):
    before = spark.createDataFrame([(i, i) for i in range(20)], "k int, a int")
    after = before.withColumn("a", F.col("a").cast("long"))
    assert rows(checksums.checksum_diff(before, after, ["k"])) == rows(table_diff(before, after, ["k"]))


def test_second_read_covers_differing_buckets_only(spark, tmp_path, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    one, two = Lake(spark, str(tmp_path), "one"), Lake(spark, str(tmp_path), "two")
    one.create("gold.orders", orders, buckets=64, bucket_by=["o_orderkey"])
    two.create("gold.orders", orders.withColumn("o_totalprice", F.col("o_totalprice") + (F.col("o_orderkey") == 77).cast("int")), buckets=64, bucket_by=["o_orderkey"])
    found = one.diff("gold.orders", two, ["o_orderkey"], unchanged=False)
    text = plan(found)
    read = re.findall(r"PartitionFilters: \[([^\]]*)\]", text)
    assert len(read) == 2 and all(re.search(r"__bucket#\d+ = \d+", r) for r in read)
    assert [tuple(r) for r in found.where("status <> 'unchanged'").collect()] == [(77, "changed")]


# --- buckets ------------------------------------------------------------------


def files(spark, lake):
    found = inventory(spark, lake.base, "*.parquet").where("path like '%__bucket=%'")
    return {r["path"] for r in found.collect()}


def test_upsert_replaces_its_buckets_only(spark, lake, rows):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(400)], "k int, v string")
    assert lake.merge("silver.t", df, ["k"], buckets=16) == {"inserted": 400, "updated": 0}
    assert lake.layout("silver.t") == {"partition_by": [], "buckets": 16, "bucket_by": ["k"]}
    before = files(spark, lake)
    batch = spark.createDataFrame([(3, "new"), (1000, "more")], df.schema)
    done = lake.merge("silver.t", batch, ["k"])
    touched = {r[0] for r in batch.select(checksums.bucket_of(["k"], 16)).collect()}
    assert done == {"inserted": 1, "updated": 1, "buckets": len(touched)}
    kept = {f for f in before if int(re.search(r"__bucket=(\d+)", f)[1]) not in touched}
    assert kept < files(spark, lake) and not (before - kept) & files(spark, lake)
    assert rows(lake.read("silver.t")) == rows(df.where("k <> 3").union(batch)) and lake.read("silver.t").columns == ["k", "v"]


def test_bucketed_tables_keep_their_buckets(spark, lake, rows):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "k int, v string")
    lake.create("silver.t", df, buckets=4, bucket_by=["k"])
    lake.append("silver.t", spark.createDataFrame([(500, "a")], df.schema))
    assert lake.merge("silver.t", spark.createDataFrame([(500, "b"), (7, "c")], df.schema), ["k"])["updated"] == 2
    lake.compact("silver.t")
    assert lake.layout("silver.t")["buckets"] == 4
    lake.rebucket("silver.t", 9)
    assert lake.layout("silver.t") == {"partition_by": [], "buckets": 9, "bucket_by": ["k"]}
    lake.overwrite("silver.t", df)
    assert rows(lake.read("silver.t")) == rows(df)
    assert {r[0] for r in lake.read("silver.t", with_bucket=True).select("__bucket").distinct().collect()} <= set(range(9))
    with pytest.raises(ValueError):
        lake.create("silver.u", df, buckets=4)
    other = Lake(spark, lake.root, "two")
    lake.promote("silver.t", other, ["k"])
    assert other.layout("silver.t")["buckets"] == 9


def test_bucketed_runs(spark, lake, rows):
    df = spark.createDataFrame([(i, i) for i in range(50)], "k int, at int")
    lake.run("silver.t", df.where("at < 30"), lambda x: x, ["k"], "at", buckets=8)
    done = lake.run("silver.t", df, lambda x: x, ["k"], "at")
    assert (done.rows_read, done.inserted, done.updated) == (20, 20, 0) and lake.layout("silver.t")["buckets"] == 8
    assert rows(lake.read("silver.t")) == rows(df)


def test_merge_marks(spark, rows):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (None, 1, "n"), (2, 6, "bb")], "k int, at int, v string")
    new = spark.createDataFrame([(2, 4, "c"), (3, 1, "d"), (None, 0, "m"), (3, 2, "e")], old.schema)
    for newest in (False, True):
        marked = merge_marked(old, new, ["k"], ["at"], newest)
        assert rows(marked.drop("_mark")) == rows(merge(old, new, ["k"], ["at"], newest_wins=newest))
        assert {r["k"]: r["_mark"] for r in marked.collect()} == {1: "kept", 2: "updated", 3: "inserted", None: "updated"}
    counts = merge_stats(old, new, ["k"]).first()
    assert (counts["inserted"], counts["updated"]) == (1, 2)
    maps = old.withColumn("m", F.create_map(F.lit("x"), "v"))
    assert merge_marked(maps, maps.where("k = 1"), ["k"], ["at"]).where("_mark = 'updated'").count() == 1
    only = merge_marked(old.select("k"), new.select("k"), ["k"])
    assert {r["k"]: r["_mark"] for r in only.collect()} == {1: "kept", 2: "updated", 3: "inserted", None: "updated"}


def test_paths_are_asked_for(spark, tmp_path):
    assert not path_exists(spark, f"{tmp_path}/none/*") and path_exists(spark, f"{tmp_path}")


# --- layout and sketches --------------------------------------------------------


def test_ranks_are_quantiles(spark):
    df = spark.range(1000).select((F.col("id") ** 3).alias("x"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("y"))
    bounds = layout.quantile_bounds(df, ["x"], bits=3)["x"]
    sizes = [r[0] for r in df.groupBy(layout.rank_among(F.col("x").cast("double"), bounds)).agg(F.count("*")).select("count(1)").collect()]
    assert len(sizes) == 8 and max(sizes) < 1000 / 8 * 1.3
    known = sorted(b for b in bounds)
    for value in (known[0], known[0] - 1, known[-1] + 1, known[3]):
        rank = spark.range(1).select(layout.rank_among(F.lit(float(value)), known)).first()[0]
        assert rank == sum(b <= value for b in known)
    assert layout.clustered(df, ["y", "x"], 4).count() == 1000


def test_interleaved_bits(spark):
    df = spark.createDataFrame([(a, b) for a in range(8) for b in range(8)], "a int, b int")
    spots = {(r[0], r[1]): r[2] for r in df.select("a", "b", layout.interleaved([F.col("a"), F.col("b")], 3)).collect()}
    for (a, b), spot in spots.items():
        assert spot == int("".join(x + y for x, y in zip(f"{a:03b}", f"{b:03b}")), 2)


def test_one_value_does_not_fill_one_file(spark):
    df = spark.range(4000).select(F.lit(1).alias("x"), F.lit("2024-01-01").cast("date").alias("d"), "id")
    sizes = layout.clustered(df, ["x", "d"], 8).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2000
    with pytest.raises(TypeError):
        layout.clustered(df.withColumn("t", F.lit("text")), ["t"], 2)


def test_partitioned_tables_have_their_order(spark, lake):
    lake.create("bronze.t", spark.createDataFrame([(1, 2)], "a int, b int"), ["a"])
    with pytest.raises(ValueError):
        lake.cluster("bronze.t", ["b"], 2)


def test_sketches_merge_and_repeat(spark):
    df = spark.range(20_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 3000).alias("c"), F.lit(None).cast("long").alias("none"))
    names = {"c": "c", "none": "none"}
    daily = sketches.distinct_sketches(df, ["day"], names)
    again = sketches.refresh_sketches(sketches.refresh_sketches(None, daily, ["day"], list(names)), daily, ["day"], list(names))
    total = sketches.estimates(sketches.merge_sketches(again.withColumn("all", F.lit(1)), ["all"], list(names)), list(names)).first()
    assert abs(total["c"] - 3000) <= 0.05 * 3000 and not total["none"]


def test_monthly_counts_do_not_read_the_facts_again(spark, tmp_path, data):
    lake = Lake(spark, str(tmp_path))
    lines = spark.read.parquet(f"{data}/lineitem.parquet").withColumn("day", F.to_date("l_shipdate"))
    lake.create("gold.daily", sketches.distinct_sketches(lines, ["l_suppkey", "day"], {"parts": "l_partkey"}))
    merged = sketches.merge_sketches(lake.read("gold.daily"), ["l_suppkey"], ["parts"])
    text = plan(merged)
    assert "lineitem" not in text and text.count("FileScan") == 1
