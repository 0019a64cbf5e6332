from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalake.sources.tables import Lake, TableRef

FRAME = "id bigint, name string, value double, created_at timestamp"


def frame(spark, ids):
    return spark.createDataFrame([(i, f"item_{i}", i * 10.5, datetime(2024, 1, 1)) for i in ids], FRAME)


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"), "dev")


def test_names():
    assert TableRef.parse("sales") == TableRef("bronze", "sales")
    assert TableRef.parse("gold.sales") == TableRef("gold", "sales")
    for bad in ("iron.sales", "gold.", ""):
        with pytest.raises(ValueError):
            TableRef.parse(bad)


def test_create_append_overwrite_history(spark, lake, rows):
    assert not lake.exists("bronze.t")
    assert lake.create("bronze.t", frame(spark, range(1, 11))) == 10
    assert lake.append("bronze.t", frame(spark, range(11, 21))) == 10
    assert lake.read("bronze.t").count() == 20
    assert sorted((r["run"] == "0", r["row_count"]) for r in lake.writes("bronze.t").collect()) == [(False, 10), (True, 10)]
    assert lake.overwrite("bronze.t", frame(spark, [100, 200])) == 2
    assert lake.read("bronze.t").agg(F.sum("id")).first()[0] == 300
    assert rows(lake.writes("bronze.t"), "run", "row_count") == [("0", 2)]
    lake.drop("bronze.t")
    assert not lake.exists("bronze.t")
    with pytest.raises(ValueError):
        lake.read("bronze.t")


def test_overwrite_may_read_the_table_itself(spark, lake):
    lake.create("bronze.t", frame(spark, range(10)))
    lake.overwrite("bronze.t", lake.read("bronze.t").where("id < 5"))
    assert lake.read("bronze.t").count() == 5


def test_merge(spark, lake):
    lake.create("silver.t", frame(spark, range(1, 11)))
    batch = frame(spark, [1, 2, 100]).withColumn("value", F.lit(0.5))
    assert lake.merge("silver.t", batch, ["id"]) == {"inserted": 1, "updated": 2}
    assert lake.read("silver.t").count() == 11
    assert lake.merge("silver.t", batch, ["id"]) == {"inserted": 0, "updated": 3}
    assert lake.read("silver.t").where("value = 0.5").count() == 3


def days(spark, pairs):
    return spark.createDataFrame([(k, date(2024, 1, d), v) for k, d, v in pairs], "k int, _date date, v string")


def test_merge_rewrites_only_touched_partitions(spark, lake, rows):
    lake.merge("silver.d", days(spark, [(1, 1, "a"), (2, 2, "b"), (3, 3, "c")]), ["k"], partition_by=["_date"])
    before = set(lake.read("silver.d").inputFiles())
    # Key 2 moves from the second to the fourth day.
    assert lake.merge("silver.d", days(spark, [(2, 4, "B"), (9, 3, "n")]), ["k"]) == {"inserted": 1, "updated": 1}
    assert rows(lake.read("silver.d"), "k", "v") == [(1, "a"), (2, "B"), (3, "c"), (9, "n")]
    after = set(lake.read("silver.d").inputFiles())
    assert [f.split("/")[-2] for f in before & after] == ["_date=2024-01-01"]
    assert not any("_date=2024-01-02" in f for f in after)


def test_partition_values_with_odd_characters(spark, lake, rows):
    schema = "k int, p string, v int"
    first = spark.createDataFrame([(1, "a b/c=d%20:e", 1), (2, None, 1), (3, "007", 1), (4, "", 1)], schema)
    lake.merge("silver.o", first, ["k"], partition_by=["p"])
    lake.merge("silver.o", spark.createDataFrame([(1, "a b/c=d%20:e", 2), (2, None, 2), (4, "", 2)], schema), ["k", "p"])
    assert rows(lake.read("silver.o")) == [(1, "a b/c=d%20:e", 2), (2, None, 2), (3, "007", 1), (4, None, 2)]
    # Key 1 moves out of the partition whose name needs escaping.
    lake.merge("silver.o", spark.createDataFrame([(1, "b", 3)], schema), ["k"])
    assert rows(lake.read("silver.o")) == [(1, "b", 3), (2, None, 2), (3, "007", 1), (4, None, 2)]


def test_keys_that_stay_need_no_search(spark, lake, rows):
    lake.merge("silver.d", days(spark, [(1, 1, "a"), (2, 2, "b")]), ["k"], partition_by=["_date"])
    batch = days(spark, [(2, 2, "B"), (3, 2, "c")])
    assert lake.merge("silver.d", batch, ["k"], keys_stay=True) == {"inserted": 1, "updated": 1}
    assert rows(lake.read("silver.d"), "k", "v") == [(1, "a"), (2, "B"), (3, "c")]


def test_two_partition_columns(spark, lake, rows):
    schema = "k int, y int, s string, v int"
    lake.merge("gold.t", spark.createDataFrame([(1, 2023, "x", 1), (2, 2024, "x", 1), (3, 2024, "y/z", 1)], schema), ["k"], partition_by=["y", "s"])
    assert lake.merge("gold.t", spark.createDataFrame([(3, 2024, "y/z", 2), (4, 2024, "y/z", 2)], schema), ["k"]) == {"inserted": 1, "updated": 1}
    assert rows(lake.read("gold.t")) == [(1, 2023, "x", 1), (2, 2024, "x", 1), (3, 2024, "y/z", 2), (4, 2024, "y/z", 2)]


def test_what_a_lost_job_leaves_behind_blocks_nothing(spark, lake, tmp_path):
    lake.create("bronze.t", frame(spark, range(3)))
    for left in ("current/dead/_temporary/0", "data-dead/__run=0/_temporary/0", "data-dead2/__run=0"):
        (tmp_path / "lake/dev/bronze/t" / left).mkdir(parents=True)
    (tmp_path / "lake/dev/bronze/t/data-dead2/__run=0/part-0.parquet").write_bytes(b"not parquet")
    assert lake.read("bronze.t").count() == 3
    lake.append("bronze.t", frame(spark, range(3, 5)))
    assert lake.overwrite("bronze.t", lake.read("bronze.t")) == 5
    assert lake.merge("bronze.t", frame(spark, [4, 9]), ["id"]) == {"inserted": 1, "updated": 1}
    assert lake.read("bronze.t").count() == 6


def test_newest_wins_in_any_order(spark, lake, rows):
    schema = "k int, at int, v string"
    for batch in ([(1, 5, "new")], [(1, 3, "old"), (2, 1, "x")], [(1, 5, "new")]):
        lake.merge("silver.t", spark.createDataFrame(batch, schema), ["k"], ["at"], newest_wins=True)
    assert rows(lake.read("silver.t")) == [(1, 5, "new"), (2, 1, "x")]


def test_staging_is_removed(spark, lake, tmp_path):
    lake.merge("silver.d", days(spark, [(1, 1, "a")]), ["k"], partition_by=["_date"])
    lake.merge("silver.d", days(spark, [(1, 2, "b")]), ["k"])
    assert list((tmp_path / "lake/dev/_staging").iterdir()) == []


def test_failed_write_leaves_the_table_as_it_was(spark, lake):
    lake.create("bronze.t", frame(spark, range(10)))
    broken = frame(spark, range(5)).withColumn("name", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        lake.overwrite("bronze.t", broken)
    assert lake.read("bronze.t").count() == 10
    assert lake.overwrite("bronze.t", frame(spark, range(3))) == 3
    assert lake.read("bronze.t").count() == 3


def test_new_columns_and_changed_types(spark, lake, rows):
    lake.create("bronze.t", spark.createDataFrame([(1, "a")], "k int, x string"))
    lake.append("bronze.t", spark.createDataFrame([(2, "b", 9)], "k int, x string, y int"))
    assert rows(lake.read("bronze.t")) == [(1, "a", None), (2, "b", 9)]
    with pytest.raises(ValueError):
        lake.append("bronze.t", spark.createDataFrame([("3", "c")], "k string, x string"))


def test_compact_and_retain(spark, lake):
    lake.create("bronze.t", frame(spark, range(100)).repartition(8))
    assert lake.compact("bronze.t", 1) == 100
    assert lake.tables("bronze").first()["name"] == "t"
    assert len(lake.read("bronze.t").inputFiles()) == 1
    later = frame(spark, range(100, 110)).withColumn("created_at", F.lit("2024-06-01").cast("timestamp"))
    lake.append("bronze.t", later)
    assert lake.retain("bronze.t", "created_at", "2024-06-10", 90) == 10
    assert lake.read("bronze.t").count() == 10


def test_tables_and_views(spark, lake, rows):
    lake.create("bronze.a", frame(spark, [1]).coalesce(1))
    lake.create("gold.b", frame(spark, [1, 2]).coalesce(1))
    lake.create("gold.c", frame(spark, [1]))
    lake.drop("gold.c")
    lake.overwrite("bronze.a", frame(spark, [2]).coalesce(1))
    assert rows(lake.tables(), "layer", "name", "files") == [("bronze", "a", 1), ("gold", "b", 1)]
    assert lake.register_views() == ["bronze_a", "gold_b"]
    assert spark.sql("select count(*) from gold_b").first()[0] == 2


def test_workspaces_are_separate_until_promoted(spark, tmp_path, lake):
    prod = Lake(spark, lake.root, "prod")
    lake.create("gold.t", frame(spark, [1, 2]))
    assert not prod.exists("gold.t")
    assert lake.promote("gold.t", prod) == {"inserted": 2, "updated": 0}
    lake.merge("gold.t", frame(spark, [2, 3]), ["id"])
    assert lake.promote("gold.t", prod, ["id"]) == {"inserted": 1, "updated": 2}
    assert prod.read("gold.t").count() == 3


def test_incremental_runs_equal_one_full_run(spark, lake, rows):
    start = datetime(2024, 1, 1)
    schema = "id int, v string, at timestamp, _date date"
    line = lambda i, v, day: (i, v, start + timedelta(days=day, minutes=i), (start + timedelta(days=day)).date())
    first = [line(1, "a", 0), (2, None, start, start.date()), line(3, "c", 1)]
    second = [line(1, "A", 2), line(4, "d", 2)]
    keep = lambda df: df.where("v is not null")

    def run(table, data, **options):
        source = spark.createDataFrame(data, schema)
        return lake.run(table, source, keep, ["id"], "at", ["at"], ["_date"], **options)

    one = run("silver.inc", first)
    assert (one.rows_read, one.inserted, one.is_incremental) == (2, 2, False)
    two = run("silver.inc", first + second)
    assert (two.rows_read, two.inserted, two.updated, two.is_incremental) == (2, 1, 1, True)
    again = run("silver.inc", first + second)
    assert (again.rows_read, again.inserted, again.updated) == (0, 0, 0)
    back = run("silver.inc", first + second, lookback=timedelta(days=5))
    assert back.rows_read == 4 and back.inserted == 0
    full = run("silver.full", first + second, full_refresh=True)
    assert full.inserted == 3
    assert rows(lake.read("silver.inc")) == rows(lake.read("silver.full"))
    assert lake.state.get("silver.inc", "at") == second[1][2]


def test_lookback_needs_a_key(spark, lake):
    with pytest.raises(ValueError, match="unique_key"):
        lake.run("silver.t", frame(spark, [1]), lambda df: df, watermark="created_at", lookback=timedelta(days=3))


def test_the_value_never_moves_back(spark, lake):
    at = lambda day: datetime(2024, 1, day)
    line = lambda i, day: spark.createDataFrame([(i, at(day))], "id int, at timestamp")
    run = lambda df: lake.run("silver.t", df, lambda x: x, ["id"], "at", ["at"], lookback=timedelta(days=3))
    run(line(1, 10))
    assert run(line(2, 9)).watermark.startswith("2024-01-10")
    assert lake.state.get("silver.t", "at") == at(10)


def test_a_keyless_run_may_be_repeated(spark, lake):
    source = spark.createDataFrame([(i,) for i in range(5)], "id int")
    run = lambda n: lake.run("bronze.t", source.where(f"id < {n}"), lambda df: df, watermark="id")
    run(2)
    real, lake.state.set = lake.state.set, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        run(4)
    lake.state.set = real
    run(5)
    assert sorted(r.id for r in lake.read("bronze.t").collect()) == [0, 1, 2, 3, 4]


def test_retention_drops_partitions_and_touches_no_other(spark, lake, rows):
    lake.create("bronze.d", days(spark, [(1, 1, "a"), (2, 5, "b")]).union(spark.createDataFrame([(3, None, "c")], "k int, _date date, v string")), ["_date"])
    before = set(lake.read("bronze.d").inputFiles())
    assert lake.retain("bronze.d", "_date", "2024-01-06", 3) == 2
    assert rows(lake.read("bronze.d"), "k") == [(2,), (3,)]
    assert set(lake.read("bronze.d").inputFiles()) < before


def test_full_run_replaces_and_empty_run_writes_nothing(spark, lake):
    source = frame(spark, range(5))
    assert lake.run("gold.t", source, lambda df: df).inserted == 5
    assert lake.run("gold.t", source, lambda df: df.where("id < 2")).inserted == 2
    assert lake.run("gold.t", source, lambda df: df.where("false")).inserted == 0
    assert lake.read("gold.t").count() == 2
