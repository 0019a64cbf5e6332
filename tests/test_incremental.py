from datetime import datetime, timedelta

import pytest

from stratalake.operators import incremental
from stratalake.operators.incremental import WatermarkStore
from stratalake.operators.registry import ingestion_history, ingestion_record, pending_files
from stratalake.operators.retention import LAYER_RETENTION_DAYS, retain


@pytest.fixture
def events(spark):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + timedelta(hours=i)) for i in range(48)], "id int, ts timestamp")


def test_strictly_above(events):
    assert incremental.newer_than(events, "id", 40).count() == 7
    assert incremental.newer_than(events, "ts", "2024-01-02 00:00:00").count() == 23


def test_no_value_means_all_rows(events):
    assert incremental.newer_than(events, "id", None).count() == 48


def test_lookback(events):
    value = datetime(2024, 1, 2)
    assert incremental.newer_than(events, "ts", value, timedelta(hours=6)).count() == 29
    assert incremental.newer_than(events, "id", 40, 5).count() == 12


def test_compound(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 0), (0, 9)], "a int, b int")
    assert rows(incremental.newer_than_all(df, {"a": 1, "b": 1})) == [(1, 2), (2, 0)]
    assert incremental.newer_than_all(df, {"a": None, "b": None}).count() == 4


def test_filter_reaches_the_scan(spark, data):
    df = incremental.newer_than(spark.read.parquet(f"{data}/events.parquet"), "ts", "2024-01-15 00:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan


def test_compute_watermark(events, spark):
    assert incremental.compute_watermark(events, "id").first()[0] == 47
    assert incremental.compute_watermark(events, "id", "min").first()[0] == 0
    assert incremental.compute_watermark(events.where("id < 0"), "id").first()[0] is None
    with pytest.raises(ValueError, match="max or min"):
        incremental.compute_watermark(events, "id", "avg")
    with pytest.raises(ValueError):
        incremental.compute_watermark(events, "nope")


def test_observed_watermark(events, tmp_path):
    counted, seen = incremental.observe_watermark(events, "id")
    counted.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 48, "watermark": "47"}


def test_store(spark, tmp_path):
    store = WatermarkStore(spark, str(tmp_path / "state"))
    assert store.get("silver.sales", "ts") is None
    assert store.get("silver.sales", "ts", "none yet") == "none yet"
    store.set("silver.sales", "id", 10, "int", row_count=10)
    store.set("silver.sales", "id", 25, "int", row_count=15)
    store.set("silver.events", "ts", "2024-01-02 03:04:05.000006", "timestamp")
    assert store.get("silver.sales", "id") == 25
    assert store.get_state("silver.sales", "id").row_count == 15
    assert store.get_all("silver.events") == {"ts": datetime(2024, 1, 2, 3, 4, 5, 6)}
    assert store.list_pipelines() == ["silver.events", "silver.sales"]
    assert store.history("silver.sales").count() == 2
    store.reset("silver.sales")
    assert store.get("silver.sales", "id") is None
    assert store.list_pipelines() == ["silver.events"]


def test_pending_files(spark, rows):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "file_path string, file_hash string")
    done = ingestion_record(files.where("file_path = 'a'"), "bronze.t", "2024-01-01 00:00:00")
    failed = ingestion_record(files.where("file_path = 'b'"), "bronze.t", "2024-01-02 00:00:00", "failed")
    changed = ingestion_record(
        spark.createDataFrame([("c", "old")], "file_path string, file_hash string"), "bronze.u", "2024-01-03 00:00:00"
    )
    registry = done.unionByName(failed).unionByName(changed)
    assert rows(pending_files(files, registry), "file_path") == [("b",), ("c",), ("d",)]
    assert rows(pending_files(files, registry, by_hash=False), "file_path") == [("b",), ("d",)]
    assert [r["file_path"] for r in ingestion_history(registry).collect()] == ["c", "b", "a"]
    assert [r["file_path"] for r in ingestion_history(registry, "bronze.t").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        ingestion_record(files, "t", "2024-01-01", "unknown")


def test_retention(events):
    assert retain(events, "ts", "2024-01-02", 0).count() == 24
    assert retain(events, "ts", "2024-04-10", LAYER_RETENTION_DAYS["bronze"]).count() == 0
    assert retain(events, "ts", "2034-01-01", LAYER_RETENTION_DAYS["gold"]).count() == 48
