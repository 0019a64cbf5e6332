import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalake.functions.cleaning import add_audit_columns
from stratalake.operators.upsert import keep_last
from stratalake.session import shared_dir
from stratalake.sources import files
from stratalake.sources.tables import Lake
from stratalake.streaming import ingest


def test_parquet_round_trip(spark, tmp_path, rows):
    df = spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") * 1.5).alias("value"))
    files.write_parquet(df, str(tmp_path / "t"))
    back = files.read_parquet(spark, str(tmp_path / "t"), ["id", "value"], "id >= 90", 5)
    assert back.columns == ["id", "value"] and back.count() == 5
    assert rows(files.read_parquet(spark, str(tmp_path / "t"))) == rows(df)


def test_partitioned_write_touches_only_its_partitions(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    files.write_parquet(spark.createDataFrame([(1, "A"), (2, "B")], "v int, category string"), path, ["category"])
    files.write_parquet(spark.createDataFrame([(9, "B")], "v int, category string"), path, ["category"], only_touched=True)
    assert rows(spark.read.parquet(path), "v", "category") == [(1, "A"), (9, "B")]


def test_inventory_and_hashes(spark, tmp_path, rows):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_text("x\n1\n")
    (tmp_path / "in" / "sub" / "b.JSON").write_text("{}")
    found = files.inventory(spark, str(tmp_path / "in"))
    assert rows(found, "name", "extension", "length") == [("a.csv", "csv", 4), ("b.JSON", "json", 2)]
    assert rows(files.inventory(spark, str(tmp_path / "in"), "*.csv"), "name") == [("a.csv",)]
    assert files.file_hashes(spark, str(tmp_path / "in"), "*.csv").first()["file_hash"] == hashlib.md5(b"x\n1\n").hexdigest()


@pytest.mark.parametrize("size, text", [(5, "5.0 B"), (2048, "2.0 KB"), (5 * 1024**2, "5.0 MB"), (3 * 1024**3, "3.0 GB"), (2 * 1024**4, "2.0 TB")])
def test_size_text(spark, size, text):
    assert spark.range(1).select(files.size_text(F.lit(size).cast("bigint"))).first()[0] == text


def test_landing_by_extension(spark, tmp_path, rows):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "sales_S1_2024-01-15.csv").write_text("Transaction ID,Qty\nT1,2\n")
    (folder / "odd.csv").write_text("Transaction ID,Qty\nT2,3\n")
    (folder / "x.jsonl").write_text('{"k": 1}\n')
    df = files.read_landing(spark, str(folder), "csv", "`Transaction ID` string, Qty int")
    df = files.rename(df, {"Transaction ID": "txn_id", "Qty": "quantity"})
    df = files.with_filename_fields(df, r"^sales_(\w+)_(\d{4}-\d{2}-\d{2})\.csv$", ["store_id", "day"])
    df = add_audit_columns(df, "pos", "2024-01-16 00:00:00")
    assert rows(df, "txn_id", "quantity", "store_id", "day", "_source") == [("T1", 2, "S1", "2024-01-15", "pos"), ("T2", 3, None, None, "pos")]
    assert files.read_landing(spark, str(folder), "jsonl", "k int").first()["k"] == 1
    with pytest.raises(ValueError):
        files.read_landing(spark, str(folder), "csv")
    with pytest.raises(ValueError):
        files.read_landing(spark, str(folder), "xlsx")


def test_registered_parser(spark, tmp_path, rows):
    def fixed_width(data, filename):
        lines = data.read().decode().splitlines()
        return pd.DataFrame({"code": [x[:2] for x in lines], "n": [int(x[2:]) for x in lines], "file": filename})

    files.register_parser("fixed_width", fixed_width, "code string, n int, file string")
    (tmp_path / "a.dat").write_text("AB 7\nCD12\n")
    (tmp_path / "b.dat").write_text("EF 1\n")
    df = files.read_landing(spark, str(tmp_path), "dat", parser="fixed_width")
    assert rows(df, "code", "n", "file") == [("AB", 7, "a.dat"), ("CD", 12, "a.dat"), ("EF", 1, "b.dat")]
    assert df.where(F.col("_source_file").endswith("a.dat")).count() == 2
    assert "fixed_width" in files.list_parsers()
    with pytest.raises(KeyError, match="no parser"):
        files.get_parser("nope")


def test_json_fixtures(spark, tmp_path, rows):
    def write(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    some = [{"id": 1, "at": "2024-01-15 10:30:00"}, {"id": 2, "at": None}]
    listed = files.json_fixture(spark, write("raw-list.json", some), {"raw_list": "id int, at timestamp"})
    assert list(listed) == ["raw_list"] and listed["raw_list"].dtypes == [("id", "int"), ("at", "timestamp")]
    named = files.json_fixture(spark, write("n.json", {"table": "bronze.sales", "rows": some}))
    assert named["bronze_sales"].count() == 2
    many = files.json_fixture(spark, write("m.json", {"tables": [{"table": "a.x", "rows": some}, {"table": "y", "rows": some[:1]}]}))
    assert {k: v.count() for k, v in many.items()} == {"a_x": 2, "y": 1}
    single = files.json_fixture(spark, write("one.json", {"id": 5}))
    assert single["one"].first()["id"] == 5


def test_csv_and_parquet_fixtures(spark, tmp_path):
    (tmp_path / "raw-sales.csv").write_text("id,name\n1,a\n")
    name, df = files.csv_fixture(spark, str(tmp_path / "raw-sales.csv"), "id int, name string")
    assert name == "raw_sales" and df.first()["id"] == 1
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    name, df = files.parquet_fixture(spark, str(tmp_path / "p.parquet"))
    assert name == "p" and df.count() == 3


def test_shared_dir_uses_the_configured_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(base)
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


# --- streams ------------------------------------------------------------------

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def test_stream_of_files_equals_batch(spark, data, tmp_path, rows):
    """Two rounds of availableNow: new files only, upserted, same as one batch."""
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    lake = Lake(spark, str(tmp_path / "lake"))
    events = spark.read.parquet(f"{data}/events.parquet")
    keyed = events.withColumn("event_id", F.col("event_id") % 500)
    keyed.where("user_id % 2 = 0").repartition(3).write.parquet(source)

    def run():
        stream = ingest.stream_files(spark, source, EVENT, pattern="*.parquet", max_files_per_trigger=1)
        ingest.merge_stream(stream, lake, "silver.events", ["event_id"], ["ts"], checkpoint).awaitTermination()

    run()
    written = {r["path"] for r in files.inventory(spark, lake.path("silver.events"), "*.parquet").collect()}
    run()
    assert {r["path"] for r in files.inventory(spark, lake.path("silver.events"), "*.parquet").collect()} == written
    assert lake.read("silver.events").count() == keyed.where("user_id % 2 = 0").select("event_id").distinct().count()


def test_stream_merge_in_arrival_order_matches_keep_last(spark, tmp_path, rows):
    source, lake = str(tmp_path / "in"), Lake(spark, str(tmp_path / "lake"))
    schema = "k int, t int"
    spark.createDataFrame([(i % 7, i) for i in range(50)], schema).coalesce(1).write.parquet(source)
    spark.createDataFrame([(i % 9, i) for i in range(50, 90)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = ingest.stream_files(spark, source, schema)
    ingest.merge_stream(stream, lake, "silver.k", ["k"], ["t"], str(tmp_path / "c")).awaitTermination()
    assert rows(lake.read("silver.k")) == rows(keep_last(spark.read.parquet(source), ["k"], ["t"]))


def test_late_duplicates_are_dropped(spark, data, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.read.parquet(f"{data}/events.parquet")
    events.union(events).coalesce(1).write.parquet(source)
    stream = ingest.first_per_key(ingest.stream_files(spark, source, EVENT), ["event_id"], "ts", "2 days")
    ingest.append_stream(stream, out, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(out).count() == events.count()
