"""What must not grow with the tables: scans, shuffles, files that one task handles."""

import random

from pyspark.sql import functions as F

from stratalake.operators import quality as q
from stratalake.operators import quantiles
from stratalake.operators.aggregates import grouped_measures
from stratalake.plans import catalogue, extended
from stratalake.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


# --- quantiles -----------------------------------------------------------


def test_quantiles_read_the_table_twice(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(x):
        calls.add(1)
        return x

    df = spark.createDataFrame([(i, i / 7) for i in range(50)], "n int, v double").rdd.map(lambda r: (count(r[0]), r[1])).toDF("n int, v double")
    found = {(r["column"], r["share"]): r["value"] for r in quantiles.table_quantiles(df, [0.1, 1.0]).collect()}
    assert found["n", 0.1] == "4" and found["n", 1.0] == "49" and float(found["v", 1.0]) == 7.0
    assert calls.value == 100


def test_quantiles_outside_their_limits_are_found(spark, monkeypatch):
    values = [(i, float(i % 10) if i % 3 else float("nan")) for i in range(100)]
    df = spark.createDataFrame(values, "n long, v double")
    want = sorted(map(str, quantiles.table_quantiles(df).collect()))
    monkeypatch.setattr(quantiles, "_limits", lambda values, fields, shares: ([100, 100], [[(20, 25), (74, 74)], [(100.0, None)]]))
    assert sorted(map(str, quantiles.table_quantiles(df).collect())) == want


# --- measures ----------------------------------------------------------------


def test_measures_of_many_groups_and_a_busy_one(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice("abc") if rng.random() < 0.9 else None, rng.randrange(3)) for g in range(1500) for _ in range(3)]
    rows += [(None if i % 2 else 7, rng.choice("xyz"), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, c string, u int")
    asked = {"sums": {"n": F.lit(1)}, "distincts": {"kinds": "c", "users": "u"}, "modes": {"top": "c"}}
    got, want = (grouped_measures(df, ["g"], one_pass=one, **asked) for one in (True, False))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.schema.simpleString() == want.schema.simpleString()


def test_measures_shuffle_rows_once(spark):
    df = spark.range(5000).select("id", (F.col("id") % 5).cast("string").alias("c"))
    got = grouped_measures(df, ["id"], sums={"n": F.lit(1)}, distincts={"kinds": "c"}, modes={"top": "c"}, one_pass=True)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Expand" not in text


# --- failing samples ---------------------------------------------------------


def test_checks_of_the_same_columns_count_once(spark, monkeypatch):
    hashes, md5 = [], F.md5
    monkeypatch.setattr(F, "md5", lambda c: hashes.append(c) or md5(c))
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, n int")
    found = q.failing_samples(df, [q.unique("k"), q.unique("k", nulls_repeat=True, severity="warn"), q.unique("k", "n")], ["n"])
    # The shown columns, and each set of columns that is to be unique.
    assert len(hashes) == 3
    assert sorted((r["severity"], r["position"], r["occurrences"], r["row"].get("k")) for r in found.collect()) in (
        [("error", 1, 2, "a"), ("warn", 1, 2, "a"), ("warn", 2, 2, None)], [("error", 1, 2, "a"), ("warn", 1, 2, None), ("warn", 2, 2, "a")]
    )


# --- landed files ----------------------------------------------------


def _pages(spark, folder, n):
    rows = spark.range(n, numPartitions=3).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.lit("<p>").alias("html"))
    rows.write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def _lines(folder):
    return [len(f.read_text().splitlines()) for f in folder.rglob("part-*.json")]


def test_parsed_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    found = catalogue.parsed_pages(spark, _pages(spark, tmp_path, 4500))
    assert found.select("page_id").distinct().count() == found.count() == 4500
    assert max(_lines(tmp_path / "landing-pages")) <= 1000


def test_large_files_are_landed_by_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(extended, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    path = _pages(spark, tmp_path, 30)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        assert extended.parsed_large_files(spark, path).count() == 30
        assert extended.parsed_large_stream(spark, path).count() == 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(n > 0 for n in _lines(tmp_path / "large-file")) >= 3
    assert sum(n > 0 for n in _lines(tmp_path / "record-stream" / "in")) >= 6


# --- compaction --------------------------------------------------------------


def test_compaction_reads_files_where_it_writes_them(spark):
    many, one = (spark.range(100, numPartitions=n) for n in (5, 1))
    assert "Repartition 2, false" in plan(tables._in_files(many, 2))
    for df in (many, one):
        assert tables._in_files(df, 2).rdd.getNumPartitions() == 2
