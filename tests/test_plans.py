"""What the plans must and must not contain."""

import pytest

from stratalake.plans.catalogue import QUERIES

# Queries that write tables first; their plans are simple reads.
EAGER = {
    "partitioned_roundtrip", "stored_upsert", "read_snapshot", "read_overwritten", "table_history",
    "incremental_runs", "stream_upsert", "published_product", "lookback_runs", "full_refresh_run", "compacted_table",
    "promoted_table", "retained_partitions", "lake_tables", "file_inventory", "landing_csv", "landing_json", "parsed_pages",
    "table_fixtures", "consumed_view", "checksum_diff", "bucketed_upsert", "rebucketed_table", "clustered_table", "monthly_distinct_customers",
    "widened_table", "parsed_large_files", "parsed_large_stream", "stream_first_per_key", "stream_silence", "appended_stream",
    "bucketed_stream_upsert", "watermark_history", "hashed_files", "filename_fields",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_pairing_and_no_python(name, spark, data):
    text = plan(QUERIES[name](spark, data))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonMapIn", "FlatMapGroups"):
        assert operator not in text


@pytest.mark.parametrize(
    "name, pushed, read",
    [
        ("scan_project_filter", "EqualTo(l_returnflag,R)", "l_extendedprice:double,l_returnflag:string>"),
        ("incremental_filter_id", "GreaterThan(event_id,5000)", "event_id:bigint"),
        ("retention_filter", "GreaterThanOrEqual(l_shipdate", "struct<l_orderkey:bigint,l_linenumber:int,l_shipdate:timestamp_ntz>"),
        ("table_count", "PushedFilters: []", "ReadSchema: struct<>"),
    ],
)
def test_filters_and_columns_reach_the_scan(name, pushed, read, spark, data):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(QUERIES[name](spark, data))
    assert pushed in text
    assert read in text


def test_watermarks_read_once(spark, data):
    assert plan(QUERIES["watermark_value"](spark, data)).count("FileScan") == 1


def test_top_k_is_not_a_full_sort(spark, data):
    assert "TakeOrderedAndProject" in plan(QUERIES["preview_topn"](spark, data))


def test_many_rules_scan_the_table_twice_at_most(spark, data):
    """One pass for all row rules, one for uniqueness."""
    text = plan(QUERIES["quality_suite_summary"](spark, data))
    assert text.count("lineitem.parquet") == 2


def test_upsert_shuffles_once(spark, data):
    text = plan(QUERIES["merge_upsert"](spark, data))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_max" in text
