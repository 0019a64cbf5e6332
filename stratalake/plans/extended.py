"""Queries of the operators that store, sketch, sample and stream; registered beside those of the catalogue."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.functions.cleaning import add_audit_columns
from stratalake.operators import checksums, incremental, layout, profile, quality, quantiles, schemas, sketches
from stratalake.operators.aggregates import mode_by_candidates
from stratalake.plans import raw
from stratalake.plans.catalogue import (
    EVENTS_AS_OF,
    LINE_KEYS,
    LINE_ORDER,
    QUERIES,
    _sales,
    faulty_sales,
    query,
    suite,
)
from stratalake.plans.raw import table
from stratalake.session import shared_dir
from stratalake.sources.files import file_hashes as hashes_of
from stratalake.sources.files import read_landing, rename, with_filename_fields
from stratalake.sources.records import register_records
from stratalake.sources.tables import Lake
from stratalake.streaming.ingest import append_stream, merge_stream, stream_files
from stratalake.streaming.state import first_and_late, silences

# --- diff by checksums, upsert by buckets, layout -----------------------------


def corrected_orders(spark, path) -> DataFrame:
    """Orders with a few prices corrected, a few rows gone and a few added."""
    orders, key = table(spark, path, "orders"), F.col("o_orderkey")
    kept = orders.where(key % 997 != 5).withColumn("o_totalprice", F.col("o_totalprice") + F.when(key % 997 == 7, 1.0).otherwise(0.0))
    return kept.unionByName(orders.where(key % 997 == 11).withColumn("o_orderkey", key + 1_000_000_000))


@query
def checksum_diff(spark, path):
    """Two workspaces' tables, stored in buckets: only the buckets whose checksums differ are compared row by row."""
    root = shared_dir(spark, "checksum-diff")
    dev, prod = Lake(spark, root, "dev"), Lake(spark, root, "prod")
    for lake, rows in ((dev, table(spark, path, "orders")), (prod, corrected_orders(spark, path))):
        lake.create("gold.orders", rows, buckets=64, bucket_by=["o_orderkey"])
    return dev.diff("gold.orders", prod, ["o_orderkey"])


@query
def checksum_nodes(spark, path):
    """The tree's upper nodes: how many buckets differ from the stored table's, for a copy in another order and a corrected one."""
    keys, rest = ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    orders = table(spark, path, "orders")
    sums = lambda df: checksums.roots(checksums.checksums(df, keys, rest, buckets=16))
    mine, out = sums(orders), []
    for name, df in (("copy", orders.repartition(7)), ("corrected", corrected_orders(spark, path))):
        theirs = sums(df)
        equal = checksums.differing(mine, theirs, ["bucket"]).agg((F.count(F.lit(1)) == 0).alias("equal"))
        whole = checksums.differing(checksums.roots(mine, []).withColumn("all", F.lit(0)), checksums.roots(theirs, []).withColumn("all", F.lit(0)), ["all"])
        # Every node of an equal table is equal; a table that differs does so at its root and in some bucket.
        out.append(equal.select(F.lit(name).alias("table"), "equal").withColumn("root_equal", F.lit(whole.isEmpty())))
    return out[0].union(out[1])


@query
def bucketed_upsert(spark, path):
    """A table without a natural partition, in buckets of its key: a small batch replaces few of them."""
    lake, lines = Lake(spark, shared_dir(spark, "bucketed-upsert")), table(spark, path, "lineitem")
    lake.merge("silver.lines", lines, LINE_KEYS, LINE_ORDER, buckets=64)
    batch = lines.where("l_orderkey < 10").withColumn("l_linestatus", F.lit("X"))
    new = lines.where("l_orderkey < 5").withColumn("l_orderkey", F.col("l_orderkey") + 1_000_000_000)
    done = lake.merge("silver.lines", batch.unionByName(new), LINE_KEYS, LINE_ORDER)
    flags = [F.lit(done["inserted"]).alias("inserted"), F.lit(done["updated"]).alias("updated"), F.lit(done["buckets"] < 64).alias("in_part")]
    return lake.read("silver.lines").select("*", *flags)


@query
def rebucketed_table(spark, path):
    """A table that outgrew its buckets: stored anew in more of them, with the same rows."""
    lake = Lake(spark, shared_dir(spark, "rebucketed"))
    lake.create("silver.orders", table(spark, path, "orders"), buckets=4, bucket_by=["o_orderkey"])
    lake.append("silver.orders", table(spark, path, "orders").where("o_orderkey < 50").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))
    lake.rebucket("silver.orders", 16)
    lake.merge("silver.orders", table(spark, path, "orders").where("o_orderkey < 3").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])
    buckets = lake.read("silver.orders", with_bucket=True).agg(F.count_distinct("__bucket")).first()[0]
    return lake.read("silver.orders").withColumn("buckets", F.lit(buckets))


@query
def clustered_table(spark, path):
    """Lines rewritten along a space-filling curve of two columns: a filter on either one opens few files."""
    lake, lines = Lake(spark, shared_dir(spark, "clustered")), table(spark, path, "lineitem")
    lake.create("bronze.lines", lines.repartition(64, "l_orderkey", "l_linenumber"))
    limits = layout.quantile_bounds(lines, ["l_shipdate", "l_extendedprice"], bits=4)
    filters = {
        "skips_by_date": F.unix_micros(F.col("l_shipdate").cast("timestamp")) < limits["l_shipdate"][0],
        "skips_by_price": F.col("l_extendedprice") > limits["l_extendedprice"][-1],
    }
    before = {n: layout.files_holding(lake.read("bronze.lines"), f).count() for n, f in filters.items()}
    lake.cluster("bronze.lines", ["l_shipdate", "l_extendedprice"], 64)
    rows = lake.read("bronze.lines")
    skips = [F.lit(3 * layout.files_holding(rows, f).count() <= before[n]).alias(n) for n, f in filters.items()]
    return rows.select("*", *skips)


# --- sketches, modes, samples, quantiles --------------------------------------


@query
def monthly_distinct_customers(spark, path):
    """Sketches stored per store and day, merged into months: within 5 % of the exact counts, without the facts."""
    lake, sales, keys = Lake(spark, shared_dir(spark, "sketches")), _sales(spark, path), ["store_id", "day"]
    daily = sales.select("store_id", F.col("_date").alias("day"), "customer_id")
    # Half of the customers' sales first; the others come later and are merged in.
    late = F.pmod(F.xxhash64("customer_id"), F.lit(2)) == 1
    first, second = (sketches.distinct_sketches(daily.where(part), keys, {"customers": "customer_id"}) for part in (~late, late))
    lake.create("gold.daily_customers", first)
    lake.create("gold.merged_customers", sketches.refresh_sketches(lake.read("gold.daily_customers"), second, keys, ["customers"]))
    month = F.date_trunc("month", "day").cast("date").alias("month")
    stored = lake.read("gold.merged_customers").select("store_id", month, "customers")
    merged = sketches.estimates(sketches.merge_sketches(stored, ["store_id", "month"], ["customers"]), ["customers"])
    pairs = sales.select("store_id", F.date_trunc("month", "_date").cast("date").alias("month"), "customer_id").distinct()
    exact = pairs.groupBy("store_id", "month").agg(F.count("customer_id").alias("exact"))
    near = F.abs(F.coalesce("customers", F.lit(0)) - F.col("exact")) <= 0.05 * F.col("exact")
    return exact.join(merged, ["store_id", "month"], "left").select("store_id", "month", F.col("exact").alias("customers"), near.alias("within"))


@query
def mode_by_few_counters(spark, path):
    """The most frequent category per store, from candidates of bounded sketches that an exact pass counts."""
    return mode_by_candidates(_sales(spark, path), ["store_id"], "category", "top_category")


QUERIES["mode_by_candidates"] = QUERIES.pop("mode_by_few_counters")


@query
def mode_of_many_values(spark, path):
    """The same for a column in which hardly a value stands out: the sketch proves nothing, so all values are counted."""
    return mode_by_candidates(table(spark, path, "lineitem"), ["l_returnflag"], "l_partkey", "top_part", tracked=8)


SAMPLED = ["txn_id", "category", "quantity", "payment_method"]


@query
def failing_samples(spark, path):
    """Failing rows of every check of the suite, from one scan."""
    found = quality.failing_samples(faulty_sales(spark, path), suite(), SAMPLED)
    return found.select("check", "kind", "severity", "position", "occurrences", *[F.col("row")[c].alias(c) for c in SAMPLED])


@query
def failing_first_rows(spark, path):
    """The first rows that break one check, in order."""
    return quality.failing_sample(faulty_sales(spark, path), quality.positive("quantity"), ["txn_id"], 20).select("txn_id", "quantity")


@query
def table_quantiles(spark, path):
    """Exact quartiles of every number column."""
    found = quantiles.table_quantiles(table(spark, path, "lineitem"))
    return found.select("column", "share", F.col("value").cast("double").alias("value"))


@query
def money_quantiles(spark, path):
    """Exact deciles of amounts of money and of counts, nulls left out."""
    sales = raw.raw_sales_with_nulls(spark, path).select(
        F.when(F.col("category").isNotNull(), F.col("unit_price")).alias("unit_price"), (-F.col("quantity")).alias("returned")
    )
    found = quantiles.table_quantiles(sales, [0.1, 0.9, 1.0])
    return found.select("column", "share", F.col("value").cast("double").alias("value"))


@query
def sketched_quantiles(spark, path):
    """Quartiles from one scan of sketches: their rank is within two percent of the wanted one."""
    events = table(spark, path, "events").select("value")
    found = quantiles.approximate_quantiles(events)
    limits = {r["share"]: r["value"] for r in found.collect()}
    below = [(F.count_if(F.col("value") <= v) / F.count("value")).alias(str(s)) for s, v in limits.items()]
    ranks = events.agg(*below).unpivot([], [F.col(f"`{s}`") for s in limits], "share", "rank")
    share = F.col("share").cast("double")
    return ranks.select(share.alias("share"), (F.abs(F.col("rank") - share) <= 0.02).alias("near"))


# --- schemas -------------------------------------------------------------------


def _json_field(name: str, kind, nullable="true"):
    parts = [F.lit(f'{{"name":"{name}","type":'), kind if not isinstance(kind, str) else F.lit(kind), F.lit(f',"nullable":{nullable},"metadata":{{}}}}')]
    return F.concat(*parts)


def published_schemas(spark, path) -> DataFrame:
    """Product versions with a schema snapshot that changes with the version's numbers."""
    major, minor, patch = (F.split("version", r"\.")[i].cast("int") for i in range(3))
    place = F.concat(
        F.lit('{"type":"struct","fields":['), _json_field("city", '"string"'), F.lit(","),
        _json_field("zone", F.when(patch % 2 == 0, '"integer"').otherwise('"long"')), F.lit("]}"),
    )
    tags = F.concat(
        F.lit('{"type":"array","elementType":'), F.when(minor % 3 == 0, '"integer"').otherwise('"string"'), F.lit(',"containsNull":true}')
    )
    price = F.when(minor % 2 == 0, '"decimal(10,2)"').otherwise('"decimal(12,2)"')
    fields = [
        _json_field("id", F.when(major == 1, '"integer"').otherwise('"long"'), "false"), _json_field("price", price),
        _json_field("place", place), _json_field("tags", tags),
        F.concat(F.lit('{"name":"extra_'), (patch % 3).cast("string"), F.lit('","type":"double","nullable":'), F.when(patch > 1, "true").otherwise("false"), F.lit(',"metadata":{}}')),
    ]
    whole = F.concat(F.lit('{"type":"struct","fields":['), F.concat_ws(",", *fields), F.lit("]}"))
    return raw.product_versions(spark, path).select("product_name", "version", whole.alias("schema_snapshot"))


@query
def schema_changes(spark, path):
    """What every published version changed against the one before, by path."""
    return schemas.schema_changes(published_schemas(spark, path))


@query
def schema_steps(spark, path):
    """Whether each version's number declares as large a step as its schema takes."""
    versions = published_schemas(spark, path)
    return schemas.version_steps(versions, schemas.schema_changes(versions))


@query
def widened_table(spark, path):
    """Rows of a wider type merged into and appended to a stored table: old files are read as the wider type."""
    lake, orders = Lake(spark, shared_dir(spark, "widened")), table(spark, path, "orders").select("o_orderkey", "o_custkey")
    narrow = orders.where("o_orderkey % 2 = 0").withColumn("o_custkey", F.col("o_custkey").cast("int"))
    lake.create("bronze.orders", narrow, buckets=8, bucket_by=["o_orderkey"])
    lake.merge("bronze.orders", orders.where("o_orderkey % 10 = 0").withColumn("o_custkey", F.col("o_custkey") + 5_000_000_000), ["o_orderkey"])
    lake.append("bronze.orders", orders.where("o_orderkey % 2 = 1"))
    return lake.read("bronze.orders")


# --- records and streams --------------------------------------------------------


def _page(record: bytes, name: str) -> Iterator[tuple]:
    page = json.loads(record)
    yield page["page_id"], page.get("url"), page.get("html")


PAGE = "page_id bigint, url string, html string"


@query
def parsed_large_files(spark, path):
    """All pages landed as large files, one per task that reads them, which a registered record parser reads in pieces."""
    folder = shared_dir(spark, "large-file")
    table(spark, path, "pages").select("page_id", "url", "html").write.json(folder)
    register_records(spark, "page_records", _page, PAGE)
    pages = spark.read.format("page_records").option("pieceBytes", 200_000).load(folder)
    return pages.select("page_id", "url", "html", (F.col("_offset") >= 0).alias("placed"))


@query
def parsed_large_stream(spark, path):
    """The same as a stream: pages landed after a restart are read once, beside those read before."""
    folder, pages = shared_dir(spark, "record-stream"), table(spark, path, "pages").select("page_id", "url", "html")
    register_records(spark, "page_records", _page, PAGE)
    for number in (0, 1):
        pages.where(F.col("page_id") % 2 == number).write.mode("append").json(f"{folder}/in")
        stream = spark.readStream.format("page_records").option("pieceBytes", 200_000).load(f"{folder}/in")
        append_stream(stream.drop("_source_file", "_offset"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(PAGE).parquet(f"{folder}/out")


DAY = timedelta(days=1)


@query
def stream_first_per_key(spark, path):
    """Events delivered three times with repetitions: the first of each, and those that came more than three days late."""
    folder, events = shared_dir(spark, "first-per-key"), table(spark, path, "events").select("event_id", "ts", "user_id", "event_type")
    day = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    early, middle = F.col("ts") <= day(10), (F.col("ts") > day(10)) & (F.col("ts") <= day(20))
    held, again = F.col("event_id") % 7 == 0, F.col("event_id") % 11 == 0
    deliveries = [
        events.where(early & ~held).unionByName(events.where(early & ~held & (F.col("event_id") % 5 == 0))),
        events.where(middle | (~held & early & (F.col("ts") > day("09")))),
        events.where((F.col("ts") > day(20)) | (early & (held | again))),
    ]
    out = None
    for number, rows in enumerate(deliveries):
        rows.repartition(2, "event_id").write.parquet(f"{folder}/in/{number}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        out = first_and_late(stream, ["event_id"], "ts", 3 * DAY, folder)
    first, late = (df.withColumn("ts", F.col("ts").cast("timestamp_ntz")) for df in out)
    return first.withColumn("kind", F.lit("first")).unionByName(late.withColumn("kind", F.lit("late")))


@query
def stream_silence(spark, path):
    """Users without an event for more than two days, told by timers of a stream that was restarted halfway."""
    folder, events = shared_dir(spark, "silence"), table(spark, path, "events").select("user_id", "ts")
    half = F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    found = None
    for number, rows in enumerate((events.where(half), events.where(~half))):
        rows.repartition(2, "user_id").write.parquet(f"{folder}/in/{number}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        found = silences(stream, "user_id", "ts", 2 * DAY, timedelta(hours=6))
        append_stream(found, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    told = spark.read.schema(found.schema).parquet(f"{folder}/out")
    return told.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_seen", "silent_from")])


@query
def appended_stream(spark, path):
    """Events appended as they land, partitioned by type."""
    folder, events = shared_dir(spark, "appended"), table(spark, path, "events").select("event_id", "user_id", "event_type")
    for number in range(2):
        events.where(F.col("event_id") % 2 == number).repartition(2).write.parquet(f"{folder}/in/{number}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        append_stream(stream, f"{folder}/out", f"{folder}/checkpoint", ["event_type"]).awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{folder}/out")


@query
def bucketed_stream_upsert(spark, path):
    """A stream upserted into a table in buckets: a micro-batch rewrites the buckets of its keys and no others."""
    folder, events = shared_dir(spark, "bucketed-stream"), table(spark, path, "events").select("event_id", "ts", "user_id")
    lake = Lake(spark, folder)
    events.repartition(2, "event_id").write.parquet(f"{folder}/in")
    stream = stream_files(spark, f"{folder}/in", events.schema, pattern="*.parquet", max_files_per_trigger=1)
    merge_stream(stream, lake, "silver.last", ["user_id"], ["ts"], f"{folder}/checkpoint", buckets=32).awaitTermination()
    return lake.read("silver.last")


# --- states, files, descriptions ---------------------------------------------------


def _state_rows(spark, path) -> DataFrame:
    """A log of high-water values as jobs would leave it, one per event."""
    return table(spark, path, "events").select(
        F.col("event_type").alias("pipeline"), F.concat(F.lit("column_"), F.col("user_id") % 10).alias("column"), raw.text("event_id").alias("value"),
        F.lit("bigint").alias("value_type"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("user_id").alias("row_count"),
        (F.col("event_id") % 11 == 0).alias("is_reset"),
    )


@query
def watermark_history(spark, path):
    """The stored states of one job through time, its current values after a reset, and all jobs that have any."""
    store = incremental.WatermarkStore(spark, shared_dir(spark, "states"))
    _state_rows(spark, path).write.parquet(store.path)
    store.reset("click", "column_3")
    current, jobs = store.get_all("click"), store.list_pipelines()
    rows = store.history("click").where("value is not null").select("column", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), F.col("value").cast("bigint").alias("value"))
    values = spark.createDataFrame([(k, v) for k, v in current.items()], "column string, current bigint")
    return rows.join(values, "column", "left").withColumn("jobs", F.lit(",".join(jobs)))


@query
def hashed_files(spark, path):
    """Keys landed as one text file per order status, and the hash of each file's content."""
    folder, orders = shared_dir(spark, "hashed"), table(spark, path, "orders").select("o_orderstatus", "o_orderkey")
    sorted_rows = orders.repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey")
    sorted_rows.select("o_orderstatus", raw.text("o_orderkey").alias("line")).write.partitionBy("o_orderstatus").text(folder)
    status = F.regexp_extract("file_path", "/o_orderstatus=([^/]*)/", 1)
    return hashes_of(spark, folder, "*.txt").select(status.alias("o_orderstatus"), "file_hash", "length")


@query
def filename_fields(spark, path):
    """Orders landed in files whose names end in the order's status; read with that field, renamed, with audit columns."""
    folder, orders = shared_dir(spark, "named-files"), table(spark, path, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    for status in ("F", "O", "P"):
        orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey").write.option("header", "true").option("extension", status).mode("append").csv(folder)
    landed = read_landing(spark, folder, "csv", "o_orderkey bigint, o_custkey bigint", pattern="part-*")
    named = with_filename_fields(landed, r"^(part)-.*\.([A-Z])$", ["prefix", "status"])
    out = add_audit_columns(rename(named, {"o_orderkey": "order_id"}), "landing", EVENTS_AS_OF)
    return out.select("order_id", "o_custkey", "prefix", "status", "_source", F.col("_ingested_at").cast("timestamp_ntz").alias("_ingested_at"))


@query
def contract_with_nulls(spark, path):
    """A table's columns against a declared contract, with the nulls that the data hold."""
    lines = table(spark, path, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate", F.nullif("l_returnflag", F.lit("A")).alias("l_returnflag"))
    declared = [("l_orderkey", "bigint", True), ("l_quantity", "int", True), ("l_returnflag", "string", False), ("l_comment", "string", True)]
    contract = quality.schema_contract(lines, declared)
    nulls = profile.null_report(lines).select("column", "nulls")
    return contract.join(nulls, "column", "left")


@query
def described_tables(spark, path):
    """Tables with their row counts, and every column with its type."""
    out = []
    for name in ("orders", "lineitem", "events"):
        df = table(spark, path, name)
        about = profile.describe(df, name).select("name", "row_count", "column_count", F.explode("columns").alias("column"))
        out.append(about.join(profile.schema_table(df).select("column", "position", "type"), "column"))
    return out[0].unionByName(out[1]).unionByName(out[2])
