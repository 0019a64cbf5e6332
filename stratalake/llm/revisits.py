"""Resolve not-modified revisits of a web archive to the full response they confirm.

An as-of join by canonical URL: each revisit looks for the latest response of its URL that is strictly earlier. The
records are range-partitioned by (URL, date), which splits also the URL that holds a third of all records; within a
partition a window carries the last response forward, and into later partitions of the same URL it is carried over the
partitions' last responses (at most two rows per partition boundary). The revisit is resolved if its validators agree
with the response's (ETag first, compared weakly; else Last-Modified); its headers then update the stored ones, but for
those that a 304 may not change.

Records: record_id string, url string, date timestamp, kind ("response" or "revisit"; others are ignored), headers
map<string, string>. Equal dates: a response is not earlier than a revisit of the same instant; of responses of one
instant the one with the greatest record_id is taken. A revisit without URL or date stays unresolved; repeated
revisits each get their row; null headers are no headers. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm.tables import stored

#: Headers that describe a message's body or one connection: a 304 does not change them.
KEPT = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)


def canonical(url: Column) -> Column:
    """A URL without scheme, "www.", default port, fragment, trailing slash and utm_ parameters; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    front = F.substring_index(bare, "?", 1)
    host = F.regexp_replace(F.lower(F.substring_index(front, "/", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.substr(front, F.length(F.substring_index(front, "/", 1)) + 1), r"/+$", "")
    query = F.substr(bare, F.length(front) + 2)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the one that sorts last."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    return F.aggregate(
        entries,
        F.create_map().cast("map<string,string>"),
        lambda done, e: F.map_concat(
            F.map_filter(done, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])
        ),
    )


def merge_headers(stored_ones: Column, update: Column) -> Column:
    """The stored headers, updated by those of a 304 that may change them."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(*KEPT))
    rest = F.map_filter(stored_ones, lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(rest, allowed)


def resolve(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per revisit: record_id, url_key, date, refers_to, refers_date, outcome, headers.

    `outcome` is resolved, changed (a validator differs), no validator (none to compare), no response, or no key.
    `headers` are the merged ones if resolved, else the revisit's own.
    """
    spark = records.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = records.filter(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("string"), canonical(F.col("url").cast("string")).alias("url_key"), "date",
        (F.col("kind") == "response").alias("full"), _lower_names(F.col("headers")).alias("headers"),
    )
    usable = F.col("url_key").isNotNull() & F.col("date").isNotNull()
    order = ["date", "full", "record_id"]
    placed = rows.filter(usable).repartitionByRange(partitions, "url_key", *order)
    placed = stored(placed.withColumn("part", F.spark_partition_id()), "captures")

    response = F.struct("date", "record_id", "headers")
    local = Window.partitionBy("part", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.withColumn("local", F.last(F.when(F.col("full"), response), ignorenulls=True).over(local)).filter(~F.col("full"))

    # A key that reaches into another partition crosses one of the boundaries, so there are few.
    across = placed.groupBy("url_key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("url_key")
    ends = placed.join(F.broadcast(across), "url_key").groupBy("url_key", "part")
    ends = ends.agg(F.max_by(response, F.when(F.col("full"), F.struct("date", "record_id"))).alias("end"), F.max("full").alias("has"))
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last(F.when(F.col("has"), F.col("end")), ignorenulls=True).over(earlier))
    carried = carried.select("url_key", "part", "carried")

    found = found.join(F.broadcast(carried), ["url_key", "part"], "left").withColumn("hit", F.coalesce("local", "carried"))
    loose = rows.filter(~usable & ~F.col("full")).withColumn("hit", F.lit(None).cast(found.schema["hit"].dataType))
    found = found.select("record_id", "url_key", "date", "headers", "hit").unionByName(
        loose.select("record_id", "url_key", "date", "headers", "hit")
    )
    theirs, ours = F.col("hit.headers"), F.col("headers")
    plain = lambda tag: F.regexp_replace(tag["etag"], "^W/", "")
    outcome = (
        F.when(F.col("url_key").isNull() | F.col("date").isNull(), "no key")
        .when(F.col("hit").isNull(), "no response")
        .when(theirs["etag"].isNotNull() & ours["etag"].isNotNull(), F.when(plain(theirs) == plain(ours), "resolved").otherwise("changed"))
        .when(
            theirs["last-modified"].isNotNull() & ours["last-modified"].isNotNull(),
            F.when(theirs["last-modified"] == ours["last-modified"], "resolved").otherwise("changed"),
        )
        .otherwise("no validator")
    )
    found = found.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    return found.select(
        "record_id", "url_key", "date", F.when(done, F.col("hit.record_id")).alias("refers_to"),
        F.when(done, F.col("hit.date")).alias("refers_date"), "outcome",
        F.when(done, merge_headers(theirs, ours)).otherwise(ours).alias("headers"),
    )


def with_payload(resolved: DataFrame, responses: DataFrame, *columns: str) -> DataFrame:
    """Give resolved revisits the named payload columns of the response they refer to (null where unresolved)."""
    payload = responses.select(F.col("record_id").alias("refers_to"), *columns)
    return resolved.join(payload, "refers_to", "left")
