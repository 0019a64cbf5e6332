"""Revisit resolution against a plain scan of the records in order."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalake.llm import revisits
from stratalake.llm.queries import captures

SCHEMA = "record_id string, url string, date timestamp, kind string, headers map<string,string>, outcome int"


def brute(rows):
    """rows: record_id, url_key, date, kind, headers (lower-case names)."""
    found = {}
    for name, key, date, kind, headers in rows:
        if kind != "revisit":
            continue
        if key is None or date is None:
            found[name] = (None, "no key", headers)
            continue
        earlier = [r for r in rows if r[3] == "response" and r[1] == key and r[2] is not None and r[2] < date]
        if not earlier:
            found[name] = (None, "no response", headers)
            continue
        best = max(earlier, key=lambda r: (r[2], r[0]))
        outcome = "no validator"
        for tag in ("etag", "last-modified"):
            if tag in best[4] and tag in headers:
                strip = lambda x: x.removeprefix("W/") if tag == "etag" else x  # noqa: B023, E731
                outcome = "resolved" if strip(best[4][tag]) == strip(headers[tag]) else "changed"
                break
        if outcome == "resolved":
            found[name] = (best[0], outcome, best[4] | {k: v for k, v in headers.items() if k not in revisits.KEPT})
        else:
            found[name] = (None, outcome, headers)
    return found


def test_whole_table(table, spark):
    records = captures(table("pages"))
    plain = records.withColumn("key", revisits.canonical(F.col("url"))).collect()
    rows = [(r.record_id, r.key, r.date, r.kind, {k.lower(): v for k, v in r.headers.items()}) for r in plain]
    for partitions in (1, 7):
        got = {r.record_id: (r.refers_to, r.outcome, r.headers) for r in revisits.resolve(records, partitions).collect()}
        assert got == brute(rows)


def test_one_url_over_many_partitions(spark):
    """The first response is far from the last revisits; partitions between hold no response."""
    start = datetime(2024, 1, 1)
    rows = [("r0", "http://h/a", start, "response", {"ETag": "1", "X": "old"}, 1)]
    rows += [(f"v{i:03}", "http://h/a", start + timedelta(seconds=i), "revisit", {"ETag": "1"}, 1) for i in range(1, 300)]
    rows += [("r1", "http://h/a", start + timedelta(seconds=250), "response", {"ETag": "2"}, 1)]
    got = {r.record_id: r.refers_to for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA), 16).collect()}
    assert got == {f"v{i:03}": "r0" if i <= 250 else None for i in range(1, 300)}


def test_edge_cases(spark):
    day = datetime(2024, 1, 1)
    rows = [
        ("a", "http://x.org/a#f", day, "response", {"ETag": '"1"', "Content-Type": "t", "Server": "s"}, 1),
        ("a2", "http://x.org/a#f", day, "response", {"ETag": '"9"'}, 1),
        ("b", "https://www.X.org/a/?utm_source=q", day + timedelta(1), "revisit", {"etag": 'W/"9"', "Content-Type": "q", "SERVER": "z"}, 1),
        ("c", "http://x.org/a", day - timedelta(9), "revisit", None, 1),
        ("d", None, day, "revisit", {"a": "b"}, 1),
        ("e", "http://x.org/a", day, "revisit", {"ETag": '"1"'}, 1),
        ("f", "http://x.org/a", None, "revisit", {}, 1),
        ("g", "http://x.org/a", day + timedelta(2), "revisit", {}, 1),
        ("h", "http://x.org/a", day, "metadata", {}, 1),
        (None, None, None, None, None, None),
    ]
    got = {r.record_id: (r.refers_to, r.outcome, r.headers) for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA), 3).collect()}
    assert got["b"] == ("a2", "resolved", {"etag": 'W/"9"', "server": "z"})
    assert {k: v[1] for k, v in got.items()} == {
        "b": "resolved", "c": "no response", "d": "no key", "e": "no response", "f": "no key", "g": "no validator"
    }
    assert revisits.resolve(spark.createDataFrame([], SCHEMA), 3).count() == 0


@pytest.mark.parametrize(
    "url, key",
    [("HTTP://www.Ex.org:80/A/?b=2&a=1&utm_x=1#t", "ex.org/A?a=1&b=2"), ("http://h", "h"), ("", ""), ("h/?", "h"), (None, None)],
)
def test_canonical(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(revisits.canonical(F.col("u"))).first()[0] == key


def test_payload(spark):
    resolved = spark.createDataFrame([("v", "r"), ("w", None)], "record_id string, refers_to string")
    responses = spark.createDataFrame([("r", "body")], "record_id string, payload string")
    got = {r.record_id: r.payload for r in revisits.with_payload(resolved, responses, "payload").collect()}
    assert got == {"v": "body", "w": None}
