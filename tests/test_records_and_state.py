"""Record files in pieces, and keyed stream state through restarts."""

import gzip
import random
from datetime import datetime, timedelta

import pytest

from stratalake.sources import records
from stratalake.streaming.state import first_and_late, silences

START = datetime(2024, 1, 1)


def hours(n):
    return START + timedelta(hours=n)


# --- records --------------------------------------------------------------------


@pytest.mark.parametrize("delimiter", [b"\n", b"\r\n", b"a|", b"||", b"\r\n\r\n"])
def test_every_record_belongs_to_one_piece(tmp_path, delimiter):
    rng = random.Random(len(delimiter))
    for size in (1, 2, 3, 7, 50, 1000):
        file = tmp_path / f"f{size}"
        file.write_bytes(delimiter.join(bytes(rng.choices(b"ab|\r\n", k=rng.randrange(0, 12))) for _ in range(60)) + rng.choice([b"", delimiter]))
        content = file.read_bytes().split(delimiter)
        cut = records.pieces(str(file), 0, file.stat().st_size, size, delimiter)
        assert len(cut) > 1 or size == 1000 or delimiter in (b"||", b"\r\n\r\n")
        found = [r for p in cut for r in records.records_of(f"file:{file}", p, delimiter, block=rng.choice([1, 2, 5, 64]))]
        whole = file.read_bytes()
        assert [r for _, r in found] == [c for c in content if c]
        assert all(whole[at : at + len(r)] == r for at, r in found)


def parse(record, name):
    fields = record.decode().split(",")
    if fields[0] != "skip":
        yield int(fields[0]), fields[1]
        if len(fields) > 2:
            yield int(fields[0]), fields[2]


def test_large_file_is_read_by_several_tasks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "big.txt").write_text("\n".join(f"{i},value {i}" for i in range(5000)) + "\nskip,x\n\n7,two,rows")
    (folder / "packed.gz").write_bytes(gzip.compress(b"9001,packed\n9002,too"))
    (folder / "_hidden").write_text("no,numbers")
    records.register_records(spark, "two_columns", parse, "n int, v string")
    df = spark.read.format("two_columns").option("pieceBytes", 10_000).load(str(folder))
    assert df.rdd.getNumPartitions() >= 8
    rows = df.collect()
    assert sorted((r["n"], r["v"]) for r in rows) == sorted([(i, f"value {i}") for i in range(5000)] + [(7, "two"), (7, "rows"), (9001, "packed"), (9002, "too")])
    assert len({r["_source_file"].rsplit("/", 1)[-1] for r in rows}) == 2
    only = spark.read.format("two_columns").option("pattern", "*.gz").load(str(folder))
    assert only.count() == 2
    assert spark.read.format("two_columns").load(str(tmp_path / "none")).count() == 0


def test_other_delimiters(spark, tmp_path):
    (tmp_path / "f.txt").write_text("1,a;;2,b;;3,line\nbreak")
    records.register_records(spark, "two_columns", parse, "n int, v string")
    rows = spark.read.format("two_columns").option("delimiter", ";;").option("pieceBytes", 4).load(str(tmp_path)).collect()
    assert sorted((r["n"], r["v"]) for r in rows) == [(1, "a"), (2, "b"), (3, "line\nbreak")]


def test_stream_reads_what_is_new(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    records.register_records(spark, "two_columns", parse, "n int, v string")

    def run():
        stream = spark.readStream.format("two_columns").option("pieceBytes", 30).load(str(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        query.start(str(tmp_path / "out")).awaitTermination()
        return sorted((r["n"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "a.txt").write_text("".join(f"{i},a\n" for i in range(20)))
    first = run()
    assert first == [(i, "a") for i in range(20)]
    (folder / "b.txt").write_text("100,b\n")
    with (folder / "a.txt").open("a") as f:
        f.write("20,grown\n")
    assert run() == [*first, (20, "grown"), (100, "b")]
    assert run() == [*first, (20, "grown"), (100, "b")]


# --- keyed state ------------------------------------------------------------------

EVENT = "k string, ts timestamp, n int"


def deliver(spark, folder, number, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/in/{number}")
    return spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def test_no_row_is_lost_between_first_and_late(spark, tmp_path):
    folder, limit = str(tmp_path), timedelta(hours=5)
    batches = [
        [("a", hours(1), 1), ("a", hours(1), 1), ("b", hours(2), 2)],
        [("c", hours(20), 3), ("a", hours(1), 1), ("none", None, 0)],
        [("d", hours(14), 4), ("e", hours(16), 5), ("c", hours(20), 3), ("f", hours(3), 6)],
    ]
    for number, rows in enumerate(batches):
        first, late = first_and_late(deliver(spark, folder, number, rows), ["k"], "ts", limit, folder)
    assert sorted(r["k"] for r in first.collect()) == ["a", "b", "c", "e"]
    assert sorted(r["k"] for r in late.collect()) == ["d", "f", "none"]


def test_silence_is_told_once_however_batches_are_cut(spark, tmp_path):
    seen = {"a": [0, 1, 2, 30, 31], "b": [0, 3, 6, 9, 12, 15, 18, 21, 24, 27, 30, 33], "c": [5], "d": [28, 33]}
    rows = sorted((hours(h), k) for k, times in seen.items() for h in times)
    want = sorted([("a", hours(2)), ("c", hours(5))])
    for name, cuts in (("one", [0, 100]), ("two", [0, 9, 100]), ("many", [0, 3, 6, 9, 12, 15, 100])):
        folder = f"{tmp_path}/{name}"
        for number, (i, j) in enumerate(zip(cuts, cuts[1:])):
            stream = deliver(spark, folder, number, [(k, t, 1) for t, k in rows[i:j]])
            found = silences(stream, "k", "ts", timedelta(hours=10), timedelta(hours=1))
            query = found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start(f"{folder}/out")
            query.awaitTermination()
        told = spark.read.parquet(f"{folder}/out").collect()
        assert sorted((r["k"], r["last_seen"]) for r in told) == want, name
        assert all(r["silent_from"] == r["last_seen"] + timedelta(hours=10) for r in told)
