"""Small helpers around tables: reading them, cutting lineage through the shared folder, linking components."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.session import shared_dir
from stratalake.sources.tables import remove


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark removes the shuffle files of a query when it ends, instead of when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table into the shared folder and read it back: later steps survive lost executors and never recompute it."""
    return stored_by(df, purpose, [])


def stored_by(df: DataFrame, purpose: str, by: list[str]) -> DataFrame:
    """As `stored`, with a folder for each value of some columns, so that later steps read the values they need."""
    spark = df.sparkSession
    path, before = shared_dir(spark, purpose), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_part(table: DataFrame, column: str, value: int) -> None:
    """Delete the folder of one value of a table that `stored_by` wrote; later steps must not read it any more."""
    files = table.filter(F.col(column) == value).inputFiles()
    folders = {str(f).rsplit("/", 1)[0] for f in files}
    for folder in folders:
        if folder.endswith(f"/{column}={value}"):
            remove(table.sparkSession, folder)


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b) between ids: (id, component_id), the smallest id reachable.

    Alternates the two star contractions (every node passes its larger, then its smaller neighbours on to its least
    one) until nothing changes. A busy node's neighbours are never gathered: its least one is a partially combined
    minimum, joined back. Edges with a null end and loops are ignored; nodes without edges are not returned.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = stored(edges.distinct(), purpose)
    before = None
    while True:
        # Every edge points from the larger to the smaller end.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = stored(small, purpose)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return found.union(roots)


#: Rows that Python gets at a time.
ROWS, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: Members of a list that a task holds at a time, on either side.
WIDE = 4096


def faced(lists: DataFrame, key: str, name: str, left: Column, n_left: str, n_all: str) -> DataFrame:
    """The rows of lists (equal `key`), dealt so that the left ones meet all of their list in the tasks that get both.

    Both sides of a list of more than `WIDE` rows are cut into blocks by their `name`; `n_left` and `n_all` are columns that count
    them. Rows come with `left`, `right`, `i` and `j`, sorted for `whole_blocks`; those of shorter lists come once.
    """
    many = {"i": F.ceil(F.col(n_left) / WIDE).cast("int"), "j": F.ceil(F.col(n_all) / WIDE).cast("int")}
    deal = lambda x: F.pmod(F.xxhash64(name), many[x]).cast("int").alias(x)
    every = lambda x: F.sequence(F.lit(0), many[x] - 1)
    flags = lambda one, other: (F.lit(one).alias("left"), F.lit(other).alias("right"))
    one = F.transform(every("j"), lambda j: F.struct(*flags(True, False), deal("i"), j.alias("j")))
    other = F.transform(every("i"), lambda i: F.struct(*flags(False, True), i.alias("i"), deal("j")))
    empty = F.array().cast("array<struct<left:boolean,right:boolean,i:int,j:int>>")
    short = F.array(F.struct(left.alias("left"), F.lit(True).alias("right"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    place = F.when(F.col(n_all) <= WIDE, short).otherwise(F.concat(F.when(left, one).otherwise(empty), other))
    lists = lists.filter(F.col(n_left) > 0)
    names = [c for c in lists.columns if c not in (n_left, n_all)]
    rows = lists.select(*names, F.explode(place).alias("place")).select(*names, "place.*")
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def whole_blocks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of `faced`, cut between blocks only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = {c: batch.column(c).to_numpy() for c in (key, "i", "j")}
        edges = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys.values()])) + 1
        if held and any(held[-1].column(c)[-1].as_py() != k[0] for c, k in keys.items()):
            edges = np.concatenate(([0], edges))
        if len(edges):
            yield pa.Table.from_batches([*held, batch.slice(0, int(edges[-1]))], batch.schema)
            held, batch = [], batch.slice(int(edges[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def facing(
    rows: pa.Table, key: str, most: int, size: np.ndarray | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of every left row and every right row of its block, about `most` pairs at a time.

    With sizes (one for each row, below 2**31) only right rows whose size is from the left row's `low` to its `high`.
    """
    left, right, *keys = (rows.column(c).to_numpy() for c in ("left", "right", key, "i", "j"))
    new = np.concatenate(([False], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))[: len(left)]
    group = np.cumsum(new)
    ones, others = np.flatnonzero(left), np.flatnonzero(right)
    if size is None:
        count = np.bincount(group[others], minlength=int(group[-1]) + 1)
        meets, first = count[group[ones]], (np.cumsum(count) - count)[group[ones]]
    else:
        others = others[np.lexsort((size[others], group[others]))]
        place = group[others] << 32 | size[others]
        first = np.searchsorted(place, group[ones] << 32 | low[ones])
        meets = np.maximum(np.searchsorted(place, group[ones] << 32 | high[ones], side="right") - first, 0)
    total, start = np.concatenate(([0], np.cumsum(meets))), 0
    while start < len(ones):
        end = max(start + 1, int(np.searchsorted(total, total[start] + most, side="right")) - 1)
        x = np.repeat(np.arange(start, end), meets[start:end])
        yield ones[x], others[first[x] + np.arange(len(x)) - (total[x] - total[start])]
        start = end


def distinct_pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The pairs of some arrays of two rows, smaller end first, each once."""
    pairs = np.sort(np.concatenate(found or [np.zeros((2, 0), np.int64)], axis=1), axis=0)
    pairs = pairs[:, np.lexsort(pairs)]
    pairs = pairs[:, np.concatenate(([True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)))[: pairs.shape[1]]]
    if pairs.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, for tasks that run its Python code.

    Tasks get whole texts in batches of rows, of which both the JVM and Python hold several copies, so batches stay small.
    """
    if int(spark.conf.get(ROWS)) > MOST_ROWS or int(spark.conf.get(ROWS)) <= 0:
        spark.conf.set(ROWS, str(MOST_ROWS))
    context = spark.sparkContext
    if not getattr(context, "_stratalake_shipped", False):
        root = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="stratalake-")) / "stratalake.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._stratalake_shipped = True
    return spark
