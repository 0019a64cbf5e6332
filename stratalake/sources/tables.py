"""Named tables in layers, kept as plain Parquet folders.

A table lives at ``<root>/<workspace>/<layer>/<name>/``: one data folder with a name of its own, and a small entry that
names it together with the table's schema, partitioning and key. Creating, replacing and rewriting write a new folder
and then a new entry, so a job that dies in between leaves the table as it was; the old folder goes last. Appends add
``__run=<id>`` folders beside ``__run=0``. An upsert is staged first and then replaces the partitions it touches; it may
be repeated after a failure and then ends in the same rows. Nothing a lost job leaves behind stands in the way of the
next write.

A table without a natural partition can be stored in buckets of its key's hash: a folder level of its own, invisible to
readers, by which an upsert replaces only the buckets that its keys fall into.

One writer per table at a time; a catalog with its own table format can stand in for this module, the operators do not
depend on it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import col, cols, match_keys
from stratalake.operators.checksums import bucket_of, checksum_diff
from stratalake.operators.incremental import WatermarkStore, newer_than, observe_watermark
from stratalake.operators.layout import clustered
from stratalake.operators.retention import retain as keep_recent
from stratalake.operators.schemas import wider
from stratalake.operators.upsert import keep_last, merge_marked
from stratalake.session import path_exists
from stratalake.sources.files import inventory, size_text, write_parquet

LAYERS = ("bronze", "silver", "gold")
ENTRY_SCHEMA = (
    "table string, number bigint, folder string, schema string, partition_by array<string>, unique_key array<string>, "
    "appended boolean, buckets int, bucket_by array<string>"
)
RUN = "__run"
BUCKET = "__bucket"
MARK = "__mark"
RUN_ONLY = T.StructType([T.StructField(RUN, T.StringType())])


@dataclass(frozen=True)
class TableRef:
    layer: str
    name: str

    @classmethod
    def parse(cls, text: str) -> TableRef:
        """``layer.name``; without a layer the table is bronze."""
        layer, _, name = text.rpartition(".")
        layer = layer or "bronze"
        if layer not in LAYERS or not name:
            raise ValueError(f"not a table name: {text}")
        return cls(layer, name)


@dataclass(frozen=True)
class RunResult:
    """What an incremental or full run did."""

    table: str
    rows_read: int
    inserted: int
    updated: int
    is_incremental: bool
    watermark: str | None


class Lake:
    """The tables of one workspace below ``root``."""

    def __init__(self, spark: SparkSession, root: str, workspace: str = "main"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.workspace = workspace
        self.base = f"{self.root}/{workspace}"
        self.state = WatermarkStore(spark, f"{self.base}/_state/watermarks")

    def path(self, table: str) -> str:
        ref = TableRef.parse(table)
        return f"{self.base}/{ref.layer}/{ref.name}"

    # --- entries -----------------------------------------------------------

    def _relation(self, path: str, schema: str) -> DataFrame:
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    def _entry(self, table: str):
        return self._relation(f"{self.path(table)}/current", ENTRY_SCHEMA).orderBy(F.desc("number")).first()

    def _live(self, table: str):
        entry = self._entry(table)
        if entry is None:
            raise ValueError(f"table not found: {table}")
        return entry

    def exists(self, table: str) -> bool:
        return self._entry(table) is not None

    def writes(self, table: str) -> DataFrame:
        """What the stored data say of the writes that made them: run, rows, files, time of the first file.

        Run 0 is the last full write or upsert; every append since then is a run of its own.
        """
        entry = self._live(table)
        file = F.col("_metadata.file_path")
        rows = self.spark.read.schema(RUN_ONLY).parquet(f"{self.path(table)}/{entry['folder']}")
        seen = rows.select(F.col(RUN).alias("run"), file.alias("file"), F.col("_metadata.file_modification_time").alias("at"))
        return seen.groupBy("run").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("file").alias("files"), F.min("at").alias("written_at"))

    def _commit(self, table, folder, schema, partition_by, unique_key=(), appended=False, before=None, buckets=None, bucket_by=()) -> None:
        """Make ``folder`` the table's data; what it replaces is removed afterwards."""
        number = 1 if before is None else before["number"] + 1
        place = f"{self.path(table)}/current"
        row = (str(table), number, folder, schema, list(partition_by), list(unique_key), appended, buckets, list(bucket_by))
        old = [] if before is None else self._relation(place, ENTRY_SCHEMA).inputFiles()
        self.spark.createDataFrame([row], ENTRY_SCHEMA).coalesce(1).write.parquet(f"{place}/{uuid.uuid4().hex}")
        for file in old:
            remove(self.spark, unquote(file))
        if before is not None and before["folder"] != folder:
            remove(self.spark, f"{self.path(table)}/{before['folder']}")

    # --- reading -----------------------------------------------------------

    def _scan(self, table: str, entry) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        folder = f"{self.path(table)}/{entry['folder']}"
        # The run is a folder level, not a column of the table.
        reader = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(RUN, T.StringType())]))
        return reader.parquet(folder).select(*cols(schema.fieldNames()))

    def read(self, table: str, with_bucket: bool = False) -> DataFrame:
        """The table's rows; ``with_bucket`` adds the number of the bucket that a table stored in buckets keeps them in."""
        rows = self._scan(table, self._live(table))
        return rows if with_bucket else rows.drop(BUCKET)

    def layout(self, table: str) -> dict:
        """How the table is stored: partition columns, number of buckets and the columns they come from."""
        entry = self._live(table)
        parts = [c for c in entry["partition_by"] if c != BUCKET]
        return {"partition_by": parts, "buckets": entry["buckets"], "bucket_by": list(entry["bucket_by"] or [])}

    def register_views(self) -> list[str]:
        """Make every table available to ``spark.sql`` as ``<layer>_<name>``."""
        names = []
        for row in self.tables().select("layer", "name").collect():
            view = f"{row['layer']}_{row['name']}"
            self.read(f"{row['layer']}.{row['name']}").createOrReplaceTempView(view)
            names.append(view)
        return sorted(names)

    def tables(self, layer: str | None = None) -> DataFrame:
        """Tables by layer with the number and total size of their data files."""
        entries = self._relation(f"{self.base}/*/*/current", ENTRY_SCHEMA)
        latest = keep_last(entries.select("table", "number", "folder"), ["table"], ["number"])
        parts = r"/(bronze|silver|gold)/([^/]+)/([^/]+)/"
        files = inventory(self.spark, self.base, "*.parquet").select(
            *[F.regexp_extract("path", parts, i).alias(c) for i, c in ((1, "layer"), (2, "name"), (3, "folder"))], "length"
        )
        found = (
            files.join(latest.select("folder"), "folder", "left_semi")
            .groupBy("layer", "name")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
            .withColumn("size", size_text(F.col("bytes")))
        )
        return found if layer is None else found.where(F.col("layer") == layer)

    # --- writing -----------------------------------------------------------

    def _write(self, df: DataFrame, target: str, partition_by: Sequence[str], track: str | None = None):
        """Write rows into a folder: their number and high-water value."""
        if partition_by:
            # Few files per partition value, while AQE splits a value that holds most rows.
            df = _storable(df, partition_by).hint("rebalance", *partition_by)
        return self._save(df, target, partition_by, track)

    @staticmethod
    def _save(df: DataFrame, target: str, partition_by: Sequence[str] = (), track: str | None = None):
        """Write and count in one job.

        The measures sit directly below the write, in the job's last stage:
        there a repeated task is counted once.
        """
        counted, seen = observe_watermark(df, track)
        write_parquet(counted, target, partition_by)
        return seen.get.get("rows") or 0, seen.get.get("watermark")

    def create(
        self, table: str, df: DataFrame, partition_by: Sequence[str] = (), buckets: int | None = None, bucket_by: Sequence[str] = ()
    ) -> int:
        """Create or replace a table; returns the number of rows. With ``buckets`` rows are stored by the hash of ``bucket_by``."""
        if buckets and not bucket_by:
            raise ValueError("buckets need the columns that they come from: bucket_by")
        return self._create(table, df, partition_by, buckets=buckets, bucket_by=bucket_by)[0]

    def _create(
        self, table, df, partition_by=(), unique_key=(), track=None, keep_if_empty=False, buckets=None, bucket_by=()
    ):
        before = self._entry(table)
        folder = f"data-{uuid.uuid4().hex}"
        if buckets:
            df, partition_by = _bucketed(df, buckets, bucket_by), [*[c for c in partition_by if c != BUCKET], BUCKET]
        rows, mark = self._write(df, f"{self.path(table)}/{folder}/{RUN}=0", partition_by, track)
        if rows or not keep_if_empty:
            self._commit(table, folder, df.schema.json(), partition_by, unique_key, before=before, buckets=buckets, bucket_by=bucket_by)
        else:
            remove(self.spark, f"{self.path(table)}/{folder}")
        return rows, mark

    def _like(self, entry) -> dict:
        """Partitioning and buckets of a table, for a full write that keeps them."""
        return {"partition_by": entry["partition_by"], "buckets": entry["buckets"], "bucket_by": entry["bucket_by"] or []}

    def overwrite(self, table: str, df: DataFrame, unique_key: Sequence[str] = ()) -> int:
        """Replace all rows, keeping the table's partitioning."""
        return self._create(table, df, unique_key=unique_key, **self._like(self._live(table)))[0]

    def rebucket(self, table: str, buckets: int, bucket_by: Sequence[str] = ()) -> int:
        """Store the table in another number of buckets, as it grows; returns the number of rows."""
        entry = self._live(table)
        parts = [c for c in entry["partition_by"] if c != BUCKET]
        bucket_by = list(bucket_by or entry["bucket_by"] or entry["unique_key"])
        if not bucket_by:
            raise ValueError("buckets need the columns that they come from: bucket_by")
        return self._create(table, self.read(table), parts, entry["unique_key"], buckets=buckets, bucket_by=bucket_by)[0]

    def append(self, table: str, df: DataFrame) -> int:
        """Add rows; existing files stay as they are."""
        return self._append(table, df)[0]

    def _append(self, table, df, track=None, run: str | None = None):
        """Add rows as a run of their own. Appending a run of the same id again replaces it."""
        entry = self._live(table)
        parts = entry["partition_by"]
        df = _bucketed(df, entry["buckets"], entry["bucket_by"])
        schema = _widen(entry["schema"], df)
        target = f"{self.path(table)}/{entry['folder']}/{RUN}={run or uuid.uuid4().hex}"
        if schema != entry["schema"] or not entry["appended"]:
            kept = {"buckets": entry["buckets"], "bucket_by": entry["bucket_by"] or []}
            self._commit(table, entry["folder"], schema, parts, [], appended=True, before=entry, **kept)
        return self._write(df, target, parts, track)

    def merge(
        self,
        table: str,
        batch: DataFrame,
        keys: Sequence[str],
        order_by: Sequence[str] = (),
        partition_by: Sequence[str] = (),
        keys_stay: bool = False,
        newest_wins: bool = False,
        buckets: int | None = None,
    ) -> dict[str, int]:
        """Upsert ``batch``; returns the numbers of inserted and updated keys.

        Creates the table if needed, with ``buckets`` stored by the hash of
        ``keys``; of a table in buckets only those are read and replaced that
        the batch's keys fall into, and their number is returned as well.
        Of a partitioned table only those partitions are read and replaced
        that hold a key of the batch or receive one. To find them the key columns of the table are read, unless
        the partition is part of the key or the caller vouches that a key never
        changes its partition (``keys_stay``). Rows of the batch replace those
        of the table, or with ``newest_wins`` only if they are greater by
        ``order_by``.
        """
        stage = self._staging()
        try:
            rows, _ = self._save(batch, stage)
            if rows == 0:
                return {"inserted": 0, "updated": 0}
            stored = self.spark.read.schema(batch.schema).parquet(stage)
            return self._merge(table, stored, keys, order_by, partition_by, keys_stay, newest_wins, buckets)
        finally:
            remove(self.spark, stage)

    def _staging(self) -> str:
        """A folder for rows that several steps read; only this call knows it."""
        return f"{self.base}/_staging/{uuid.uuid4().hex}"

    def _merge(self, table, batch, keys, order_by=(), partition_by=(), keys_stay=False, newest_wins=False, buckets=None) -> dict[str, int]:
        entry = self._entry(table)
        if entry is None:
            last = keep_last(_storable(batch, partition_by), keys, order_by)
            rows, _ = self._create(table, last, partition_by, keys, buckets=buckets, bucket_by=keys if buckets else ())
            return {"inserted": rows, "updated": 0}
        parts = entry["partition_by"]
        batch = _bucketed(_storable(batch, [c for c in parts if c != BUCKET]), entry["buckets"], entry["bucket_by"])
        schema = _widen(entry["schema"], batch)
        current = self._scan(table, {**entry.asDict(), "schema": schema})
        was_unique = sorted(entry["unique_key"]) == sorted(keys)
        in_place = bool(parts) and not entry["appended"]
        touched = None
        if in_place:
            touched = batch.select(*cols(parts))
            # A key's bucket can't change if it is made of the key.
            fixed = set(keys) | ({BUCKET} if set(entry["bucket_by"] or []) <= set(keys) else set())
            if not keys_stay and not set(parts) <= fixed:
                # A key may move: the partition that holds it now is touched as well.
                fresh = batch.select(*cols(keys)).distinct()
                touched = touched.union(match_keys(current, fresh, keys, "left_semi").select(*cols(parts)))
            touched = touched.distinct()
            current = match_keys(current, touched, parts, "left_semi")
        # Rows outside the touched partitions have none of the batch's keys.
        merged = merge_marked(current, batch, keys, order_by, newest_wins, MARK)
        merged = merged.select(*cols(T.StructType.fromJson(json.loads(schema)).fieldNames()), MARK)
        if not in_place:
            folder = f"data-{uuid.uuid4().hex}"
            stats = self._save_marked(merged, f"{self.path(table)}/{folder}/{RUN}=0", parts)
            self._commit(table, folder, schema, parts, keys, before=entry, buckets=entry["buckets"], bucket_by=entry["bucket_by"] or [])
            return stats
        return self._replace(table, entry, merged, touched, schema, keys if was_unique else [])

    def _save_marked(self, merged: DataFrame, target: str, partition_by: Sequence[str] = ()) -> dict[str, int]:
        """Write the rows of an upsert; the numbers of inserted and updated keys come out of the same job."""
        if partition_by:
            merged = merged.hint("rebalance", *partition_by)
        seen = Observation()
        kinds = [F.count_if(F.col(MARK) == kind).alias(kind) for kind in ("inserted", "updated")]
        write_parquet(merged.observe(seen, *kinds).drop(MARK), target, partition_by)
        return {kind: seen.get.get(kind) or 0 for kind in ("inserted", "updated")}

    def _replace(self, table, entry, merged, touched, schema, unique_key) -> dict[str, int]:
        """Put the merged rows in place of the touched partitions, from a staged copy."""
        parts, stage = entry["partition_by"], self._staging()
        target = f"{self.path(table)}/{entry['folder']}/{RUN}=0"
        try:
            stats = self._save_marked(merged, stage)
            result = self.spark.read.schema(merged.drop(MARK).schema).parquet(stage)
            gone = []
            if set(parts) != {BUCKET}:
                # Keys that moved may leave a partition empty; no key leaves its bucket.
                emptied = match_keys(touched, result.select(*cols(parts)).distinct(), parts, "left_anti")
                gone = emptied.select(*[col(c).cast("string").alias(c) for c in parts]).collect()
            kept = {"buckets": entry["buckets"], "bucket_by": entry["bucket_by"] or []}
            if schema != entry["schema"]:
                self._commit(table, entry["folder"], schema, parts, unique_key, before=entry, **kept)
            write_parquet(result.hint("rebalance", *parts), target, parts, only_touched=True)
            for row in gone:
                remove(self.spark, f"{target}/{_partition_path(self.spark, parts, row)}")
            if entry["buckets"]:
                stats["buckets"] = result.select(*cols(parts)).distinct().count()
        finally:
            remove(self.spark, stage)
        return stats

    def drop(self, table: str) -> None:
        """Remove the table."""
        self._live(table)
        remove(self.spark, self.path(table))

    def compact(self, table: str, files: int | None = None) -> int:
        """Rewrite into fewer files.

        Without ``files`` Spark sizes them by its advisory partition size and
        splits a partition value that is too large for one.
        """
        entry = self._live(table)
        df = self._scan(table, entry)
        parts = entry["partition_by"]
        if not parts:
            df = _in_files(df, files) if files else df.hint("rebalance")
        return self._create(table, df.drop(BUCKET), unique_key=entry["unique_key"], **self._like(entry))[0]

    def cluster(self, table: str, columns: Sequence[str], files: int) -> int:
        """Rewrite an unpartitioned table along a space-filling curve of the columns, so box filters skip files."""
        entry = self._live(table)
        if entry["partition_by"]:
            raise ValueError("a partitioned table already has an order of its own")
        return self._create(table, clustered(self._scan(table, entry), columns, files), unique_key=entry["unique_key"])[0]

    def retain(self, table: str, column: str, as_of: str, days: int) -> int:
        """Drop rows older than ``days``; returns the number of rows that stay. Rows without a value stay.

        If the table is partitioned by ``column`` alone, expired partitions are removed and the rest is not touched.
        """
        entry = self._live(table)
        current = self.read(table)
        kept = keep_recent(current, column, as_of, days)
        if entry["partition_by"] != [column]:
            return self.overwrite(table, kept, entry["unique_key"])
        values = current.select(col(column)).distinct()
        expired = values.join(keep_recent(values, column, as_of, days), column, "left_anti").where(col(column).isNotNull())
        for row in expired.select(col(column).cast("string").alias(column)).collect():
            part = _partition_path(self.spark, [column], row)
            remove(self.spark, f"{self.path(table)}/{entry['folder']}/{RUN}=*/{part}")
        return self.read(table).count()

    # --- runs --------------------------------------------------------------

    def run(
        self,
        table: str,
        source: DataFrame,
        transform,
        unique_key: Sequence[str] = (),
        watermark: str | None = None,
        order_by: Sequence[str] = (),
        partition_by: Sequence[str] = (),
        lookback=None,
        full_refresh: bool = False,
        keys_stay: bool = False,
        buckets: int | None = None,
    ) -> RunResult:
        """Bring ``table`` up to date from ``source``.

        Without a watermark column, or on a full refresh, the table is
        replaced. Otherwise only source rows above the stored value are
        transformed and merged (appended if there is no key), and the value
        advances after the data is written; it never moves back. An empty
        result writes nothing. A run that died before the value advanced may be
        repeated: its appended rows are replaced by those of the repetition.
        ``lookback`` takes rows again and therefore needs a key.
        """
        if lookback is not None and not unique_key:
            raise ValueError("lookback takes rows again: it needs a unique_key")
        incremental = watermark is not None and not full_refresh and self.exists(table)
        value = self.state.get_text(table, watermark) if incremental else None
        rows = newer_than(source, watermark, value, lookback) if watermark else source
        result = transform(rows)
        track = watermark if watermark in result.columns else None
        if unique_key:
            stage = self._staging()
            try:
                read, mark = self._save(result, stage, (), track)
                if read == 0:
                    return RunResult(table, 0, 0, 0, incremental, None)
                batch = self.spark.read.schema(result.schema).parquet(stage)
                if incremental:
                    stats = self._merge(table, batch, unique_key, order_by, partition_by, keys_stay)
                else:
                    last = keep_last(_storable(batch, partition_by), unique_key, order_by)
                    by = unique_key if buckets else ()
                    written, _ = self._create(table, last, partition_by, unique_key, buckets=buckets, bucket_by=by)
                    stats = {"inserted": written, "updated": 0}
            finally:
                remove(self.spark, stage)
        else:
            if incremental:
                run = hashlib.md5(f"{watermark}>{value}".encode()).hexdigest()
                read, mark = self._append(table, result, track, run)
            else:
                read, mark = self._create(table, result, partition_by, (), track, keep_if_empty=True)
            stats = {"inserted": read, "updated": 0}
        if mark is not None:
            kind = result.schema[watermark].dataType.simpleString()
            if incremental and value is not None:
                greater = F.greatest(F.lit(value).cast(kind), F.lit(mark).cast(kind)).cast("string")
                mark = self.spark.range(1).select(greater).first()[0]
            self.state.set(table, watermark, mark, kind, read)
        return RunResult(table, read, stats["inserted"], stats["updated"], incremental, mark)

    def promote(self, table: str, target: Lake, keys: Sequence[str] = (), order_by: Sequence[str] = ()) -> dict[str, int]:
        """Copy a tested table into another workspace: replace it, or upsert by ``keys``."""
        rows, layout = self.read(table), self.layout(table)
        if keys:
            buckets = layout["buckets"] if sorted(layout["bucket_by"]) == sorted(keys) else None
            return target._merge(table, rows, keys, order_by, layout["partition_by"], buckets=buckets)
        if target.exists(table):
            return {"inserted": target.overwrite(table, rows), "updated": 0}
        return {"inserted": target.create(table, rows, **layout), "updated": 0}

    def diff(self, table: str, other: Lake, keys: Sequence[str], columns: Sequence[str] | None = None, unchanged: bool = True) -> DataFrame:
        """What changed, by key, from this workspace's table to another one's: added, removed, changed, unchanged.

        By checksums; if both are stored in the same buckets of these keys, files of equal buckets are not read again.
        """
        mine, theirs = self.layout(table), other.layout(table)
        same = mine["buckets"] and mine["buckets"] == theirs["buckets"] and mine["bucket_by"] == theirs["bucket_by"] == list(keys)
        both = [lake.read(table, with_bucket=bool(same)) for lake in (self, other)]
        return checksum_diff(*both, keys, columns, mine["buckets"] if same else 256, 64, BUCKET if same else None, unchanged)


def remove(spark: SparkSession, path: str) -> None:
    """Delete files or folders (``*`` matches any name) from the store that holds them."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.globStatus(pattern) or []:
        store.delete(found.getPath(), True)


def _partition_path(spark: SparkSession, parts: Sequence[str], row) -> str:
    """The folder of one partition, as Spark's writer names it; characters that a pattern gives a meaning are escaped."""
    naming = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    names = [naming.getPartitionPathString(c, row[c]) for c in parts]
    return "/".join(re.sub(r"([\\{}\[\]*?,])", r"\\\1", n) for n in names)


def _storable(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Empty text in a partition column as null, which is what a partition directory makes of it."""
    texts = [c for c in partition_by if isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: F.nullif(col(c), F.lit("")) for c in texts}) if texts else df


def _bucketed(df: DataFrame, buckets: int | None, bucket_by: Sequence[str] | None) -> DataFrame:
    return df.withColumn(BUCKET, bucket_of(bucket_by, buckets)) if buckets else df


def _in_files(df: DataFrame, files: int) -> DataFrame:
    """A scan's rows in so many files: its tasks are joined, so that stored files are read where they are written again.

    A scan of fewer tasks is dealt anew.
    """
    return df.coalesce(files) if df.rdd.getNumPartitions() >= files else df.repartition(files)


def _widen(schema_json: str, df: DataFrame) -> str:
    """The stored schema plus columns new in ``df``; a type may only become wider, which old files are read as."""
    schema = T.StructType.fromJson(json.loads(schema_json))
    fields = {f.name: f for f in schema.fields}
    for field in df.schema.fields:
        if field.name not in fields:
            fields[field.name] = T.StructField(field.name, field.dataType, True)
            continue
        have = fields[field.name]
        kind = wider(have.dataType, field.dataType)
        if kind is None:
            raise ValueError(f"{field.name}: table has {have.dataType}, batch has {field.dataType}")
        fields[field.name] = T.StructField(field.name, kind, have.nullable, have.metadata)
    return T.StructType(list(fields.values())).json()
