"""Reading and writing files, file inventories, landing-zone ingest and fixtures."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import cols

Parser = Callable[[io.BytesIO, str], pd.DataFrame]


# --- Parquet ---------------------------------------------------------------


def read_parquet(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    where: str | Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Scan with filter, projection and row cap; Spark pushes the first two into the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    if columns is not None:
        df = df.select(*cols(columns))
    return df if limit is None else df.limit(limit)


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    only_touched: bool = False,
    compression: str = "zstd",
    max_records_per_file: int | None = None,
) -> None:
    """Write Parquet, partitioned by directories if asked.

    ``only_touched`` replaces just the partitions that occur in ``df`` and
    leaves the others. The path must not be one that ``df`` reads.
    """
    writer = df.write.mode(mode).option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if only_touched:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)


# --- inventories -----------------------------------------------------------


def inventory(
    spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, modified_after: str | None = None
) -> DataFrame:
    """Files below ``path``: path, name, extension, length, modification time. Reads no content."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(path).select(
        "path",
        name.alias("name"),
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"),
        "length",
        F.col("modificationTime").alias("modified_at"),
    )


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """MD5 of each file's content, computed by the executors that read it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.load(path).select(F.col("path").alias("file_path"), F.md5("content").alias("file_hash"), "length")


def size_text(size: Column) -> Column:
    """Bytes in a readable unit (factor 1024, one digit)."""
    text = F.format_string("%.1f TB", size / F.lit(1024.0**4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        text = F.when(size < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", size / F.lit(1024.0**power))).otherwise(text)
    return text


# --- landing zone ----------------------------------------------------------

READERS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "txt": "text"}
_parsers: dict[str, tuple[Parser, str]] = {}


def register_parser(name: str, parser: Parser, schema: str) -> None:
    """Name a function ``(bytes, filename) -> pandas.DataFrame`` with its output schema."""
    _parsers[name] = (parser, schema)


def get_parser(name: str) -> tuple[Parser, str]:
    if name not in _parsers:
        raise KeyError(f"no parser is registered as {name!r}; known are {list_parsers()}")
    return _parsers[name]


def list_parsers() -> list[str]:
    return sorted(_parsers)


def parse_files(spark: SparkSession, path: str, parser: Parser, schema: str, pattern: str = "*") -> DataFrame:
    """Run a user parser over whole files on the executors; ``_source_file`` is added.

    One file is the unit of work: a file reaches the parser as a whole and
    must fit an executor's memory, but no two files have to.
    """
    out = T.StructType.fromDDL(schema).add("_source_file", T.StringType())
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_path, content in zip(batch["path"], batch["content"]):
                rows = parser(io.BytesIO(content), file_path.rsplit("/", 1)[-1])
                yield rows.assign(_source_file=file_path)[out.fieldNames()]

    return files.select("path", "content").mapInPandas(parse, out)


def read_landing(
    spark: SparkSession,
    path: str,
    extension: str,
    schema: str | None = None,
    parser: str | None = None,
    pattern: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Landing files of one extension (in any case), by Spark's reader for it or by a registered parser.

    CSV needs a schema: inference reads the data twice and guesses (``T1``
    would become a timestamp).
    """
    pattern = pattern or "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)
    if parser is not None:
        function, declared = get_parser(parser)
        return parse_files(spark, path, function, declared, pattern)
    if extension.lower() not in READERS:
        raise ValueError(f"no reader for .{extension} files; register a parser")
    kind = READERS[extension.lower()]
    if kind == "csv" and schema is None:
        raise ValueError("CSV needs a schema")
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if kind == "csv":
        reader = reader.option("header", "true").option("sep", "\t" if extension.lower() == "tsv" else ",")
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(kind).load(path).withColumn("_source_file", F.col("_metadata.file_path"))


def with_filename_fields(df: DataFrame, pattern: str, fields: Sequence[str], column: str = "_source_file") -> DataFrame:
    """Add one text column per capture group of ``pattern`` on the file's name; null if it does not match."""
    name = F.element_at(F.split(F.col(column), "/"), -1)
    return df.withColumns(
        {
            field: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, i + 1))
            for i, field in enumerate(fields)
        }
    )


def rename(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(columns))


# --- fixtures --------------------------------------------------------------


def table_name(text: str) -> str:
    """A file stem or ``layer.table`` as a view name."""
    return re.sub(r"\W", "_", text, flags=re.ASCII)


def _stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def csv_fixture(spark: SparkSession, path: str, schema: str | None = None) -> tuple[str, DataFrame]:
    reader = spark.read.option("header", "true")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", "true")
    return table_name(_stem(path)), reader.csv(path)


def parquet_fixture(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    return table_name(_stem(path)), spark.read.parquet(path)


def json_fixture(spark: SparkSession, path: str, schemas: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables of one JSON file, by view name.

    The file is a list of rows, one object (a single row), ``{"table", "rows"}``
    or ``{"tables": [{"table", "rows"}, ...]}``.
    """
    schemas = dict(schemas or {})
    whole = spark.read.option("multiLine", "true").json(path)

    def typed(name: str, rows: DataFrame) -> DataFrame:
        if name not in schemas:
            return rows
        wanted = T.StructType.fromDDL(schemas[name])
        return rows.select(
            *[
                (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in wanted.fields
            ]
        )

    def rows_of(df: DataFrame) -> DataFrame:
        return df.select(F.inline("rows"))

    if "tables" in whole.columns and "rows" not in whole.columns:
        listed = whole.select(F.explode("tables").alias("t")).select("t.table", "t.rows")
        names = [r["table"] for r in listed.select("table").collect()]
        return {
            table_name(n): typed(table_name(n), rows_of(listed.where(F.col("table") == n))) for n in names
        }
    if "rows" in whole.columns:
        label = whole.select("table").first()["table"] if "table" in whole.columns else None
        name = table_name(label or _stem(path))
        return {name: typed(name, rows_of(whole))}
    name = table_name(_stem(path))
    return {name: typed(name, whole)}
