"""Cleaning of text columns, types and audit columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import col

# Texts that stand for null once surrounding blanks are removed.
NULL_SPELLINGS = (
    "", "NaN", "nan", "NAN", "NA", "na", "N/A", "n/a",
    "<NA>", "null", "NULL", "None", "none", "#N/A", "#NA", "-",
)

# Every character Unicode counts as white space.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def null_if_spelled(value: Column) -> Column:
    """Null for the null spellings, the untouched (untrimmed) text otherwise."""
    return F.when(~F.btrim(value, F.lit(BLANKS)).isin(*NULL_SPELLINGS), value)


def clean_null_strings(df: DataFrame) -> DataFrame:
    """Apply :func:`null_if_spelled` to all text columns in one projection.

    Numeric NaN is left alone.
    """
    return df.select(
        *[
            null_if_spelled(col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name)
            for f in df.schema.fields
        ]
    )


def apply_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns to declared types; text that does not parse becomes null.

    A bare ``decimal`` is refused, because Spark would read it as
    ``decimal(10,0)`` and drop the cents.
    """
    for name, ddl in types.items():
        if ddl.strip().lower() == "decimal":
            raise ValueError(f"{name}: give precision and scale, e.g. decimal(12,2)")
    return df.select(
        *[
            col(name).try_cast("timestamp" if types[name].lower() == "datetime" else types[name]).alias(name)
            if name in types
            else col(name)
            for name in df.columns
        ]
    )


def nanos_to_timestamps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nanoseconds since the epoch (as Spark reads nanosecond Parquet with ``nanosAsLong``) to timestamps.

    Spark keeps microseconds; the rest is cut off downwards.
    """
    return df.withColumns(
        {c: F.timestamp_micros(F.expr(f"(`{c}` - pmod(`{c}`, 1000L)) div 1000L")) for c in columns}
    )


def add_audit_columns(df: DataFrame, source: str, run_ts: str, source_file: Column | None = None) -> DataFrame:
    """Append ``_source``, ``_ingested_at`` and, if given, ``_source_file``."""
    out = df.withColumn("_source", F.lit(source)).withColumn("_ingested_at", F.lit(run_ts).cast("timestamp"))
    return out if source_file is None else out.withColumn("_source_file", source_file)
