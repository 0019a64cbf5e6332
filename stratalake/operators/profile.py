"""Table profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import col, comparable, has_map


def _long(wide: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn one wide row (``<field><i>`` columns) into one row per table column."""
    rows = [
        F.struct(F.lit(name).alias("column"), *[F.col(f"{prefix}{i}").alias(out) for prefix, out in fields.items()], F.col("_rows").alias("rows"))
        for i, name in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))


def null_report(df: DataFrame) -> DataFrame:
    """Per column: null count, row count, null percentage (2 digits). One aggregate."""
    counts = [F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *counts)
    return _long(wide, df.columns, {"n": "nulls"}).withColumn("pct", share(F.col("nulls"), F.col("rows")))


def null_totals(df: DataFrame) -> DataFrame:
    """Nulls over all cells of the table: total nulls, total cells, percentage."""
    return (
        null_report(df)
        .agg(F.sum("nulls").alias("total_nulls"), F.sum("rows").alias("total_cells"))
        .withColumn("pct", share(F.col("total_nulls"), F.col("total_cells")))
    )


def share(part: Column, whole: Column) -> Column:
    """Percentage with 2 digits; 0 for an empty whole."""
    value = F.round(part * F.lit(100).cast("decimal(4,1)") / F.nullif(whole, F.lit(0)), 2)
    return F.coalesce(value, F.lit(0)).cast("double")


def table_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: rows, nulls, distinct values, smallest and largest value as text.

    Nulls and extremes of all columns come from one aggregate. Exact distinct
    counts come from one more pass over (column, value) pairs, combined before
    the shuffle; ``approximate`` folds sketches into the first pass instead.
    """
    fields = df.schema.fields
    aggs = []
    for i, field in enumerate(fields):
        value = comparable(field)
        aggs += [
            F.count_if(col(field.name).isNull()).alias(f"n{i}"),
            F.min(value).cast("string").alias(f"lo{i}") if not has_map(field.dataType) else F.lit(None).cast("string").alias(f"lo{i}"),
            F.max(value).cast("string").alias(f"hi{i}") if not has_map(field.dataType) else F.lit(None).cast("string").alias(f"hi{i}"),
        ]
        if approximate:
            aggs.append(F.approx_count_distinct(value).alias(f"d{i}"))
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    shape = {"n": "nulls", "lo": "min", "hi": "max"}
    if approximate:
        return _long(wide, df.columns, {**shape, "d": "distinct"})
    pairs = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("i"), as_text(f).alias("value"))
                    for i, f in enumerate(fields)
                ]
            )
        ).alias("p")
    ).select("p.i", "p.value")
    distinct = pairs.distinct().groupBy("i").agg(F.count("value").alias("distinct"))
    names = F.array(*[F.lit(c) for c in df.columns])
    named = distinct.select(F.get(names, F.col("i")).alias("column"), "distinct")
    return _long(wide, df.columns, shape).join(named, "column", "left").withColumn(
        "distinct", F.coalesce("distinct", F.lit(0))
    )


def as_text(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return comparable(field) if has_map(field.dataType) else F.to_json(col(field.name))
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(col(field.name))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return (col(field.name) + F.lit(0.0).cast(field.dataType)).cast("string")  # one zero
    return col(field.name).cast("string")


def schema_table(df: DataFrame) -> DataFrame:
    """Column name, type, nullability and position as a table."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def describe(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """One row: name, rows, columns, column count, path. The count reads no column data."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("name"),
        "row_count",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(path).cast("string").alias("path"),
    )


def preview(df: DataFrame, limit: int = 100, columns: list[str] | None = None, order_by: list[Column] | None = None) -> DataFrame:
    """The first rows, in a stated order if one is given (a top-k, not a full sort)."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    out = df.orderBy(*order_by) if order_by else df
    out = out.limit(limit)
    return out.select(*[col(c) for c in columns]) if columns else out
