"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A top-level column by its exact name, even if it contains dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Iterable[str]) -> list[Column]:
    return [col(name) for name in names]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; have {df.columns}")


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on all keys, null keys equal to each other.

    The right side is renamed, so both may derive from the same DataFrame.
    """
    renamed = right.select(*[col(key).alias(f"_right_{i}") for i, key in enumerate(keys)])
    same = reduce(
        lambda a, b: a & b, [col(key).eqNullSafe(F.col(f"_right_{i}")) for i, key in enumerate(keys)]
    )
    return left.join(renamed, same, how)


def has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return has_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(has_map(field.dataType) for field in data_type.fields)
    return False


def comparable(field: T.StructField) -> Column:
    """The column itself, or its JSON text where it holds a map.

    Spark can neither order nor group by maps.
    """
    if isinstance(field.dataType, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(col(field.name))))
    return F.to_json(col(field.name)) if has_map(field.dataType) else col(field.name)


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Money columns as double, for consumers without decimals."""
    return df.select(
        *[
            col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else col(f.name)
            for f in df.schema.fields
        ]
    )
