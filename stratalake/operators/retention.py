"""Retention per layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.functions.columns import col

# Days a layer keeps its rows; None keeps them for ever.
LAYER_RETENTION_DAYS = {"bronze": 90, "silver": 365, "gold": None}


def retain(df: DataFrame, column: str, as_of: str, days: int | None) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; a row without a date is not known to be older and stays.

    The limit is a constant of the column's type, so a scan partitioned by the
    column skips the expired partitions.
    """
    if days is None:
        return df
    limit = F.date_sub(F.lit(as_of).cast("date"), days).cast(df.schema[column].dataType)
    return df.where((col(column) >= limit) | col(column).isNull())
