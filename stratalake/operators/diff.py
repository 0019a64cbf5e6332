"""Comparing tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.functions.columns import col, cols, comparable, require_columns


def _signed(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each distinct row once, with its number of copies on either side.

    Copies are combined before the shuffle; no join, so equal rows never
    multiply.
    """
    require_columns(left, columns)
    require_columns(right, columns)
    sides = []
    for df, l, r in ((left, 1, 0), (right, 0, 1)):
        fields = [df.schema[c] for c in columns]
        sides.append(
            df.select(
                *[comparable(f).alias(f.name) for f in fields],
                F.lit(l).cast("bigint").alias("_l"),
                F.lit(r).cast("bigint").alias("_r"),
            )
        )
    both = sides[0].unionByName(sides[1])
    return both.groupBy(*cols(columns)).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))


def symmetric_diff(
    left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None, distinct: bool = False
) -> DataFrame:
    """Rows on one side only, with the number of surplus copies per side.

    ``distinct`` ignores how often a row occurs.
    """
    columns = list(columns or left.columns)
    rows = _signed(left, right, columns)
    if distinct:
        only_left = F.when((F.col("_l") > 0) & (F.col("_r") == 0), 1).otherwise(0).cast("bigint")
        only_right = F.when((F.col("_r") > 0) & (F.col("_l") == 0), 1).otherwise(0).cast("bigint")
    else:
        only_left = F.greatest(F.col("_l") - F.col("_r"), F.lit(0))
        only_right = F.greatest(F.col("_r") - F.col("_l"), F.lit(0))
    out = rows.select(*cols(columns), only_left.alias("only_left"), only_right.alias("only_right"))
    return out.where((F.col("only_left") > 0) | (F.col("only_right") > 0))


def diff_counts(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None, distinct: bool = False) -> DataFrame:
    """One row: number of rows only left, only right, and both together."""
    found = symmetric_diff(left, right, columns, distinct)
    return found.agg(
        F.coalesce(F.sum("only_left"), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum("only_right"), F.lit(0)).alias("only_right"),
    ).withColumn("differences", F.col("only_left") + F.col("only_right"))


def table_diff(
    before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Status per key: added, removed, changed or unchanged.

    A key counts as changed if its rows, with their number of copies, are not
    the same on both sides, so repeated keys are compared as a whole.
    """
    columns = list(columns or [c for c in before.columns if c not in keys])
    rows = _signed(before, after, [*keys, *columns])
    per_key = rows.groupBy(*cols(keys)).agg(
        F.sum("_l").alias("_l"),
        F.sum("_r").alias("_r"),
        F.max(F.col("_l") != F.col("_r")).alias("_differs"),
    )
    status = (
        F.when(F.col("_l") == 0, "added")
        .when(F.col("_r") == 0, "removed")
        .when(F.col("_differs"), "changed")
        .otherwise("unchanged")
    )
    return per_key.select(*cols(keys), status.alias("status"))


def tolerance_diff(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 0.01
) -> DataFrame:
    """Keys whose numbers differ by more than ``tolerance``, with the status of each key.

    Both sides fold into one row per key. Statuses: missing_left,
    missing_right, repeated_key (the key occurs more than once on a side, so
    rows cannot be paired) or different. A null differs from any number; NaN equals NaN.
    """
    require_columns(left, [*keys, *columns])
    require_columns(right, [*keys, *columns])
    sides = [
        df.select(*cols(keys), *cols(columns), F.lit(is_left).alias("_left"))
        for df, is_left in ((left, True), (right, False))
    ]
    on_left = F.col("_left")
    aggs = [F.count_if(on_left).alias("_nl"), F.count_if(~on_left).alias("_nr")]
    for i, c in enumerate(columns):
        aggs += [F.max(F.when(on_left, col(c))).alias(f"_l{i}"), F.max(F.when(~on_left, col(c))).alias(f"_r{i}")]
    per_key = sides[0].unionByName(sides[1]).groupBy(*cols(keys)).agg(*aggs)

    def far(i: int) -> Column:
        l, r = F.col(f"_l{i}"), F.col(f"_r{i}")
        apart = F.abs(l - r).cast("double") > F.lit(float(tolerance))
        return F.coalesce(apart & ~l.eqNullSafe(r), l.isNull() != r.isNull())

    different = reduce(lambda a, b: a | b, [far(i) for i in range(len(columns))])
    status = (
        F.when((F.col("_nl") > 1) | (F.col("_nr") > 1), "repeated_key")
        .when(F.col("_nl") == 0, "missing_left")
        .when(F.col("_nr") == 0, "missing_right")
        .when(different, "different")
    )
    values = [
        c
        for i, name in enumerate(columns)
        for c in (F.col(f"_l{i}").alias(f"{name}_left"), F.col(f"_r{i}").alias(f"{name}_right"))
    ]
    return per_key.select(*cols(keys), status.alias("status"), *values).where(F.col("status").isNotNull())


def matches_expected(
    actual: DataFrame,
    expected: DataFrame,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] | None = None,
    tolerance: float | None = None,
) -> bool:
    """Whether a result equals the expected rows on the chosen columns.

    With ``keys`` and ``tolerance`` the other chosen columns are compared as
    numbers within the tolerance; otherwise rows must be equal, copies included.
    """
    columns = list(columns or expected.columns)
    if keys and tolerance is not None:
        numbers = [c for c in columns if c not in keys]
        return tolerance_diff(actual, expected, keys, numbers, tolerance).isEmpty()
    return symmetric_diff(actual, expected, columns).isEmpty()
