"""Distinct counts kept as table columns: sketches per fine group that merge into coarser ones without the facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.functions.columns import col, cols, require_columns

#: 2**14 registers: a standard error of 0.8 %, at most 16 KB a sketch; few values are kept exactly.
PRECISION = 14


def distinct_sketches(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], precision: int = PRECISION) -> DataFrame:
    """Per group one sketch (binary) for each counted column; ``columns`` maps output names to columns.

    Nulls are not counted. A group in which the column is always null has an empty sketch.
    """
    require_columns(df, [*keys, *columns.values()])
    sketches = [F.hll_sketch_agg(col(c), F.lit(precision)).alias(name) for name, c in columns.items()]
    return df.groupBy(*cols(keys)).agg(*sketches)


def merge_sketches(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones; a value in several of them counts once."""
    require_columns(df, [*keys, *names])
    return df.groupBy(*cols(keys)).agg(*[F.hll_union_agg(col(n)).alias(n) for n in names])


def estimates(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The sketches replaced by the distinct counts that they stand for."""
    require_columns(df, names)
    return df.withColumns({n: F.hll_sketch_estimate(col(n)) for n in names})


def refresh_sketches(stored: DataFrame | None, fresh: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Stored sketches with those of new rows merged in; a repeated batch changes nothing, as sets do not count copies."""
    both = fresh if stored is None else stored.select(*cols(keys), *cols(names)).unionByName(fresh.select(*cols(keys), *cols(names)))
    return merge_sketches(both, keys, names)
