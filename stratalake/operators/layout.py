"""Laying rows out so that filters skip files: order along a space-filling curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import col, cols, require_columns

#: Bits of rank per column: 64 quantiles each.
BITS = 6


def _number(df: DataFrame, column: str) -> Column:
    """A column as a double that keeps its order."""
    kind = df.schema[column].dataType
    value = col(column)
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    raise TypeError(f"{column}: {kind.simpleString()} has no quantiles; order by numbers, dates or times")


def quantile_bounds(df: DataFrame, columns: Sequence[str], bits: int = BITS, error: float = 0.002) -> dict[str, list[float]]:
    """For each column the values between its 2**bits quantiles, all in one pass over mergeable summaries."""
    require_columns(df, columns)
    shares = [i / 2**bits for i in range(1, 2**bits)]
    numbers = df.select(*[_number(df, c).alias(f"_{i}") for i, c in enumerate(columns)])
    found = numbers.approxQuantile([f"_{i}" for i in range(len(columns))], shares, error)
    return {c: sorted(set(values)) for c, values in zip(columns, found, strict=True)}


def rank_among(value: Column, bounds: Sequence[float]) -> Column:
    """How many of the sorted bounds are at most ``value``: a search tree of comparisons; null ranks lowest."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(bounds[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return F.when(value.isNull(), F.lit(0)).otherwise(search(0, len(bounds)))


def interleaved(ranks: Sequence[Column], bits: int = BITS) -> Column:
    """The Z-order number: the ranks' bits in turn, the highest first."""
    place, number = bits * len(ranks), F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for rank in ranks:
            place -= 1
            one = F.shiftright(rank.cast("long"), bit).bitwiseAND(F.lit(1).cast("long"))
            number = number + one * F.lit(1 << place).cast("long")
    return number


def clustered(df: DataFrame, columns: Sequence[str], files: int, bits: int = BITS) -> DataFrame:
    """The rows dealt into ``files`` ranges along the curve, so a box filter on any of the columns meets few of them.

    Ranks are quantiles, so each column cuts the rows evenly however its values lie. Rows of one cell are told apart by the
    columns themselves: a value that holds many rows does not end up in one file.
    """
    if not 1 <= bits <= 16:
        raise ValueError("bits must be 1 to 16")
    bounds = quantile_bounds(df, columns, bits)
    names = [f"__rank{i}" for i in range(len(columns))]
    ranked = df.withColumns({n: rank_among(_number(df, c), bounds[c]) for n, c in zip(names, columns, strict=True)})
    spot = "__spot"
    placed = ranked.withColumn(spot, interleaved([F.col(n) for n in names], bits)).drop(*names)
    rest = [F.xxhash64(*cols(c for c in df.columns if not _has_map(df, c)))]
    ordered = placed.repartitionByRange(files, F.col(spot), *cols(columns), *rest).sortWithinPartitions(spot, *cols(columns))
    return ordered.drop(spot)


def _has_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()


def files_holding(df: DataFrame, condition: Column | str | None = None) -> DataFrame:
    """The files in which rows meet a condition: those that a reader has to open for them."""
    found = df if condition is None else df.where(condition)
    return found.select(F.input_file_name().alias("file")).distinct()
