"""Grouped measures with exact distinct counts and modes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import col, cols, match_keys
from stratalake.session import shared_dir


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` in percent of ``whole``, rounded; null where ``whole`` is zero."""
    return F.round(part * F.lit(100).cast("decimal(4,1)") / F.nullif(whole, F.lit(0)), digits)


def grouped_measures(
    df: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
    distincts: Mapping[str, str] | None = None,
    modes: Mapping[str, str] | None = None,
    one_pass: bool = False,
) -> DataFrame:
    """Sums, extremes, exact distinct counts and modes per group.

    ``sums={"n": F.lit(1)}`` counts rows. A mode is the most frequent non-null
    value, the lowest one on a tie.

    Each distinct count and each mode first aggregates by (group, value). This
    spreads a group that holds most rows over all tasks and keeps no set of
    values in memory, which ``mode`` would do for a whole group in one task.

    By default every counted column is a pass of its own that reads only that
    column and the keys: best for stored, columnar tables. ``one_pass`` reads
    ``df`` once, stores what is counted and shuffles it once: best if ``df`` is
    itself the result of joins. Only groups with so many rows that a task should
    not get one whole are counted as grouping sets, which copy each row per
    counted column.
    """
    sums, mins, maxs = dict(sums or {}), dict(mins or {}), dict(maxs or {})
    distincts, modes = dict(distincts or {}), dict(modes or {})
    plain = {**sums, **mins, **maxs}

    def fold(name: str, value: Column) -> Column:
        if name in sums:
            return F.sum(value).alias(name)
        return (F.min(value) if name in mins else F.max(value)).alias(name)

    if not (distincts or modes):
        return df.groupBy(*cols(keys)).agg(*[fold(n, v) for n, v in plain.items()])
    run = _in_one_pass if one_pass else _per_column
    return run(df, keys, plain, fold, distincts, modes).select(*cols(keys), *cols([*plain, *distincts, *modes]))


def _most_frequent(value: Column, count: Column) -> Column:
    lead = F.min(F.when(value.isNotNull(), F.struct((-count).alias("o"), value.alias("v"))))
    return lead.getField("v")


def _per_column(df, keys, plain, fold, distincts, modes) -> DataFrame:
    """Per-group results of each column, unioned and folded; null groups need no special treatment."""
    parts = []
    carried = dict(plain)
    for name, column in modes.items():
        by_value = df.groupBy(*cols(keys), col(column).alias("_value")).agg(
            F.count(F.lit(1)).alias("_n"), *[fold(n, v) for n, v in carried.items()]
        )
        parts.append(
            by_value.groupBy(*cols(keys)).agg(
                _most_frequent(F.col("_value"), F.col("_n")).alias(name), *[fold(n, F.col(n)) for n in carried]
            )
        )
        # The first mode carries the plain measures along.
        carried = {}
    if carried:
        parts.append(df.groupBy(*cols(keys)).agg(*[fold(n, v) for n, v in carried.items()]))
    for name, column in distincts.items():
        values = df.select(*cols(keys), col(column).alias("_value")).distinct()
        parts.append(values.groupBy(*cols(keys)).agg(F.count("_value").alias(name)))
    if len(parts) == 1:
        return parts[0]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.groupBy(*cols(keys)).agg(*[F.max(n).alias(n) for n in [*plain, *distincts, *modes]])


#: A group with more than this share of all rows is busy; so many may be found.
BUSY, BUSY_GROUPS = 0.001, 1024


def _busy(rows: DataFrame, place: Column) -> list[int]:
    """The places of groups that hold more than ``BUSY`` of all rows, by a bounded sketch: none is missed that holds 1.5 times as much."""
    top = F.call_function("approx_top_k", place, F.lit(BUSY_GROUPS), F.lit(4 * BUSY_GROUPS))
    found = rows.agg(top.alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [r["item"] for r in found["top"] or [] if r["count"] > BUSY * found["n"]]


def _counts_as_grouped(kind: T.DataType) -> bool:
    """Whether sets of such values tell them apart as grouping does."""
    return kind == T.StringType() or isinstance(kind, (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))


def _in_one_pass(df, keys, plain, fold, distincts, modes) -> DataFrame:
    """Rows are dealt by group and counted where they meet; those of busy groups as grouping sets, spread over all tasks.

    A mode's or a set's memory is bounded by a group that is not busy.
    """
    counted = [*modes.values(), *distincts.values()]
    values = [f"_v{i}" for i in range(len(counted))]
    rows = df.select(
        *cols(keys),
        *[col(c).alias(v) for c, v in zip(counted, values)],
        *[v.alias(f"_m_{n}") for n, v in plain.items()],
    )
    if not keys or not all(_counts_as_grouped(df.schema[c].dataType) for c in counted):
        return _as_grouping_sets(rows, keys, values, plain, fold, distincts, modes)
    folder = shared_dir(df.sparkSession, "measured")
    rows.write.parquet(folder)
    rows = df.sparkSession.read.schema(rows.schema).parquet(folder)
    place = F.xxhash64(*cols(keys))
    busy = _busy(rows, place)
    spread = rows.where(~place.isin(busy)) if busy else rows
    out = [fold(n, col(f"_m_{n}")) for n in plain]
    out += [F.mode(v, True).alias(name) for name, v in zip(modes, values)]
    out += [F.size(F.collect_set(v)).cast("long").alias(name) for name, v in zip(distincts, values[len(modes) :])]
    dealt = spread.repartition(*cols(keys)).groupBy(*cols(keys)).agg(*out)
    if not busy:
        return dealt
    return dealt.unionByName(_as_grouping_sets(rows.where(place.isin(busy)), keys, values, plain, fold, distincts, modes))


def _as_grouping_sets(rows, keys, values, plain, fold, distincts, modes) -> DataFrame:
    """One grouping set per counted column; the first one carries the plain measures."""
    by_value = rows.groupingSets([[*cols(keys), col(v)] for v in values], *cols(keys), *cols(values)).agg(
        F.grouping("_v0").alias("_other"),
        F.count(F.lit(1)).alias("_n"),
        *[fold(n, col(f"_m_{n}")) for n in plain],
    )
    first = F.col("_other") == 0
    out = [fold(n, F.when(first, col(n))) for n in plain]
    out += [_most_frequent(F.col(v), F.col("_n")).alias(name) for name, v in zip(modes, values)]
    # Within its own grouping set each value occurs once; in the others it is null.
    out += [F.count(v).alias(name) for name, v in zip(distincts, values[len(modes) :])]
    return by_value.groupBy(*cols(keys)).agg(*out)


def mode_by(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """The most frequent non-null value of ``column`` per group."""
    return grouped_measures(df, keys, modes={name: column})


# --- modes by heavy hitters ---------------------------------------------------

#: Fixed value of the sketch: an item's count is off by at most this share of all counts, over the size of its table.
ERROR_FACTOR = 3.5


def _count_error(tracked: int) -> float:
    """The share of a group's rows by which a count of the sketch may be off, for so many tracked values."""
    size = 8
    while size * 3 // 4 < tracked:
        size *= 2
    return ERROR_FACTOR / size


def mode_by_candidates(df: DataFrame, keys: Sequence[str], column: str, name: str, tracked: int = 64) -> DataFrame:
    """``mode_by`` for columns of very many values: the most frequent non-null value per group, the lowest on a tie.

    A first pass keeps at most ``tracked`` counters per group and task, merged over tasks; its values are the
    candidates. A second pass counts them exactly. What is not a candidate occurs at most in the sketch's error bound of
    the group's rows, so a candidate with more is proven to be the mode, ties included. Groups without such a value (no value
    stands out) are counted as ``mode_by`` does. Only these shuffle all their values.
    """
    rows = df.select(*cols(keys), col(column).alias("_value"))
    known = rows.where(F.col("_value").isNotNull())
    sketch = F.call_function("approx_top_k", F.col("_value"), F.lit(tracked), F.lit(tracked))
    found = known.groupBy(*cols(keys)).agg(sketch.alias("_top"), F.count(F.lit(1)).alias("_rows"))
    listed = found.select(*cols(keys), "_rows", F.explode("_top").alias("_c")).select(*cols(keys), "_rows", F.col("_c.item").alias("_value"))
    same = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    candidates = listed.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_rows", F.col("_value").alias("_candidate"))
    on = reduce(lambda a, b: a & b, [*same, F.col("_value") == F.col("_candidate")])
    counted = known.join(candidates, on).groupBy(*cols(keys), "_rows", "_value").agg(F.count(F.lit(1)).alias("_n"))
    best = counted.groupBy(*cols(keys)).agg(_most_frequent(F.col("_value"), F.col("_n")).alias(name), F.max("_n").alias("_n"), F.max("_rows").alias("_rows"))
    proven = F.col("_n") > F.col("_rows") * F.lit(_count_error(tracked))
    sure = best.where(proven).select(*cols(keys), name)
    # The others: groups without a known value, and those in which no value stands out.
    rest = match_keys(rows, sure, keys, "left_anti")
    return sure.unionByName(mode_by(rest, keys, "_value", name))
