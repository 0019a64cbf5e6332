"""Exact quantiles of many columns in two scans of the table and no sort of it.

The first scan makes a bounded sketch per column, which tells limits that hold each wanted quantile almost surely. The
second one counts the values inside these limits one by one and all others together; the counts tell whether the limits
hold, and the few values inside them are all that is looked at from then on. Every number is mapped to a 64-bit whole
number of the same order, and repeated histograms of its next few bits lead to the one wanted. A quantile outside its
limits is found by the same histograms of the whole column.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import col, require_columns
from stratalake.session import shared_dir

QUARTILES = (0.25, 0.5, 0.75)
#: How many low bits are still unknown after each scan.
SHIFTS = (53, 42, 32, 21, 10, 0)
#: Size of the sketches, and how far from its share a quantile's limits are: twice the error that sketches of this size have.
SKETCH, MARGIN = 2048, 0.005
RESULT_SCHEMA = "column string, share double, value string"


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType) and not (isinstance(kind, T.DecimalType) and kind.precision > 18)


def _is_float(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DoubleType, T.FloatType))


def number_columns(df: DataFrame) -> list[str]:
    """The columns that have quantiles here: whole and floating numbers, decimals of up to 18 digits."""
    return [f.name for f in df.schema.fields if _is_number(f.dataType)]


def plain_values(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """The columns as ``v0``, ``v1``, ...: doubles, and whole numbers (a decimal's digits) as 64-bit ones."""
    out = []
    for i, field in enumerate(fields):
        value = col(field.name)
        if _is_float(field):
            value = value.cast("double")
        elif isinstance(field.dataType, T.DecimalType):
            value = (value.cast(f"decimal(38,{field.dataType.scale})") * F.lit(10**field.dataType.scale)).cast("long")
        out.append(value.cast("double" if _is_float(field) else "long").alias(f"v{i}"))
    return df.select(*out)


def order_keys(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """The columns as 64-bit numbers ``k0``, ``k1``, ... that order as they do."""
    out = plain_values(df, fields)
    for i, field in enumerate(fields):
        value, whole, real = F.col(f"v{i}"), F.lit(None).cast("long"), F.lit(None).cast("double")
        whole, real = (whole, value) if _is_float(field) else (value, real)
        out = _with_keys(out.withColumns({"whole": whole, "real": real})).withColumnRenamed("key", f"k{i}")
    return out.select(*[f"k{i}" for i in range(len(fields))])


def _with_keys(rows: DataFrame) -> DataFrame:
    """``key`` in place of ``whole`` and ``real`` (one of them is null): a 64-bit number that orders as they do.

    A double becomes its place among all doubles: exponent and fraction as one number, negative ones mirrored; NaN comes
    last. Each step is a projection of its own, so that nothing is computed twice.
    """
    two, value = F.lit(2.0), F.col("real")
    # Zero, the infinities and NaN have places of their own.
    size = F.abs(value)
    out = rows.withColumn("_s", F.when((size > 0) & (size < float("inf")), size))
    out = out.withColumn("_g", F.floor(F.log2("_s")))
    out = out.withColumn("_p", F.col("_s") / F.pow(two, F.col("_g")))
    # The logarithm may be off by one next to a power of two.
    off = F.when(F.col("_p") >= 2, F.col("_g") + 1).when(F.col("_p") < 1, F.col("_g") - 1).otherwise(F.col("_g"))
    out = out.withColumn("_e", F.when(off < -1022, -1022).otherwise(off))
    out = out.withColumn("_f", ((F.col("_s") / F.pow(two, F.col("_e")) - 1) * float(2**52)).cast("long"))
    top, key = F.lit(2047 * 2**52), (F.col("_e") + 1023) * F.lit(2**52) + F.col("_f")
    key = F.when(F.isnan(value), top + 1).when(size == float("inf"), top).when(value == 0, F.lit(0).cast("long")).otherwise(key)
    key = F.coalesce("whole", F.when(value < 0, -key).otherwise(key))
    return out.withColumn("key", key).drop("whole", "real", "_s", "_g", "_p", "_e", "_f")


def from_key(key: int, kind: T.DataType) -> str:
    """The number that a key stands for, as text."""
    if isinstance(kind, T.DecimalType):
        return str(Decimal(key).scaleb(-kind.scale))
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return str(key)
    value = struct.unpack(">d", struct.pack(">Q", abs(key)))[0]
    return "NaN" if math.isnan(value) else repr(-value if key < 0 else value)


def _limits(values: DataFrame, fields: Sequence[T.StructField], shares: Sequence[float]) -> tuple[list[int], list[list[tuple]]]:
    """How many values each column has, and the intervals ``(low, high)`` that should hold its quantiles.

    Intervals are closed, in order and apart; an open end is None. One scan of bounded sketches.
    """
    sketches, ends = [], []
    for i in range(len(fields)):
        real = F.col(f"v{i}").cast("double")
        sketches += [F.kll_sketch_agg_double(F.when(F.isnan(real), float("inf")).otherwise(real), F.lit(SKETCH)).alias(f"s{i}"), F.count(f"v{i}").alias(f"n{i}")]
        for j, share in enumerate(shares):
            for end, rank in (("low", share - MARGIN), ("high", share + MARGIN)):
                at = F.kll_sketch_get_quantile_double(F.col(f"s{i}"), F.lit(rank)) if 0 < rank < 1 else F.lit(None).cast("double")
                ends.append(F.when(F.col(f"n{i}") > 0, at).alias(f"{end}{i}_{j}"))
    found = values.agg(*sketches).select(*[f"n{i}" for i in range(len(fields))], *ends).first()
    intervals = []
    for i, field in enumerate(fields):
        pairs = []
        for j in range(len(shares)) if found[f"n{i}"] else ():
            low, high = found[f"low{i}_{j}"], found[f"high{i}_{j}"]
            if _is_float(field):
                # The sketch takes NaN as infinite.
                high = None if high == math.inf else high
            else:
                low = None if low is None or low < -(2.0**62) else math.floor(low) if low < 2.0**62 else 2**62
                high = None if high is None or high > 2.0**62 else math.ceil(high) if high > -(2.0**62) else -(2**62)
            pairs.append((low, high))
        apart: list[tuple] = []
        for low, high in sorted(pairs, key=lambda p: -math.inf if p[0] is None else p[0]):
            if apart and (low is None or apart[-1][1] is None or low <= apart[-1][1]):
                ends_at = (apart[-1][1], high)
                apart[-1] = (apart[-1][0], None if None in ends_at else max(ends_at))
            else:
                apart.append((low, high))
        intervals.append(apart)
    return [found[f"n{i}"] for i in range(len(fields))], intervals


def _slots(values: DataFrame, fields: Sequence[T.StructField], intervals: list[list[tuple]]) -> DataFrame:
    """``i, slot, whole, real`` of every value: inside the intervals slots are odd; before, between and after them slots are
    even, and the value itself is left out."""
    cells = []
    for i, field in enumerate(fields):
        value, slot = F.col(f"v{i}"), F.lit(2 * len(intervals[i]))
        for j, (low, high) in reversed(list(enumerate(intervals[i]))):
            inside = F.lit(2 * j + 1)
            slot = inside if high is None else F.when(value <= F.lit(high), inside).otherwise(slot)
            if low is not None:
                slot = F.when(value < F.lit(low), 2 * j).otherwise(slot)
        kept = F.when(slot % 2 == 1, value)
        whole, real = (F.lit(None).cast("long"), kept) if _is_float(field) else (kept, F.lit(None).cast("double"))
        cells.append(F.when(value.isNotNull(), F.struct(F.lit(i).alias("i"), slot.alias("slot"), whole.alias("whole"), real.alias("real"))))
    return values.select(F.explode(F.array(*cells)).alias("c")).where("c is not null").select("c.*")


def _kept(rows: DataFrame) -> DataFrame:
    """The rows with their keys, stored: each of the histograms reads them again."""
    keys, place = _with_keys(rows), shared_dir(rows.sparkSession, "quantiles")
    keys.write.parquet(place)
    return rows.sparkSession.read.schema(keys.schema).parquet(place)


def _refined(keys: DataFrame, ranks: dict[tuple[int, float], int]) -> dict[tuple[int, float], int]:
    """The key of each rank (from 1) among the keys ``i, key, n`` of a column, by histograms of a few bits at a time."""
    # For each column and share: the leading bits found, and the rank that is left among the numbers that share them.
    wanted = {at: (0, rank) for at, rank in ranks.items()}
    before = None
    for shift in SHIFTS if wanted else ():
        rows = keys
        if before is not None:
            heads: dict[int, set[int]] = {}
            for (i, _), (head, _) in wanted.items():
                heads.setdefault(i, set()).add(head)
            among = F.lit(False)
            for i, some in heads.items():
                among = among | ((F.col("i") == i) & F.shiftright("key", before).isin(sorted(some)))
            rows = keys.where(among)
        counts: dict[tuple[int, int | None], list[tuple[int, int]]] = {}
        for r in rows.groupBy("i", F.shiftright("key", shift).alias("head")).agg(F.sum("n").alias("n")).collect():
            up = None if before is None else r["head"] >> (before - shift)
            counts.setdefault((r["i"], up), []).append((r["head"], r["n"]))
        for (i, share), (head, rank) in wanted.items():
            for value, n in sorted(counts[i, None if before is None else head]):
                if rank <= n:
                    wanted[i, share] = (value, rank)
                    break
                rank -= n
        before = shift
    return {at: key for at, (key, _) in wanted.items()}


def table_quantiles(df: DataFrame, shares: Sequence[float] = QUARTILES, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, share, value``: for each share the least value that at least this share of the known values does not exceed.

    Values are text, so that no number loses digits. Two scans of the number columns, whatever their number and the size of
    the table, and six of the counts of those values that lie near the wanted ones; each of these brings at most 2048 counts
    per column and share to the driver. Columns without values get none.
    """
    columns = list(columns if columns is not None else number_columns(df))
    require_columns(df, columns)
    kinds = [df.schema[c] for c in columns]
    if not all(_is_number(f.dataType) for f in kinds):
        raise TypeError(f"not numbers of up to 64 bits: {[f.name for f in kinds if not _is_number(f.dataType)]}")
    if not all(0 < s <= 1 for s in shares):
        raise ValueError("shares must be above 0 and at most 1")
    spark = df.sparkSession
    if not kinds or not shares:
        return spark.createDataFrame([], RESULT_SCHEMA)
    values = plain_values(df, kinds)
    totals, intervals = _limits(values, kinds, shares)
    counted = _kept(_slots(values, kinds, intervals).groupBy("i", "slot", "whole", "real").agg(F.count(F.lit(1)).alias("n")))
    held: dict[int, dict[int, int]] = {}
    for r in counted.groupBy("i", "slot").agg(F.sum("n").alias("n")).collect():
        held.setdefault(r["i"], {})[r["slot"]] = r["n"]

    # A rank's place among the values that were counted one by one, which are those of the odd slots.
    near, far = {}, {}
    for i, total in enumerate(totals):
        for share in shares if total else ():
            rank = max(1, math.ceil(round(share * total, 9)))
            passed = inside = 0
            for slot in range(2 * len(intervals[i]) + 1):
                n = held[i].get(slot, 0)
                if rank <= passed + n:
                    break
                passed, inside = passed + n, inside + (n if slot % 2 else 0)
            if slot % 2:
                near[i, share] = rank - passed + inside
            else:
                far[i, share] = rank
    found = _refined(counted.where("slot % 2 = 1"), near)
    if far:
        missed = {i for i, _ in far}
        every = _slots(values, kinds, [[(None, None)] if i in missed else [] for i in range(len(kinds))])
        found |= _refined(_kept(every.where("slot % 2 = 1").withColumn("n", F.lit(1).cast("long"))), far)
    told = [(columns[i], float(s), from_key(found[i, s], kinds[i].dataType)) for i, total in enumerate(totals) if total for s in shares]
    return spark.createDataFrame(told, RESULT_SCHEMA)


def approximate_quantiles(df: DataFrame, shares: Sequence[float] = QUARTILES, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, share, value`` from one scan: mergeable quantile sketches of bounded size, off by about one percent of rank."""
    columns = list(columns if columns is not None else number_columns(df))
    require_columns(df, columns)
    sketches = df.agg(*[F.kll_sketch_agg_double(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double(F.col(f"s{i}"), F.lit(float(s))).alias("value"))
        for i, c in enumerate(columns) for s in shares
    ]
    return sketches.select(F.inline(F.array(*rows)))
