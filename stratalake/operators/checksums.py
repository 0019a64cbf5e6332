"""Comparing large tables by checksums: a tree of order-free sums over buckets of keys.

Keys fall into buckets by their hash, and within a bucket into parts. A leaf of the tree is the number of rows of one part
and two sums over 32-bit halves of their hashes; sums do not depend on the order of rows or files, and are combined before the
shuffle. A node above is the sum of its leaves. Only leaves that differ are read again and compared row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import col, cols, comparable, require_columns
from stratalake.operators.diff import table_diff

SUMS = ("rows", "low", "high")


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row's key, the same in every table that types its keys alike."""
    return F.pmod(F.xxhash64(*cols(keys)), F.lit(buckets)).cast("int")


def part_of(keys: Sequence[str], parts: int) -> Column:
    """The part within a bucket, by another hash than the bucket's."""
    return F.pmod(F.xxhash64(F.lit(1), *cols(keys)), F.lit(parts)).cast("int")


def row_hash(fields: Sequence[T.StructField]) -> Column:
    """A hash of a row in which a null differs from every value, and both zeros are one."""
    values = []
    for field in fields:
        value = comparable(field)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = value + F.lit(0.0).cast(field.dataType)
        values += [value, value.isNull()]
    return F.xxhash64(*values)


def checksums(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = 256, parts: int = 64, bucket: str | None = None
) -> DataFrame:
    """The leaves: bucket, part, rows, low, high. One scan of the chosen columns; at most buckets x parts rows.

    ``bucket`` names a column that holds the bucket already, as tables stored in buckets do.
    """
    require_columns(df, [*keys, *columns])
    number = bucket_of(keys, buckets) if bucket is None else col(bucket)
    hashed = row_hash([df.schema[c] for c in [*keys, *columns]])
    rows = df.select(number.alias("bucket"), part_of(keys, parts).alias("part"), hashed.alias("h"))
    return rows.groupBy("bucket", "part").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.sum(F.shiftrightunsigned("h", 32)).alias("high"),
    )


def roots(leaves: DataFrame, by: Sequence[str] = ("bucket",)) -> DataFrame:
    """Nodes above the leaves: per bucket, or with no ``by`` the one sum of the whole table."""
    return leaves.groupBy(*cols(by)).agg(*[F.sum(c).alias(c) for c in SUMS])


def differing(left: DataFrame, right: DataFrame, by: Sequence[str] = ("bucket", "part")) -> DataFrame:
    """Nodes whose sums differ, or that one side lacks."""
    signed = [df.select(*cols(by), *[(F.col(c) * sign).alias(c) for c in SUMS]) for df, sign in ((left, 1), (right, -1))]
    sums = signed[0].unionByName(signed[1]).groupBy(*cols(by)).agg(*[F.sum(c).alias(c) for c in SUMS])
    return sums.where(" or ".join(f"{c} <> 0" for c in SUMS)).select(*cols(by))


def checksum_diff(
    before: DataFrame,
    after: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    buckets: int = 256,
    parts: int = 64,
    bucket: str | None = None,
    unchanged: bool = True,
) -> DataFrame:
    """The rows of ``table_diff``: each key with added, removed, changed or unchanged.

    The checksums are compared at once; the result reads both tables again where they differ. If both are stored in
    folders by ``bucket``, the folders of equal buckets are not read for that. Keys of equal parts are unchanged, and
    only their key columns are read, from one side (``unchanged=False`` leaves them out). Columns have to be of
    the same type on both sides; otherwise all leaves differ and the result is that of ``table_diff``.
    """
    columns = list(columns or [c for c in before.columns if c not in keys and c != bucket])
    sums = [checksums(df, keys, columns, buckets, parts, bucket) for df in (before, after)]
    # At most buckets x parts numbers.
    found = differing(*sums).collect()
    number = bucket_of(keys, buckets) if bucket is None else col(bucket)
    leaf = number * parts + part_of(keys, parts)
    leaves = [r["bucket"] * parts + r["part"] for r in found]
    # The first condition reaches the folders of a table stored in buckets, the second one tells the parts.
    differs = number.isin(sorted({r["bucket"] for r in found})) & leaf.isin(leaves) if found else F.lit(False)
    again = [df.where(differs).select(*cols(keys), *cols(columns)) for df in (before, after)]
    changes = table_diff(*again, keys, columns)
    if not unchanged:
        return changes
    full = {b for b in {r["bucket"] for r in found} if sum(r["bucket"] == b for r in found) == parts}
    same = before.where(~leaf.isin(leaves)) if found else before
    same = same.where(~number.isin(sorted(full))) if full else same
    return changes.unionByName(same.select(*cols(keys)).distinct().withColumn("status", F.lit("unchanged")))
