"""Lookup joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.functions.columns import col, cols, has_map

NULL_SPREAD = 1024


def lookup(facts: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join that adds ``columns`` of ``dimension`` (unique on ``key``) to every fact.

    Spark broadcasts the dimension when its measured size allows it. Otherwise
    both sides are shuffled by the key; facts without a key, which match
    nothing but would all meet in one task, are spread by their other columns.
    Busy keys are split by AQE.
    """
    spread_by = [c for c in facts.columns if c != key and not has_map(facts.schema[c].dataType)]
    chance = F.xxhash64(*cols(spread_by)) if spread_by else F.monotonically_increasing_id()
    spread = F.when(col(key).isNull(), F.pmod(chance, F.lit(NULL_SPREAD)).cast("int")).otherwise(F.lit(0))
    left = facts.withColumn("_spread", spread)
    # Always 0, but not a literal: a literal would be folded out of the join key.
    none = F.pmod(F.hash(col(key)), F.lit(1))
    right = dimension.select(col(key).alias("_key"), none.alias("_none"), *cols(columns))
    joined = left.join(right, (left[f"`{key}`"] == right["_key"]) & (left["_spread"] == right["_none"]), "left")
    return joined.drop("_spread", "_key", "_none")
