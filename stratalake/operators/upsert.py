"""Keep-last de-duplication and upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.functions.columns import col, cols, comparable, has_map, match_keys, require_columns


def keep_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order_by``, ties broken by all other columns.

    Spark rows have no order of their own, so the order is an argument. Null
    keys form one group; nulls order lowest. The maximum is taken within each
    input partition before the shuffle, so a key that holds a third of all rows
    sends one row per partition.
    """
    require_columns(df, [*keys, *order_by])
    fields = [f for f in df.schema.fields if f.name not in keys]
    rest = [f for f in fields if f.name not in order_by]
    if not fields:
        return df.dropDuplicates([*keys])
    if any(has_map(f.dataType) for f in fields):
        ordering = F.struct(*cols(order_by), *[comparable(f).alias(f.name) for f in rest])
        last = F.max_by(F.struct(*cols(f.name for f in fields)), ordering)
    else:
        last = F.max(F.struct(*cols(order_by), *cols(f.name for f in rest)))
    return (
        df.groupBy(*cols(keys))
        .agg(last.alias("_last"))
        .select(*[col(c) if c in keys else F.col("_last").getField(c).alias(c) for c in df.columns])
    )


def merge(
    existing: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] = (),
    existing_unique: bool = False,
    newest_wins: bool = False,
) -> DataFrame:
    """Upsert: batch rows replace existing rows of the same key, later rows replace earlier ones.

    With ``newest_wins`` only ``order_by`` decides, whichever side a row is from; such an upsert ends in the same rows
    in whatever order batches arrive, or repeat.

    Columns missing on one side are filled with null. With ``existing_unique``
    (the table is known to hold each key once) existing rows skip the
    aggregate: they only pass an anti join against the batch keys, which
    Spark broadcasts when their measured size allows it.
    """
    if newest_wins:
        return keep_last(existing.unionByName(batch, allowMissingColumns=True), keys, order_by)
    if existing_unique:
        last = keep_last(batch, keys, order_by)
        kept = match_keys(existing, last, keys, "left_anti")
        return kept.unionByName(last, allowMissingColumns=True)
    both = existing.withColumn("_from_batch", F.lit(0)).unionByName(
        batch.withColumn("_from_batch", F.lit(1)), allowMissingColumns=True
    )
    return keep_last(both, keys, ["_from_batch", *order_by]).drop("_from_batch")


def merge_marked(
    existing: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] = (),
    newest_wins: bool = False,
    mark: str = "_mark",
) -> DataFrame:
    """The rows of ``merge`` and, for each key, whether it was ``kept``, ``inserted`` or ``updated`` by the batch.

    One aggregate over both sides gives the row and the mark, so neither side is read again to count them.
    """
    side = "_from_batch"
    both = existing.withColumn(side, F.lit(0)).unionByName(batch.withColumn(side, F.lit(1)), allowMissingColumns=True)
    require_columns(both, [*keys, *order_by])
    fields = [f for f in both.schema.fields if f.name not in (*keys, side)]
    rest = [f for f in fields if f.name not in order_by]
    first = [] if newest_wins else [F.col(side)]
    values = F.struct(*cols(f.name for f in fields)) if fields else F.struct(F.lit(0).alias("_none"))
    if any(has_map(f.dataType) for f in fields):
        last = F.max_by(values, F.struct(*first, *cols(order_by), *[comparable(f).alias(f.name) for f in rest], F.col(side).alias("_tie")))
    else:
        last = F.max(F.struct(*first, *cols(order_by), *cols(f.name for f in rest), F.lit(0).alias("_none")))
    merged = both.groupBy(*cols(keys)).agg(last.alias("_last"), F.min(side).alias("_low"), F.max(side).alias("_high"))
    state = F.when(F.col("_high") == 0, "kept").when(F.col("_low") == 1, "inserted").otherwise("updated")
    columns = [c for c in both.columns if c != side]
    return merged.select(*[col(c) if c in keys else F.col("_last").getField(c).alias(c) for c in columns], state.alias(mark))


def merge_stats(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row ``inserted, updated``: distinct batch keys absent from / present in ``existing``.

    Both sides fold into one aggregate over the keys (one shuffle, combined
    before it), so neither duplicate nor null keys distort the counts.
    """
    tagged = existing.select(*cols(keys), F.lit(False).alias("_new"), F.lit(True).alias("_old")).union(
        batch.select(*cols(keys), F.lit(True), F.lit(False))
    )
    flags = tagged.groupBy(*cols(keys)).agg(F.max("_new").alias("_new"), F.max("_old").alias("_old"))
    return flags.agg(
        F.count_if(F.col("_new") & ~F.col("_old")).alias("inserted"),
        F.count_if(F.col("_new") & F.col("_old")).alias("updated"),
    )
