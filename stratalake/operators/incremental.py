"""Reads driven by a stored high-water value, and the state behind them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stratalake.functions.columns import col, cols, require_columns
from stratalake.operators.upsert import keep_last
from stratalake.session import path_exists

STATE_SCHEMA = (
    "pipeline string, column string, value string, value_type string, "
    "updated_at timestamp, row_count bigint, is_reset boolean"
)


def typed_literal(df: DataFrame, column: str, value: Any) -> Column:
    """``value`` as a literal of the column's own type, so the filter can reach the scan.

    Times are taken as wall-clock time of the session's zone, whatever the zone of this process.
    """
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(df.schema[column].dataType)


def newer_than(df: DataFrame, column: str, value: Any, lookback: timedelta | int | None = None) -> DataFrame:
    """Rows with ``column`` strictly above ``value``; all rows while there is no value yet.

    ``lookback`` moves the limit back, to take late rows again; the upsert that
    follows makes the repetition harmless.
    """
    if value is None:
        return df
    if isinstance(lookback, timedelta):
        value = datetime.fromisoformat(str(value)) - lookback
    elif lookback is not None:
        value = Decimal(str(value)) - lookback
    return df.where(col(column) > typed_literal(df, column, value))


def newer_than_all(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Compound form: ``(a > x) or (a = x and b > y) or ...`` in the given column order.

    The implied ``a >= x`` is added for the scan, which can prune by it.
    """
    known = [(c, typed_literal(df, c, v)) for c, v in values.items() if v is not None]
    if not known:
        return df
    steps = []
    for i, (column, value) in enumerate(known):
        equal = [col(c) == v for c, v in known[:i]]
        steps.append(reduce(lambda a, b: a & b, [*equal, col(column) > value]))
    first_column, first_value = known[0]
    return df.where((col(first_column) >= first_value) & reduce(lambda a, b: a | b, steps))


def _extreme(agg: str):
    """The aggregate that a high-water ("max") or low-water ("min") value is."""
    try:
        return {"max": F.max, "min": F.min}[agg]
    except KeyError:
        raise ValueError(f"a watermark is the max or min of a column, not its {agg}") from None


def compute_watermarks(df: DataFrame, column: str, aggs: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """High- and low-water values in one aggregate, per group if ``by`` is given: ``aggs`` maps names to max or min."""
    require_columns(df, [column, *by])
    return df.groupBy(*cols(by)).agg(*[_extreme(agg)(col(column)).alias(name) for name, agg in aggs.items()])


def compute_watermark(df: DataFrame, column: str, agg: str = "max", by: Sequence[str] = ()) -> DataFrame:
    """Next high-water value, per group if ``by`` is given; no row value for an empty input."""
    return compute_watermarks(df, column, {"watermark": agg}, by)


def observe_watermark(df: DataFrame, column: str | None, agg: str = "max") -> tuple[DataFrame, Observation]:
    """Attach row count and high-water value to the plan; read them after the write that runs it."""
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")]
    if column is not None:
        metrics.append(_extreme(agg)(col(column)).cast("string").alias("watermark"))
    return df.observe(seen, *metrics), seen


def current_state(log: DataFrame) -> DataFrame:
    """Latest value per (pipeline, column); a reset removes the entry."""
    latest = keep_last(log, ["pipeline", "column"], ["updated_at"])
    return latest.where(~F.coalesce(F.col("is_reset"), F.lit(False))).drop("is_reset")


@dataclass(frozen=True)
class WatermarkState:
    pipeline: str
    column: str
    value: Any
    updated_at: datetime
    row_count: int


class WatermarkStore:
    """Append-only state table at ``path``; the full history stays readable."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def log(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return self.spark.read.schema(STATE_SCHEMA).parquet(self.path)

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, STATE_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def set(self, pipeline: str, column: str, value: Any, value_type: str = "string", row_count: int = 0) -> None:
        now = datetime.now()
        self._append([(pipeline, column, str(value), value_type, now, int(row_count), False)])

    def _current(self, pipeline: str, column: str):
        wanted = self.log().where((F.col("pipeline") == pipeline) & (F.col("column") == column))
        return current_state(wanted).first()

    def get_text(self, pipeline: str, column: str) -> str | None:
        """The value as Spark wrote it, to be cast back to the column's type."""
        row = self._current(pipeline, column)
        return None if row is None else row["value"]

    def get_state(self, pipeline: str, column: str) -> WatermarkState | None:
        row = self._current(pipeline, column)
        if row is None:
            return None
        value = self.spark.range(1).select(F.lit(row["value"]).cast(row["value_type"])).first()[0]
        return WatermarkState(pipeline, column, value, row["updated_at"], row["row_count"])

    def get(self, pipeline: str, column: str, default: Any = None) -> Any:
        state = self.get_state(pipeline, column)
        return default if state is None else state.value

    def get_all(self, pipeline: str) -> dict[str, Any]:
        rows = current_state(self.log().where(F.col("pipeline") == pipeline)).select("column", "value", "value_type").collect()
        if not rows:
            return {}
        values = self.spark.range(1).select(*[F.lit(r["value"]).cast(r["value_type"]) for r in rows]).first()
        return {r["column"]: v for r, v in zip(rows, values, strict=True)}

    def reset(self, pipeline: str, column: str | None = None) -> None:
        names = [column] if column else list(self.get_all(pipeline))
        if names:
            self._append([(pipeline, name, None, None, datetime.now(), 0, True) for name in names])

    def list_pipelines(self) -> list[str]:
        return [r[0] for r in current_state(self.log()).select("pipeline").distinct().orderBy("pipeline").collect()]

    def history(self, pipeline: str) -> DataFrame:
        return self.log().where(F.col("pipeline") == pipeline).orderBy(F.desc("updated_at"))
