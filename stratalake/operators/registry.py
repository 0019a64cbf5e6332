"""Registry of ingested files: what is still to do, what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY_SCHEMA = (
    "file_path string, file_hash string, target_table string, rows_ingested bigint, ingested_at timestamp, status string"
)
# Outcomes a registry row can record.
STATUSES = ("success", "failed", "skipped")


def pending_files(inventory: DataFrame, registry: DataFrame, by_hash: bool = True) -> DataFrame:
    """Files without a successful registry entry; with ``by_hash`` a changed file is pending again."""
    on = ["file_path", "file_hash"] if by_hash else ["file_path"]
    done = registry.where(F.col("status") == "success").select(*on).distinct()
    return inventory.join(done, on, "left_anti")


def ingestion_record(
    files: DataFrame, target_table: str, ingested_at: str, status: str = "success", rows: str | None = None
) -> DataFrame:
    """Registry rows for processed files ``(file_path, file_hash[, rows])``."""
    if status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    return files.select(
        "file_path",
        "file_hash",
        F.lit(target_table).alias("target_table"),
        (F.col(rows) if rows else F.lit(0)).cast("bigint").alias("rows_ingested"),
        F.lit(ingested_at).cast("timestamp").alias("ingested_at"),
        F.lit(status).alias("status"),
    )


def ingestion_history(registry: DataFrame, target_table: str | None = None) -> DataFrame:
    """Registry rows, newest first, of one target table if given."""
    rows = registry if target_table is None else registry.where(F.col("target_table") == target_table)
    return rows.orderBy(F.desc("ingested_at"), "file_path")
