"""A training-data pipeline over `documents`: each stage works on what the stage before it kept.

Stages: toxic documents go; lines that repeat an earlier line go, and documents of which nothing is left; of each group
of near duplicates one document stays; documents that hold a benchmark item go; the rest is packed into sequences. All
stages but the last return the columns of `documents`; n_chars follows the text. Extra columns pass through, nulls and
empty texts are kept (they are neither toxic nor duplicates) and end up as a sequence piece of one end token.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm import bottom_k, decontaminate, line_dedup, packing, toxicity
from stratalake.llm.tables import read, ship, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7; the classifier is fitted on labelled rows of this input."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, into="__score__").filter("__score__ < 0.7").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later matches of lines; a document goes if this leaves it no words."""
    cut = line_dedup.dedup_lines(docs, least=1, count="__lines__", removed="__removed__")
    same = F.size("__removed__") == 0
    kept = cut.filter(same | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; rows without an id stay."""
    gone = bottom_k.near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; rows without an id stay."""
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"), short_inside=True).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("_leak"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens; one row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The stages train a classifier, hash and tokenize: SQL can't express them (tests/llm hold a brute-force version).
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`, each written as Parquet and read again as the next one's input."""
    docs = read(ship(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
