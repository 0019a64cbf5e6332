"""Who may use which product: pattern rules without a pattern join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.functions.columns import col
from stratalake.operators.upsert import keep_last

# Rank of the access levels.
LEVEL_RANK = {"read": 1, "write": 2, "admin": 3}

EVENT_SCHEMA = (
    "product_name string, workspace_pattern string, access_level string, "
    "granted_at timestamp, granted_by string, is_revoked boolean"
)


def level_rank(level: Column) -> Column:
    rank = F.lit(0)
    for name, value in LEVEL_RANK.items():
        rank = F.when(level == name, F.lit(value)).otherwise(rank)
    return rank


def level_name(rank: Column) -> Column:
    name = F.lit(None).cast("string")
    for text, value in LEVEL_RANK.items():
        name = F.when(rank == value, F.lit(text)).otherwise(name)
    return name


def pattern_matches(pattern: Column, workspace: Column) -> Column:
    """``*`` matches all, ``abc*`` by prefix, anything else exactly."""
    prefix = F.substring(pattern, F.lit(1), F.length(pattern) - 1)
    return F.when(F.endswith(pattern, F.lit("*")), F.startswith(workspace, prefix)).otherwise(pattern == workspace)


def current_rules(events: DataFrame) -> DataFrame:
    """Grant and revoke events folded to the rules in force: the last one per (product, pattern)."""
    latest = keep_last(events, ["product_name", "workspace_pattern"], ["granted_at"])
    return latest.where(~F.coalesce(F.col("is_revoked"), F.lit(False))).drop("is_revoked")


def _rule_keys(rules: DataFrame) -> DataFrame:
    """Best rank per (product, is_prefix, text): ``*`` is the empty prefix."""
    pattern = F.col("workspace_pattern")
    is_prefix = F.endswith(pattern, F.lit("*"))
    text = F.when(is_prefix, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    return (
        rules.select("product_name", is_prefix.alias("_prefix"), text.alias("_text"), level_rank(F.col("access_level")).alias("_rank"))
        .groupBy("product_name", "_prefix", "_text")
        .agg(F.max("_rank").alias("_rank"))
    )


def check_access(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Answer requests ``(workspace, product_name, requested_level)``.

    Adds ``effective_level``, ``matching_rule`` and ``granted``. The highest
    level among the matching rules counts; on a tie the exact name is
    reported, then the longest prefix. Without a matching rule access is denied.

    A workspace can only be matched by its own name or one of its prefixes, so
    each distinct (workspace, product) is spelled out into those few keys and
    joined by equality with the rules, of which each key holds at most one.
    Requests and rules of a busy product are never paired with each other.
    """
    asked = requests.select("workspace", "product_name").distinct()
    length = F.length("workspace")
    keys = F.concat(
        F.array(F.struct(F.lit(False).alias("p"), F.col("workspace").alias("t"))),
        F.transform(
            F.sequence(F.lit(0), length),
            lambda n: F.struct(F.lit(True).alias("p"), F.substring(F.col("workspace"), F.lit(1), n).alias("t")),
        ),
    )
    spelled = asked.select("workspace", "product_name", F.explode(keys).alias("k")).select(
        "workspace", "product_name", F.col("k.p").alias("_prefix"), F.col("k.t").alias("_text")
    )
    hits = spelled.join(_rule_keys(rules), ["product_name", "_prefix", "_text"])
    best = (
        hits.groupBy("workspace", "product_name")
        .agg(
            F.max(
                F.struct(
                    F.col("_rank").alias("rank"),
                    (~F.col("_prefix")).alias("exact"),
                    F.length("_text").alias("n"),
                )
            ).alias("_best")
        )
        .select("workspace", "product_name", "_best.*")
        .withColumn(
            "_rule",
            F.when(F.col("exact"), F.col("workspace")).otherwise(
                F.concat(F.substring(F.col("workspace"), F.lit(1), F.col("n")), F.lit("*"))
            ),
        )
        .select("workspace", "product_name", F.col("rank").alias("_rank"), "_rule")
    )
    rank = F.coalesce(F.col("_rank"), F.lit(0))
    return requests.join(best, ["workspace", "product_name"], "left").select(
        *[col(c) for c in requests.columns],
        level_name(F.col("_rank")).alias("effective_level"),
        F.col("_rule").alias("matching_rule"),
        ((rank > 0) & (rank >= level_rank(F.col("requested_level")))).alias("granted"),
    )


def levels_for(rules: DataFrame, workspace: str) -> DataFrame:
    """Highest level of one workspace on every product it can use at all."""
    matching = rules.where(pattern_matches(F.col("workspace_pattern"), F.lit(workspace)))
    return (
        matching.groupBy("product_name")
        .agg(F.max(level_rank(F.col("access_level"))).alias("_rank"))
        .where(F.col("_rank") > 0)
        .select("product_name", level_name(F.col("_rank")).alias("access_level"))
    )


def accessible_products(products: DataFrame, rules: DataFrame, workspace: str, min_level: str = "read") -> DataFrame:
    """Names of the non-deprecated products a workspace can use at ``min_level`` or above."""
    enough = levels_for(rules, workspace).where(level_rank(F.col("access_level")) >= LEVEL_RANK[min_level])
    listed = products.where(~F.col("is_deprecated")).select(F.col("name").alias("product_name"))
    return listed.join(enough, "product_name", "left_semi")
