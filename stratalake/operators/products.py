"""Catalogue of versioned data products: latest and matching versions, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.functions.columns import cols
from stratalake.functions.versions import FORMS, constraint_form, constraint_numbers, version_numbers, version_struct
from stratalake.operators.access import levels_for
from stratalake.operators.upsert import keep_last

PRODUCT_SCHEMA = (
    "name string, owner_workspace string, description string, tags array<string>, sla_freshness_hours int, "
    "created_at timestamp, updated_at timestamp, is_deprecated boolean, deprecation_message string"
)
VERSION_SCHEMA = (
    "product_name string, version string, source_workspace string, source_table string, schema_snapshot string, "
    "row_count bigint, location string, commit string, published_at timestamp, published_by string, changelog string"
)
SUBSCRIPTION_SCHEMA = (
    "product_name string, consumer_workspace string, version_constraint string, local_alias string, "
    "subscribed_at timestamp, is_cancelled boolean"
)

# Patch numbers are looked up in blocks of this many, so that a product with
# countless patches under one minor version still spreads over many groups.
BLOCK_BITS = 12
PATCH_BLOCK = 1 << BLOCK_BITS
DIGITS = ("_major", "_minor", "_block", "_patch")


def latest_versions(versions: DataFrame) -> DataFrame:
    """Per product the row of its highest version, by version order and not by date."""
    ordered = versions.withColumn("_v", version_struct(F.col("version"))).where(F.col("_v").isNotNull())
    return keep_last(ordered, ["product_name"], ["_v"]).drop("_v")


def _digits(major: Column, minor: Column, patch: Column) -> list[Column]:
    """A version as numbers that order like it, from most to least significant."""
    parts = (major, minor, F.shiftright(patch, BLOCK_BITS), patch.bitwiseAND(PATCH_BLOCK - 1))
    return [p.cast("bigint").alias(d) for p, d in zip(parts, DIGITS)]


def _below(versions: DataFrame, bounds: DataFrame) -> DataFrame:
    """Add ``_found``, the highest version strictly below each bound, found digit by digit.

    Both sides hold distinct rows ``product_name`` + DIGITS. The answer shares
    some leading digits with the bound, is smaller in the next one and the
    highest beyond it; the longest such prefix wins. Each step therefore only
    needs, per prefix, the distinct next digits in order: bounds and versions
    of one product are never paired, and no step orders a product as a whole.
    """
    top = F.max(F.struct(*[F.col(d) for d in DIGITS])).alias("_top")
    found = bounds
    for depth, digit in enumerate(DIGITS):
        prefix = ["product_name", *DIGITS[:depth]]
        steps = versions.groupBy(*prefix, digit).agg(top).withColumn("_is_version", F.lit(True))
        marks = bounds.select(*prefix, digit).distinct().withColumn("_is_version", F.lit(False))
        # A bound sorts before a version with the same digit: strictly below.
        before = Window.partitionBy(*prefix).orderBy(digit, "_is_version").rowsBetween(Window.unboundedPreceding, 0)
        answers = (
            steps.unionByName(marks, allowMissingColumns=True)
            .withColumn(f"_hit{depth}", F.last("_top", ignorenulls=True).over(before))
            .where(~F.col("_is_version"))
            .select(*prefix, digit, f"_hit{depth}")
        )
        found = found.join(answers, [*prefix, digit], "left")
    longest_first = [F.col(f"_hit{d}") for d in reversed(range(len(DIGITS)))]
    return found.select("product_name", *DIGITS, F.coalesce(*longest_first).alias("_found"))


def _limits() -> tuple[list[Column], list[Column]]:
    """The half-open range of versions a parsed constraint allows: its start and its end."""
    form, major, minor, patch = (F.col(c) for c in ("_form", "_a", "_b", "_c"))
    zero = F.lit(0).cast("bigint")

    def named(*names: str) -> Column:
        return form.isin(*[FORMS.index(n) for n in names])

    open_start, open_end = named("latest", "<", "<="), named("latest", ">=", ">")
    same_major, same_minor = named("^", "N.x"), named("~", "N.M.x")
    start = [F.when(open_start, zero).otherwise(c) for c in (major, minor, patch)]
    start[2] = start[2] + F.when(named(">"), 1).otherwise(0)
    end = [
        F.when(open_end, F.lit(2**62)).when(same_major, major + 1).otherwise(major),
        F.when(open_end | same_major, zero).when(same_minor, minor + 1).otherwise(minor),
        F.when(open_end | same_major | same_minor, zero).when(named("<="), patch + 1).when(named("exact"), patch + 1).otherwise(patch),
    ]
    return start, end


def resolve_versions(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Add ``resolved_version``: the best version for each ``(product_name, version_constraint)``.

    Requests without a match, or with text that is no constraint, get null.
    Every constraint allows a range of versions, so the answer is the highest
    version below the range's end if it is not below its start. Each distinct
    end is looked up once, however many requests name it.
    """
    text = F.col("version_constraint")
    a, b, c = constraint_numbers(text)
    start, end = _limits()
    # Parsing inside the aggregate keeps later filters from repeating it.
    asked = (
        requests.groupBy("product_name", "version_constraint")
        .agg(F.max(constraint_form(text)).alias("_form"), F.max(a).alias("_a"), F.max(b).alias("_b"), F.max(c).alias("_c"))
        .where(F.col("_form").isNotNull())
        .select("product_name", "version_constraint", *[n.alias(d) for n, d in zip(start, ("_a", "_b", "_c"))], *_digits(*end))
    )
    major, minor, patch = version_numbers(F.col("version"))
    known = (
        versions.groupBy("product_name", "version")
        .agg(F.max(major).alias("_x"), F.max(minor).alias("_y"), F.max(patch).alias("_z"))
        .where(F.col("_x").isNotNull())
        .select("product_name", *_digits(F.col("_x"), F.col("_y"), F.col("_z")))
    )
    below = _below(known, asked.select("product_name", *DIGITS).distinct())
    hit = F.col("_found")
    found = F.struct(
        hit["_major"].alias("_a"), hit["_minor"].alias("_b"), (hit["_block"] * PATCH_BLOCK + hit["_patch"]).alias("_c")
    )
    resolved = (
        asked.join(below, ["product_name", *DIGITS])
        .withColumn("_found", F.when(hit.isNotNull(), found))
        .where(F.col("_found") >= F.struct("_a", "_b", "_c"))
        .select("product_name", "version_constraint", F.concat_ws(".", "_found._a", "_found._b", "_found._c").alias("resolved_version"))
    )
    return requests.join(resolved, ["product_name", "version_constraint"], "left").select(
        *cols(requests.columns), "resolved_version"
    )


def current_subscriptions(events: DataFrame) -> DataFrame:
    """Subscribe and unsubscribe events folded to the last one per (product, workspace)."""
    latest = keep_last(events, ["product_name", "consumer_workspace"], ["subscribed_at"])
    return latest.where(~F.coalesce(F.col("is_cancelled"), F.lit(False))).drop("is_cancelled")


def subscribers(events: DataFrame, product: str) -> DataFrame:
    return current_subscriptions(events.where(F.col("product_name") == product)).select("consumer_workspace")


def subscriptions_view(subscriptions: DataFrame, products: DataFrame) -> DataFrame:
    """Subscriptions with the owner, description and freshness limit of their product."""
    details = products.select(
        F.col("name").alias("product_name"), "owner_workspace", "description", "sla_freshness_hours"
    )
    return subscriptions.join(details, "product_name").select(
        "consumer_workspace",
        "product_name",
        "version_constraint",
        "local_alias",
        "subscribed_at",
        "owner_workspace",
        "description",
        "sla_freshness_hours",
    )


def list_products(
    products: DataFrame, owner: str | None = None, tag: str | None = None, include_deprecated: bool = False
) -> DataFrame:
    out = products
    if owner:
        out = out.where(F.col("owner_workspace") == owner)
    if tag:
        out = out.where(F.array_contains("tags", tag))
    if not include_deprecated:
        out = out.where(~F.col("is_deprecated"))
    return out.orderBy("name")


def available_products(products: DataFrame, versions: DataFrame, rules: DataFrame, workspace: str) -> DataFrame:
    """What a workspace can use: non-deprecated products with its level and the latest version."""
    latest = latest_versions(versions).select(
        F.col("product_name").alias("name"), F.col("version").alias("latest_version"), "row_count"
    )
    levels = levels_for(rules, workspace).withColumnRenamed("product_name", "name")
    return (
        products.where(~F.col("is_deprecated"))
        .join(levels, "name")
        .join(latest, "name", "left")
        .select(
            "name",
            F.col("owner_workspace").alias("owner"),
            "description",
            "tags",
            "latest_version",
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
            "access_level",
            "sla_freshness_hours",
        )
    )


def missing_columns(expected: DataFrame, snapshots: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected columns ``(on..., column)`` that the schema snapshot ``(on..., column)`` lacks."""
    have = snapshots.select(*cols(on), "column").distinct()
    return expected.join(have, [*on, "column"], "left_anti")


def sla_status(products: DataFrame, versions: DataFrame, as_of: str, default_hours: int = 24) -> DataFrame:
    """Age of each product's latest version against its own freshness limit.

    Beyond the limit the product is ``warn``, beyond twice the limit (or
    without any version) ``error``.
    """
    newest = latest_versions(versions).select(F.col("product_name").alias("name"), "version", "published_at")
    hours = F.coalesce("sla_freshness_hours", F.lit(default_hours))
    published = F.col("published_at").cast("timestamp_ntz")
    now = F.lit(as_of).cast("timestamp_ntz")
    status = (
        F.when(published.isNull() | (published < now - F.make_dt_interval(hours=hours * 2)), "error")
        .when(published < now - F.make_dt_interval(hours=hours), "warn")
        .otherwise("pass")
    )
    return products.join(newest, "name", "left").select("name", "version", "published_at", status.alias("status"))
