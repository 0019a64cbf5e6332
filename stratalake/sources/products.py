"""Publishing versioned data products and consuming them from other workspaces."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.versions import NUMBERS
from stratalake.operators import access
from stratalake.operators import products as ops
from stratalake.operators import schemas
from stratalake.operators.upsert import keep_last
from stratalake.session import path_exists
from stratalake.sources.tables import Lake

RELATIONS = {
    "products": ops.PRODUCT_SCHEMA,
    "versions": ops.VERSION_SCHEMA,
    "access": access.EVENT_SCHEMA,
    "subscriptions": ops.SUBSCRIPTION_SCHEMA,
}


@dataclass(frozen=True)
class Published:
    product_name: str
    version: str
    location: str
    row_count: int
    schema: str


@dataclass(frozen=True)
class Consumed:
    product_name: str
    version: str
    location: str
    local_alias: str
    view: str | None


class ProductCatalog:
    """Products below ``root/_products``; its relations are append-only tables of events."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.base = f"{root.rstrip('/')}/_products"

    # --- relations ---------------------------------------------------------

    def _events(self, relation: str) -> DataFrame:
        schema, path = RELATIONS[relation], f"{self.base}/_registry/{relation}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _record(self, relation: str, *rows: tuple) -> None:
        df = self.spark.createDataFrame(list(rows), RELATIONS[relation]).coalesce(1)
        df.write.mode("append").parquet(f"{self.base}/_registry/{relation}")

    def products(self) -> DataFrame:
        return keep_last(self._events("products"), ["name"], ["updated_at"])

    def versions(self) -> DataFrame:
        return self._events("versions")

    def rules(self) -> DataFrame:
        return access.current_rules(self._events("access"))

    def subscriptions(self) -> DataFrame:
        return ops.current_subscriptions(self._events("subscriptions"))

    # --- owners ------------------------------------------------------------

    def register(self, name: str, owner: str, description: str = "", tags=(), sla_freshness_hours: int | None = None) -> None:
        if not self.products().where(F.col("name") == name).isEmpty():
            raise ValueError(f"product already registered: {name}")
        now = datetime.now()
        self._record("products", (name, owner, description, list(tags), sla_freshness_hours, now, now, False, None))

    def deprecate(self, name: str, message: str = "") -> None:
        row = self.products().where(F.col("name") == name).first()
        if row is None:
            raise ValueError(f"product not found: {name}")
        changed = {**row.asDict(), "is_deprecated": True, "deprecation_message": message, "updated_at": datetime.now()}
        self._record("products", tuple(changed[c] for c in row.asDict()))

    def grant(self, product: str, pattern: str, level: str = "read", by: str = "system") -> None:
        if level not in access.LEVEL_RANK:
            raise ValueError(f"unknown access level: {level}")
        self._record("access", (product, pattern, level, datetime.now(), by, False))

    def revoke(self, product: str, pattern: str, by: str = "system") -> bool:
        """Take a rule out of force; false if there was none."""
        found = (F.col("product_name") == product) & (F.col("workspace_pattern") == pattern)
        if self.rules().where(found).isEmpty():
            return False
        self._record("access", (product, pattern, None, datetime.now(), by, True))
        return True

    def publish(
        self,
        lake: Lake,
        product: str,
        source_table: str,
        version: str,
        description: str = "",
        tags=(),
        changelog: str = "",
        sla_freshness_hours: int | None = None,
        published_by: str = "system",
        strict: bool = False,
    ) -> Published:
        """Copy a table's rows to a folder of this publication and record it as a version of the product.

        Only the owner may publish, and a recorded version never changes: its
        folder has a name that no other publication has. The first publication
        also registers the product and lets every workspace read it. The copy
        comes first, then version, product and rule, so a copy that died
        leaves no trace in the relations and may be repeated. ``strict``
        refuses a version whose number declares a smaller step than its schema
        takes against the version before.
        """
        if not re.fullmatch(NUMBERS, version):
            raise ValueError(f"not a version (major.minor.patch): {version}")
        row = self.products().where(F.col("name") == product).first()
        if row is not None and row["owner_workspace"] != lake.workspace:
            raise PermissionError(f"only workspace {row['owner_workspace']} publishes {product}; this is {lake.workspace}")
        taken = (F.col("product_name") == product) & (F.col("version") == version)
        if not self.versions().where(taken).isEmpty():
            raise ValueError(f"version {version} of '{product}' already exists")
        df = lake.read(source_table)
        if strict:
            self._refuse_small_step(product, version, df.schema.json())
        location = f"{self.base}/{product}/v{version}-{uuid.uuid4().hex}"
        rows, _ = Lake._save(df, location)
        now, schema = datetime.now(), df.schema.json()
        self._record(
            "versions",
            (product, version, lake.workspace, source_table, schema, rows, location, None, now, published_by, changelog),
        )
        if row is None:
            self.register(product, lake.workspace, description, tags, sla_freshness_hours)
            self.grant(product, "*", "read")
        return Published(product, version, location, rows, schema)

    def _refuse_small_step(self, product: str, version: str, schema: str) -> None:
        known = self.versions().where(F.col("product_name") == product).select("product_name", "version", "schema_snapshot")
        every = known.union(self.spark.createDataFrame([(product, version, schema)], known.schema))
        step = schemas.version_steps(every, schemas.schema_changes(every)).where(F.col("version") == version).first()
        if step is not None and not step["honest"]:
            raise ValueError(f"{version} declares a {step['declared']} step after {step['previous']}; its schema takes a {step['needed']} one")

    def schema_changes(self, product: str) -> DataFrame:
        """What each published version of a product changed against the one before, by path."""
        return schemas.schema_changes(self.versions().where(F.col("product_name") == product))

    # --- consumers ---------------------------------------------------------

    def can(self, workspace: str, product: str, level: str = "read") -> bool:
        """Whether a workspace may use a product at a level."""
        return self.check(workspace, product, level)["granted"]

    def check(self, workspace: str, product: str, level: str = "read"):
        request = self.spark.createDataFrame(
            [(workspace, product, level)], "workspace string, product_name string, requested_level string"
        )
        return access.check_access(request, self.rules().where(F.col("product_name") == product)).first()

    def resolve(self, product: str, constraint: str = "latest"):
        """The version row a constraint selects, or None."""
        versions = self.versions().where(F.col("product_name") == product)
        request = self.spark.createDataFrame([(product, constraint)], "product_name string, version_constraint string")
        found = ops.resolve_versions(request, versions).first()["resolved_version"]
        return None if found is None else versions.where(F.col("version") == found).first()

    def _readable(self, workspace: str, product: str, constraint: str):
        if not self.can(workspace, product, "read"):
            raise PermissionError(f"workspace '{workspace}' may not read product '{product}'")
        row = self.resolve(product, constraint)
        if row is None:
            raise ValueError(f"no version of '{product}' matches '{constraint}'")
        return row

    def _load(self, row) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(row["schema_snapshot"]))).parquet(row["location"])

    def read(self, workspace: str, product: str, constraint: str = "latest") -> DataFrame:
        return self._load(self._readable(workspace, product, constraint))

    def query(self, workspace: str, product: str, sql: str | None = None, constraint: str = "latest") -> DataFrame:
        """Run SQL that names the product as ``{product}``; all rows without SQL."""
        df = self.read(workspace, product, constraint)
        return df if sql is None else self.spark.sql(sql, product=df)

    def subscribe(self, product: str, workspace: str, constraint: str = "latest", alias: str | None = None) -> None:
        if not self.can(workspace, product, "read"):
            raise PermissionError(f"workspace '{workspace}' may not read product '{product}'")
        self._record("subscriptions", (product, workspace, constraint, alias or _alias(product), datetime.now(), False))

    def unsubscribe(self, product: str, workspace: str) -> bool:
        found = (F.col("product_name") == product) & (F.col("consumer_workspace") == workspace)
        if self.subscriptions().where(found).isEmpty():
            return False
        self._record("subscriptions", (product, workspace, None, None, datetime.now(), True))
        return True

    def consume(
        self, workspace: str, product: str, constraint: str = "latest", alias: str | None = None, create_view: bool = True
    ) -> Consumed:
        """Resolve a product, subscribe to it and offer it as view ``products_<alias>``."""
        row = self._readable(workspace, product, constraint)
        alias = alias or _alias(product)
        self._record("subscriptions", (product, workspace, constraint, alias, datetime.now(), False))
        return self._offer(row, alias, create_view)

    def _offer(self, row, alias: str, create_view: bool = True) -> Consumed:
        view = f"products_{alias}" if create_view else None
        if view:
            self._load(row).createOrReplaceTempView(view)
        return Consumed(row["product_name"], row["version"], row["location"], alias, view)

    def consume_all(self, workspace: str, declared: list[tuple[str, str, str | None]]) -> tuple[list[Consumed], dict[str, str]]:
        """Consume declared (product, constraint, alias) triples; returns what worked and the errors of the rest."""
        done, errors = [], {}
        for product, constraint, alias in declared:
            try:
                done.append(self.consume(workspace, product, constraint, alias))
            except (PermissionError, ValueError) as error:
                errors[product] = str(error)
        return done, errors

    def refresh_subscriptions(self, workspace: str) -> list[Consumed]:
        """Resolve all constraints of a workspace again, in one job, and renew its views."""
        mine = self.subscriptions().where(F.col("consumer_workspace") == workspace)
        resolved = ops.resolve_versions(mine, self.versions())
        located = resolved.where(F.col("resolved_version").isNotNull()).join(
            self.versions().select("product_name", F.col("version").alias("resolved_version"), "version", "location", "schema_snapshot"),
            ["product_name", "resolved_version"],
        )
        return [self._offer(row, row["local_alias"]) for row in located.orderBy("product_name").collect()]

    def available(self, workspace: str) -> DataFrame:
        return ops.available_products(self.products(), self.versions(), self.rules(), workspace)

    def schema_of(self, product: str, constraint: str = "latest") -> str:
        row = self.resolve(product, constraint)
        if row is None:
            raise ValueError(f"no version of '{product}' matches '{constraint}'")
        return row["schema_snapshot"]

    def validate_schema(self, workspace: str, product: str, expected: list[str]) -> tuple[bool, list[str]]:
        """Whether the subscribed version has the expected columns, and those it lacks."""
        mine = (F.col("consumer_workspace") == workspace) & (F.col("product_name") == product)
        subscription = self.subscriptions().where(mine).first()
        row = self.resolve(product, subscription["version_constraint"] if subscription else "latest")
        snapshot = T.StructType.fromJson(json.loads(row["schema_snapshot"])) if row else T.StructType()
        lacking = [c for c in expected if c not in snapshot.names]
        return row is not None and not lacking, lacking


def _alias(product: str) -> str:
    """A product's name as part of a view's name."""
    return re.sub(r"[/-]", "_", product)
