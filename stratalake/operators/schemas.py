"""Nested schemas as tables of (path, type) rows, and what a change of schema means to those who read it.

Types form a lattice: one is wider than another if it holds all its values and old files can be read as the wider type.
A change that only widens or adds is minor, one that removes, narrows or retypes is major, one that no reader
notices is a patch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import cols, require_columns
from stratalake.functions.versions import version_struct

# Decimal digits that whole-number types need to hold all their values.
DIGITS = {"byte": 3, "short": 5, "integer": 10, "long": 20}
#: A double holds whole numbers of so many digits exactly.
DOUBLE_DIGITS = 15
LEVELS = ("none", "patch", "minor", "major")


# --- the lattice over Spark's types -------------------------------------------


def _numbers(kind: T.DataType) -> tuple[int, int] | None:
    """Digits before and after the point."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    digits = DIGITS.get(kind.typeName())
    return None if digits is None else (digits, 0)


def is_wider(old: T.DataType, new: T.DataType) -> bool:
    """Whether ``new`` holds all values of ``old``, and files of ``old`` can be read as ``new``."""
    if old == new:
        return True
    have, want = _numbers(old), _numbers(new)
    if have and want:
        # Whole numbers widen into decimals, but not back.
        return have[0] <= want[0] and have[1] <= want[1] and (isinstance(new, T.DecimalType) or not isinstance(old, T.DecimalType))
    if isinstance(new, T.DoubleType):
        return isinstance(old, T.FloatType) or (have is not None and not isinstance(old, T.DecimalType) and have[0] <= DOUBLE_DIGITS)
    return isinstance(old, T.DateType) and isinstance(new, T.TimestampNTZType)


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The wider of two types, inside structs, arrays and maps too; None if neither holds the other."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f for f in a.fields}
        for field in b.fields:
            if field.name not in fields:
                fields[field.name] = T.StructField(field.name, field.dataType, True)
                continue
            kind = wider(fields[field.name].dataType, field.dataType)
            if kind is None:
                return None
            fields[field.name] = T.StructField(field.name, kind, fields[field.name].nullable or field.nullable)
        return T.StructType(list(fields.values()))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        kind = wider(a.elementType, b.elementType)
        return None if kind is None else T.ArrayType(kind, a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        key, value = wider(a.keyType, b.keyType), wider(a.valueType, b.valueType)
        return None if key is None or value is None else T.MapType(key, value, a.valueContainsNull or b.valueContainsNull)
    return a if is_wider(b, a) else b if is_wider(a, b) else None


# --- the same over type names in columns ----------------------------------------


def _digits(name: Column) -> tuple[Column, Column, Column]:
    """Whether a type name is a decimal, its digits before and its digits after the point (null for no exact number)."""
    decimal = r"^decimal\((\d+),(-?\d+)\)$"
    is_decimal = name.rlike(decimal)
    precision, scale = (F.regexp_extract(name, decimal, i).try_cast("int") for i in (1, 2))
    whole = F.lit(None).cast("int")
    for kind, digits in DIGITS.items():
        whole = F.when(name == kind, digits).otherwise(whole)
    return is_decimal, F.when(is_decimal, precision - scale).otherwise(whole), F.when(is_decimal, scale).otherwise(F.when(whole.isNotNull(), 0))


def widens(old: Column, new: Column) -> Column:
    """``is_wider`` over columns of type names, as schema snapshots spell them."""
    from_decimal, before, after = _digits(old)
    to_decimal, digits, scale = _digits(new)
    exact = (before <= digits) & (after <= scale) & (to_decimal | ~from_decimal)
    to_double = (new == "double") & ((old == "float") | (~from_decimal & (before <= DOUBLE_DIGITS)))
    dates = (old == "date") & (new == "timestamp_ntz")
    return (old == new) | F.coalesce(exact, F.lit(False)) | F.coalesce(to_double, F.lit(False)) | dates


# --- trees ------------------------------------------------------------------------


_FIELDS = "fields array<struct<name: string, type: string, nullable: boolean>>"
_PARTS = "elementType string, containsNull boolean, keyType string, valueType string, valueContainsNull boolean"


def schema_tree(schemas: DataFrame, ids: Sequence[str], column: str = "schema_snapshot") -> DataFrame:
    """Every field of every schema as a row: the id columns, path, type, nullable.

    Schemas are given as JSON text. Fields of structs are joined by dots (a name that holds one is put in back quotes),
    elements, keys and values of collections are named ``element``, ``key`` and ``value``. One step per level of nesting,
    over all schemas at once.
    """
    require_columns(schemas, [*ids, column])
    keys = cols(ids)
    todo = schemas.select(*keys, F.lit("").alias("path"), F.col(column).alias("type"), F.lit(False).alias("nullable"))
    found = []
    nested = F.col("type").startswith("{")
    dot = F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit(".")))
    while True:
        kind, node = F.get_json_object("type", "$.type"), F.from_json("type", f"{_FIELDS}, {_PARTS}")
        opened = todo.where(nested).select(*keys, "path", "nullable", kind.alias("kind"), node.alias("node"))
        if opened.isEmpty():
            break
        found.append(opened.where("path <> ''").select(*keys, "path", F.col("kind").alias("type"), "nullable"))

        def child(name, kind, may_be_null):
            return F.struct(F.concat(dot, name).alias("path"), kind.alias("type"), may_be_null.alias("nullable"))

        def quoted(name):
            return F.when(name.rlike("[.`]"), F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))).otherwise(name)

        # One expression for all kinds, so that each level reads the level above once.
        fields = F.transform("node.fields", lambda f: child(quoted(f["name"]), f["type"], f["nullable"]))
        element = F.array(child(F.lit("element"), F.col("node.elementType"), F.col("node.containsNull")))
        pair = F.array(
            child(F.lit("key"), F.col("node.keyType"), F.lit(False)), child(F.lit("value"), F.col("node.valueType"), F.col("node.valueContainsNull"))
        )
        children = F.when(F.col("kind") == "struct", fields).when(F.col("kind") == "array", element).when(F.col("kind") == "map", pair)
        todo = opened.select(*keys, F.explode(children).alias("c")).select(*keys, "c.path", "c.type", "c.nullable")
        found.append(todo.where(~nested))
    if not found:
        return todo.where("path <> ''")
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    return rows


def _change(old: Column, new: Column, was_null: Column, may_be_null: Column) -> Column:
    same = old == new
    return (
        F.when(old.isNull(), "added")
        .when(new.isNull(), "removed")
        .when(~same & widens(old, new), "widened")
        .when(~same & widens(new, old), "narrowed")
        .when(~same, "retyped")
        .when(~was_null & may_be_null, "loosened")
        .when(was_null & ~may_be_null, "tightened")
    )


# Fixed meaning of a change to those who read the table.
LEVEL_OF = {
    "added": "minor", "widened": "minor", "loosened": "minor", "tightened": "patch", "removed": "major", "narrowed": "major",
    "retyped": "major",
}


def _level(change: Column) -> Column:
    out = F.lit("none")
    for name, level in LEVEL_OF.items():
        out = F.when(change == name, level).otherwise(out)
    return out


def previous_versions(versions: DataFrame, by: str = "product_name") -> DataFrame:
    """Add ``previous``: the next lower version of the same product; null for its first one."""
    ordered = versions.withColumn("_v", version_struct(F.col("version"))).where(F.col("_v").isNotNull())
    return ordered.withColumn("previous", F.lag("version").over(Window.partitionBy(by).orderBy("_v"))).drop("_v")


def schema_changes(versions: DataFrame, column: str = "schema_snapshot") -> DataFrame:
    """What each version of a product changed against the one before: product_name, version, previous, path, change, level.

    Both trees of a change fold into one row per path; nothing is joined but the pairs of versions.
    """
    known = versions.select("product_name", "version", column).dropDuplicates(["product_name", "version"])
    tree = schema_tree(known, ["product_name", "version"], column)
    pairs = previous_versions(known.select("product_name", "version")).where("previous is not null")
    sides = [
        pairs.join(tree.withColumnRenamed("version", side), ["product_name", side]).select(
            "product_name", "version", "previous", "path", F.col("type").alias("type"), "nullable", F.lit(side == "version").alias("is_new")
        )
        for side in ("previous", "version")
    ]
    new = F.col("is_new")
    both = sides[0].unionByName(sides[1]).groupBy("product_name", "version", "previous", "path").agg(
        F.max(F.when(~new, F.col("type"))).alias("old_type"), F.max(F.when(new, F.col("type"))).alias("new_type"),
        F.max(F.when(~new, F.col("nullable"))).alias("old_null"), F.max(F.when(new, F.col("nullable"))).alias("new_null"),
    )
    change = _change(F.col("old_type"), F.col("new_type"), F.col("old_null"), F.col("new_null"))
    changed = both.withColumn("change", change).where("change is not null")
    return changed.select("product_name", "version", "previous", "path", "old_type", "new_type", "change", _level(F.col("change")).alias("level"))


def version_steps(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Per version: the step that its number declares, the step that its schema needs, and whether it declares enough."""
    pairs = previous_versions(versions.select("product_name", "version").distinct()).where("previous is not null")
    new, old = version_struct(F.col("version")), version_struct(F.col("previous"))
    declared = F.when(new["major"] != old["major"], 3).when(new["minor"] != old["minor"], 2).otherwise(1)
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")) - 1
    needed = changes.groupBy("product_name", "version").agg(F.max(rank).cast("int").alias("needed"), F.count(F.lit(1)).alias("changes"))
    names = F.array(*[F.lit(x) for x in LEVELS])
    found = pairs.join(needed, ["product_name", "version"], "left").withColumn("declared", declared)
    required = F.coalesce("needed", F.lit(0))
    return found.select(
        "product_name", "version", "previous", F.get(names, F.col("declared")).alias("declared"), F.get(names, required).alias("needed"),
        F.coalesce("changes", F.lit(0)).alias("changes"), (F.col("declared") >= required).alias("honest"),
    )
