"""Version numbers and version constraints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A version is three numbers without leading zeros; a constraint
# may name one to three numbers, missing ones being zero.
NUMBERS = r"(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)"
VERSION = rf"\A{NUMBERS}\z"
CONSTRAINT = r"\A(>=|<=|>|<|\^|~)?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(\.x)?\z"
# The forms of a constraint.
FORMS = ("latest", "exact", "^", "~", "N.x", "N.M.x", ">=", ">", "<=", "<")


def version_numbers(text: Column) -> list[Column]:
    """Major, minor and patch of ``major.minor.patch`` text; nulls for other text."""
    return [F.regexp_extract(text, VERSION, i).try_cast("bigint") for i in (1, 2, 3)]


def version_struct(text: Column) -> Column:
    """A version as a struct that orders as versions do; null if the text is none."""
    major, minor, patch = version_numbers(text)
    return F.when(
        text.rlike(VERSION), F.struct(major.alias("major"), minor.alias("minor"), patch.alias("patch"))
    )


def constraint_numbers(text: Column) -> list[Column]:
    """The (up to) three numbers a constraint names."""
    digits = [F.regexp_extract(text, CONSTRAINT, i) for i in (2, 3, 4)]
    return [F.when(d == "", F.lit(0)).otherwise(d.try_cast("bigint")).cast("bigint") for d in digits]


def constraint_form(text: Column) -> Column:
    """Position in FORMS; null for text that is no constraint."""
    operator, wild = F.regexp_extract(text, CONSTRAINT, 1), F.regexp_extract(text, CONSTRAINT, 5)
    minor, patch = F.regexp_extract(text, CONSTRAINT, 3), F.regexp_extract(text, CONSTRAINT, 4)
    name = (
        F.when(text == "latest", "latest")
        .when(text.rlike(VERSION), "exact")
        .when((operator == "") & (wild != "") & (patch == ""), F.when(minor == "", "N.x").otherwise("N.M.x"))
        .when((operator != "") & (wild == ""), operator)
    )
    return F.nullif(F.array_position(F.array(*[F.lit(f) for f in FORMS]), name), F.lit(0)) - 1
