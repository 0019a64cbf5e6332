"""Data-quality checks: many rules, few scans, one results table.

A check states how many rows break it. Row rules of all kinds fold into one
aggregate over the table, whatever their number; each column tested for
uniqueness adds one aggregate over that column alone; a free-form query adds
its own plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import col, cols, require_columns

STATUSES = ("passed", "failed", "warned", "skipped", "errored")
RESULT_SCHEMA = "check string, kind string, severity string, violations bigint, total bigint, status string"


@dataclass(frozen=True)
class Check:
    """One check.

    Exactly one of ``violates`` (row predicate), ``unique_on`` (columns) and
    ``query`` (table to violating rows, or to one number if ``scalar``) is set.
    ``tolerance`` is the share of violating rows still accepted; ``expect`` is
    the number a scalar query has to return.
    """

    name: str
    kind: str
    severity: str = "error"
    tolerance: float = 0.0
    violates: Column | None = None
    unique_on: tuple[str, ...] = ()
    nulls_repeat: bool = False
    query: Callable[[DataFrame], DataFrame] | None = None
    scalar: bool = False
    expect: float = 0
    skip: bool = False
    columns: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.severity not in ("error", "warn"):
            raise ValueError(f"severity must be error or warn, not {self.severity}")


# --- the kinds -------------------------------------------------------------


def not_null(column: str, **options) -> Check:
    return Check(f"{column}_not_null", "not_null", violates=col(column).isNull(), columns=(column,), **options)


def unique(*columns: str, nulls_repeat: bool = False, **options) -> Check:
    """Values occur once. Nulls are ignored unless ``nulls_repeat`` (the GROUP BY reading)."""
    name = "_".join(columns) + "_unique"
    return Check(name, "unique", unique_on=columns, nulls_repeat=nulls_repeat, columns=columns, **options)


def positive(column: str, **options) -> Check:
    return Check(f"{column}_positive", "positive", violates=col(column) <= 0, columns=(column,), **options)


def accepted_values(column: str, values: Sequence, **options) -> Check:
    return Check(
        f"{column}_accepted_values",
        "accepted_values",
        violates=~col(column).isin(*values),
        columns=(column,),
        **options,
    )


def minimum(column: str, value, **options) -> Check:
    return Check(f"{column}_min", "min", violates=col(column) < F.lit(value), columns=(column,), **options)


def maximum(column: str, value, **options) -> Check:
    return Check(f"{column}_max", "max", violates=col(column) > F.lit(value), columns=(column,), **options)


def rule(name: str, expression: str, **options) -> Check:
    """A boolean SQL expression every row has to meet; an unknown (null) result passes."""
    return Check(name, "rule", violates=~F.expr(expression), **options)


def violation_query(name: str, query: Callable[[DataFrame], DataFrame], **options) -> Check:
    """Passes if the query returns no row."""
    return Check(name, "query", query=query, **options)


def scalar_query(name: str, query: Callable[[DataFrame], DataFrame], expect: float = 0, **options) -> Check:
    """Passes if the query returns one row whose number equals ``expect``."""
    return Check(name, "scalar", query=query, scalar=True, expect=expect, **options)


def not_empty(**options) -> Check:
    """The table holds at least one row."""
    return Check("not_empty", "not_empty", **options)


def expect_count(n: int, **options) -> Check:
    """The table holds exactly ``n`` rows."""
    return Check("expect_count", "row_count", expect=n, **options)


def column_checks(column: str, tests: Sequence[str | dict], **options) -> list[Check]:
    """Checks from the declared form: ``["not_null", {"accepted_values": [...]}, {"min": 0}]``."""
    plain = {"not_null": not_null, "unique": unique, "positive": positive}
    with_value = {"accepted_values": accepted_values, "min": minimum, "max": maximum}
    out = []
    for test in tests:
        if isinstance(test, str):
            if test not in plain:
                raise ValueError(f"unknown column test: {test}")
            out.append(plain[test](column, **options))
            continue
        for name, value in test.items():
            if name not in with_value:
                raise ValueError(f"unknown column test: {name}")
            out.append(with_value[name](column, value, **options))
    return out


# --- evaluation ------------------------------------------------------------


def _label(check: Check) -> list[Column]:
    return [
        F.lit(check.name).alias("check"),
        F.lit(check.kind).alias("kind"),
        F.lit(check.severity).alias("severity"),
        F.lit(float(check.tolerance)).alias("tolerance"),
    ]


def _row_counts(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All row rules, and the table's row count, in one aggregate."""
    counts = [F.count_if(c.violates).alias(f"v{i}") for i, c in enumerate(checks) if c.violates is not None]
    wide = df.agg(F.count(F.lit(1)).alias("total"), *counts)
    rows = []
    for i, check in enumerate(checks):
        if check.violates is not None:
            violations = F.col(f"v{i}")
        elif check.kind == "not_empty":
            violations = F.when(F.col("total") == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        else:
            violations = F.abs(F.col("total") - F.lit(check.expect)).cast("bigint")
        rows.append(F.struct(*_label(check), violations.alias("violations"), F.col("total").alias("total")))
    return wide.select(F.inline(F.array(*rows)))


def _unique_counts(df: DataFrame, columns: Sequence[str], checks: Sequence[Check]) -> DataFrame:
    """Surplus rows (beyond the first of each value), from one count per value."""
    per_value = df.groupBy(*cols(columns)).agg(F.count(F.lit(1)).alias("_n"))
    known = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])
    surplus = F.col("_n") - 1
    wide = per_value.agg(
        F.coalesce(F.sum(F.when(known, surplus)), F.lit(0)).alias("known"),
        F.coalesce(F.sum(surplus), F.lit(0)).alias("all"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
    )
    rows = [
        F.struct(
            *_label(c),
            F.col("all" if c.nulls_repeat else "known").alias("violations"),
            F.col("total"),
        )
        for c in checks
    ]
    return wide.select(F.inline(F.array(*rows)))


def _query_counts(df: DataFrame, check: Check) -> DataFrame:
    found = check.query(df)
    if check.scalar:
        # One row with one number, equal to the expected one; a difference counts as at least one violation.
        number = F.max(F.col(f"`{found.columns[0]}`")).cast("double")
        apart = F.ceil(F.abs(number - F.lit(float(check.expect))))
        rows = F.count(F.lit(1))
        wrong = number.isNull() | F.isnan(number) | (rows != 1)
        violations = F.when(wrong, F.greatest(F.lit(1), rows)).otherwise(apart)
    elif check.tolerance:
        # A share needs the number of rows as well; both fold into one aggregate.
        marks = found.select(F.lit(1).alias("v"), F.lit(0).alias("t")).union(df.select(F.lit(0), F.lit(1)))
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("v", "violations"), ("t", "total"))]
        return marks.agg(*sums).select(*_label(check), "violations", "total")
    else:
        violations = F.count(F.lit(1))
    return found.agg(violations.cast("bigint").alias("violations")).select(
        *_label(check), "violations", F.lit(None).cast("bigint").alias("total")
    )


def _fits(df: DataFrame, check: Check) -> bool:
    """Whether Spark can resolve the check against the table; runs nothing."""
    try:
        if check.violates is not None:
            df.select(check.violates)
        elif check.unique_on:
            df.select(*cols(check.unique_on))
        elif check.query is not None:
            check.query(df)
    except AnalysisException:
        return False
    return True


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: ``check, kind, severity, violations, total, status``.

    ``status`` is passed, failed, warned, skipped or errored (the check does
    not fit the table, for example names an unknown column). A check passes
    without violations, or while their share of the rows stays within its
    tolerance.
    """
    if not checks:
        raise ValueError("no checks given")
    without_result = {id(c): "skipped" for c in checks if c.skip}
    without_result |= {id(c): "errored" for c in checks if not c.skip and not _fits(df, c)}
    active = [c for c in checks if id(c) not in without_result]
    parts = []
    by_row = [c for c in active if c.query is None and not c.unique_on]
    if by_row:
        parts.append(_row_counts(df, by_row))
    grouped: dict[tuple[str, ...], list[Check]] = {}
    for check in active:
        if check.unique_on:
            grouped.setdefault(check.unique_on, []).append(check)
    parts += [_unique_counts(df, columns, group) for columns, group in grouped.items()]
    parts += [_query_counts(df, c) for c in active if c.query is not None]
    within = F.col("violations") / F.nullif(F.col("total"), F.lit(0)) <= F.col("tolerance")
    good = (F.col("violations") == 0) | F.coalesce(within, F.lit(False))
    status = F.when(good, "passed").when(F.col("severity") == "warn", "warned").otherwise("failed")
    results = [part.withColumn("status", status).drop("tolerance") for part in parts]
    listed = [
        (c.name, c.kind, c.severity, None, None, without_result[id(c)]) for c in checks if id(c) in without_result
    ]
    if listed:
        results.append(df.sparkSession.createDataFrame(listed, RESULT_SCHEMA))
    return reduce(lambda a, b: a.union(b), results)


def summarize(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Roll-up: number of checks per status, and whether the gate is open."""
    count = {s: F.count_if(F.col("status") == s).alias(s) for s in STATUSES}
    return (
        results.groupBy(*cols(by))
        .agg(F.count(F.lit(1)).alias("checks"), *count.values())
        .withColumn("success", (F.col("failed") == 0) & (F.col("errored") == 0))
    )


class QualityGateError(Exception):
    """An error-severity check failed."""


def gate(results: DataFrame) -> DataFrame:
    """Raise if a check of severity ``error`` failed or could not be evaluated; warnings pass.

    The checks run once: what is returned holds their results, at most one row per check.
    """
    results = results.sparkSession.createDataFrame(results.collect(), results.schema)
    blocking = (F.col("status") == "failed") | ((F.col("status") == "errored") & (F.col("severity") == "error"))
    broken = results.where(blocking).orderBy("check").collect()
    if broken:
        listed = ", ".join(f"{r['check']} ({r['status']}, {r['violations']} violations)" for r in broken)
        raise QualityGateError(f"blocked by: {listed}")
    return results


def failing_rows(df: DataFrame, check: Check) -> DataFrame:
    """The violating rows themselves (for uniqueness: values and their count)."""
    if check.violates is not None:
        return df.where(check.violates)
    if check.unique_on:
        found = df.groupBy(*cols(check.unique_on)).agg(F.count(F.lit(1)).alias("occurrences"))
        if not check.nulls_repeat:
            found = found.dropna(subset=list(check.unique_on))
        return found.where(F.col("occurrences") > 1)
    if check.query is None:
        raise ValueError(f"{check.name} has no failing rows")
    return check.query(df)


def failing_sample(df: DataFrame, check: Check, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` violating rows in a stated order, for debugging."""
    found = failing_rows(df, check)
    require_columns(found, order_by)
    return found.orderBy(*cols(order_by)).limit(n)


#: Hex digits of a row's hash that tell apart the places of a sample: 65536 per check.
PLACE_DIGITS = 4


def failing_samples(df: DataFrame, checks: Sequence[Check], columns: Sequence[str], n: int = 5) -> DataFrame:
    """Up to ``n`` failing rows of every check: ``check, kind, severity, position, occurrences, row``, from one scan.

    ``row`` maps the chosen columns that are not null to their text; of a uniqueness check it holds the repeated values, with
    the number of their occurrences. Which rows are shown depends on hashes of these columns alone and not on the order of the
    data: failing rows fall into places by their hash, each place keeps the least one, and the ``n`` least places are shown.
    One aggregate over (check, place or value) does this for all checks; it is combined before the shuffle, so a check
    that every row breaks sends at most one row per place and task. Free-form queries add plans of their own.
    """
    require_columns(df, columns)
    active = [c for c in checks if not c.skip and _fits(df, c)]
    by_row = [c for c in active if c.violates is not None]
    by_value = [c for c in active if c.unique_on]
    shown = list(dict.fromkeys([*columns, *[c for check in by_value for c in check.unique_on]]))

    def texts(names: Sequence[str]) -> Column:
        return F.struct(*[(col(c).cast("string") if c in names else F.lit(None).cast("string")).alias(f"c{i}") for i, c in enumerate(shown)])

    def digest(names: Sequence[str]) -> Column:
        # The length before each text keeps apart what would read the same when joined.
        parts = [F.coalesce(F.concat(F.length(col(c).cast("string")).cast("string"), F.lit(":"), col(c).cast("string")), F.lit("-")) for c in names]
        return F.md5(F.concat_ws(",", *parts).cast("binary"))

    marks = []
    for i, check in enumerate(by_row):
        mark = F.struct(F.lit(i).alias("i"), F.substring("_hash", -PLACE_DIGITS, PLACE_DIGITS).alias("place"), F.col("_hash").alias("hash"), texts(columns).alias("row"))
        marks.append(F.when(check.violates, mark))
    # Checks of the same columns count their values once; a value's hash is its place and needs no copy.
    on = list(dict.fromkeys(c.unique_on for c in by_value))
    known = {names: reduce(lambda a, b: a & b, [col(c).isNotNull() for c in names]) for names in on}
    for i, names in enumerate(on, len(by_row)):
        nulls = any(c.nulls_repeat for c in by_value if c.unique_on == names)
        mark = F.struct(F.lit(i).alias("i"), digest(names).alias("place"), F.lit(None).cast("string").alias("hash"), texts(names).alias("row"))
        marks.append(mark if nulls else F.when(known[names], mark))
    parts = []
    if marks:
        every = df.withColumn("_hash", digest(columns)).select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.*")
        kept = every.groupBy("i", "place").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("hash", "row")).alias("first"))
        # A value that occurs once breaks nothing.
        kept = kept.where((F.col("i") < len(by_row)) | (F.col("n") > 1))
        if by_value:
            # What was counted for some columns goes to each of their checks; a null only to those in which it repeats.
            cell = {c: F.col(f"first.row.c{shown.index(c)}") for names in on for c in names}
            whole = {names: reduce(lambda a, b: a & b, [cell[c].isNotNull() for c in names]) for names in on}
            to = []
            for j, check in enumerate(by_value, len(by_row)):
                mine = F.col("i") == len(by_row) + on.index(check.unique_on)
                to.append(F.when(mine if check.nulls_repeat else mine & whole[check.unique_on], j))
            targets = F.when(F.col("i") < len(by_row), F.array("i")).otherwise(F.array_compact(F.array(*to)))
            first = F.struct(F.coalesce("first.hash", "place").alias("hash"), F.col("first.row").alias("row")).alias("first")
            kept = kept.select(F.explode(targets).alias("i"), "place", "n", first)
        order = Window.partitionBy("i").orderBy("first.hash", "place")
        top = kept.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
        names = F.array(*[F.lit(c) for c in shown])
        cells = F.map_from_arrays(names, F.array(*[F.col(f"first.row.c{i}") for i in range(len(shown))]))
        labels = F.array(*[F.struct(*_label(c)[:3]) for c in [*by_row, *by_value]])
        counted = F.when(F.col("i") >= len(by_row), F.col("n"))
        row = F.map_filter(cells, lambda _, v: v.isNotNull()).alias("row")
        parts.append(top.select(F.get(labels, F.col("i")).alias("l"), "position", counted.alias("occurrences"), row).select("l.*", "position", "occurrences", "row"))
    for check in active:
        if check.query is not None and not check.scalar:
            found = check.query(df)
            cells = F.map_filter(F.create_map(*[x for c in found.columns for x in (F.lit(c), col(c).cast("string"))]), lambda _, v: v.isNotNull())
            listed = found.select(*_label(check)[:3], cells.alias("row"), F.md5(F.to_json(F.struct(*cols(found.columns)))).alias("hash"))
            top = listed.orderBy("hash").limit(n).withColumn("position", F.row_number().over(Window.partitionBy("check").orderBy("hash")))
            parts.append(top.select("check", "kind", "severity", "position", F.lit(None).cast("bigint").alias("occurrences"), "row"))
    if not parts:
        return df.sparkSession.createDataFrame([], "check string, kind string, severity string, position int, occurrences bigint, row map<string,string>")
    return reduce(lambda a, b: a.union(b), parts)


# --- freshness and schema --------------------------------------------------


def age_status(newest: Column, as_of: str, warn_after: timedelta, error_after: timedelta) -> Column:
    """pass, warn or error by the age of ``newest``; no data at all is an error."""
    now = F.lit(as_of).cast("timestamp_ntz")
    newest = newest.cast("timestamp_ntz")
    return (
        F.when(newest.isNull() | (newest < now - F.lit(error_after)), "error")
        .when(newest < now - F.lit(warn_after), "warn")
        .otherwise("pass")
    )


def freshness(
    df: DataFrame,
    column: str,
    as_of: str,
    by: Sequence[str] = (),
    warn_after: timedelta = timedelta(hours=24),
    error_after: timedelta = timedelta(hours=48),
) -> DataFrame:
    """Newest value and freshness status, per group if ``by`` is given."""
    return (
        df.groupBy(*cols(by))
        .agg(F.max(col(column)).alias("newest"))
        .withColumn("status", age_status(F.col("newest"), as_of, warn_after, error_after))
    )


def schema_contract(df: DataFrame, declared: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Compare a table's columns with declared (name, type, nullable) triples.

    One row per column: ok, missing, extra, mistyped or nullable. Reads no data.
    """
    actual = {f.name: f for f in df.schema.fields}
    rows = []
    for name, ddl, may_be_null in declared:
        wanted = T.DataType.fromDDL("timestamp" if ddl.lower() == "datetime" else ddl)
        have = actual.get(name)
        if have is None:
            status = "missing"
        elif have.dataType != wanted:
            status = "mistyped"
        elif have.nullable and not may_be_null:
            status = "nullable"
        else:
            status = "ok"
        rows.append((name, wanted.simpleString(), have.dataType.simpleString() if have else None, status))
    known = {name for name, _, _ in declared}
    rows += [(f.name, None, f.dataType.simpleString(), "extra") for f in df.schema.fields if f.name not in known]
    return df.sparkSession.createDataFrame(rows, "column string, declared string, actual string, status string")
