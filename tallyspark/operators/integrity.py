"""The ten integrity checks. Statistics for all columns come from one aggregation; all row checks share one scan; only the
duplicate checks shuffle."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import NUMERIC, day, num, shown, type_of
from .findings import Check, emit, shaped, text
from .rules import LIST_LIMIT

OPERATORS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "!=": lambda a, b: a != b, "==": lambda a, b: a == b}
#: Names and severities of the checks.
NAMES = {
    "IC-001": "Null values", "IC-002": "Duplicate rows", "IC-003": "Duplicate keys", "IC-004": "Date range", "IC-005": "Numeric range", "IC-006": "Negative amounts", "IC-007": "Format", "IC-008": "Reference values", "IC-009": "Cross-column consistency",
    "IC-010": "Statistical outliers",
}


@dataclass
class ColumnRules:
    """What is expected of one column."""

    dtype: str | None = None
    required: bool = False
    null_threshold: float | None = None
    min_value: float | None = None
    max_value: float | None = None
    min_date: str | None = None
    max_date: str | None = None
    allowed_negative: bool = False
    pattern: str | None = None
    reference_values: list[str] | None = None


@dataclass
class CrossCheck:
    """left op right, or left op the product or sum of right_fields."""

    left: str
    op: str = "=="
    right: str | None = None
    right_fields: list[str] = field(default_factory=list)
    right_op: str = "product"


@dataclass
class IntegrityConfig:
    columns: dict[str, ColumnRules] = field(default_factory=dict)
    primary_key: list[str] = field(default_factory=list)
    cross_checks: list[CrossCheck] = field(default_factory=list)
    null_threshold: float = 0.0
    outlier_multiplier: float = 3.0
    min_date: str = "1900-01-01"
    max_date: str | None = None

    def of(self, column: str) -> ColumnRules:
        return self.columns.get(column, ColumnRules())


def _check(df: DataFrame, ic: str, column: str | None, predicate: Column, severity: str, expected: str, why: str) -> Check:
    return Check(ic, NAMES[ic], predicate, severity, column, shown(df, column) if column else None, expected, why, 2, "integrity")


def nulls(df: DataFrame, config: IntegrityConfig, columns: list[str], stats: dict) -> list[Check]:
    """IC-001: null rows of columns whose share of nulls is above their threshold."""
    out = []
    for c in columns:
        rules, share = config.of(c), (stats[f"null {c}"] or 0) / max(1, stats["rows"])
        if share > (config.null_threshold if rules.null_threshold is None else rules.null_threshold):
            out.append(_check(df, "IC-001", c, F.col(f"`{c}`").isNull(), "high" if rules.required else "low", "not null", f"{share:.2%} of {c} is null"))
    return out


def date_range(df: DataFrame, config: IntegrityConfig, columns: list[str], *_) -> list[Check]:
    """IC-004: days outside the bounds, for columns hinted as dates or with `date` as a part of their name."""
    out, latest = [], config.max_date or str(dt.date.today() + dt.timedelta(days=1))
    for c in sorted(columns):
        rules = config.of(c)
        temporal = isinstance(type_of(df, c), (T.DateType, T.TimestampType, T.TimestampNTZType))
        if rules.dtype == "date" or "date" in c.split("_") or rules.min_date or rules.max_date or temporal and "date" in c:
            low, high = rules.min_date or config.min_date, rules.max_date or latest
            d = day(df, c)
            out.append(_check(df, "IC-004", c, (d < F.lit(low).cast("date")) | (d > F.lit(high).cast("date")), "medium", f"{low}..{high}", f"{c} is out of its range"))
    return out


def numeric_range(df: DataFrame, config: IntegrityConfig, columns: list[str], *_) -> list[Check]:
    """IC-005: numbers outside configured bounds."""
    out = []
    for c in columns:
        rules, x = config.of(c), num(df, c)
        parts = ([x < float(rules.min_value)] if rules.min_value is not None else []) + ([x > float(rules.max_value)] if rules.max_value is not None else [])
        if parts:
            low, high = ("" if v is None else str(v) for v in (rules.min_value, rules.max_value))
            out.append(_check(df, "IC-005", c, reduce(lambda a, b: a | b, parts), "medium", f"{low}..{high}", f"{c} is out of its range"))
    return out


def negative(df: DataFrame, config: IntegrityConfig, columns: list[str], *_) -> list[Check]:
    """IC-006: negative numbers in configured columns, and in those with `amount` in their name, unless allowed."""
    out = []
    for c in columns:
        rules = config.of(c)
        if rules.allowed_negative or rules.dtype not in (None, "numeric", "currency") or "amount" not in c and c not in config.columns or (rules.min_value or 0) < 0:
            continue
        if rules.dtype is None and not isinstance(type_of(df, c), (*NUMERIC, T.StringType)):
            continue
        out.append(_check(df, "IC-006", c, num(df, c) < 0, "medium", ">= 0", f"{c} is negative"))
    return out


def formats(df: DataFrame, config: IntegrityConfig, columns: list[str], *_) -> list[Check]:
    """IC-007: values in which the configured pattern is not found."""
    return [_check(df, "IC-007", c, F.col(f"`{c}`").isNotNull() & ~shown(df, c).rlike(p), "low", p, f"{c} does not fit its pattern") for c in columns if (p := config.of(c).pattern)]


def references(df: DataFrame, config: IntegrityConfig, columns: list[str], *_) -> list[Check]:
    """IC-008: values that are not in a short configured list; reference_findings() takes lists of any length and tables."""
    return [_check(df, "IC-008", c, F.col(f"`{c}`").isNotNull() & ~shown(df, c).isin(values), "high", "reference set", f"{c} is not a reference value") for c in columns if (values := config.of(c).reference_values) is not None and len(values) <= LIST_LIMIT]


def cross_columns(df: DataFrame, config: IntegrityConfig, columns: list[str], stats: dict) -> list[Check]:
    """IC-009: rows in which both sides are known and the relation does not hold; numbers if either column has any, else days."""
    out = []
    for k, cross in enumerate(config.cross_checks):
        named = [cross.left, *([cross.right] if cross.right else cross.right_fields)]
        if len(named) < 2 or any(c not in columns for c in named):
            continue
        left, right = cross_sides(df, cross, bool(stats[f"cross {k} left"]) and bool(stats[f"cross {k} right"]))
        holds = OPERATORS.get(cross.op, OPERATORS["=="])(left, right)
        expected = f"{cross.op} {cross.right or f' {cross.right_op} '.join(cross.right_fields)}"
        out.append(_check(df, "IC-009", cross.left, left.isNotNull() & right.isNotNull() & ~holds, "medium", expected, f"{cross.left} is not {expected}"))
    return out


def cross_sides(df: DataFrame, cross: CrossCheck, numeric: bool) -> tuple[Column, Column]:
    if cross.right:
        return (num(df, cross.left), num(df, cross.right)) if numeric else (day(df, cross.left), day(df, cross.right))
    return num(df, cross.left), reduce(add if cross.right_op == "sum" else mul, [num(df, c) for c in cross.right_fields])


def outliers(df: DataFrame, config: IntegrityConfig, columns: list[str], stats: dict) -> list[Check]:
    """IC-010: numbers further than so many sample standard deviations from the mean of their column."""
    out, m = [], config.outlier_multiplier
    for c in columns:
        mean, std, n = (stats.get(f"{k} {c}") for k in ("mean", "std", "n"))
        if n and n >= 2 and std:
            x = num(df, c)
            out.append(_check(df, "IC-010", c, (x < mean - m * std) | (x > mean + m * std), "low", f"{mean - m * std}..{mean + m * std}", f"{c} is an outlier"))
    return out


def statistics(df: DataFrame, config: IntegrityConfig, columns: list[str]) -> dict:
    """What the row checks need to know of whole columns, in one aggregation."""
    aggs = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null {c}") for c in columns]]
    for c in columns:
        if isinstance(type_of(df, c), (*NUMERIC, T.StringType, T.BooleanType)):
            x = num(df, c)
            aggs += [F.avg(x).alias(f"mean {c}"), F.stddev_samp(x).alias(f"std {c}"), F.count(x).alias(f"n {c}")]
    for k, cross in enumerate(config.cross_checks):
        if cross.left in columns and all(c in columns for c in ([cross.right] if cross.right else cross.right_fields)):
            left, right = cross_sides(df, cross, True)
            aggs += [F.count(left).alias(f"cross {k} left"), F.count(right).alias(f"cross {k} right")]
    return df.agg(*aggs).first().asDict()


ROW_CHECKS = {"IC-001": nulls, "IC-004": date_range, "IC-005": numeric_range, "IC-006": negative, "IC-007": formats, "IC-008": references, "IC-009": cross_columns, "IC-010": outliers}


#: Types whose values are equal when their texts are, so that they are compared as they are.
PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType)


def duplicate_keys(df: DataFrame, columns: list[str]) -> list[Column]:
    """What tells rows that agree on the columns: up to four plain columns themselves, otherwise a SHA-256 of the columns' texts."""
    if 0 < len(columns) <= 4 and all(isinstance(type_of(df, c), PLAIN) for c in columns):
        return [F.col(f"`{c}`") for c in columns]
    names = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    return [F.unhex(F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256))]


def duplicate_findings(df: DataFrame, ic: str, columns: list[str], session_id: str, row_index: str) -> DataFrame:
    """IC-002 and IC-003: all rows that agree on the columns with another row; nulls agree with nulls.

    Keys are counted, combined before the shuffle, and the rows' numbers and keys are joined to those that repeat: each row
    moves twice at most, whatever the share of rows that repeat. Whole rows never move."""
    keys = {f"__k{i}": k for i, k in enumerate(duplicate_keys(df, columns))}
    rows = df.select(F.col(f"`{row_index}`").cast("long").alias("row_index"), *[k.alias(n) for n, k in keys.items()])
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*[F.col(n).alias(f"{n}r") for n in keys])
    same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in keys])
    found = rows.join(repeated, same, "left_semi").select("row_index")
    values = {"layer": F.lit(2), "finding_type": F.lit("integrity"), "rule_id": F.lit(ic), "rule_name": F.lit(NAMES[ic]), "column_name": F.lit(", ".join(columns) if ic == "IC-003" else None).cast("string"), "expected_value": F.lit("unique"), "severity": F.lit("high"), "confidence": F.lit(1.0), "reasoning": F.lit("the row occurs more than once" if ic == "IC-002" else "the key occurs more than once"), "detection_method": F.lit("rule"), "session_id": F.lit(session_id)}
    return shaped(found.withColumns(values).withColumn("finding_id", F.sha2(F.concat_ws("|", F.lit(session_id), F.lit(ic), F.col("row_index").cast("string"), F.lit("")), 256)))


def referenced(df: DataFrame, column: str, reference: DataFrame, there: bool = True) -> DataFrame:
    """The rows of df whose value in the column is in a table's first column, or, unless there, those of which it is not; a null
    value is neither."""
    allowed = reference.select(F.col(reference.columns[0]).cast("string").alias("__allowed")).filter("__allowed is not null").distinct()
    known = df.filter(F.col(f"`{column}`").isNotNull()).withColumn("__v", shown(df, column))
    return known.join(allowed, F.col("__v") == F.col("__allowed"), "left_semi" if there else "left_anti").drop("__v")


def reference_findings(df: DataFrame, column: str, reference: DataFrame, session_id: str = "session", row_index: str = "row_index") -> DataFrame:
    """IC-008 against a table with one column of allowed values: an anti-join, broadcast by Spark if the table is small."""
    missing = referenced(df, column, reference, there=False)
    return emit(missing, [_check(df, "IC-008", column, F.lit(True), "high", "reference set", f"{column} is not a reference value")], session_id, row_index)


def run_checks(df: DataFrame, config: IntegrityConfig = IntegrityConfig(), session_id: str = "session", row_index: str = "row_index", only: list[str] | None = None, snapshot: list[str] | None = None) -> DataFrame:
    """The findings of all ten checks, or of those named in `only`, over every column but row_index."""
    columns = [c for c in df.columns if c != row_index]
    wanted = set(only or NAMES)
    stats = statistics(df, config, columns) if wanted & {"IC-001", "IC-009", "IC-010"} else {}
    checks = [c for ic, f in ROW_CHECKS.items() if ic in wanted for c in f(df, config, columns, stats)]
    parts = [emit(df, checks, session_id, row_index, snapshot)] if checks else []
    if "IC-002" in wanted:
        parts.append(duplicate_findings(df, "IC-002", columns, session_id, row_index))
    if "IC-003" in wanted and config.primary_key and all(c in columns for c in config.primary_key):
        parts.append(duplicate_findings(df, "IC-003", config.primary_key, session_id, row_index))
    for c in columns if "IC-008" in wanted else []:
        values = config.of(c).reference_values
        if values is not None and len(values) > LIST_LIMIT:
            parts.append(reference_findings(df, c, df.sparkSession.createDataFrame([(v,) for v in values], "v string"), session_id, row_index))
    return reduce(DataFrame.unionByName, parts) if parts else emit(df, [])


__all__ = ["ColumnRules", "CrossCheck", "IntegrityConfig", "NAMES", "duplicate_findings", "reference_findings", "run_checks", "statistics", "text"]
