"""Findings: one uniform row per violating record, made by a single scan for any number of checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The findings' schema and the weights of severities.
SCHEMA = (
    "finding_id string, session_id string, layer int, finding_type string, rule_id string, rule_name string, row_index long, row_data string, column_name string, actual_value string, expected_value string, severity string, "
    "confidence double, reasoning string, detection_method string, cross_verified boolean, cross_verify_status string, human_decision string, human_decision_at string, human_decision_note string, created_at string"
)
WEIGHTS = {"high": 3, "medium": 2, "low": 1}
SEVERITIES = tuple(WEIGHTS)
#: The column of a hit's check, by number.
HIT = "__hit"


@dataclass(frozen=True)
class Check:
    """What to look for in a row, and what to say of it."""

    rule_id: str | None
    name: str
    predicate: Column
    severity: str
    column: str | None = None
    actual: Column | None = None
    expected: str | None = None
    reasoning: str = ""
    layer: int = 3
    kind: str = "anomaly"
    method: str = "rule"
    confidence: float = 1.0
    reads: tuple[str, ...] = field(default=())

    def holds(self) -> Column:
        return F.coalesce(self.predicate, F.lit(False))


def text(value) -> Column:
    return F.lit(None).cast("string") if value is None else F.lit(str(value))


def emit(df: DataFrame, checks: list[Check], session_id: str = "session", row_index: str = "row_index", snapshot: list[str] | None = None, created_at: str | None = None) -> DataFrame:
    """The findings of all checks over df, whose rows row_index numbers.

    Several checks share one scan that reads only their columns; a single check is a plain filter, which the file scan can
    push down. snapshot lists the columns that row_data keeps as JSON (none: row_data is null)."""
    if not checks:
        return df.sparkSession.createDataFrame([], SCHEMA)
    nothing = F.lit(None).cast("string")
    data = F.to_json(F.struct(*[F.col(f"`{c}`") for c in snapshot]), {"ignoreNullFields": "false"}) if snapshot else nothing
    index = F.col(f"`{row_index}`").cast("long").alias("row_index")
    if len(checks) == 1:
        hits, of = df.filter(checks[0].predicate), lambda values: values[0]
        actual = checks[0].actual.cast("string") if checks[0].actual is not None else nothing
    else:
        # A row's hits are the numbers of the checks, so what is said of a hit is made afterwards, and only if it is wanted.
        numbers = F.array_remove(F.array(*[F.when(c.holds(), k).otherwise(-1) for k, c in enumerate(checks)]), -1)
        hits, of = df.withColumn(HIT, F.explode(numbers)), lambda values: F.element_at(F.array(*values), F.col(HIT) + 1)
        shown = [F.when(F.col(HIT) == k, c.actual.cast("string")) for k, c in enumerate(checks) if c.actual is not None]
        actual = F.coalesce(*shown) if shown else nothing
    rows = hits.select(
        index, data.alias("row_data"), of([F.lit(c.layer) for c in checks]).alias("layer"), of([F.lit(c.kind) for c in checks]).alias("finding_type"), of([text(c.rule_id) for c in checks]).alias("rule_id"),
        of([F.lit(c.name) for c in checks]).alias("rule_name"), of([text(c.column) for c in checks]).alias("column_name"), actual.alias("actual_value"), of([text(c.expected) for c in checks]).alias("expected_value"),
        of([F.lit(c.severity) for c in checks]).alias("severity"), of([F.lit(c.confidence).cast("double") for c in checks]).alias("confidence"), of([F.lit(c.reasoning) for c in checks]).alias("reasoning"),
        of([F.lit(c.method) for c in checks]).alias("detection_method"),
    )
    identity = F.sha2(F.concat_ws("|", F.lit(session_id), F.coalesce("rule_id", F.lit("")), F.col("row_index").cast("string"), F.coalesce("column_name", F.lit(""))), 256)
    return shaped(rows.withColumns({"finding_id": identity, "session_id": F.lit(session_id), "created_at": text(created_at)}))


def shaped(rows: DataFrame) -> DataFrame:
    """rows with the findings' columns, in order; those that are missing are null, cross_verified false."""
    out = []
    for part in SCHEMA.split(", "):
        name, kind = part.split(" ")
        missing = F.lit(False) if name == "cross_verified" else F.lit(None)
        out.append((F.col(name) if name in rows.columns else missing).cast(kind).alias(name))
    return rows.select(*out)


def first_of_each(findings: DataFrame) -> DataFrame:
    """A finding per rule and row."""
    return findings.dropDuplicates(["rule_id", "row_index"])


def union_distinct(*parts: DataFrame) -> DataFrame:
    """All findings, one for each finding_id."""
    got = parts[0]
    for part in parts[1:]:
        got = got.unionByName(part)
    return got.dropDuplicates(["finding_id"])


def rank(severity: str | Column = "severity") -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(99)


def weight(severity: str = "severity") -> Column:
    c = F.col(severity)
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def top(findings: DataFrame, limit: int = 50) -> DataFrame:
    """The findings that a report lists: by severity, then row."""
    return findings.orderBy(rank(), "row_index", "rule_id").limit(limit)


def summary(findings: DataFrame) -> DataFrame:
    """Counts by rule and severity; findings without a rule count under `unknown`."""
    return findings.groupBy(F.coalesce("rule_id", F.lit("unknown")).alias("rule_id"), "severity").agg(F.count(F.lit(1)).alias("n"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: total, high, medium, low, llm."""
    return findings.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count_if(F.col("detection_method") == "llm").alias("llm"))


def rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity and rule, by severity, and in all."""
    return findings.rollup("severity", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def integrity_score(findings: DataFrame) -> DataFrame:
    """One row (score, rating): the sum of the findings' weights and what it is called."""
    score = findings.agg(F.coalesce(F.sum(weight()), F.lit(0)).cast("long").alias("score"))
    rating = F.when(F.col("score") == 0, "CLEAN").when(F.col("score") <= 10, "MINOR").when(F.col("score") <= 30, "MODERATE").otherwise("SEVERE")
    return score.withColumn("rating", rating)


def check_scores(findings: DataFrame) -> DataFrame:
    """(rule_id, findings, severity_score) of each check that found something."""
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.sum(weight()).cast("long").alias("severity_score"))
