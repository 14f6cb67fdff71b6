"""Reading input tables from any store that Spark reads: CSV, XLSX and parquet, with text as it is written, the usual marks
for null as nulls, rows numbered in the source's order, and bad lines counted and kept."""

from __future__ import annotations

import csv
import io
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .csv_splits import REJECTED, ROW, Dialect, read_records
from .sniff import HEAD, NAMED, Files, SourceError, detect_encoding, detect_format, detect_separator
from .xlsx import read_sheet, unique

Naming = Callable[[list[str]], list[str]]

log = logging.getLogger(__name__)
LOW_CONFIDENCE = 0.7
#: The column of a row's place in its source; sources have no such name.
INDEX = "__row_index"


@dataclass
class Source:
    """An opened input: its rows, numbered in INDEX, its first column, and named as in the source, and what is known of it."""

    table: DataFrame
    kind: str
    names: list[str]
    encoding: str | None = None
    separator: str | None = None
    warnings: list[str] = field(default_factory=list)
    rejected: DataFrame | None = None  # (row_index, line) of a CSV's bad lines
    seen: Observation | None = None  # counts rows and bad lines in the first action over the table

    def counts(self) -> dict[str, int]:
        """Rows and bad lines, of the first action over the table; it must have taken place."""
        got = self.seen.get if self.seen is not None else {}
        return {"records": got.get("records", 0) or 0, "bad_lines": got.get("bad_lines", 0) or 0}


def _dialect(path: str, data: bytes, sep: str | None, encoding: str | None, skip_rows: int) -> tuple[Dialect, list[str], list[str]]:
    """(dialect, names, warnings) of a CSV file's head."""
    warnings = []
    found, sure = detect_encoding(data)
    if encoding is None:
        if sure < LOW_CONFIDENCE:
            warnings.append(f"encoding {found} is a guess ({sure:.2f}); read as utf-8, unreadable characters are replaced")
            found = "utf-8"
        encoding = found
    if len(data) >= HEAD and encoding.startswith("utf-16"):
        data = data[: len(data) // 2 * 2]
    text = data.decode(encoding, "replace").removeprefix("﻿")
    newline = "\n" if "\n" in text or "\r" not in text else "\r"
    lines = text.split(newline)[skip_rows:]
    body = [x for x in lines if x.strip()]
    if not body:
        raise SourceError(f"{path} has no rows")
    sep = NAMED.get(sep, sep) if sep else detect_separator("\n".join(body))
    first = next(k for k, x in enumerate(lines) if x.strip())
    names = next(csv.reader(io.StringIO(newline.join(lines[first:]), newline=""), delimiter=sep))
    if len(names) == 1:
        warnings.append("there is only one column")
    return Dialect(sep, encoding, newline, skip_rows), names, warnings


def _named(read: DataFrame, fields: list[str], names: list[str], index: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(index, names…) of the row numbers and fields of read."""
    return read.select(F.col(ROW).alias(index), *[F.col(f"`{f}`").alias(n) for f, n in zip(fields, names)], *more)


def open_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, skip_rows: int = 0, naming: Naming = unique, index: str = INDEX) -> Source:
    """A CSV file, or a folder of files with one header, all columns text. Separator and encoding are detected unless given.

    Quoted line ends are part of their field, and files are read in parallel all the same. Lines with too many fields, or that
    can't be read, are left out of the table, counted by `seen`, and are in `rejected`."""
    dialect, names, warnings = _dialect(path, Files(spark, path).head(HEAD), sep, encoding, skip_rows)
    for w in warnings:
        log.warning("%s: %s", path, w)
    seen = Observation()
    read = read_records(spark, path, names, dialect)
    bad = F.col(REJECTED).isNotNull()
    named = _named(read, [f"c{k}" for k in range(len(names))], naming(names), index, (REJECTED,))
    # A filter is not pushed below observe, so plans with a predicate over all columns do not grow with the renaming below.
    watched = named.observe(seen, F.count(F.lit(1)).alias("records"), F.count_if(bad).alias("bad_lines"))
    return Source(watched.filter(~bad).drop(REJECTED), "csv", names, dialect.encoding, dialect.sep, warnings, read.filter(bad).select(ROW, F.col(REJECTED).alias("line")), seen)


def open_xlsx(spark: SparkSession, path: str, sheet: str | int | None = None, skip_rows: int = 0, naming: Naming = unique, index: str = INDEX) -> Source:
    got, seen = read_sheet(spark, path, sheet, skip_rows), Observation()
    names = got.columns[1:]
    return Source(_named(got, names, naming(names), index).observe(seen, F.count(F.lit(1)).alias("records")), "xlsx", names, seen=seen)


def open_parquet(spark: SparkSession, path: str, naming: Naming = unique, index: str = INDEX) -> Source:
    """Parquet files; the index counts rows over files in the order of their paths, by each file's own row numbers."""
    df = spark.read.parquet(path)
    sizes = df.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file").count().orderBy("__file").collect()  # a row a file
    at, base = 0, []
    for file, n in sizes:
        base.append((file, at))
        at += n
    names, seen = df.columns, Observation()
    numbered = df.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__own"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    numbered = numbered.join(F.broadcast(spark.createDataFrame(base, "__file string, __at long")), "__file").withColumn(ROW, F.col("__at") + F.col("__own"))  # a row a file
    rows = _named(numbered, [f"c{k}" for k in range(len(names))], naming(names), index)
    return Source(rows.observe(seen, F.count(F.lit(1)).alias("records")), "parquet", names, seen=seen)


def open_source(spark: SparkSession, path: str, sheet: str | int | None = None, sep: str | None = None, encoding: str | None = None, skip_rows: int = 0, naming: Naming = unique, index: str = INDEX) -> Source:
    """A table in whatever format the path has; naming gives its columns' names from the source's, index that of the rows' places."""
    kind = detect_format(path, Files(spark, path).head(HEAD))
    if kind == "xlsx":
        return open_xlsx(spark, path, sheet, skip_rows, naming, index)
    return open_csv(spark, path, sep, encoding, skip_rows, naming, index) if kind == "csv" else open_parquet(spark, path, naming, index)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, skip_rows: int = 0) -> DataFrame:
    return open_csv(spark, path, sep, encoding, skip_rows).table.drop(INDEX)


def read_xlsx(spark: SparkSession, path: str, sheet: str | int | None = None, skip_rows: int = 0) -> DataFrame:
    return open_xlsx(spark, path, sheet, skip_rows).table.drop(INDEX)


def read_any(spark: SparkSession, path: str, sheet: str | int | None = None, sep: str | None = None, encoding: str | None = None, skip_rows: int = 0) -> DataFrame:
    """The rows of open_source without their numbers; an input without rows is an error."""
    source = open_source(spark, path, sheet, sep, encoding, skip_rows)
    df = source.table.drop(INDEX)
    if df.isEmpty():
        raise SourceError(f"{path} has no rows")
    return df


def reference_values(path: str) -> list[str]:
    """The first column of a short CSV list; a header counts as one only if it is named like an id."""
    with open(path, newline="", encoding="utf-8-sig") as f:
        got = [row[0].strip() for row in csv.reader(f) if row and row[0].strip()]
    return got[1:] if got and got[0].lower() in ("vendor_id", "vendor", "id", "code", "name") else got


def guard_rows(df: DataFrame, most: int | None) -> DataFrame:
    """df, or an error if it has more than `most` rows; without a limit nothing is counted."""
    if most is not None and df.limit(most + 1).count() > most:
        raise SourceError(f"the input has more than {most} rows")
    return df


__all__ = ["INDEX", "Source", "SourceError", "guard_rows", "open_csv", "open_parquet", "open_source", "open_xlsx", "read_any", "read_csv", "read_xlsx", "reference_values"]
