"""XLSX workbooks, cells as text, no library needed: read from any store as binary files, or, from a path that all machines
have, by a Spark data source with a partition per sheet."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.coerce import NA_TOKENS

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The built-in number formats that show dates.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
NULLS = frozenset(NA_TOKENS)


def sheets(path) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in the workbook's order."""
    with zipfile.ZipFile(path) as z:
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        return [(s.get("name"), f"xl/{links[s.get(LINK)].lstrip('/').removeprefix('xl/')}") for s in book.iter(f"{MAIN}sheet")]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _day(value: float) -> str:
    moment = dt.datetime(1899, 12, 30) + dt.timedelta(days=value)
    return moment.date().isoformat() if moment.time() == dt.time() else moment.isoformat(sep=" ", timespec="seconds")


def rows(path, part: str) -> Iterator[list[str | None]]:
    """The rows of a sheet that have a cell, as text; numbers as Python writes them, dates in ISO order."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
            cells = styles.find(f"{MAIN}cellXfs")
            for xf in cells if cells is not None else []:
                k = int(xf.get("numFmtId", 0))
                dated.append(k in DATE_FORMATS or bool(re.search(r"[dmyhs]", re.sub(r"\"[^\"]*\"|\[[^\]]*\]|\\.", "", own.get(k, "")), re.I)))
        with z.open(part) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                out: list[str | None] = []
                for cell in row.iter(f"{MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    kind, v = cell.get("t"), cell.find(f"{MAIN}v")
                    text = v.text if v is not None else None
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif kind == "s" and text is not None:
                        text = strings[int(text)]
                    elif kind == "b" and text is not None:
                        text = "True" if text == "1" else "False"
                    elif kind in (None, "n") and text is not None:
                        style = int(cell.get("s", 0))
                        x = float(text)
                        text = _day(x) if style < len(dated) and dated[style] else str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)
                    out[at] = text
                if any(x is not None for x in out):
                    yield out
                row.clear()


def header_of(path, part: str, skip: int) -> list[str]:
    for k, row in enumerate(rows(path, part)):
        if k == skip:
            return [x or "" for x in row]
    return []


class SheetPartition(InputPartition):
    def __init__(self, part: str):
        self.part = part


class XlsxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.width, self.path, self.skip = len(schema.fields), options["path"], int(options.get("skipRows", 0))
        self.parts = [p for _, p in chosen(self.path, options.get("sheet"))]

    def partitions(self) -> list[InputPartition]:
        return [SheetPartition(p) for p in self.parts]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        for k, row in enumerate(rows(self.path, partition.part)):
            if k > self.skip:
                yield tuple((row + [None] * self.width)[: self.width])


def chosen(path, sheet: str | None) -> list[tuple[str, str]]:
    """The sheets that an option names: by name, by position, all (`*`), or the first."""
    every = sheets(path)
    if sheet == "*":
        return every
    if sheet is None or sheet == "":
        return every[:1]
    named = [s for s in every if s[0] == sheet]
    if named:
        return named
    if sheet.isdigit() and int(sheet) < len(every):
        return [every[int(sheet)]]
    raise ValueError(f"{path} has no sheet {sheet!r}")


def unique(names: list[str]) -> list[str]:
    """Names for a header's cells: empty ones by position, repeats with a trailing _."""
    out: list[str] = []
    for k, n in enumerate(names):
        name = n or f"column_{k}"
        while name in out:
            name += "_"
        out.append(name)
    return out


def read_sheet(spark: SparkSession, path: str, sheet: str | int | None = None, skip_rows: int = 0) -> DataFrame:
    """(row_index, columns of the first chosen sheet's header): the rows of the chosen sheets of one workbook, in order.

    A workbook is one compressed file of a bounded number of rows a sheet, so one task reads it; nothing but the header comes
    to the driver."""
    books = spark.read.format("binaryFile").load(path).select("content")
    wanted = None if sheet is None else str(sheet)

    def header(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                book = io.BytesIO(content)
                yield pa.RecordBatch.from_pydict({"name": pa.array(header_of(book, chosen(book, wanted)[0][1], skip_rows), pa.string())})

    names = unique([r["name"] for r in books.mapInArrow(header, "name string").collect()])
    width = len(names)

    def read(batches):
        at = 0
        for batch in batches:
            for content in batch.column("content").to_pylist():
                book, ready = io.BytesIO(content), []
                for _, part in chosen(book, wanted):
                    for k, row in enumerate(rows(book, part)):
                        if k > skip_rows:
                            ready.append([None if c in NULLS else c for c in (row + [None] * width)[:width]])
                        if len(ready) >= 4096:
                            yield batch_of(at, ready)
                            at, ready = at + len(ready), []
                if ready:
                    yield batch_of(at, ready)
                    at += len(ready)

    def batch_of(at: int, ready: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(at, at + len(ready)), pa.int64()), *(pa.array(c, pa.string()) for c in zip(*ready))], ["row_index", *(f"c{k}" for k in range(width))])

    return books.mapInArrow(read, ", ".join(["row_index long", *(f"c{k} string" for k in range(width))])).toDF("row_index", *names)


class XlsxSource(DataSource):
    """spark.read.format("xlsx").option("sheet", name or position or *).load(path): the first sheet's header names the columns."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        path = self.options["path"]
        names = header_of(path, chosen(path, self.options.get("sheet"))[0][1], int(self.options.get("skipRows", 0)))
        out = StructType()
        for name in unique(names):
            out.add(name, "string")
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(schema, dict(self.options))
