"""CSV files of any size read in parallel, quoted line ends included.

Whether a line end is inside quotes depends on all that stands before it. Each split of a file is therefore looked at twice
over: as if it began outside of quotes, and as if inside. What a split says is small (how many records begin in it and where
it ends, for each of the two), so a running composition over all splits in order tells how each begins, and the number of its
first record. Then the splits are parsed in parallel. A record that crosses into another split is put together from its
pieces, which a further pass over the files brings."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import NA_TOKENS
from .files import SourceError

ROW, REJECTED, SPLIT = "row_index", "__rejected", "__split"
NULLS = frozenset(NA_TOKENS)
#: Rows of a batch handed on.
BATCH = 4096
RECUT = "the files have been cut otherwise than before; read them again"


@dataclass(frozen=True)
class Dialect:
    sep: str = ","
    encoding: str = "utf-8"
    newline: str = "\n"
    skip: int = 0

    def codec(self) -> str:
        return "utf-8" if self.encoding == "utf-8-sig" else self.encoding


class Quotes:
    """For lines: whether one leaves a quoted field open, begun outside of quotes or inside.

    A field is quoted if it begins with a quote; two quotes in it are one; what follows its closing quote is plain text."""

    def __init__(self, sep: str):
        s = re.escape(sep)
        inner = r'(?:[^"]++|"")*+'
        fields = rf'(?:(?:"{inner}"[^{s}]*+|[^"{s}][^{s}]*+)?+{s})*+"{inner}'
        self.outside = re.compile(fields, re.DOTALL)
        self.inside = re.compile(rf'{inner}(?:"[^{s}]*+{s}{fields})?+', re.DOTALL)

    def open(self, line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        return bool((self.inside if inside else self.outside).fullmatch(line))


def lines_of(spark: SparkSession, path: str | list[str], dialect: Dialect) -> DataFrame:
    """(file, start, value): the lines of the files as bytes, with the place of the split that each is from.

    Spark cuts files by settings and by the number of executors of the moment; for both passes to cut them alike, the
    settings of a session of the reader's own count, in which that number is fixed."""
    own = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        if (value := spark.conf.get(key, None)) is not None:
            own.conf.set(key, value)
    if own.conf.get("spark.sql.files.minPartitionNum", None) is None:
        own.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    reader = own.read.option("lineSep", dialect.newline)
    if dialect.codec().startswith("utf-16"):  # a line end is two bytes
        reader = reader.option("encoding", dialect.codec().upper().replace("-LE", "LE").replace("-BE", "BE"))
    read = reader.text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    return spark.createDataFrame([], lines.schema).unionAll(lines)  # of the caller's session


def _decoded(batch: pa.RecordBatch, codec: str) -> list[str]:
    return [v.decode(codec, "replace") for v in batch.column("value").to_pylist()]


def _blank(line: str, sep: str) -> bool:
    return not line.strip("\r\n " if sep == "\t" else " \t\r\n")


class _Walk:
    """Lines of one split in order -> records, given whether it begins inside quotes."""

    def __init__(self, dialect: Dialect, first: bool, inside: bool):
        self.dialect, self.inside, self.quotes = dialect, inside, Quotes(dialect.sep)
        self.to_skip, self.mark = (dialect.skip, True) if first else (0, False)
        self.in_head, self.begun = inside, False
        self.held: list[str] = []
        self.head: list[str] = []

    def add(self, line: str, keep: bool = True) -> str | None:
        """The record that the line completes, of those that begin in the split; without keep, some text."""
        if self.mark:
            line, self.mark = line.removeprefix("\ufeff"), False
        if self.to_skip:
            self.to_skip -= 1
            return None
        if not self.inside and _blank(line, self.dialect.sep):
            return None
        self.inside = self.quotes.open(line, self.inside)
        if self.in_head:
            if keep:
                self.head.append(line)
            self.in_head = self.inside
            return None
        if keep:
            self.held.append(line)
        self.begun = self.inside
        if self.inside:
            return None
        record, self.held = self.dialect.newline.join(self.held) if len(self.held) > 1 else line, []
        return record.removesuffix("\r")

    def records(self, batch: pa.RecordBatch) -> Iterator[str]:
        lines = _decoded(batch, self.dialect.codec())
        if not (self.inside or self.mark or self.to_skip) and _plain(batch, self.dialect.codec()):
            yield from (line.removesuffix("\r") for line in lines if not _blank(line, self.dialect.sep))
        else:
            yield from (r for r in map(self.add, lines) if r is not None)


def _runs(batches, *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of equal values of the named columns, as slices of batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.stack([pc.fill_null(batch.column(n).dictionary_encode().indices, -1).to_numpy() for n in names])
        cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield tuple(batch.column(n)[lo].as_py() for n in names), batch.slice(lo, hi - lo)


def _plain(batch: pa.RecordBatch, codec: str) -> bool:
    """Whether no line of the batch has a quote; a byte that looks like one in a wide charset only costs time."""
    return not pc.any(pc.match_substring(batch.column("value"), '"')).as_py() and not codec.startswith("utf-16")


def _summaries(batches, dialect: Dialect) -> Iterator[pa.RecordBatch]:
    """For each split: (file, start, n0, open0, n1, open1, short), records begun and the end, begun outside or inside of
    quotes, and whether it ends before the rows to skip do."""
    now, walks, n = None, (), [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [now[0]], "start": [now[1]], "n0": [n[0]], "open0": [walks[0].inside], "n1": [n[1]], "open1": [walks[1].inside], "short": [walks[0].to_skip > 0]})

    for key, batch in _runs(batches, "file", "start"):
        if key != now:
            if now:
                yield row()
            now, n = key, [0, 0]
            walks = tuple(_Walk(dialect, key[1] == 0, inside) for inside in (False, True))
        lines = _decoded(batch, dialect.codec())
        plain = _plain(batch, dialect.codec())
        for k, walk in enumerate(walks):
            if plain and not walk.to_skip:
                n[k] += 0 if walk.inside else sum(not _blank(line, dialect.sep) for line in lines)
                continue
            for line in lines:
                before = walk.begun
                done = walk.add(line, keep=False)
                n[k] += (done is not None or walk.begun) and not before  # a record counts where it begins
    if now:
        yield row()


def _placed(summaries: list) -> list[tuple]:
    """(file, start, split, inside, base, crosses) of each split: its number, how it begins, the number of its first record over
    all files without their headers, and whether a record crosses its start or end."""
    out, at = [], 0
    file, inside = None, False
    for k, r in enumerate(sorted(summaries, key=lambda r: (r["file"], r["start"]))):
        if r["file"] != file:
            if inside:
                raise SourceError(f"{file}: a quote is not closed")
            file, inside, at = r["file"], False, at - 1  # the header
            if r["short"] or not r["n0"] or r["n0"] == 1 and r["open0"]:
                raise SourceError(f"{file}: the rows to skip and the header are not in its first split")
        begins, n = inside, r["n1"] if inside else r["n0"]
        inside = r["open1"] if inside else r["open0"]
        out.append((file, r["start"], k, begins, at + (r["start"] == 0), begins or inside))
        at += n
    if inside:
        raise SourceError(f"{file}: a quote is not closed")
    return out


def _parsed(records: list[str], dialect: Dialect) -> list[list[str] | None]:
    """The fields of each record; None where it can't be read."""
    csv.field_size_limit(1 << 31)
    try:
        got = list(csv.reader(records, delimiter=dialect.sep))
        if len(got) == len(records):
            return got
    except csv.Error:
        pass
    out: list[list[str] | None] = []
    for record in records:
        try:
            got = list(csv.reader([record], delimiter=dialect.sep))
            out.append(got[0] if len(got) == 1 else None)
        except csv.Error:
            out.append(None)
    return out


def _table(rows: list[tuple[int, str]], names: list[str], dialect: Dialect) -> pa.RecordBatch:
    """Numbered records as a batch: fields by column, short records filled with nulls; those that are too long or can't be
    read have no fields but their text as rejected."""
    fields = _parsed([r for _, r in rows], dialect)
    width = len(names)
    good = [f is not None and len(f) <= width for f in fields]
    cells = [([None if c in NULLS else c for c in f] + [None] * (width - len(f)) if g else [None] * width) for f, g in zip(fields, good)]
    columns = [pa.array([c[k] for c in cells], pa.string()) for k in range(width)]
    rejected = [None if g else r for g, (_, r) in zip(good, rows)]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), *columns, pa.array(rejected, pa.string())], [ROW, *(f"c{k}" for k in range(width)), REJECTED])


def _records(batches, names: list[str], dialect: Dialect) -> Iterator[pa.RecordBatch]:
    """Lines (split, first, inside, base, value) -> the records that begin and end in their split."""
    now, walk, at, header = None, None, 0, False
    ready: list[tuple[int, str]] = []
    for (split, first, inside, base), batch in _runs(batches, "split", "first", "inside", "base"):
        if split is None:
            raise SourceError(RECUT)
        if split != now:
            now, walk, at, header = split, _Walk(dialect, first, inside), base, first
        for record in walk.records(batch):
            if header:
                header, own = False, _parsed([record], dialect)[0]
                if own != names:
                    raise SourceError(f"a file's header is {own}, another's {names}")
                continue
            ready.append((at, record))
            at += 1
            if len(ready) >= BATCH:
                yield _table(ready, names, dialect)
                ready = []
    if ready:
        yield _table(ready, names, dialect)


def _pieces(batches, dialect: Dialect) -> Iterator[pa.RecordBatch]:
    """Lines of splits that records cross -> (row_index, split, text): what of the record that crosses their start or end
    each has."""
    now, walk, at, base, header = None, None, 0, 0, False

    def rows() -> pa.RecordBatch:
        got = [(base - 1, walk.head)] * bool(walk.head) + [(at, walk.held)] * bool(walk.held)
        return pa.RecordBatch.from_pydict({ROW: pa.array([r[0] for r in got], pa.int64()), SPLIT: pa.array([now] * len(got), pa.int32()), "text": pa.array([dialect.newline.join(r[1]) for r in got], pa.string())})

    for (split, first, inside, begin), batch in _runs(batches, "split", "first", "inside", "base"):
        if split is None:
            raise SourceError(RECUT)
        if split != now:
            if walk is not None:
                yield rows()
            now, walk, at, base, header = split, _Walk(dialect, first, inside), begin, begin, first
        for _ in walk.records(batch):
            at, header = at + (not header), False
    if walk is not None:
        yield rows()


def _joined(batches, names: list[str], dialect: Dialect) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(batch.column(ROW).to_pylist(), (t.removesuffix("\r") for t in batch.column("text").to_pylist())))
        if rows:
            yield _table(rows, names, dialect)


def read_records(spark: SparkSession, path: str | list[str], names: list[str], dialect: Dialect) -> DataFrame:
    """(row_index, c0, c1, …, __rejected): the records below the headers of one or more files, all fields as
    text, the usual marks for null as nulls.

    row_index is a record's place, from 0, in all files in the order of their paths, rejected records included, blank lines
    not. A rejected record has more fields than there are names, or can't be read; its text is in __rejected. Short records
    are filled with nulls. The rows to skip, counted in lines, and the header must be in each file's first split. All files
    have the same header, else tasks fail with a SourceError, as does reading at once where a quote is never closed."""
    lines = lines_of(spark, path, dialect)
    found = lines.mapInArrow(lambda b: _summaries(b, dialect), "file string, start long, n0 long, open0 boolean, n1 long, open1 boolean, short boolean").collect()  # a row a split
    places = _placed(found)
    shape = f"{ROW} long, {', '.join(f'c{k} string' for k in range(len(names)))}, {REJECTED} string"
    table = F.broadcast(spark.createDataFrame(places, "file string, start long, split int, inside boolean, base long, crosses boolean"))  # a row a split
    columns = ["split", (F.col("start") == 0).alias("first"), "inside", "base", "value"]
    out = lines.join(table, ["file", "start"], "left").select(*columns).mapInArrow(lambda b: _records(b, names, dialect), shape)
    if any(p[5] for p in places):
        # The pass reads all files: Spark cuts files by the bytes of all that it reads, so with a filter of files it would cut them otherwise.
        again = lines_of(spark, path, dialect).join(table, ["file", "start"], "left").filter("split IS NULL OR crosses")
        pieces = again.select(*columns).mapInArrow(lambda b: _pieces(b, dialect), f"{ROW} long, {SPLIT} int, text string")
        whole = pieces.groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct(SPLIT, "text"))).alias("p")).select(ROW, F.array_join("p.text", dialect.newline).alias("text"))
        out = out.unionByName(whole.mapInArrow(lambda b: _joined(b, names, dialect), shape))
    return out
