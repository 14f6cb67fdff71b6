"""Reversible line deduplication: sharded cuckoo filters in front of exact reference-count tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, by_slices, durable, join_sized, small_batches, table

SLOTS = 4
STRIP = " \t\n\r\x0b\x0c"
#: Keys that a shard's filters are meant to hold at most; the number of shards follows from the first batch.
SHARD_KEYS = 250_000


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, in a chain of tables that grows when the last one is full.

    Each key must be added once and removed only if it was added; then contains() never misses a key."""

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @staticmethod
    def load(data: bytes | None) -> CuckooFilter:
        tables, at = [], 0
        while data and at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            tables.append(np.frombuffer(data, np.uint16, n * SLOTS, at + 8).reshape(n, SLOTS).copy())
            at += 8 + n * SLOTS * 2
        return CuckooFilter(tables)

    def dump(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @staticmethod
    def _places(h1: np.ndarray, h2: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (h2.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = ((h1.view(np.uint64) >> np.uint64(17)) & np.uint64(buckets - 1)).astype(np.int64)
        return mark, first, first ^ CuckooFilter._hop(mark, buckets)

    @staticmethod
    def _hop(mark, buckets: int):
        return (np.asarray(mark).astype(np.int64) * 0x5BD1E995 >> 5) & (buckets - 1)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        for t in self.tables:
            mark, a, b = self._places(h1, h2, len(t))
            found |= (t[a] == mark[:, None]).any(axis=1) | (t[b] == mark[:, None]).any(axis=1)
        return found

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        pending = np.arange(len(h1))
        if self.tables and len(pending):
            pending = self._fill(self.tables[-1], h1, h2, pending)
        while len(pending):
            buckets = 1 << max(4, int(np.ceil(np.log2(len(pending) / SLOTS / 0.6 + 1))))
            self.tables.append(np.zeros((buckets, SLOTS), np.uint16))
            pending = self._fill(self.tables[-1], h1, h2, pending)

    def _fill(self, t: np.ndarray, h1: np.ndarray, h2: np.ndarray, pending: np.ndarray) -> np.ndarray:
        """Add the pending keys to one table; returns those that did not fit."""
        mark, a, b = self._places(h1, h2, len(t))
        while len(pending):
            free_a, free_b = t[a[pending]] == 0, t[b[pending]] == 0
            roomy = free_a.sum(axis=1) >= free_b.sum(axis=1)
            bucket, free = np.where(roomy, a[pending], b[pending]), np.where(roomy[:, None], free_a, free_b)
            can = np.flatnonzero(free.any(axis=1))
            if not len(can):
                break
            _, one = np.unique(bucket[can], return_index=True)
            can = can[one]
            t[bucket[can], free[can].argmax(axis=1)] = mark[pending[can]]
            pending = np.delete(pending, can)
        left = []
        for k in pending:
            if not self._kick(t, int(mark[k]), int(a[k])):
                left.append(k)
        return np.array(left, np.int64)

    def _kick(self, t: np.ndarray, mark: int, bucket: int, most: int = 200) -> bool:
        moves = []
        for step in range(most):
            free = np.flatnonzero(t[bucket] == 0)
            if len(free):
                t[bucket, free[0]] = mark
                return True
            slot = step % SLOTS
            moves.append((bucket, slot, int(t[bucket, slot])))
            mark, t[bucket, slot] = int(t[bucket, slot]), mark
            bucket ^= int(self._hop(mark, len(t)))
        for at, slot, old in reversed(moves):
            t[at, slot] = old
        return False

    def remove(self, h1: np.ndarray, h2: np.ndarray) -> None:
        places = [self._places(h1, h2, len(t)) for t in self.tables]
        for k in range(len(h1)):
            for t, (mark, a, b) in reversed(list(zip(self.tables, places))):
                for bucket in (a[k], b[k]):
                    slot = np.flatnonzero(t[bucket] == mark[k])
                    if len(slot):
                        t[bucket, slot[0]] = 0
                        break
                else:
                    continue
                break


def keyed(text: str | None, least: int) -> list[bytes | None]:
    """A key for each line of the text: stripped of ASCII white space, A-Z lower-cased; None if it is too short."""
    return [s.encode().lower() if len(s := line.strip(STRIP)) >= least else None for line in (text or "").split("\n")]


def _signed(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - ((h >> 127) << 64), (h & (2**64 - 1)) - (((h >> 63) & 1) << 64)


def _lines(batches, least: int) -> Iterator[pa.RecordBatch]:
    for batch in by_slices(batches, "text"):
        h1, h2, ids = [], [], []
        for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            for key in set(keyed(text, least)) - {None}:
                a, b = _signed(key)
                h1.append(a), h2.append(b), ids.append(id_)
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64())], ["h1", "h2", "id"])


def _rebuilt(batches, least: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, drop: first halves of the key hashes to drop) -> row and what stays of each text."""
    for batch in by_slices(batches, "text"):
        n_lines, n_dropped, kept = [], [], []
        for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist()):
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            if drop:
                drop = set(drop)
                lines = [line for line, key in zip(lines, keyed(text, least)) if key is None or _signed(key)[0] not in drop]
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append("\n".join(lines))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["row", "n_lines", "n_dropped", "kept"])


@dataclass(frozen=True)
class LineIndex:
    """An immutable state of the index; insert() and delete() return the next one.

    postings (h1, h2, id): a row for each line key (two halves of its hash) and document.
    refs (h1, h2, n, first): in how many documents the key is, and the smallest of their ids; exact.
    filters (shard, data): the cuckoo filters of the keys in refs. A key that they deny is new and needs no lookup in refs.

    A row with a null id is not indexed and loses no line. A key counts once per document, also if rows repeat an id."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    least: int = 10

    @staticmethod
    def lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
        rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        return rows.mapInArrow(lambda b: _lines(b, least), "h1 long, h2 long, id long")

    @staticmethod
    def counted(postings: DataFrame) -> DataFrame:
        return postings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))

    def _sharded(self, keys: DataFrame, work, schema: str) -> DataFrame:
        shard = F.pmod("h1", F.lit(self.shards)).cast("int").alias("shard")
        return keys.select("h1", "h2", shard).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(work, schema)

    def _filters(self, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
        grow = add is not None

        def work(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            shard = int((keys if len(keys) else held)["shard"].iloc[0])
            f = CuckooFilter.load(held["data"].iloc[0] if len(held) else None)
            (f.add if grow else f.remove)(keys["h1"].to_numpy(np.int64), keys["h2"].to_numpy(np.int64))
            return pd.DataFrame({"shard": [shard], "data": [f.dump()]})

        return durable(self._sharded(add if add is not None else remove, work, "shard int, data binary"))

    def _denied(self, keys: DataFrame) -> DataFrame:
        """(h1, h2) of the keys that the filters deny."""

        def work(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            h1, h2 = keys["h1"].to_numpy(np.int64), keys["h2"].to_numpy(np.int64)
            new = ~CuckooFilter.load(held["data"].iloc[0] if len(held) else None).contains(h1, h2)
            return pd.DataFrame({"h1": h1[new], "h2": h2[new]})

        return self._sharded(keys, work, "h1 long, h2 long")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with the documents of docs, none of whose ids it holds yet."""
        lines = durable(self.lines(docs, id_col, text_col, self.least).distinct())
        batch = durable(self.counted(lines))
        denied = durable(self._denied(batch))
        fresh = batch.join(denied, ["h1", "h2"], "left_semi")
        maybe = durable(batch.join(denied, ["h1", "h2"], "left_anti").join(self.refs.toDF("h1", "h2", "n0", "first0"), ["h1", "h2"], "left"))
        seen = maybe.filter("n0 is not null")
        fresh = durable(fresh.union(maybe.filter("n0 is null").select("h1", "h2", "n", "first")))
        merged = seen.select("h1", "h2", (F.col("n") + F.col("n0")).alias("n"), F.least("first", "first0").alias("first"))
        refs = durable(self.refs.join(seen, ["h1", "h2"], "left_anti").union(merged).union(fresh))
        return replace(self, postings=self.postings.union(lines), refs=refs, filters=self._filters(add=fresh))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index without the documents whose ids are given; lines that they alone shared count as unique again."""
        ids = ids.select(F.col(id_col).cast("long").alias("id")).distinct()
        gone = durable(self.postings.join(ids, "id", "left_semi").select("h1", "h2", "id"))
        postings = durable(self.postings.join(ids, "id", "left_anti").select("h1", "h2", "id"))
        touched = gone.select("h1", "h2").distinct()
        left = durable(self.counted(postings.join(touched, ["h1", "h2"], "left_semi")))
        refs = durable(self.refs.join(touched, ["h1", "h2"], "left_anti").union(left))
        return replace(self, postings=postings, refs=refs, filters=self._filters(remove=touched.join(left, ["h1", "h2"], "left_anti")))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
        """(row: the other columns of docs, n_lines, n_dropped, kept): lines whose key is in several indexed documents go, but for the first's.

        docs must be indexed. The drop lists are broadcast up to `limit` bytes; beyond, texts are shuffled by id once."""
        shared = durable(self.refs.filter("n > 1").select("h1", "h2", "first"))
        drops = join_sized(self.postings, shared, ["h1", "h2"], "inner", limit).filter("id <> first")
        drops = durable(drops.groupBy("id").agg(F.collect_list("h1").alias("drop")))
        least = self.least
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
        rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        rows = join_sized(rows, drops, "id", "left", limit).select("row", "text", "drop")
        return rows.mapInArrow(lambda b: _rebuilt(b, least), f"row {rows.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")


def empty_index(spark, expected_lines: int = 0, least: int = 10) -> LineIndex:
    """An index of no documents; expected_lines sets the number of shards."""
    nothing = lambda schema: spark.createDataFrame([], schema)
    return LineIndex(nothing("h1 long, h2 long, id long"), nothing("h1 long, h2 long, n long, first long"), nothing("shard int, data binary"), max(8, -(-expected_lines // SHARD_KEYS)), least)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, increments: int = 2, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Index all documents, in so many increments, then drop repeated lines: (row, n_lines, n_dropped, kept), row being the
    columns of docs other than the text.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least `least` code points
    that are in several documents lose their lines in all but the smallest id. Null and empty texts are one empty line.
    Rows that repeat an id count as one document. Other columns are ignored; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    lines = docs.agg(F.sum(F.size(F.split(F.col(text_col), "\n", -1)))).first()[0] or 0
    index = empty_index(docs.sparkSession, lines, least)
    for k in range(increments):
        index = index.insert(docs.filter(F.pmod(F.xxhash64(id_col), F.lit(increments)) == k), id_col, text_col)
    return index.apply(docs, id_col, text_col, limit)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every row of documents, with what line deduplication leaves of it."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT k.doc_id, k.i, k.line, s.key IS NOT NULL AND k.doc_id <> s.first AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
