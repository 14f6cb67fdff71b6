"""What the corpus operators share: durable intermediate tables, size-checked joins, word shingles."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

#: Bytes, as measured, of a join side that may be broadcast.
BROADCAST_BYTES = 8 << 20
#: The white space of every contract here, as a regular expression; bytes.split() splits at the same bytes.
SPACE = r"[\x20\x09-\x0D]"
#: Rows in an Arrow batch, and in a batch that a parquet scan reads, at most.
BATCH_ROWS = 2000
READ_ROWS = 512
#: Bytes of text that a Python worker holds as one slice.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local session, as in tests, gets a temporary folder where none is set; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="corpus-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors cost no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bytes_of(df: DataFrame) -> int:
    """About the bytes of all rows of df: eight for each value, and the lengths of strings, binaries and arrays."""
    size = F.lit(8 * len(df.columns))
    for field in df.schema:
        kind = field.dataType
        if isinstance(kind, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(kind, ArrayType):
            width = len(kind.elementType) if isinstance(kind.elementType, StructType) else 1
            size = size + 8 * width * F.greatest(F.size(field.name), F.lit(0))
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, a durable table, marked to be broadcast if it has been measured at up to limit bytes (BROADCAST_BYTES)."""
    return F.broadcast(df) if bytes_of(df) <= (BROADCAST_BYTES if limit is None else limit) else df


def join_sized(left: DataFrame, right: DataFrame, on: str | list[str], how: str, limit: int | None = None) -> DataFrame:
    """left join right, which is broadcast only up to limit bytes; beyond, a shuffled join whose hot keys adaptive execution splits."""
    return left.join(sized(right, limit), on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What small_batches sets.
BATCH_SETTINGS = {"spark.sql.parquet.columnarReaderBatchSize": READ_ROWS, "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": SLICE_BYTES}
_BEFORE: dict[str, dict[str, str | None]] = {}


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers at most BATCH_ROWS rows, and about SLICE_BYTES bytes, at once, and reads
    READ_ROWS rows of parquet at once: texts may be long, and batches are held by the executor and by its workers.

    Spark looks at these settings when a result is computed, after the operator has returned it, so they stay until
    restore_batches(), which is for when the results have been written."""
    _BEFORE.setdefault(spark.sparkContext.applicationId, {k: spark.conf.get(k, None) for k in BATCH_SETTINGS})
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)


def restore_batches(spark: SparkSession) -> None:
    """Give the session the batch settings back that it had before the first operator."""
    for key, value in _BEFORE.pop(spark.sparkContext.applicationId, {}).items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def by_slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice's text is at most about so many bytes."""
    for batch in batches:
        size = batch.column(batch.schema.get_field_index(text)).nbytes
        step = max(1, batch.num_rows * most // max(size, 1)) if size > most else max(1, batch.num_rows)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


class Remembered(dict):
    """What a function gives for keys, remembered up to a bound; when that is reached, the older half goes."""

    def __init__(self, of: Callable, most: int):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            for old in list(islice(self, self.most // 2)):
                del self[old]
        got = self[key] = self.of(key)
        return got


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = WordHashes()
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def words_of(text: str | None) -> list[bytes]:
    """The text's words: A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split() if text else []


def shingles_of(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the whole text; of the whole sequence if it has fewer words."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    width = min(width, n)
    got = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        got = (got ^ hashed[j : n - width + 1 + j]) * _STEP
        got ^= got >> _SHIFT
    return np.unique(got)
