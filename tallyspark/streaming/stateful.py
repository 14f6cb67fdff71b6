"""Stateful streaming twins of R004 (same value under consecutive numbers) and R008 (repeated invoices).

Rows may come in any order: a row is flagged when its partner arrives, before or after it. State is per pair of keys, so no
account or vendor is one task's, and a timer drops it when the watermark is `keep` past a key's last row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DataType, LongType, StructField, StructType

from ..operators.grouped import in_sequence, numbered

FOUND = "row_index long"


def _record(**fields: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


class _Timed(StatefulProcessor):
    """Keeps a key's state until event time is `keep_ms` past the last of its rows."""

    keep_ms: int

    def _touch(self, last_ms: int) -> None:
        if not self.latest.exists() or self.latest.get()[0] < last_ms:
            if self.latest.exists():
                self.handle.deleteTimer(self.latest.get()[0] + self.keep_ms)
            self.latest.update((last_ms,))
            self.handle.registerTimer(last_ms + self.keep_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", _record(ms=LongType()))
        self.open(handle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists() and self.latest.get()[0] + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.latest.clear()
            self.drop()
        return iter(())

    def close(self) -> None:
        pass


class _Consecutive(_Timed):
    """Rows of one number and value: those that have the number are flagged once one that is numbered one less has come."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def open(self, handle) -> None:
        self.waiting = handle.getListState("waiting", _record(row_index=LongType()))
        self.preceded = handle.getValueState("preceded", _record(yes=BooleanType()))

    def drop(self) -> None:
        self.waiting.clear()
        self.preceded.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own, before, last = [], False, 0
        for pdf in rows:
            own += pdf.loc[~pdf["earlier"], "row_index"].tolist()
            before = before or bool(pdf["earlier"].any())
            last = max(last, int(pdf["ms"].max()))
        self._touch(last)
        if before and not self.preceded.exists():
            self.preceded.update((True,))
            own += [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
            self.waiting.clear()
        if self.preceded.exists():
            yield pd.DataFrame({"row_index": pd.Series(own, dtype="int64")})
        else:
            for i in own:
                self.waiting.appendValue((i,))


class _Repeated(_Timed):
    """Rows of one invoice: the first waits for a second, then all are flagged."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def open(self, handle) -> None:
        self.first = handle.getValueState("first", _record(row_index=LongType(), told=BooleanType()))

    def drop(self) -> None:
        self.first.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own, last = [], 0
        for pdf in rows:
            own += pdf["row_index"].tolist()
            last = max(last, int(pdf["ms"].max()))
        self._touch(last)
        known = self.first.get() if self.first.exists() else None
        if known is None and len(own) == 1:
            self.first.update((own[0], False))
            return
        out = own if known is None or known[1] else [known[0], *own]
        self.first.update((known[0] if known else own[0], True))
        yield pd.DataFrame({"row_index": pd.Series(out, dtype="int64")})


def _ms(keep: str) -> int:
    return round(pd.Timedelta(keep).total_seconds() * 1000)


def _streamed(rows: DataFrame, keys: list[str], processor: _Timed, late: str, rule: str) -> DataFrame:
    watched = rows.withWatermark("__t", late)
    found = watched.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=FOUND, outputMode="Append", timeMode="EventTime")
    return found.select("row_index", F.lit(rule).alias("rule_id"))


def sequence_stream(events: DataFrame, time: str, order: str, value: str, partition: list[str] | None = None, late: str = "1 hour", keep: str = "1 day", row_index: str = "row_index") -> DataFrame:
    """(row_index, rule_id) of R004: rows of which a row numbered one less, in their partition, has the same value.

    On a batch as in_sequence; on a stream a row is flagged once, when the later of the two has come, if they come within
    `keep` of each other in event time and neither is later than the watermark. Needs the RocksDB state store."""
    if not events.isStreaming:
        return in_sequence(events, order, value, partition, row_index).select(F.col(row_index).cast("long").alias("row_index"), F.lit("R004").alias("rule_id"))
    before, number = numbered(events, order)
    keys = ["__before", "__number", "__value", *[f"__p{k}" for k in range(len(partition or []))]]
    t = F.col(time).cast("timestamp")
    rows = events.select(F.col(row_index).cast("long").alias("row_index"), before.alias("__before"), number.alias("__number"), F.col(value).cast("string").alias("__value"), *[F.col(c).cast("string").alias(f"__p{k}") for k, c in enumerate(partition or [])], t.alias("__t"), F.unix_millis(t).alias("ms"))
    rows = rows.filter("__number IS NOT NULL AND __value IS NOT NULL AND __t IS NOT NULL")
    both = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("earlier"))  # a row comes as itself, and as the one before the next number
    both = both.withColumn("__number", (F.col("__number") + F.col("earlier").cast("int")).cast("string"))
    return _streamed(both.select("row_index", "ms", "earlier", "__t", *keys), keys, _Consecutive(_ms(keep)), late, "R004")


def repeated_stream(events: DataFrame, time: str, keys: list[str], late: str = "1 hour", keep: str = "1 day", row_index: str = "row_index") -> DataFrame:
    """(row_index, rule_id) of R008: rows whose keys, none null, occur in more than one row; on a stream, in rows that come within
    `keep` of each other in event time. Needs the RocksDB state store."""
    own = [f"__k{i}" for i in range(len(keys))]
    rows = events.select(F.col(row_index).cast("long").alias("row_index"), *[F.col(k).cast("string").alias(n) for k, n in zip(keys, own)], F.col(time).cast("timestamp").alias("__t")).dropna(subset=own)
    if not events.isStreaming:
        groups = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
        return rows.join(groups, own, "left_semi").select("row_index", F.lit("R008").alias("rule_id"))
    rows = rows.filter("__t IS NOT NULL").withColumn("ms", F.unix_millis("__t"))
    return _streamed(rows.select("row_index", "ms", "__t", *own), own, _Repeated(_ms(keep)), late, "R008")
