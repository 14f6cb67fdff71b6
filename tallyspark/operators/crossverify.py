"""Cross-verification of findings against a second dataset, joined by keys of both."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import day, num, shown

#: The bits of a bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768
#: Bits of a filter for each key, and bitmaps in one at most: 8 MB.
BITS_PER_KEY, MOST_BITMAPS = 16, 2048
PROBES = 3


@dataclass(frozen=True)
class CrossFile:
    """A second file, its keys by the audited table's names for them, and what contradicts a finding: (left, operator, right)
    with a column of the audited table and one of the file."""

    file: str = ""
    keys: dict[str, str] = field(default_factory=dict)
    contradicts: list[tuple[str, str, str]] = field(default_factory=list)


def _positions(keys: list[str], bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), *[F.col(f"`{c}`") for c in keys]), F.lit(bits)) for k in range(PROBES)])


def key_filter(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """(a bloom filter of the rows' keys as (bucket, bitmap), its bits). It is at most 8 MB, so it may be broadcast."""
    n = rows.agg(F.approx_count_distinct(F.struct(*keys))).first()[0] or 0
    bits = BITMAP_BITS * max(1, min(MOST_BITMAPS, -(-n * BITS_PER_KEY // BITMAP_BITS)))
    at = rows.select(F.explode(_positions(keys, bits)).alias("at"))
    maps = at.groupBy((F.col("at") / BITMAP_BITS).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP_BITS).alias("bitmap"))
    return maps, bits


def reduced(other: DataFrame, keys: list[str], maps: DataFrame, bits: int) -> DataFrame:
    """The rows of other whose keys a filter may hold: all that it does hold, and few others."""
    own = other.columns
    out = other.withColumn("__at", _positions(keys, bits))
    for k in range(PROBES):
        at = F.col("__at")[k]
        out = out.withColumn("bucket", (at / BITMAP_BITS).cast("int")).join(F.broadcast(maps), "bucket")
        byte = F.conv(F.hex(F.substring("bitmap", (at % BITMAP_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out = out.filter(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(__at[{k}] % 8 as int))")) != 0).drop("bucket", "bitmap")
    return out.select(*[F.col(f"`{c}`") for c in own])


def cross_verify(findings: DataFrame, other: DataFrame | None, key: str | list[str] = "row_index", contradicts: Column | None = None) -> DataFrame:
    """findings with cross_verified and cross_verify_status: CONFIRMED where a matching row contradicts the record, UNCONFIRMED
    where all agree, UNVERIFIABLE where there is none; `pending` without a second dataset.

    contradicts is over columns of both sides, which other than the keys have different names. Equal findings each keep their row;
    a null key matches nothing. The other side is reduced by a bloom filter of the findings' keys before it is shuffled; only
    the findings' ids, keys and what contradicts reads go through the join."""
    if other is None:
        return findings.withColumns({"cross_verified": F.lit(False), "cross_verify_status": F.lit("pending")})
    keys = [key] if isinstance(key, str) else key
    kept = [c for c in findings.columns if c not in ("cross_verified", "cross_verify_status")]
    identity = F.col("finding_id") if "finding_id" in kept else F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept]), {"ignoreNullFields": "false"}), 256)
    tagged = findings.select(identity.alias("__id"), *[F.col(f"`{c}`") for c in kept])
    some = reduced(other, keys, *key_filter(tagged.select(*keys), keys))
    wrong = F.coalesce(contradicts, F.lit(False)) if contradicts is not None else F.lit(False)
    seen = tagged.join(some, keys).select("__id", wrong.alias("__wrong")).groupBy("__id").agg(F.bool_or("__wrong").alias("__wrong"))
    status = F.when(F.col("__wrong").isNull(), "UNVERIFIABLE").when(F.col("__wrong"), "CONFIRMED").otherwise("UNCONFIRMED")
    return tagged.join(seen, "__id", "left").select(*[F.col(f"`{c}`") for c in kept], (status == "CONFIRMED").alias("cross_verified"), status.alias("cross_verify_status"))


def _compared(left: DataFrame, a: str, op: str, right: DataFrame, b: str) -> tuple[Column, Column, Column]:
    """(left value, right value, whether they stand in the relation) as numbers, days or text: what both columns are."""
    from .integrity import OPERATORS

    for read in (num, day, shown):
        x, y = read(left, a), read(right, b)
        if read is shown or all(d.filter(v.isNotNull()).limit(1).count() for d, v in ((left, x), (right, y))):
            return x, y, OPERATORS[op](F.col(f"__l_{a}"), F.col(f"__r_{b}"))
    raise AssertionError


def verify_by_file(findings: DataFrame, table: DataFrame, other: DataFrame, cross: CrossFile, row_index: str = "row_index") -> DataFrame:
    """cross_verify of findings on rows of table with a second file's rows, by the keys and contradictions that cross names.

    Keys are compared as text. The rows of table that have findings give the keys; a contradiction compares numbers where both
    columns have any, else days, else text."""
    missing = [c for c in (*cross.keys, *(x[0] for x in cross.contradicts)) if c not in table.columns] + [c for c in (*cross.keys.values(), *(x[2] for x in cross.contradicts)) if c not in other.columns]
    if missing:
        raise ValueError(f"cross-verification: no columns {', '.join(missing)}")
    left = {f"__k{k}": shown(table, c) for k, c in enumerate(cross.keys)}
    right = {f"__k{k}": shown(other, c) for k, c in enumerate(cross.keys.values())}
    relations = []
    for a, op, b in cross.contradicts:
        x, y, holds = _compared(table, a, op, other, b)
        left[f"__l_{a}"], right[f"__r_{b}"] = x, y
        relations.append(holds)
    rows = table.select(F.col(row_index).alias("row_index"), *[c.alias(n) for n, c in left.items()])
    known = findings.join(rows, "row_index", "left")
    got = cross_verify(known, other.select(*[c.alias(n) for n, c in right.items()]), [f"__k{k}" for k in range(len(cross.keys))], reduce(or_, relations) if relations else None)
    return got.drop(*left)
