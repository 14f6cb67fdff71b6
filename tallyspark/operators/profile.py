"""Cleaning, type inference and column profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from ..functions import coerce
from .digest import hash_table

TYPES = ("date", "numeric", "currency", "boolean")
#: How many values inference reads, and the share that decides.
SAMPLE, DECISIVE = 100, 0.8


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """df with the 0-based position of each row in its source's order: partitions are counted, then rows numbered within."""
    numbered = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    counts = numbered.groupBy(part.alias("__p")).count().orderBy("__p").collect()  # a row per partition
    offsets, at = {}, 0
    for p, n in counts:
        offsets[p], at = at, at + n
    table = df.sparkSession.createDataFrame(list(offsets.items()), "__p long, __at long")
    rows = numbered.withColumn("__p", part).join(F.broadcast(table), "__p")
    return rows.withColumn(name, F.col("__at") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__p", "__at")


def prune_empty(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """df without rows, then without columns, that are all null; columns in keep don't count and stay."""
    own = [c for c in df.columns if c not in keep]
    rows = df.na.drop("all", subset=own)
    counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in own]).first().asDict()
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c in keep or counts[c]])


def _votes(text) -> dict:
    """Whether a text reads as each type, as a whole: identifiers such as TXN001 are not numbers."""
    t = F.trim(text)
    figures = t.rlike(r"^[(+-]?\s*[0-9][0-9.,]*\)?$") & coerce.number(t).isNotNull()
    amount = coerce.currency_code(t).isNotNull() & t.rlike(r"(?i)^((VND|USD|₫|\$)\s*[-(]?[0-9][0-9.,]*\)?|[-(]?[0-9][0-9.,]*\)?\s*(VND|USD|₫|\$))$")
    return {"date": coerce.date(t).isNotNull(), "numeric": figures | t.rlike(coerce.NUMBER), "currency": amount, "boolean": F.lower(t).isin("true", "false", "yes", "no", "1", "0")}


@dataclass(frozen=True)
class ColumnFacts:
    """What is known of a column; codes: the currencies that its text names."""

    name: str
    dtype: str
    locale: str
    row_count: int
    null_count: int
    unique_count: int
    samples: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()

    @property
    def null_ratio(self) -> float:
        return self.null_count / max(1, self.row_count)


def first_values(df: DataFrame, columns: list[str], below, row_index: str = "row_index", few: list[str] | None = None, n: int = SAMPLE) -> DataFrame:
    """(k, values): for the k-th of the columns its first n non-null values, as text, among rows whose row_index is less than
    `below`, or that have a value in one of the columns named in few."""
    here = F.col(row_index) < below
    for c in few or []:
        here = here | F.col(f"`{c}`").isNotNull()
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for k, c in enumerate(columns)])
    rows = df.filter(here).select(F.col(row_index).alias("at"), F.explode(cells).alias("x")).select("at", "x.k", "x.v").filter("v IS NOT NULL")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("at"))).filter(F.col("place") <= n)  # each task keeps n of a column
    return rows.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("values"))


def votes_of(values: DataFrame) -> DataFrame:
    """(k, n, dtype, locale, samples) of first_values: the type that most values read as, if four fifths do (ties go to the first
    in TYPES), mixed if fewer do, text if none does; the locale of the first 20 that are not blank; the first 3 different ones."""
    each = values.select("k", F.explode("values").alias("v"))
    said, blank = _votes(F.col("v")), F.trim("v") == ""
    counts = each.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~blank & F.coalesce(said[t], F.lit(False))).alias(t) for t in TYPES])
    most = F.greatest(*TYPES)
    best = F.coalesce(*[F.when(F.col(t) == most, t) for t in TYPES])
    counts = counts.select("k", "n", F.when(most == 0, "text").when(most >= DECISIVE * F.col("n"), best).otherwise("mixed").alias("dtype"))
    filled = F.slice(F.filter("values", lambda v: F.trim(v) != ""), 1, coerce.LOCALE_SAMPLE)
    votes = F.transform(filled, coerce.locale_vote)
    count = lambda which: F.size(F.filter(votes, lambda v: v == which))
    locale = F.when((F.size(filled) >= coerce.LOCALE_LEAST) & (count("vi") > count("en")), "vi").otherwise("en")
    return counts.join(values.select("k", locale.alias("locale"), F.slice(F.array_distinct("values"), 1, 3).alias("samples")), "k")


def survey(df: DataFrame, row_index: str = "row_index", hints: dict[str, str] | None = None, approximate: bool = True) -> dict[str, ColumnFacts]:
    """Facts of all columns but row_index, from two jobs whatever the number of columns: one aggregation over all rows, and one
    over the few first rows that inference reads (again, over more of them, where columns begin with many nulls)."""
    columns, hints = [c for c in df.columns if c != row_index], hints or {}
    if not columns:
        return {}
    unique = F.approx_count_distinct if approximate else F.count_distinct
    aggs = [F.count(F.lit(1)).alias("rows"), F.min(row_index).alias("first"), F.max(row_index).alias("last")]
    for k, c in enumerate(columns):
        x = F.col(f"`{c}`")
        nested = isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType))
        aggs += [F.count(x).alias(f"n{k}"), unique(x.cast("string") if nested else x).alias(f"u{k}")]
        if isinstance(df.schema[c].dataType, StringType):
            aggs += [F.bool_or(coerce.currency_code(x) == code).alias(f"{code}{k}") for code in coerce.CODES]
    facts = df.agg(*aggs).first().asDict()
    few = [c for k, c in enumerate(columns) if 0 < facts[f"n{k}"] <= SAMPLE]
    width, found = 100 * SAMPLE, {}
    while facts["rows"]:
        found = {r["k"]: r for r in votes_of(first_values(df, columns, facts["first"] + width, row_index, few)).collect()}  # a row a column
        if facts["first"] + width > facts["last"] or all(k in found and found[k]["n"] >= min(SAMPLE, facts[f"n{k}"]) for k in range(len(columns)) if facts[f"n{k}"]):
            break
        width *= 100
    out = {}
    for k, c in enumerate(columns):
        r = found.get(k)
        codes = tuple(code for code in sorted(coerce.CODES) if facts.get(f"{code}{k}"))
        out[c] = ColumnFacts(c, hints.get(c) or (r["dtype"] if r else "text"), r["locale"] if r else "en", facts["rows"], facts["rows"] - facts[f"n{k}"], facts[f"u{k}"], tuple(r["samples"]) if r else (), codes)
    return out


def infer_schema(df: DataFrame, row_index: str = "row_index", hints: dict[str, str] | None = None) -> dict[str, str]:
    """A type for each column: date, numeric, currency, boolean, text or mixed, from its first 100 non-null values by row_index."""
    return {c: f.dtype for c, f in survey(df, row_index, hints).items()}


def normalise(df: DataFrame, types: dict[str, str], row_index: str = "row_index", locales: dict[str, str] | None = None) -> DataFrame:
    """df with each column in its type: dates, doubles (in the column's own locale), booleans, or composed text."""
    if locales is None:
        locales = {c: f.locale for c, f in survey(df, row_index, types).items()} if "numeric" in types.values() else {}
    out = {}
    for c, t in types.items():
        text = F.col(f"`{c}`").cast("string")
        if t == "date":
            out[c] = coerce.date(text)
        elif t == "numeric":
            out[c] = F.coalesce(F.when(text.rlike(r"[eE]") & text.rlike(coerce.NUMBER), text.try_cast("double")), coerce.number(text, locales.get(c, "en")))
        elif t == "currency":
            out[c] = coerce.currency_amount(text)
            out[f"{c}__ccy"] = coerce.currency_code(text)
        elif t == "boolean":
            out[c] = coerce.boolean(text)
        else:
            out[c] = coerce.composed(text)
    return df.withColumns(out)


def multi_currency(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, codes): the columns whose text has more than one currency, by one aggregation over all of them."""
    named = [F.bool_or(coerce.currency_code(F.col(f"`{c}`").cast("string")) == code).alias(f"{code}{k}") for k, c in enumerate(columns) for code in coerce.CODES]
    codes = lambda k: F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{code}{k}"), code) for code in sorted(coerce.CODES)])), ",")
    rows = df.agg(*named).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), codes(k).alias("codes")) for k, c in enumerate(columns)])))
    return rows.filter(F.col("codes").contains(","))


def profile(df: DataFrame, row_index: str = "row_index", approximate: bool = False) -> DataFrame:
    """A row per column: column_name, row_count, null_count, null_ratio, unique_count (approximate if asked for).

    One aggregation over all columns, whose single row is then unpivoted; samples() has a column's first values."""
    columns = [c for c in df.columns if c != row_index]
    unique = F.approx_count_distinct if approximate else F.count_distinct
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[x for k, c in enumerate(columns) for x in (F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{k}"), unique(F.col(f"`{c}`")).alias(f"unique_{k}"))])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("row_count"), F.col(f"null_{k}").alias("null_count"), (F.col(f"null_{k}") / F.greatest("n", F.lit(1))).alias("null_ratio"), F.col(f"unique_{k}").alias("unique_count")) for k, c in enumerate(columns)]))
    return counts.select("n", *[x for k in range(len(columns)) for x in (f"null_{k}", f"unique_{k}")]).select(rows)


def samples(df: DataFrame, column: str, row_index: str = "row_index", n: int = 3) -> list[str]:
    """The first n different values of a column, as text, in the order of row_index."""
    c = F.col(f"`{column}`")
    first = df.filter(c.isNotNull()).groupBy(c.cast("string").alias("v")).agg(F.min(row_index).alias("at")).orderBy("at").limit(n)
    return [r["v"] for r in first.collect()]


content_digest = hash_table
