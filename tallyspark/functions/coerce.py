"""Column expressions that coerce and normalise text: all built-in functions but for Unicode composition."""

from __future__ import annotations

import keyword
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Texts that a CSV reader takes for null, and the date formats in the order in which they are tried.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
DATE_FORMATS = ("d/M/yyyy", "yyyy-M-d", "d-M-yyyy", "M/d/yyyy", "yyyyMMdd")
REDACTED = "[REDACTED]"
#: The currencies, how many values tell a column's locale, and how few do not.
CODES = ("USD", "VND")
LOCALE_SAMPLE, LOCALE_LEAST = 20, 5
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def num(df: DataFrame, column: str) -> Column:
    """The column as a double; null where it is not a number. NaN is null, so comparisons with it are never true."""
    kind, c = type_of(df, column), F.col(f"`{column}`")
    if isinstance(kind, NUMERIC):
        x = c.cast("double")
    elif isinstance(kind, T.BooleanType):
        x = c.cast("int").cast("double")
    elif isinstance(kind, T.StringType):
        x = F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(x), x)


def shown(df: DataFrame, column: str) -> Column:
    """The column as the text that a rule's pattern or a finding shows: 5000000.0, True, 2024-01-31."""
    kind, c = type_of(df, column), F.col(f"`{column}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(c.try_cast("decimal(38,10)").cast("string"), r"(\.[0-9]*?[1-9]|\.0)0*$", "$1")
        return F.when((F.abs(c) >= 1e16) | (c != 0) & (F.abs(c) < 1e-4) | F.isnan(c), c.cast("string")).otherwise(plain)
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def day(df: DataFrame, column: str) -> Column:
    """The column as a date: date and timestamp types, or text in ISO order with or without a time. Numbers give null."""
    kind, c = type_of(df, column), F.col(f"`{column}`")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    if isinstance(kind, T.StringType):
        return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-M-d")).cast("date"), F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[ T]"), F.substring(c, 1, 10).try_cast("date")))
    return F.lit(None).cast("date")


def number(text: Column, locale: str | Column = "en") -> Column:
    """A number written in the locale: parentheses negate, other marks go. vi: 1.000,5; en: 1,000.5."""
    trimmed = F.trim(text)
    inner = F.when(trimmed.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(trimmed, r"^\((.*)\)$", "$1"))).otherwise(trimmed)
    bare = F.regexp_replace(inner, r"[^0-9,.\-]", "")
    vi = F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")
    en = F.regexp_replace(bare, ",", "")
    return (F.when(F.lit(locale) == "vi", vi) if isinstance(locale, str) else F.when(locale == "vi", vi)).otherwise(en).try_cast("double")


def date(text: Column) -> Column:
    """A date in the first of DATE_FORMATS that reads the whole text; compact dates need eight digits and a year from 1900 to 2100."""
    t = F.trim(text)
    slashes = r"^\d{1,2}/\d{1,2}/\d{4}$"
    shapes = (slashes, r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$", slashes, r"^(19\d\d|20\d\d|2100)\d{4}$")
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(f)).cast("date")) for f, shape in zip(DATE_FORMATS, shapes)])


def locale_vote(text: Column) -> Column:
    """'vi', 'en' or null: what the separators of one number say of its locale."""
    t = F.trim(text)
    dots, commas = F.instr(t, ".") > 0, F.instr(t, ",") > 0
    last = F.regexp_extract(t, r"([.,])[^.,]*$", 1)
    tail = F.length(F.regexp_extract(t, r"[.,]([0-9]*)[^0-9.,]*$", 1))
    threes = t.rlike(r"^[^0-9]*[0-9]{1,3}([.,][0-9]{3})+[^0-9.,]*$")
    return (
        F.when(dots & commas, F.when(last == ",", "vi").otherwise("en"))
        .when(commas, F.when(tail == 2, "vi").when(threes, "en"))
        .when(dots, F.when(tail == 2, "en").when(threes, "vi"))
    )


def detect_locale(df: DataFrame, column: str, order: str, sample: int = LOCALE_SAMPLE, least: int = LOCALE_LEAST) -> DataFrame:
    """One row (locale): the vote of the column's first `sample` non-blank values by `order`; en below `least` values and in ties."""
    c = F.col(f"`{column}`").cast("string")
    first = df.filter(F.trim(c) != "").orderBy(order).limit(sample).select(locale_vote(c).alias("v"))
    vi, en = F.count_if(F.col("v") == "vi"), F.count_if(F.col("v") == "en")
    return first.agg(F.when((F.count(F.lit(1)) >= least) & (vi > en), "vi").otherwise("en").alias("locale"))


def currency_code(text: Column) -> Column:
    upper = F.upper(text)
    return F.when(upper.contains("USD") | text.contains("$"), "USD").when(upper.contains("VND") | text.contains("₫"), "VND")


def currency_amount(text: Column) -> Column:
    """The amount beside a currency mark, in the locale that its own separators tell (en if they tell none)."""
    bare = F.trim(F.regexp_replace(text, r"(?i)VND|USD|₫|\$", ""))
    return number(bare, F.coalesce(locale_vote(bare), F.lit("en")))


def boolean(text: Column) -> Column:
    """true, yes and 1 are true; any other text is false; null stays null."""
    return F.lower(F.trim(text)).isin("true", "yes", "1")


@arrow_udf(T.StringType())
def _composed(text: pa.Array) -> pa.Array:
    return pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in pc.utf8_trim_whitespace(text).to_pylist()], pa.string())


def composed(text: Column | str) -> Column:
    """Text stripped and in Unicode's composed form; Spark has no built-in for the latter (and Arrow's own
    does not compose), so texts that are not ASCII, and no others, go to Python in Arrow batches."""
    c = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(c, r"^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(_composed(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)))


def snake_column(text: Column) -> Column:
    """ASCII text in snake case, as a column."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def snake_case(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text.strip()).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def headers(names: list[str]) -> list[str]:
    """Column names in snake case: empty ones are `column`, Python's keywords get a trailing _, repeats get _1, _2, …"""
    out, seen = [], set()
    for name in names:
        base = snake_case(name) or "column"
        base = f"{base}_" if keyword.iskeyword(base) else base
        got, k = base, 0
        while got in seen:
            k += 1
            got = f"{base}_{k}"
        seen.add(got)
        out.append(got)
    return out


def redact(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the text of the listed columns, where they exist, replaced."""
    return df.withColumns({c: F.lit(REDACTED) for c in columns if c in df.columns})
