"""Detections that look at more than one row: frequent small transactions, and the flags that some shipped rules test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.coerce import day, num, shown
from .findings import shaped


def find_column(df: DataFrame, part: str) -> str | None:
    """The first column whose name contains the part."""
    return next((c for c in df.columns if part in c.lower()), None)


def frequent_small(df: DataFrame, vendor: str | None = None, date: str | None = None, amount: str | None = None, limit: float = 1e8, least: int = 5, session_id: str = "session", row_index: str = "row_index") -> DataFrame:
    """R018: all rows of vendor-days with more than `least` rows, all below `limit`. Rows with a null among the three are left out.

    Groups are counted before the shuffle and rows joined back to the few groups found, so a hot vendor is never one task."""
    vendor, date, amount = vendor or find_column(df, "vendor"), date or find_column(df, "date"), amount or find_column(df, "amount")
    if not (vendor and date and amount):
        return shaped(df.limit(0).select(F.lit(0).cast("long").alias("row_index")))
    rows = df.select(F.col(f"`{row_index}`").cast("long").alias("row_index"), F.col(f"`{vendor}`").alias("vendor"), day(df, date).alias("day"), num(df, amount).alias("amount"), shown(df, amount).alias("actual_value")).dropna(subset=["vendor", "day", "amount"])
    groups = rows.groupBy("vendor", "day").agg(F.count(F.lit(1)).alias("n"), F.max("amount").alias("most")).filter((F.col("n") > least) & (F.col("most") < limit)).select("vendor", "day")
    hits = rows.join(groups, ["vendor", "day"], "left_semi")
    values = {"layer": F.lit(3), "finding_type": F.lit("anomaly"), "rule_id": F.lit("R018"), "rule_name": F.lit("Frequent small transactions"), "column_name": F.lit(amount), "expected_value": F.lit(f"at most {least} a day below {limit:g}"), "severity": F.lit("high"), "confidence": F.lit(1.0), "reasoning": F.lit("many transactions of one vendor on one day stay below the approval limit"), "detection_method": F.lit("rule"), "session_id": F.lit(session_id)}
    return shaped(hits.withColumns(values).withColumn("finding_id", F.sha2(F.concat_ws("|", F.lit(session_id), F.lit("R018"), F.col("row_index").cast("string"), F.lit(amount)), 256)))


def numbered(df: DataFrame, column: str) -> tuple[Column, Column]:
    """(what stands before the digits at the end, those digits as a whole number) of a column of numbers or of ids such as
    TXN001; null without digits."""
    text = F.regexp_replace(shown(df, column), r"\.0$", "")
    return F.regexp_extract(text, r"^(.*?)[0-9]*$", 1), F.when(text.rlike(r"[0-9]$"), F.regexp_extract(text, r"([0-9]{1,38})$", 1)).try_cast("decimal(38,0)")


def in_sequence(df: DataFrame, order: str, value: str, partition: list[str] | None = None, row_index: str = "row_index") -> DataFrame:
    """(row_index) of R004: rows of which any row that is numbered one less, in their partition, has the same value.

    A neighbour is found by a join on the number and the value, so no order and no large group is needed; only these and
    row_index move. Numbers are compared exactly, by the digits at the end and what stands before them."""
    before, number = numbered(df, order)
    rows = df.select(F.col(row_index), *[F.col(c).alias(f"__p{k}") for k, c in enumerate(partition or [])], before.alias("__before"), number.alias("__number"), F.col(f"`{value}`").alias("__value")).filter("__number IS NOT NULL AND __value IS NOT NULL")
    keys = [c for c in rows.columns if c != row_index]
    previous = rows.withColumn("__number", (F.col("__number") + 1).cast("decimal(38,0)")).select(*keys).distinct()
    return rows.join(previous, keys, "left_semi").select(row_index)


def sequence_flag(df: DataFrame, order: str, value: str, partition: list[str] | None = None, flag: str = "sequence_flag") -> DataFrame:
    """R004: whether any row that is numbered one less has the same value."""
    found = in_sequence(df.withColumn("__row", F.col(order)), order, value, partition, "__row").withColumnRenamed("__row", order).distinct().withColumn(flag, F.lit(True))
    return df.join(found, order, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def repeated_flag(df: DataFrame, keys: list[str], flag: str = "invoice_duplicate_flag") -> DataFrame:
    """R008: whether the keys occur in more than one row."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*keys, F.lit(True).alias(flag))
    return df.join(counts, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def mismatch_flag(df: DataFrame, dimension: DataFrame, key: str | Column, differs: Column, flag: str = "currency_mismatch_flag") -> DataFrame:
    """R011: whether `differs` holds between a row and its row in a dimension; false where the dimension has none."""
    return df.join(dimension, key, "left").withColumn(flag, F.coalesce(differs, F.lit(False)))


def imbalance(df: DataFrame, key: str, debit: Column, credit: Column, tolerance: float = 0.0) -> DataFrame:
    """R013: (key, debit, credit) of journals whose sides do not add up to the same."""
    sums = df.groupBy(key).agg(F.sum(debit).alias("debit"), F.sum(credit).alias("credit"))
    return sums.filter(F.abs(F.coalesce("debit", F.lit(0)) - F.coalesce("credit", F.lit(0))) > tolerance)


#: The columns that flags are derived from, by role; a configuration may name others.
FLAG_COLUMNS = {
    "number": "txn_no", "amount": "amount", "invoice": "invoice_no", "vendor": "vendor_id", "currency": "currency", "account_currency": "account_currency", "journal": "journal_id",
    "debit": "debit", "credit": "credit", "price": "unit_price", "standard_price": "std_price", "entered": "entry_date", "date": "transaction_date",
}


GROUPED_FLAGS = ("sequence_flag", "invoice_duplicate_flag", "imbalance_flag")


def grouped_flags(df: DataFrame, of: dict[str, str], wanted: set[str], tolerance: float, row_index: str) -> DataFrame | None:
    """(row_index, flags that are wanted) of the rows for which any of the flags that look at other rows is true: each is found
    on its own columns and row_index, so the whole table moves for none of them."""
    has = lambda flag, *roles: flag in wanted and flag not in df.columns and all(of[r] in df.columns for r in roles)
    c = lambda role: F.col(f"`{of[role]}`")
    parts = []
    if has("sequence_flag", "number", "amount"):
        parts.append(in_sequence(df.withColumn("__amount", num(df, of["amount"])), of["number"], "__amount", row_index=row_index).withColumn("__flag", F.lit("sequence_flag")))
    if has("invoice_duplicate_flag", "invoice"):
        keys = [of["invoice"], *([of["vendor"]] if of["vendor"] in df.columns else [])]
        groups = df.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
        rows = df.select(row_index, *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)])
        parts.append(rows.join(groups, [f"__k{i}" for i in range(len(keys))], "left_semi").select(row_index, F.lit("invoice_duplicate_flag").alias("__flag")))
    if has("imbalance_flag", "journal", "debit", "credit"):
        rows = df.select(row_index, c("journal").alias("__j"), num(df, of["debit"]).alias("__d"), num(df, of["credit"]).alias("__c"))
        wrong = imbalance(rows, "__j", F.col("__d"), F.col("__c"), tolerance).select("__j")
        parts.append(rows.join(wrong, "__j", "left_semi").select(row_index, F.lit("imbalance_flag").alias("__flag")))
    if not parts:
        return None
    flags = [f for f in GROUPED_FLAGS if f in wanted and f not in df.columns]
    return reduce(DataFrame.unionAll, parts).groupBy(row_index).agg(*[F.bool_or(F.col("__flag") == f).alias(f) for f in flags])


def with_flags(df: DataFrame, columns: dict[str, str] | None = None, tolerance: float = 0.005, row_index: str = "row_index", wanted: set[str] | None = None) -> DataFrame:
    """df with the flags that the shipped rules R004, R008, R011, R013, R017 and R019 test, or of these the wanted ones, as far as
    df has their columns.

    A flag that df has already stays. Row flags are expressions; those that look at other rows come from one narrow table of
    row numbers, joined once. A null in a column that a flag needs gives false."""
    of = FLAG_COLUMNS | (columns or {})
    wanted = wanted if wanted is not None else {*GROUPED_FLAGS, "currency_mismatch_flag", "price_deviation_flag", "backdated_flag"}
    has = lambda flag, *roles: flag in wanted and flag not in df.columns and all(of[r] in df.columns for r in roles)
    row = {}
    if has("currency_mismatch_flag", "currency", "account_currency"):
        row["currency_mismatch_flag"] = F.upper(F.trim(of["currency"])) != F.upper(F.trim(of["account_currency"]))
    if has("price_deviation_flag", "price", "standard_price"):
        row["price_deviation_flag"] = price_deviation(num(df, of["price"]), num(df, of["standard_price"]))
    if has("backdated_flag", "entered", "date"):
        row["backdated_flag"] = backdated(day(df, of["entered"]), day(df, of["date"]))
    out = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in row.items()})
    found = grouped_flags(df, of, wanted, tolerance, row_index)
    if found is not None:
        flags = [c for c in found.columns if c != row_index]
        out = out.join(found, row_index, "left").withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
        missing = {"sequence_flag": ("number", "amount"), "invoice_duplicate_flag": ("invoice",), "imbalance_flag": ("journal", "debit", "credit")}
        out = out.drop(*[f for f in flags if not all(of[r] in df.columns for r in missing[f])])
    return out


def price_deviation(price: Column, standard: Column, share: float = 0.2) -> Column:
    """R017: whether a price is further than so large a share from the standard price."""
    return F.abs(price - standard) > share * standard


def backdated(entry: Column, transaction: Column, days: int = 30) -> Column:
    """R019: whether the entry was made more than so many days after the transaction."""
    return F.datediff(entry, transaction) > days


def previous_flag(df: DataFrame, order: str, value: str, partition: list[str], flag: str = "sequence_flag") -> DataFrame:
    """R004 where numbers have gaps or repeat: the row before in the order of a partition, which must not be a hot one."""
    w = Window.partitionBy(*partition).orderBy(order)
    return df.withColumn(flag, F.coalesce((F.lag(order).over(w) == F.col(order) - 1) & (F.lag(value).over(w) == F.col(value)), F.lit(False)))
