"""Queries over whole runs' parts: shipped rules, sources, surveys, digests, second files; with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coerce
from .operators import digest, grouped, integrity, profile
from .operators.crossverify import CrossFile, verify_by_file
from .operators.rules import RuleEngine, Settings, build, default_rules
from .sources.files import shared_folder
from .sources.readers import open_csv, open_parquet
from .streaming import stateful


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A ledger made of orders and customers, as expressions that Spark and DuckDB read alike.
LEDGER = {
    "row_index": "o_orderkey", "txn_no": "concat('TXN', CAST(o_orderkey AS STRING))", "amount": "CAST(floor(o_totalprice / 1000) * 1000000 AS DOUBLE)", "transaction_date": "CAST(o_orderdate AS DATE)",
    "transaction_time": "concat(lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':15')", "approval_special": "CASE WHEN o_orderkey % 3 = 0 THEN 'S' END", "approver": "CASE WHEN o_custkey % 5 <> 0 THEN 'ann' END", "vendor_id": "concat('V', CAST(o_custkey % 400 AS STRING))",
    "document_ref": "CASE WHEN o_orderkey % 7 <> 0 THEN 'D' END", "revenue": "o_totalprice - 20000", "discount_rate": "(o_orderkey % 50) / 100.0", "interco_flag": "o_orderkey % 11 = 0", "matching_id": "CASE WHEN o_orderkey % 2 = 0 THEN 'M' END",
    "invoice_no": "concat('I', CAST(o_orderkey % 9973 AS STRING))", "currency": "CASE WHEN o_orderstatus = 'P' THEN 'USD' ELSE 'VND' END", "account_currency": "'VND'", "journal_id": "o_custkey", "debit": "CAST(o_orderkey % 2 AS DOUBLE)", "credit": "CAST((o_orderkey + 1) % 2 AS DOUBLE)",
    "unit_price": "o_totalprice", "std_price": "250000.0", "entry_date": "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 40 AS INT))",
}
VENDORS = [f"V{k}" for k in range(0, 400) if k % 10]
HOLIDAYS = [f"{y}-{d}" for y in range(1995, 2003) for d in ("01-01", "05-01", "12-25")]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in LEDGER.items()])


def shipped_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all rules of the default pack but R018 find in the ledger, flags derived, in one scan and one join of narrow rows."""
    engine = RuleEngine([r for r in default_rules() if r.id != "R018"], Settings(12, 31, {"__CONFIG_APPROVED_VENDORS__": VENDORS, "__CONFIG_PUBLIC_HOLIDAYS__": HOLIDAYS}))
    return engine.evaluate(grouped.with_flags(ledger(spark, sf_dir))).select("row_index", "rule_id", "severity")


def _ledger_sql() -> str:
    return "SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {n}" for n, e in LEDGER.items()).replace("date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 40 AS INT))", "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT)") + " FROM orders"


_FOUND = {
    "R001": ("high", "amount > 500000000"), "R002": ("high", "isodow(transaction_date) >= 6 AND approval_special IS NULL"), "R003": ("medium", "amount > 0 AND amount % 1000000 = 0"),
    "R004": ("medium", "amount = (SELECT p.amount FROM l p WHERE p.row_index = l.row_index - 1)"), "R005": ("medium", "row_index % 24 >= 22 OR row_index % 24 < 6"), "R006": ("medium", "month(transaction_date) = 12 AND day(transaction_date) = 31"),
    "R007": ("high", "row_index IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)"), "R008": ("high", "(invoice_no, vendor_id) IN (SELECT (invoice_no, vendor_id) FROM l GROUP BY ALL HAVING count(*) > 1)"), "R009": ("high", "amount BETWEEN 450000000 AND 500000000"),
    "R010": ("high", "amount > 100000000 AND approver IS NULL"), "R011": ("medium", "currency <> account_currency"), "R012": ("high", "revenue < 0"), "R013": ("high", "journal_id IN (SELECT journal_id FROM l GROUP BY journal_id HAVING abs(sum(debit) - sum(credit)) > 0.005)"),
    "R014": ("medium", "interco_flag AND matching_id IS NULL"), "R015": ("low", "strftime(transaction_date, '%m-%d') IN ('01-01', '05-01', '12-25')"), "R016": ("medium", "discount_rate > 0.30"), "R017": ("medium", "abs(unit_price - std_price) > 0.2 * std_price"),
    "R019": ("medium", "entry_date - transaction_date > 30"), "R020": ("medium", "amount > 10000000 AND document_ref IS NULL"),
}
SHIPPED_SQL = f"WITH l AS MATERIALIZED ({_ledger_sql()}) " + " UNION ALL ".join(f"SELECT row_index, '{r}' AS rule_id, '{s}' AS severity FROM l WHERE {p}" for r, (s, p) in _FOUND.items())


def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents written as CSV files, line ends and quotes within texts, and read back in parallel."""
    place = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(place)
    return open_csv(spark, place).table.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


CSV_SQL = f"SELECT doc_id, source, sha256(CASE WHEN text IN ({', '.join(repr(t) for t in coerce.NA_TOKENS)}) THEN '' ELSE coalesce(text, '') END) AS digest FROM documents"


def parquet_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each of the nations in its file."""
    got = open_parquet(spark, f"{sf_dir}/nation.parquet", index="place").table
    return got.select("place", "n_nationkey")


def surveyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the columns of orders as text, all from one aggregation and one look at the first rows."""
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS row_index", "CAST(o_orderkey AS STRING) AS number", "date_format(o_orderdate, 'dd/MM/yyyy') AS day", "concat(CASE WHEN o_orderkey % 2 = 0 THEN 'USD ' ELSE 'VND ' END, CAST(o_custkey AS STRING)) AS money",
        "CASE WHEN o_orderkey > 3000 THEN o_orderpriority END AS late", "o_orderstatus AS status", "CAST(NULL AS STRING) AS nothing",
    )
    facts = profile.survey(df, approximate=False).values()
    return spark.createDataFrame([(f.name, f.dtype, f.row_count, f.null_count, f.unique_count, ",".join(f.codes), "|".join(f.samples)) for f in facts], "column_name string, dtype string, row_count long, null_count long, unique_count long, codes string, samples string")


def _survey_sql() -> str:
    columns = {
        "number": "o_orderkey::VARCHAR", "day": "strftime(o_orderdate, '%d/%m/%Y')", "money": "(CASE WHEN o_orderkey % 2 = 0 THEN 'USD ' ELSE 'VND ' END) || o_custkey::VARCHAR", "late": "CASE WHEN o_orderkey > 3000 THEN o_orderpriority END", "status": "o_orderstatus", "nothing": "NULL::VARCHAR",
    }
    shapes = {"date": "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "numeric": "^[0-9]+$", "currency": "^(USD|VND) [0-9]+$"}
    votes = ", ".join(f"count(*) FILTER (WHERE regexp_matches(x, '{s}')) AS {t}" for t, s in shapes.items())
    parts = []
    for n, e in columns.items():
        parts.append(f"""
SELECT '{n}' AS column_name, (SELECT CASE WHEN greatest(date, numeric, currency) = 0 THEN 'text' WHEN greatest(date, numeric, currency) < 0.8 * n THEN 'mixed' WHEN date = greatest(date, numeric, currency) THEN 'date' WHEN numeric = greatest(date, numeric, currency) THEN 'numeric' ELSE 'currency' END
  FROM (SELECT count(*) AS n, {votes} FROM (SELECT x FROM v_{n} WHERE x IS NOT NULL ORDER BY pos LIMIT 100))) AS dtype,
  count(*) AS row_count, count(*) - count(x) AS null_count, count(DISTINCT x) AS unique_count, coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT substr(x, 1, 3) AS c FROM v_{n} WHERE regexp_matches(x, '^(USD|VND) '))), '') AS codes,
  coalesce((SELECT string_agg(x, '|' ORDER BY pos) FROM (SELECT x, min(pos) AS pos FROM (SELECT x, pos FROM v_{n} WHERE x IS NOT NULL ORDER BY pos LIMIT 100) GROUP BY x ORDER BY pos LIMIT 3)), '') AS samples FROM v_{n}""")
    return "WITH " + ", ".join(f"v_{n} AS (SELECT o_orderkey AS pos, {e} AS x FROM orders)" for n, e in columns.items()) + " UNION ALL ".join(parts)


def digest_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a version of orders with other prices and missing rows differs from orders, by hash trees over order numbers."""
    now = table(spark, sf_dir, "orders").withColumn("row_index", F.col("o_orderkey"))
    then = now.filter("o_orderkey % 7001 <> 1").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5003 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return digest.differing_ranges(digest.hash_tree(now), digest.hash_tree(then))


RANGES_SQL = """
SELECT leaf * 1024 AS first_row, leaf * 1024 + 1023 AS last_row, n AS rows_a, n - gone AS rows_b
FROM (SELECT o_orderkey // 1024 AS leaf, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7001 = 1) AS gone, count(*) FILTER (WHERE o_orderkey % 5003 = 0 AND o_orderkey % 7001 <> 1) AS other FROM orders GROUP BY 1) WHERE gone + other > 0
"""


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on dear orders, verified by customer number against a list of customers: the status must be the list's, and the
    price not above its limit."""
    orders = table(spark, sf_dir, "orders").withColumn("row_index", F.col("o_orderkey"))
    found = RuleEngine([build({"id": "R001", "name": "Price", "field": "o_totalprice", "condition": "gt", "threshold": 200000, "severity": "high"})]).evaluate(orders)
    listed = table(spark, sf_dir, "customer").filter("c_acctbal > 0").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN 'F' ELSE 'O' END AS status", "c_acctbal * 100 AS most")
    cross = CrossFile("customer", {"o_custkey": "c_custkey"}, [("o_orderstatus", "!=", "status"), ("o_totalprice", ">", "most")])
    return verify_by_file(found, orders, listed, cross).select("row_index", "cross_verify_status", "cross_verified")


CROSSED_SQL = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'F' ELSE 'O' END AS status, c_acctbal * 100 AS most FROM customer WHERE c_acctbal > 0)
SELECT o_orderkey AS row_index, CASE WHEN c_custkey IS NULL THEN 'UNVERIFIABLE' WHEN o_orderstatus <> status OR o_totalprice > most THEN 'CONFIRMED' ELSE 'UNCONFIRMED' END AS cross_verify_status,
       c_custkey IS NOT NULL AND (o_orderstatus <> status OR o_totalprice > most) AS cross_verified
FROM orders LEFT JOIN c ON c_custkey = o_custkey WHERE o_totalprice > 200000
"""


def text_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R004 on ids such as TXN17: customers whose predecessor, by the digits, has the same segment."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_index"), F.concat(F.lit("TXN"), F.col("c_custkey").cast("string")).alias("no"), "c_mktsegment")
    return grouped.in_sequence(rows, "no", "c_mktsegment")


def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IC-002 over rows with nulls: customers without their keys, balances rounded."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS row_index", "CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey END AS nation", "round(c_acctbal / 1000) AS balance")
    return integrity.run_checks(rows, only=["IC-002"]).select("row_index")


def queries() -> dict:
    orders = lambda s, d: table(s, d, "orders").withColumn("row_index", F.col("o_orderkey"))
    return {
        "rules_shipped_pack": (shipped_rules, SHIPPED_SQL),
        "csv_records": (csv_records, CSV_SQL),
        "parquet_places": (parquet_places, "SELECT (row_number() OVER ()) - 1 AS place, n_nationkey FROM nation"),
        "survey": (surveyed, _survey_sql()),
        "digest_ranges": (digest_ranges, RANGES_SQL),
        "cross_verify_file": (crossed, CROSSED_SQL),
        "r004_text_ids": (text_sequence, "SELECT a.c_custkey AS row_index FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey - 1 AND a.c_mktsegment = b.c_mktsegment"),
        "ic002_with_nulls": (repeated_rows, "WITH r AS (SELECT c_custkey, CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey END AS n, round(c_acctbal / 1000) AS b FROM customer) SELECT c_custkey AS row_index FROM (SELECT c_custkey, count(*) OVER (PARTITION BY n, b) AS k FROM r) WHERE k > 1"),
        "stream_repeated": (lambda s, d: stateful.repeated_stream(orders(s, d), "o_orderdate", ["o_custkey", "o_orderdate"]), "SELECT o_orderkey AS row_index, 'R008' AS rule_id FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM orders) WHERE n > 1"),
        "stream_sequence": (lambda s, d: stateful.sequence_stream(orders(s, d), "o_orderdate", "o_orderkey", "o_orderstatus"), "SELECT a.o_orderkey AS row_index, 'R004' AS rule_id FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey - 1 AND a.o_orderstatus = b.o_orderstatus"),
    }
