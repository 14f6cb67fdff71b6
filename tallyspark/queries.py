"""The library's operators as queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_runs
from .functions import coerce
from .operators import digest, grouped, integrity, profile
from .operators.crossverify import cross_verify
from .operators.findings import check_scores, integrity_score, rollup, severity_counts, summary, top, union_distinct
from .operators.integrity import ColumnRules, CrossCheck, IntegrityConfig
from .operators.rules import RuleEngine, Settings, build
from .plans import report, review
from .plans.store import TABLES, latest_sessions, llm_stats
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
#: A key for each table's rows; lineitem has none, so its is made of three columns.
KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(spark: SparkSession, sf_dir: str, name: str, **columns: str) -> DataFrame:
    """A table with its key as row_index, and columns replaced by SQL expressions."""
    df = table(spark, sf_dir, name).withColumn("row_index", F.expr(KEYS[name]).cast("long"))
    return df.withColumns({c: F.expr(e) for c, e in columns.items()})


#: name: (table, replaced columns, rule, SQL predicate over the table's columns after replacement)
RULES: dict[str, tuple[str, dict, dict, str]] = {
    "rule_gt": ("orders", {}, {"field": "o_totalprice", "condition": "gt", "threshold": 450000}, "o_totalprice > 450000"),
    "rule_gte": ("lineitem", {}, {"field": "l_quantity", "condition": "gte", "threshold": 50}, "l_quantity >= 50"),
    "rule_lt": ("customer", {}, {"field": "c_acctbal", "condition": "lt", "threshold": 0}, "c_acctbal < 0"),
    "rule_lte": ("lineitem", {}, {"field": "l_discount", "condition": "lte", "threshold": 0}, "l_discount <= 0"),
    "rule_eq_num": ("part", {}, {"field": "p_size", "condition": "eq", "value": 15.0}, "p_size = 15"),
    "rule_eq_str": ("orders", {}, {"field": "o_orderstatus", "condition": "eq", "value": "P"}, "trim(o_orderstatus) = 'P'"),
    "rule_neq_num": ("part", {}, {"field": "p_size", "condition": "neq", "value": 15.0}, "p_size <> 15"),
    "rule_neq_str": ("part", {}, {"field": "p_type", "condition": "neq", "value": "ECONOMY"}, "p_type <> 'ECONOMY'"),
    "rule_in": ("orders", {}, {"field": "o_orderpriority", "condition": "in", "values": ["1-URGENT", "2-HIGH"]}, "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "rule_in_long_list": ("customer", {}, {"field": "c_custkey", "condition": "in", "values": list(range(0, 3000, 3))}, "c_custkey % 3 = 0 AND c_custkey < 3000"),
    "rule_not_in": ("customer", {}, {"field": "c_mktsegment", "condition": "not_in", "values": ["AUTOMOBILE", "MACHINERY"]}, "c_mktsegment NOT IN ('AUTOMOBILE', 'MACHINERY')"),
    "rule_is_null": ("lineitem", {"l_returnflag": "nullif(l_returnflag, 'R')"}, {"field": "l_returnflag", "condition": "is_null"}, "nullif(l_returnflag, 'R') IS NULL"),
    "rule_not_null": ("lineitem", {"l_returnflag": "nullif(l_returnflag, 'R')"}, {"field": "l_returnflag", "condition": "not_null"}, "nullif(l_returnflag, 'R') IS NOT NULL"),
    "rule_matches": ("part", {}, {"field": "p_brand", "condition": "matches", "pattern": "[13579]$"}, "regexp_matches(p_brand, '[13579]$')"),
    "rule_not_matches": ("orders", {"o_orderpriority": "nullif(o_orderpriority, '5-LOW')"}, {"field": "o_orderpriority", "condition": "not_matches", "pattern": "^[12]"}, "NOT regexp_matches(coalesce(nullif(o_orderpriority, '5-LOW'), ''), '^[12]')"),
    "rule_weekend": ("orders", {}, {"field": "o_orderdate", "condition": "weekend_transaction"}, "isodow(o_orderdate) >= 6"),
    "rule_month_end": ("orders", {}, {"field": "o_orderdate", "condition": "end_of_period", "value": "month"}, "last_day(o_orderdate) = o_orderdate::DATE"),
    "rule_quarter_end": ("orders", {}, {"field": "o_orderdate", "condition": "end_of_period", "value": "quarter"}, "last_day(o_orderdate) = o_orderdate::DATE AND month(o_orderdate) % 3 = 0"),
    "rule_year_end": ("orders", {}, {"field": "o_orderdate", "condition": "end_of_period", "value": "year"}, "month(o_orderdate) = 12 AND day(o_orderdate) = 31"),
    "rule_fiscal_end": ("orders", {}, {"field": "o_orderdate", "condition": "end_of_period", "value": "year"}, "month(o_orderdate) = 6 AND day(o_orderdate) = 30"),
    "rule_cross_gt": ("lineitem", {}, {"field": "l_tax", "condition": "cross_field_gt", "reference_field": "l_discount"}, "l_tax > l_discount"),
    "rule_cross_eq": ("lineitem", {}, {"field": "l_tax", "condition": "cross_field_eq", "reference_field": "l_discount"}, "l_tax = l_discount"),
    "rule_compound_and": ("orders", {"o_orderpriority": "nullif(o_orderpriority, '5-LOW')"}, {"condition": "compound", "logic": "AND", "conditions": [{"field": "o_orderdate", "condition": "weekend_transaction"}, {"field": "o_orderpriority", "condition": "is_null"}]}, "isodow(o_orderdate) >= 6 AND o_orderpriority = '5-LOW'"),
    "rule_compound_or": ("orders", {}, {"condition": "compound", "logic": "OR", "conditions": [{"field": "o_totalprice", "condition": "gt", "threshold": 495000}, {"field": "o_orderdate", "condition": "end_of_period", "value": "month"}]}, "o_totalprice > 495000 OR last_day(o_orderdate) = o_orderdate::DATE"),
    "rule_compound_nested": (
        "orders", {}, {"condition": "compound", "logic": "AND", "conditions": [{"field": "o_orderstatus", "condition": "eq", "value": "F"}, {"condition": "compound", "logic": "OR", "conditions": [{"field": "o_totalprice", "condition": "gt", "threshold": 490000}, {"condition": "compound", "logic": "AND", "conditions": [{"field": "o_orderpriority", "condition": "eq", "value": "1-URGENT"}, {"field": "o_totalprice", "condition": "lt", "threshold": 5000}]}]}]},
        "o_orderstatus = 'F' AND (o_totalprice > 490000 OR o_orderpriority = '1-URGENT' AND o_totalprice < 5000)",
    ),
    "rule_fields_any": ("lineitem", {}, {"fields": ["l_tax", "l_discount"], "condition": "gte", "threshold": 0.08}, "l_tax >= 0.08 OR l_discount >= 0.08"),
}


def _rule(name: str) -> Query:
    source, columns, body, _ = RULES[name]
    settings = Settings(6, 30) if name == "rule_fiscal_end" else Settings()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = RuleEngine([build({"id": "R001", "name": name, "severity": "high"} | body)], settings).evaluate(keyed(spark, sf_dir, source, **columns))
        return found.select("row_index", "rule_id", "severity")

    return query


def _rule_sql(name: str) -> str:
    source, _, _, predicate = RULES[name]
    return f"SELECT ({KEYS[source]})::BIGINT AS row_index, 'R001' AS rule_id, 'high' AS severity FROM {source} WHERE {predicate}"


THREE = [
    {"id": "R001", "name": "High price", "field": "o_totalprice", "condition": "gt", "threshold": 450000, "severity": "high"},
    {"id": "R002", "name": "Weekend", "field": "o_orderdate", "condition": "weekend_transaction", "severity": "medium"},
    {"id": "R003", "name": "Low price", "field": "o_totalprice", "condition": "lt", "threshold": 2000, "severity": "low"},
    {"id": "R004", "name": "Switched off", "field": "o_totalprice", "condition": "gt", "threshold": 0, "severity": "low", "active": False},
]
THREE_SQL = """
SELECT o_orderkey AS row_index, 'R001' AS rule_id, 'high' AS severity FROM orders WHERE o_totalprice > 450000
UNION ALL SELECT o_orderkey, 'R002', 'medium' FROM orders WHERE isodow(o_orderdate) >= 6
UNION ALL SELECT o_orderkey, 'R003', 'low' FROM orders WHERE o_totalprice < 2000
"""


def three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of three rules, made in one scan."""
    return RuleEngine([build(r) for r in THREE]).evaluate(keyed(spark, sf_dir, "orders"))


def unflagged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the customers and of a copy of each with a ruinous balance, which a rule flags, so that the copies go."""
    rows = keyed(spark, sf_dir, "customer")
    copies = rows.withColumns({"row_index": -F.col("row_index") - 1, "c_acctbal": F.lit(-1e6).cast(rows.schema["c_acctbal"].dataType)})
    every = rows.unionByName(copies)
    flagged = RuleEngine([build({"id": "R001", "name": "Ruinous balance", "severity": "high", "field": "c_acctbal", "condition": "lt", "threshold": -100000})]).evaluate(every)
    return review.batches(every, flagged, ["c_name"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(three(spark, sf_dir))


def _checks(source: str, config: IntegrityConfig, only: str, columns: dict | None = None, keep: list[str] | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = keyed(spark, sf_dir, source, **(columns or {}))
        df = df.select("row_index", *keep) if keep else df
        return integrity.run_checks(df, config, only=[only]).select("row_index", "rule_id", "column_name", "severity")

    return query


def _ic(source: str, ic: str, column: str | None, severity: str, predicate: str) -> str:
    return f"SELECT ({KEYS[source]})::BIGINT AS row_index, '{ic}' AS rule_id, {f"'{column}'" if column else 'NULL::VARCHAR'} AS column_name, '{severity}' AS severity FROM {source} WHERE {predicate}"


def score_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = IntegrityConfig({"c_acctbal": ColumnRules(max_value=9900), "c_mktsegment": ColumnRules(pattern="^[A-M]")})
    return integrity.run_checks(keyed(spark, sf_dir, "customer"), config, only=["IC-005", "IC-006", "IC-007"])


SCORE_SQL = """
SELECT 'IC-005' AS rule_id, 2 AS w FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT 'IC-006', 2 FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'IC-007', 1 FROM customer WHERE NOT regexp_matches(c_mktsegment, '^[A-M]')
"""


RECOMMENDED_SQL = f"""
WITH c AS (SELECT (SELECT count(*) FROM ({THREE_SQL}) WHERE severity = 'high') AS high, (SELECT count(*) FROM ({SCORE_SQL}) WHERE rule_id = 'IC-006') AS negative),
l AS (SELECT list_filter([CASE WHEN high > 3 THEN 'Escalate: there are more than three findings of high severity.' END, CASE WHEN negative > 0 THEN 'Verify the negative amounts against their documents.' END], lambda x: x IS NOT NULL) AS said FROM c)
SELECT (generate_subscripts(said, 1) - 1)::INTEGER AS position, unnest(said) AS recommendation FROM l
"""


def infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each column of orders, as text, from its first values."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_index"), F.col("o_orderkey").cast("string").alias("number"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.concat(F.lit("USD "), F.col("o_custkey").cast("string")).alias("money"), "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("answer"), F.when(F.col("o_orderkey") % 2 == 0, "7").otherwise("x7y").alias("mixture"), F.lit(None).cast("string").alias("nothing"), F.concat(F.lit("TXN"), F.col("o_orderkey").cast("string")).alias("identifier"))
    return spark.createDataFrame(list(profile.infer_schema(df).items()), "column_name string, dtype string")


INFER_SQL = "SELECT * FROM (VALUES ('number', 'numeric'), ('day', 'date'), ('money', 'currency'), ('o_orderpriority', 'text'), ('answer', 'boolean'), ('mixture', 'mixed'), ('nothing', 'text'), ('identifier', 'text')) t(column_name, dtype)"


def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on large line items, verified against the orders above a price; the status of both must agree."""
    line = keyed(spark, sf_dir, "lineitem", row_index="l_orderkey")
    found = RuleEngine([build({"id": "R001", "name": "Quantity", "field": "l_quantity", "condition": "gte", "threshold": 50, "severity": "high"})]).evaluate(line, snapshot=["l_linestatus"]).withColumn("line_status", F.get_json_object("row_data", "$.l_linestatus"))
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 50000").select(F.col("o_orderkey").alias("row_index"), "o_orderstatus")
    return cross_verify(found.select("row_index", "line_status"), orders, "row_index", F.col("line_status") != F.col("o_orderstatus")).distinct().groupBy("cross_verify_status").agg(F.count(F.lit(1)).alias("n"))


def validate_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of replies on batches of customers, of which some name rows outside of the batch, unknown severities or
    impossible confidences, or quote nothing of the row."""
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 50).alias("batch"), F.col("c_custkey").alias("row_index"), F.to_json(F.struct("c_name")).alias("row"), "c_name")
    k = F.col("row_index")
    said = F.struct(
        F.when(k % 11 == 0, k + 1_000_000).otherwise(k).alias("row_index"), F.when(k % 5 == 0, "grave").otherwise("HIGH").alias("severity"), F.when(k % 7 == 0, 1.5).otherwise(0.5).alias("confidence"),
        F.when(k % 3 == 0, "nothing quoted").otherwise(F.concat(F.lit("odd: "), F.lower("c_name"))).alias("reasoning"), F.lit("c_name").alias("column_name"),
    )
    replies = rows.groupBy("batch").agg(F.to_json(F.collect_list(said)).alias("reply")).withColumn("reply", F.when(F.col("batch") % 13 == 12, "no json").otherwise(F.col("reply")))
    return review.validated(replies, rows.drop("c_name")).select("row_index", "severity", "confidence")


VALIDATED_SQL = "SELECT c_custkey AS row_index, 'high' AS severity, 0.5::DOUBLE AS confidence FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AND (c_custkey // 50) % 13 <> 12"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer calls made of events, as the store keeps them."""
    return table(spark, sf_dir, "events").select(F.lit("s").alias("session_id"), F.col("event_type").alias("provider"), F.col("event_id").alias("prompt_tokens"), (F.col("event_id") % 7).alias("response_tokens"), (F.col("user_id") % 100).alias("latency_ms"), (F.col("event_id") % 3 == 0).alias("success"), F.lit("").alias("created_at"))


def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    got = grouped.mismatch_flag(table(spark, sf_dir, "orders"), customers, "o_custkey", (F.col("o_orderpriority") == "1-URGENT") & (F.col("c_mktsegment") != "MACHINERY"))
    return got.filter("currency_mismatch_flag").select("o_orderkey")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").filter(grouped.price_deviation(unit, F.col("p_retailprice"))).select(F.expr(KEYS["lineitem"]).alias("row_index"))


def late_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").filter(grouped.backdated(F.col("l_shipdate"), F.col("o_orderdate"))).select(F.expr(KEYS["lineitem"]).alias("row_index"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six flags that shipped rules test, derived from orders in the shape of a ledger."""
    ledger = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS txn_no", "floor(o_totalprice / 100000) AS amount", "o_custkey % 700 AS invoice_no", "o_orderstatus AS vendor_id", "substr(o_orderpriority, 1, 1) AS currency", "'1' AS account_currency", "o_custkey AS journal_id",
        "o_orderkey % 2 AS debit", "(o_orderkey + 1) % 2 AS credit", "o_totalprice AS unit_price", "200000.0 AS std_price", "o_orderdate AS transaction_date", "date_add(o_orderdate, CAST(o_orderkey % 60 AS INT)) AS entry_date",
    )
    names = ["sequence_flag", "invoice_duplicate_flag", "currency_mismatch_flag", "imbalance_flag", "price_deviation_flag", "backdated_flag"]
    return grouped.with_flags(ledger.withColumn("row_index", F.col("txn_no"))).select("txn_no", *names)


FLAGS_SQL = """
WITH l AS (SELECT *, floor(o_totalprice / 100000) AS amount, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS p, lag(floor(o_totalprice / 100000)) OVER (ORDER BY o_orderkey) AS q FROM orders)
SELECT o_orderkey AS txn_no, coalesce(p = o_orderkey - 1 AND q = amount, false) AS sequence_flag, count(*) OVER (PARTITION BY o_custkey % 700, o_orderstatus) > 1 AS invoice_duplicate_flag,
       substr(o_orderpriority, 1, 1) <> '1' AS currency_mismatch_flag, abs(sum(o_orderkey % 2) OVER (PARTITION BY o_custkey) - sum((o_orderkey + 1) % 2) OVER (PARTITION BY o_custkey)) > 0.005 AS imbalance_flag,
       abs(o_totalprice - 200000) > 40000 AS price_deviation_flag, o_orderkey % 60 > 30 AS backdated_flag
FROM l
"""


def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R014 as a relation: orders without a returned line."""
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return integrity.referenced(table(spark, sf_dir, "orders"), "o_orderkey", returned, there=False).select("o_orderkey")


def _orders_text(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in columns.items()])


def price(df_name: str = "o_totalprice"):
    return F.format_number(df_name, 2)


def _plain() -> dict[str, tuple[Query, str]]:
    t = table
    swap = lambda c: F.translate(c, ",.", ".,")
    return {
        "rules_fused": (lambda s, d: three(s, d).select("row_index", "rule_id", "severity"), THREE_SQL),
        "anomaly_summary": (flagship, f"SELECT rule_id, severity, count(*) AS n FROM ({THREE_SQL}) GROUP BY ALL"),
        "severity_counts": (lambda s, d: severity_counts(three(s, d)), f"SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, 0::BIGINT AS llm FROM ({THREE_SQL})"),
        "severity_rollup": (lambda s, d: rollup(three(s, d)), f"SELECT severity, rule_id, count(*) AS n FROM ({THREE_SQL}) GROUP BY ROLLUP (severity, rule_id)"),
        "topk_findings": (lambda s, d: top(three(s, d)).select("severity", "row_index", "rule_id"), f"SELECT severity, row_index, rule_id FROM ({THREE_SQL}) ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, row_index, rule_id LIMIT 50"),
        "findings_union_dedup": (lambda s, d: union_distinct(three(s, d), three(s, d).filter("severity = 'high'")).select("row_index", "rule_id"), f"SELECT DISTINCT row_index, rule_id FROM ({THREE_SQL})"),
        "recommendations": (lambda s, d: report.recommendations(three(s, d).unionByName(score_findings(s, d))), RECOMMENDED_SQL),
        "ic001_nulls": (_checks("orders", IntegrityConfig({"o_orderstatus": ColumnRules(required=True)}), "IC-001", {"o_orderstatus": "nullif(o_orderstatus, 'P')"}), _ic("orders", "IC-001", "o_orderstatus", "high", "o_orderstatus = 'P'")),
        "ic002_dup_rows": (_checks("documents", IntegrityConfig(), "IC-002", keep=["text"]), _ic("documents", "IC-002", None, "high", "text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")),
        "ic003_dup_keys": (_checks("lineitem", IntegrityConfig(primary_key=["l_orderkey", "l_linenumber"]), "IC-003"), _ic("lineitem", "IC-003", "l_orderkey, l_linenumber", "high", "(l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")),
        "ic004_date_range": (_checks("orders", IntegrityConfig({"o_orderdate": ColumnRules(min_date="1996-01-01", max_date="2001-01-01")}), "IC-004"), _ic("orders", "IC-004", "o_orderdate", "medium", "o_orderdate < '1996-01-01' OR o_orderdate::DATE > '2001-01-01'")),
        "ic005_num_range": (_checks("part", IntegrityConfig({"p_retailprice": ColumnRules(min_value=910, max_value=990)}), "IC-005"), _ic("part", "IC-005", "p_retailprice", "medium", "p_retailprice < 910 OR p_retailprice > 990")),
        "ic006_negative": (_checks("customer", IntegrityConfig({"c_acctbal": ColumnRules(dtype="numeric")}), "IC-006"), _ic("customer", "IC-006", "c_acctbal", "medium", "c_acctbal < 0")),
        "ic007_format": (_checks("part", IntegrityConfig({"p_brand": ColumnRules(pattern="[13579]$")}), "IC-007"), _ic("part", "IC-007", "p_brand", "low", "NOT regexp_matches(p_brand, '[13579]$')")),
        "ic008_ref_integrity": (_checks("supplier", IntegrityConfig({"s_nationkey": ColumnRules(reference_values=["1", "2"])}), "IC-008"), _ic("supplier", "IC-008", "s_nationkey", "high", "s_nationkey NOT IN (1, 2)")),
        "ic008_ref_table": (lambda s, d: integrity.reference_findings(keyed(s, d, "supplier"), "s_nationkey", t(s, d, "nation").filter("n_regionkey = 1").select("n_nationkey")).select("row_index", "rule_id"), "SELECT s_suppkey AS row_index, 'IC-008' AS rule_id FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
        "ic009_cross_col": (_checks("lineitem", IntegrityConfig(cross_checks=[CrossCheck("l_extendedprice", ">=", right_fields=["l_quantity", "l_factor"])]), "IC-009", {"l_factor": "100.0D"}), _ic("lineitem", "IC-009", "l_extendedprice", "medium", "NOT l_extendedprice >= l_quantity * 100")),
        "ic010_outlier": (_checks("events", IntegrityConfig(), "IC-010", keep=["value"]), _ic("events", "IC-010", "value", "low", "abs(value - (SELECT avg(value) FROM events)) > 3 * (SELECT stddev_samp(value) FROM events)")),
        "integrity_score": (lambda s, d: integrity_score(score_findings(s, d)), f"SELECT sum(w)::BIGINT AS score, CASE WHEN sum(w) = 0 THEN 'CLEAN' WHEN sum(w) <= 10 THEN 'MINOR' WHEN sum(w) <= 30 THEN 'MODERATE' ELSE 'SEVERE' END AS rating FROM ({SCORE_SQL})"),
        "integrity_check_scores": (lambda s, d: check_scores(score_findings(s, d)), f"SELECT rule_id, count(*) AS findings, sum(w)::BIGINT AS severity_score FROM ({SCORE_SQL}) GROUP BY rule_id"),
        "r018_freq_small": (lambda s, d: grouped.frequent_small(keyed(s, d, "events"), "user_id", "ts", "value", 200).select("row_index"), "SELECT event_id AS row_index FROM (SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE)) WHERE n > 5 AND m < 200"),
        "r004_sequence": (lambda s, d: grouped.sequence_flag(t(s, d, "events"), "event_id", "event_type").filter("sequence_flag").select("event_id"), "SELECT event_id FROM (SELECT event_id, event_type, lag(event_id) OVER (ORDER BY event_id) AS p, lag(event_type) OVER (ORDER BY event_id) AS q FROM events) WHERE p = event_id - 1 AND q = event_type"),
        "rules_derived_flags": (flags, FLAGS_SQL),
        "r008_dup_invoice": (lambda s, d: grouped.repeated_flag(t(s, d, "orders"), ["o_custkey", "o_orderdate"]).filter("invoice_duplicate_flag").select("o_orderkey"), "SELECT o_orderkey FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM orders) WHERE n > 1"),
        "r011_ccy_mismatch": (mismatches, "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND c_mktsegment <> 'MACHINERY'"),
        "r013_imbalance": (lambda s, d: grouped.imbalance(t(s, d, "lineitem"), "l_orderkey", F.when(F.col("l_linestatus") == "O", F.col("l_quantity")), F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).select("l_orderkey"), "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0) <> coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0)"),
        "r014_unmatched": (unmatched, "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
        "r017_price_dev": (prices, f"SELECT {KEYS['lineitem']} AS row_index FROM lineitem JOIN part ON p_partkey = l_partkey WHERE abs(l_extendedprice / l_quantity - p_retailprice) > 0.2 * p_retailprice"),
        "r019_backdated": (late_entries, f"SELECT {KEYS['lineitem']} AS row_index FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE date_diff('day', o_orderdate, l_shipdate) > 30"),
        "ref_semi": (lambda s, d: integrity.referenced(t(s, d, "supplier"), "s_nationkey", t(s, d, "nation").filter("n_regionkey = 1").select("n_nationkey")).select("s_suppkey"), "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
        "ref_anti": (lambda s, d: integrity.referenced(t(s, d, "supplier"), "s_nationkey", t(s, d, "nation").filter("n_regionkey = 1").select("n_nationkey"), there=False).select("s_suppkey"), "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
        "cross_verify": (cross, "WITH f AS (SELECT DISTINCT l_orderkey AS k, l_linestatus AS st FROM lineitem WHERE l_quantity >= 50) SELECT CASE WHEN o_orderkey IS NULL THEN 'UNVERIFIABLE' WHEN st <> o_orderstatus THEN 'CONFIRMED' ELSE 'UNCONFIRMED' END AS cross_verify_status, count(*) AS n FROM f LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 50000) ON o_orderkey = k GROUP BY ALL"),
        "prune_empty": (lambda s, d: profile.prune_empty(_orders_text(s, d, a=F.expr("nullif(o_orderstatus, 'O')"), b=F.expr("nullif(o_orderpriority, '5-LOW')"), nothing=F.lit(None).cast("string")), ("o_orderkey",)), "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS a, nullif(o_orderpriority, '5-LOW') AS b FROM orders WHERE nullif(o_orderstatus, 'O') IS NOT NULL OR nullif(o_orderpriority, '5-LOW') IS NOT NULL"),
        "profile": (lambda s, d: profile.profile(_orders_text(s, d, status=F.expr("nullif(o_orderstatus, 'P')"), priority=F.col("o_orderpriority")), "o_orderkey"), "SELECT 'status' AS column_name, count(*) AS row_count, count(*) FILTER (WHERE o_orderstatus = 'P') AS null_count, count(*) FILTER (WHERE o_orderstatus = 'P') / count(*) AS null_ratio, count(DISTINCT nullif(o_orderstatus, 'P')) AS unique_count FROM orders UNION ALL SELECT 'priority', count(*), 0, 0, count(DISTINCT o_orderpriority) FROM orders"),
        "infer_schema": (infer, INFER_SQL),
        "detect_locale": (lambda s, d: coerce.detect_locale(_orders_text(s, d, v=swap(price())), "v", "o_orderkey"), r"SELECT CASE WHEN count(*) >= 5 AND count(*) FILTER (WHERE regexp_matches(v, ',[0-9]{2}$')) > count(*) FILTER (WHERE regexp_matches(v, '[.][0-9]{2}$')) THEN 'vi' ELSE 'en' END AS locale FROM (SELECT translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS v FROM orders ORDER BY o_orderkey LIMIT 20)"),
        "multi_currency": (lambda s, d: profile.multi_currency(_orders_text(s, d, both=F.concat(F.when(F.col("o_orderkey") % 2 == 0, "USD ").otherwise("VND "), price()), one=F.concat(F.lit("USD "), price())), ["both", "one"]), "SELECT column_name, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM (SELECT 'both' AS column_name, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'VND' END AS code FROM orders UNION ALL SELECT 'one', 'USD' FROM orders) GROUP BY column_name HAVING count(DISTINCT code) > 1"),
        "norm_number_en": (lambda s, d: _orders_text(s, d, v=coerce.number(price(), "en")), "SELECT o_orderkey, round(o_totalprice, 2) AS v FROM orders"),
        "norm_number_vi": (lambda s, d: _orders_text(s, d, v=coerce.number(swap(price()), "vi")), "SELECT o_orderkey, round(o_totalprice, 2) AS v FROM orders"),
        "norm_number_paren": (lambda s, d: t(s, d, "customer").select("c_custkey", coerce.number(F.concat(F.lit("("), F.format_number(F.abs("c_acctbal"), 2), F.lit(")"))).alias("v")), "SELECT c_custkey, -round(abs(c_acctbal), 2) AS v FROM customer"),
        "norm_date": (lambda s, d: _orders_text(s, d, v=coerce.date(F.date_format("o_orderdate", "dd/MM/yyyy")).cast("string")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders"),
        "norm_currency": (lambda s, d: _orders_text(s, d, raw=F.concat(F.when(F.col("o_orderkey") % 2 == 0, "USD ").otherwise("vnd "), F.when(F.col("o_orderkey") % 2 == 0, price()).otherwise(F.format_number(F.floor("o_totalprice"), 0)))).select("o_orderkey", coerce.currency_code(F.col("raw")).alias("code"), coerce.currency_amount(F.translate("raw", "x", "")).alias("amount")), "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'VND' END AS code, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) ELSE floor(o_totalprice) END AS amount FROM orders"),
        "norm_bool": (lambda s, d: _orders_text(s, d, v=coerce.boolean(F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "no"))), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS v FROM orders"),
        "norm_text": (lambda s, d: t(s, d, "documents").select("doc_id", F.sha2(coerce.composed("text"), 256).alias("digest")), "SELECT doc_id, sha256(nfc_normalize(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS digest FROM documents"),
        "snake_case": (lambda s, d: t(s, d, "customer").select("c_custkey", coerce.snake_column(F.col("c_name")).alias("v")), "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') AS v FROM customer"),
        "pii_redact": (lambda s, d: coerce.redact(t(s, d, "customer"), ["c_name"]).select("c_custkey", "c_name"), "SELECT c_custkey, '[REDACTED]' AS c_name FROM customer"),
        "llm_batches": (lambda s, d: unflagged_batches(s, d).groupBy("batch").agg(F.count(F.lit(1)).alias("n")), "SELECT c_custkey // 50 AS batch, count(*) AS n FROM customer GROUP BY 1"),
        "llm_response_validate": (validate_replies, VALIDATED_SQL),
        "llm_stats": (lambda s, d: llm_stats(calls(s, d)), "SELECT count(*) AS calls, count(*) FILTER (WHERE event_id % 3 = 0) AS successes, sum(event_id)::BIGINT AS prompt_tokens, sum(event_id % 7)::BIGINT AS response_tokens, round(avg(user_id % 100), 3) AS latency_ms FROM events"),
        "sessions_last_n": (lambda s, d: latest_sessions(t(s, d, "events").select(F.col("event_id").alias("session_id"), F.col("ts").alias("created_at"), *[F.lit(None).cast("string").alias(c) for c in ("input_path", "input_hash", "config_hash", "status", "report")]), 20).select("session_id"), "SELECT event_id AS session_id FROM events ORDER BY ts DESC, event_id LIMIT 20"),
        "content_hash": (lambda s, d: t(s, d, "documents").select("doc_id", digest.text_digest("text").alias("digest")), "SELECT doc_id, sha256(text) AS digest FROM documents"),
        "stream_window_counts": (lambda s, d: windows.window_counts(t(s, d, "events"), "ts", ["event_type"]), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"),
        "pii_text_email": (lambda s, d: t(s, d, "documents").filter(F.col("text").rlike(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+")).select("doc_id"), r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+')"),
    }


def queries() -> dict[str, Query]:
    return {name: _rule(name) for name in RULES} | {name: q for name, (q, _) in (_plain() | queries_runs.queries()).items()}


def oracle_sql() -> dict[str, str]:
    return {name: _rule_sql(name) for name in RULES} | {name: sql for name, (_, sql) in (_plain() | queries_runs.queries()).items()}


__all__ = ["TABLES", "flagship", "oracle_sql", "queries"]
