import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import coerce
from tallyspark.operators import grouped, integrity, profile
from tallyspark.operators.crossverify import cross_verify
from tallyspark.operators.integrity import ColumnRules, CrossCheck, IntegrityConfig
from tallyspark.plans import review
from tallyspark.plans.audit import run_audit
from tallyspark.plans.config import ConfigError, parse
from tallyspark.plans.store import Store
from tallyspark.plans.trail import Trail, TrailEntry, verify
from tallyspark.sources.readers import read_any, read_xlsx
from tallyspark.sources.sniff import SourceError
from tallyspark.streaming.windows import frequent_small_stream, window_counts


def values(spark, texts, *columns):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def test_scalar_goldens(spark):
    t = F.col("t")
    assert values(spark, ["1,000,000", "1,500.50", "(250)", "x", None], coerce.number(t)) == [1000000.0, 1500.5, -250.0, None, None]
    assert values(spark, ["1.000.000", "1.500,5"], coerce.number(t, "vi")) == [1000000.0, 1500.5]
    assert [str(d) if d else None for d in values(spark, ["01/05/2025", "2025-01-15", "not-a-date", "12/25/2025", "15-01-2025", "20250115", "123456", "01/05/25", "2025-01-15 10:00:00"], coerce.date(t))] == ["2025-05-01", "2025-01-15", None, "2025-12-25", "2025-01-15", "2025-01-15", None, None, None]
    assert values(spark, ["VND 500.000", "$50.00", "12"], coerce.currency_code(t), coerce.currency_amount(t)) == [("VND", 500000.0), ("USD", 50.0), (None, 12.0)]
    assert values(spark, [" Yes ", "no", None], coerce.boolean(t)) == [True, False, None]
    assert values(spark, ["  hello  ", "é", None], coerce.composed("t")) == ["hello", "é", None]
    assert values(spark, ["1.000,5", "1,000.5", "10,50", "1,000", "10.50", "1.000", "7"], coerce.locale_vote(t)) == ["vi", "en", "vi", "en", "en", "vi", None]
    assert coerce.headers(["Transaction Date", "Amount (VND)", "class", "", "amount vnd", "Thành tiền"]) == ["transaction_date", "amount_vnd", "class_", "column", "amount_vnd_1", "thanh_tien"]


def test_shown_prints_numbers_as_text(spark):
    df = spark.createDataFrame([(5000000.0,), (0.001,), (1.5,), (-0.0,)], "x double")
    assert [r[0] for r in df.select(coerce.shown(df, "x")).collect()][:3] == ["5000000.0", "0.001", "1.5"]


def ledger(spark):
    return spark.createDataFrame([(0, "A", 100.0, "2024-01-01"), (1, "B", -50.0, "2024-01-02"), (2, "A", 100.0, "2024-01-01")], "row_index long, account string, amount double, date string")


def test_minimal_ledger_scores_eight(spark):
    found = integrity.run_checks(ledger(spark))
    assert sorted((r.rule_id, r.row_index) for r in found.collect()) == [("IC-002", 0), ("IC-002", 2), ("IC-006", 1)]
    assert tuple(integrity_score(found)) == (8, "MINOR")


def integrity_score(found):
    from tallyspark.operators.findings import integrity_score as score

    return score(found).first()


def test_each_check(spark):
    rows = [(i, float(i), "k%d" % (i // 2), "2024-01-%02d" % (i + 1), None if i == 3 else "v") for i in range(12)] + [(12, 9999.0, "z", "1800-01-01", "w")]
    df = spark.createDataFrame(rows, "row_index long, n double, k string, start_date string, v string")
    config = IntegrityConfig({"n": ColumnRules(max_value=10), "v": ColumnRules(pattern="^v$", reference_values=["v"], required=True)}, ["k"], [CrossCheck("n", "<", "row_index2"), CrossCheck("n", "<=", right_fields=["n", "n"])])
    got = {(r.rule_id, r.row_index, r.severity) for r in integrity.run_checks(df, config).collect()}
    assert {g for g in got if g[0] == "IC-001"} == {("IC-001", 3, "high")}
    assert {g[1] for g in got if g[0] == "IC-003"} == set(range(12))
    assert {g for g in got if g[0] == "IC-004"} == {("IC-004", 12, "medium")}
    assert {g[1] for g in got if g[0] == "IC-005"} == {11, 12}
    assert {g[1] for g in got if g[0] == "IC-007"} == {g[1] for g in got if g[0] == "IC-008"} == {12}
    assert {g[1] for g in got if g[0] == "IC-009"} == set()
    assert {g for g in got if g[0] == "IC-010"} == {("IC-010", 12, "low")}


def test_empty_table_has_no_findings(spark):
    assert integrity.run_checks(ledger(spark).limit(0)).count() == 0


def test_frequent_small(spark):
    rows = [(i, "v1", "2024-01-01", 10.0) for i in range(6)] + [(i, "v2", "2024-01-01", 10.0) for i in range(6, 11)] + [(20 + i, "v3", "2024-01-01", 2e8) for i in range(6)] + [(30, None, "2024-01-01", 1.0)]
    df = spark.createDataFrame(rows, "row_index long, vendor string, date string, amount double")
    assert sorted(r.row_index for r in grouped.frequent_small(df).collect()) == list(range(6))


def test_cross_verify(spark):
    found = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "row_index long, x string")
    other = spark.createDataFrame([(1, "a"), (2, "z"), (2, "b")], "row_index long, y string")
    got = {r.row_index: r.cross_verify_status for r in cross_verify(found, other, "row_index", F.col("x") != F.col("y")).collect()}
    assert got == {1: "UNCONFIRMED", 2: "CONFIRMED", 3: "UNVERIFIABLE"}


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", None)], "a string, b int")
    b = spark.createDataFrame([(None, "y"), (1, "x")], "b int, a string")
    assert profile.content_digest(a) == profile.content_digest(b) != profile.content_digest(a.union(a))


def test_row_index_follows_the_source(spark):
    df = profile.with_row_index(spark.range(100, numPartitions=7))
    assert [(r.id, r.row_index) for r in df.orderBy("id").collect()] == [(i, i) for i in range(100)]


def test_csv_reading(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿Id;Näme;x\n1;ä;NA\n2;\"b;c\";2\n3;d;4;5\n4;e\n".encode())
    rows = [tuple(r) for r in read_any(spark, str(p)).collect()]
    assert rows == [("1", "ä", None), ("2", "b;c", "2"), ("4", "e", None)]
    (tmp_path / "b.csv").write_bytes("a|b\n1|caf\xe9\n".encode("latin-1"))
    assert read_any(spark, str(tmp_path / "b.csv")).first()[1] == "café"
    (tmp_path / "c.csv").write_bytes(b"")
    with pytest.raises(SourceError):
        read_any(spark, str(tmp_path / "c.csv"))
    (tmp_path / "d.csv").write_text("title\n\na,b\n1,2\n")
    assert [tuple(r) for r in read_any(spark, str(tmp_path / "d.csv"), skip_rows=1).collect()] == [("1", "2")]


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>day</t></is></c><c r="D1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45292</v></c><c r="D2"><v>1.50</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>q</t></is></c></row><row><c r="A2" t="b"><v>1</v></c></row></sheetData></worksheet>')


def test_xlsx_reading(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    got = read_any(spark, str(tmp_path / "w.xlsx"))
    assert got.columns == ["name", "day", "column_2", "n"] and [tuple(r) for r in got.collect()] == [("ab", "2024-01-01", None, "1.5")]
    assert [tuple(r) for r in read_xlsx(spark, str(tmp_path / "w.xlsx"), "Two").collect()] == [("True",)]


def test_trail_chain(tmp_path):
    trail = Trail(tmp_path / "t.jsonl")
    trail.append(TrailEntry("s", "A", summary="x", confidence=0.5))
    assert verify(trail.path) == (False, "the trail is not sealed")
    trail.seal("s")
    assert verify(trail.path)[0]
    lines = trail.path.read_text().splitlines()
    trail.path.write_text("\n".join([lines[0].replace('"x"', '"y"'), *lines[1:]]) + "\n")
    assert not verify(trail.path)[0]
    with pytest.raises(ValueError):
        TrailEntry("s", "A", summary="x" * 501)


def test_config_errors():
    assert parse({"unknown": 1, "fiscal_year_end": "06-30"}).settings().fiscal_month == 6
    for bad in ({"review": {"batch_size": 0}}, {"report_formats": ["doc"]}, {"integrity": {"columns": {"a": 1}}}, {"fiscal_year_end": "x"}):
        with pytest.raises(ConfigError):
            parse(bad)


def test_review_keeps_only_sound_replies(spark):
    df = spark.createDataFrame([(i, f"Name {i}", "secret") for i in range(4)], "row_index long, name string, email string")
    batched = review.batches(df, df.filter("row_index = 0"), ["email"], 50)
    assert "secret" not in "".join(r.row for r in batched.collect()) and batched.count() == 3
    reply = '```json\n[{"row_index": 1, "severity": "HIGH", "confidence": 0.9, "reasoning": "name 1 is odd"}, {"row_index": 9, "severity": "low", "confidence": 1, "reasoning": "Name 9"}]\n```'
    found = review.validated(review.ask(batched, review.Stub(reply), df.columns), batched)
    assert [(r.row_index, r.severity, r.detection_method) for r in found.collect()] == [(1, "high", "llm")]


def test_whole_run(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Transaction ID,Date,Amount,Vendor ID,Approver\n" + "".join(f"TXN{i:03d},2024-01-{i % 28 + 1:02d},{600000000 if i == 3 else -5 if i == 4 else 100 + i},V{i},\n" for i in range(30)))
    config = parse({"approved_vendors": [f"V{i}" for i in range(29)], "report_formats": ["json", "markdown", "pdf"]})
    run = run_audit(spark, str(tmp_path / "in.csv"), tmp_path / "out", config, "s1")
    assert run.report["status"] == "completed" and not run.errors
    assert run.types["transaction_id"] == "text" and run.types["amount"] == "numeric" and run.types["date"] == "date"
    assert run.report["integrity"]["checks"]["IC-006"]["findings"] == 1
    assert run.report["anomalies"]["by_rule"]["R001"] == 1 and run.report["anomalies"]["by_rule"]["R007"] == 1
    json.loads((tmp_path / "out/s1_report.json").read_text())
    assert "## Recommendations" in (tmp_path / "out/s1_report.md").read_text()
    assert verify(tmp_path / "out/s1_trail.jsonl")[0]
    store = Store(spark, str(tmp_path / "out/store"))
    one = store.findings("s1").first()
    store.decide("s1", one.finding_id, "accepted")
    store.decide("s1", one.finding_id, "rejected")
    assert store.findings("s1").filter(F.col("finding_id") == one.finding_id).first().human_decision == "rejected"
    assert [r.status for r in store.sessions(5).collect()] == ["completed"]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 8} 0{i % 8}:10:00", "v", float(i)) for i in range(24)] + [(99, "2024-02-01 00:00:00", "w", 1.0)]
    df = spark.createDataFrame(rows, "id long, t string, vendor string, amount double").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for k, f in enumerate((lambda d: window_counts(d, "t", ["vendor"]), lambda d: frequent_small_stream(d, "t", "vendor", "amount", 100))):
        q = f(stream).writeStream.format("memory").queryName(f"q{k}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        closed = {tuple(r) for r in spark.table(f"q{k}").collect()}
        assert closed and closed <= {tuple(r) for r in f(df).collect()}


def test_batches_query_leaves_flagged_rows_out(spark, monkeypatch):
    from tallyspark import queries

    seen, batches = [], queries.review.batches
    monkeypatch.setattr(queries.review, "batches", lambda df, flagged, *a: seen.append((df, flagged)) or batches(df, flagged, *a))
    got = queries.queries()["llm_batches"](spark, "/root/testdata/sf0.001").agg({"n": "sum"}).first()[0]
    df, flagged = seen[0]
    hit = flagged.select("row_index").distinct()
    assert hit.count() > 0 and df.join(hit, "row_index", "left_semi").count() == hit.count() == df.count() - got


LEDGER = """txn_no,amount,transaction_date,transaction_time,approval_special,approver,vendor_id,document_ref,revenue,discount_rate,interco_flag,matching_id,invoice_no,currency,account_currency,journal_id,debit,credit,unit_price,std_price,entry_date
{rows}"""


def test_each_shipped_rule_finds_its_planted_row(spark, tmp_path):
    calm = dict(txn_no=0, amount=1234.5, transaction_date="2024-03-05", transaction_time="10:00", approval_special="S1", approver="ann", vendor_id="V1", document_ref="D1", revenue=10, discount_rate=0.1, interco_flag="false", matching_id="M1", invoice_no="I0", currency="USD", account_currency="USD", journal_id="J0", debit=5, credit=5, unit_price=10, std_price=10, entry_date="2024-03-06")
    planted = [
        ("R001", {"amount": 600000001}), ("R002", {"transaction_date": "2024-03-09", "entry_date": "2024-03-10", "approval_special": ""}), ("R003", {"amount": 3000000}), ("R004", {"txn_no": 11, "amount": 77.5}), ("R004", {"txn_no": 12, "amount": 77.5}), ("R005", {"transaction_time": "23:15"}),
        ("R006", {"transaction_date": "2024-12-31", "entry_date": "2025-01-02"}), ("R007", {"vendor_id": "V9"}), ("R008", {"invoice_no": "I7", "vendor_id": "V1"}), ("R008", {"invoice_no": "I7", "vendor_id": "V1"}), ("R009", {"amount": 460000001}), ("R010", {"amount": 150000001, "approver": ""}), ("R011", {"currency": "EUR"}),
        ("R012", {"revenue": -4}), ("R013", {"journal_id": "J5", "debit": 9}), ("R014", {"interco_flag": "true", "matching_id": ""}), ("R015", {"transaction_date": "2024-05-01", "entry_date": "2024-05-02"}), ("R016", {"discount_rate": 0.45}), ("R017", {"unit_price": 13}), ("R019", {"entry_date": "2024-06-30"}), ("R020", {"amount": 600000002, "document_ref": ""}),
    ] + [("R018", {"vendor_id": "V2", "transaction_date": "2024-03-12", "entry_date": "2024-03-12"})] * 6
    rows = [{**calm, "txn_no": 1000 + 2 * k, "invoice_no": f"I{100 + k}", "journal_id": f"J{100 + k}", "transaction_date": f"2024-04-{1 + k % 5:02d}", "entry_date": f"2024-04-{2 + k % 5:02d}", "vendor_id": f"V{1 + k % 2 * 2}"} | own for k, (_, own) in enumerate(planted)]
    (tmp_path / "ledger.csv").write_text(LEDGER.format(rows="\n".join(",".join(str(v) for v in r.values()) for r in rows)))
    config = parse({"approved_vendors": ["V1", "V2", "V3"], "public_holidays": ["2024-05-01"] + [str(2025 + k // 28) + f"-02-{1 + k % 28:02d}" for k in range(300)]})
    run = run_audit(spark, str(tmp_path / "ledger.csv"), tmp_path / "out", config)
    found = {}
    for f in run.anomalies.collect():
        found.setdefault(f.rule_id, set()).add(f.row_index)
    want = {}
    for k, (rule, _) in enumerate(planted):
        want.setdefault(rule, set()).add(k)
    assert not run.errors and found.keys() == want.keys()
    want["R004"] = {4}  # the second of the two
    want["R001"] |= want["R020"]
    assert found == want


def test_markdown_says_how_many_high_findings_it_leaves_out(spark, tmp_path, monkeypatch):
    from tallyspark.plans import report

    monkeypatch.setattr(report, "DETAIL_ROWS", 2)
    (tmp_path / "t.csv").write_text("amount,ref\n" + "\n".join(f"{600000001 + k},D{k}" for k in range(5)))
    run = run_audit(spark, str(tmp_path / "t.csv"), tmp_path / "out")
    text = next((tmp_path / "out").glob("*_report.md")).read_text()
    assert run.report["high_total"] == 5 and "and 3 more of high severity" in text


def test_several_checks_make_what_they_say_after_the_hits(spark):
    """No higher-order function, which Spark interprets, over the predicates; what is not wanted is not made."""
    from tallyspark.operators.rules import RuleEngine, build

    rules = [{"id": f"R00{k}", "name": f"n{k}", "severity": "high", "field": c, "condition": "gte", "threshold": k} for k, c in ((1, "a"), (2, "b"), (3, "a"))]
    df = spark.createDataFrame([(0, 1.0, 5), (1, 3.5, None), (2, None, 0), (3, 3.0, 2)], "row_index long, a double, b int")
    found = RuleEngine([build(r) for r in rules]).evaluate(df)
    got = {(r.row_index, r.rule_id, r.rule_name, r.column_name, r.actual_value, r.expected_value) for r in found.collect()}
    assert got == {(0, "R001", "n1", "a", "1.0", "1"), (0, "R002", "n2", "b", "5", "2"), (1, "R001", "n1", "a", "3.5", "1"), (1, "R003", "n3", "a", "3.5", "3"), (3, "R001", "n1", "a", "3.0", "1"), (3, "R002", "n2", "b", "2", "2"), (3, "R003", "n3", "a", "3.0", "3")}
    plan = found.select("row_index", "rule_id")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "regexp_replace" not in plan
