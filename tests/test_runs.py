import json
import random
import time

import pytest
import yaml
from pyspark.sql import functions as F

from tallyspark.cli import main
from tallyspark.errors import CheckpointError, ReviewError, SourceError, StoreError, TrailError
from tallyspark.operators import digest, profile
from tallyspark.operators.crossverify import cross_verify, key_filter, reduced
from tallyspark.operators.rules import load as load_rules
from tallyspark.plans import audit
from tallyspark.plans.audit import run_audit
from tallyspark.plans.calls import CallLog, trail_rows
from tallyspark.plans.config import parse
from tallyspark.plans.manifest import ColumnMeta, SourceManifest
from tallyspark.plans.review import Stub, ask, batches
from tallyspark.plans.stages import Stages
from tallyspark.plans.store import Store
from tallyspark.plans.trail import Trail, TrailEntry, verify

HEAD = "Txn No,Amount,Vendor ID,Invoice No,Entry Date,Note\n"


def written(tmp_path, n=40, bad=""):
    rows = "".join(f'TXN{k:03d},{100 * (k // 2)},V{k % 3},I{k // 4},2024-01-{1 + k % 28:02d},"two\nlines, {k}"\n' for k in range(n))
    (tmp_path / "in.csv").write_text(HEAD + rows + bad)
    return str(tmp_path / "in.csv")


def rows_of(run):
    return sorted((r.layer, r.rule_id, r.row_index, r.column_name or "", r.finding_id) for r in run.integrity.unionByName(run.anomalies).collect())


def test_a_run_that_was_cut_short_goes_on_after_its_last_layer(spark, tmp_path, monkeypatch):
    path = written(tmp_path)
    whole = run_audit(spark, path, tmp_path / "a", session_id="s")

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(audit, "detect", killed)
        with pytest.raises(KeyboardInterrupt):
            run_audit(spark, path, tmp_path / "b", session_id="s")
    with monkeypatch.context() as m:  # the first two layers are not made again
        m.setattr(audit, "ingest", killed)
        m.setattr(audit, "check_integrity", killed)
        again = run_audit(spark, path, tmp_path / "b", session_id="s")
    assert not again.errors and rows_of(again) == rows_of(whole) and len(rows_of(again)) > 0
    actions = [json.loads(x)["action"] for x in (tmp_path / "b" / "s_trail.jsonl").read_text().splitlines()]
    assert {"INGEST", "INGEST_REUSED", "INTEGRITY_REUSED", "ANOMALY"} <= set(actions) and verify(tmp_path / "b" / "s_trail.jsonl")[0]
    (tmp_path / "in.csv").write_text((tmp_path / "in.csv").read_text() + "TXN999,1,V1,I99,2024-01-01,x\n")
    changed = run_audit(spark, path, tmp_path / "b", session_id="s")  # another input has another address
    assert changed.source["rows"] == 41


def test_a_stage_without_its_marker_does_not_count(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "st"))
    key = Stages.key("x", 1)
    assert stages.load("1", key) is None
    spark.range(3).write.parquet(f"{stages._place('1', key)}/data-left")
    assert stages.load("1", key) is None
    df, facts = stages.save("1", key, spark.range(5), lambda: {"n": 5})
    assert df.count() == 5 and facts == {"n": 5} and stages.load("1", key)[0].count() == 5
    assert Stages.key("x", 2) != key
    (tmp_path / "st" / f"1-{key[:32]}" / "COMMIT.json").write_text("no json")
    with pytest.raises(CheckpointError):
        stages.load("1", key)


def test_manifest_bad_lines_rules_and_snapshots_of_a_run(spark, tmp_path):
    run = run_audit(spark, written(tmp_path, bad="1,2,3,4,5,6,7,8\nTXN900,5,V1,I90,2024-02-01\n"), tmp_path / "o", parse({"approved_vendors": ["V1", "V2"]}), "s")
    m = SourceManifest.from_dict(json.loads((tmp_path / "o" / "s_manifest.json").read_text()))
    assert (m.records, m.bad_lines, m.rows, m.kind, m.separator, len(m.digest)) == (42, 1, 41, "csv", ",", 64)
    assert [(c.original, c.name, c.dtype) for c in m.columns] == [("Txn No", "txn_no", "text"), ("Amount", "amount", "numeric"), ("Vendor ID", "vendor_id", "text"), ("Invoice No", "invoice_no", "text"), ("Entry Date", "entry_date", "date"), ("Note", "note", "text")]
    assert m.columns[5].null_count == 1 and m.columns[2].samples == ["V0", "V1", "V2"] and SourceManifest.from_dict(m.to_dict()) == m
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "o" / "s_rejected")).collect()] == [(40, "1,2,3,4,5,6,7,8")]
    text = (tmp_path / "o" / "s_report.md").read_text()
    assert "1 bad lines left out" in text and "Warning: 1 lines could not be read" in text and "1 bad lines" in (tmp_path / "o" / "s_trail.jsonl").read_text()
    rules = load_rules(tmp_path / "o" / "rules" / "s_rules.yaml")
    assert next(r.values for r in rules if r.id == "R007") == ["V1", "V2"] and "R015" not in {r.id for r in rules}  # no holidays are configured
    store = Store(spark, str(tmp_path / "o" / "store"))
    assert {r["id"] for r in store.rules("s")} == {r.id for r in rules} and store.session("s")["status"] == "completed"
    with pytest.raises(StoreError):
        store.session("other")
    # text ids such as TXN007 are in sequence, and equal amounts of neighbours are found
    assert {r.row_index for r in run.anomalies.filter("rule_id = 'R004'").collect()} == {k for k in range(40) if k % 2}


def test_manifest_columns_are_checked():
    assert len(ColumnMeta("a", "a", "text", samples=["1", "2", "3", "4"]).samples) == 3
    with pytest.raises(ValueError):
        ColumnMeta("a", "a", "text", null_ratio=1.5)


class Counting:
    """Writes a line for each call."""

    name = "counting"

    def __init__(self, place):
        self.place = str(place)

    def healthy(self):
        return True

    def complete(self, prompt):
        with open(f"{self.place}/calls", "a") as f:
            f.write(f"{hash(prompt)}\n")
        return "[]"


def failing(df, place):
    """df's rows, but the first task that has handed a batch on fails, once."""
    import os

    def work(batches):
        for b in batches:
            yield b
            try:
                os.mkdir(f"{place}/failed")
            except FileExistsError:
                continue
            raise RuntimeError("on purpose")

    return df.mapInArrow(work, df.schema)


def test_no_prompt_is_asked_twice_and_one_chain_tells_of_all(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS row_index", "concat('v', id) AS v")
    flagged = spark.createDataFrame([(3,), (77,)], "row_index long")
    batched = batches(df, flagged, [], 10)
    log = CallLog(f"file://{tmp_path}/log", "s")
    replies = lambda: failing(ask(batched, Counting(tmp_path), ["v"], log=log), tmp_path)
    with pytest.raises(Exception, match="on purpose"):  # some tasks have ended, one has asked and failed
        replies().collect()
    assert (tmp_path / "calls").exists()
    for _ in range(2):
        got = replies().collect()
    assert sorted(r.batch for r in got) == list(range(10))
    assert len((tmp_path / "calls").read_text().splitlines()) == 10
    calls = log.entries(spark)
    assert calls.count() == 10 and calls.filter("success").count() == 10
    trail = Trail(tmp_path / "t.jsonl")
    trail.append(TrailEntry("s", "START"))
    assert trail.extend("s", trail_rows(calls), "3") == 20
    trail.seal("s")
    lines = [json.loads(x) for x in (tmp_path / "t.jsonl").read_text().splitlines()]
    assert verify(tmp_path / "t.jsonl") == (True, "") and [(x["action"], x["summary"]) for x in lines[1:5]] == [("REVIEW_ASKED", "batch 0 asked of counting"), ("REVIEW_ANSWERED", "batch 0 answered"), ("REVIEW_ASKED", "batch 1 asked of counting"), ("REVIEW_ANSWERED", "batch 1 answered")]


def test_claims_of_dead_tasks_run_out(tmp_path):
    log = CallLog(str(tmp_path / "log"), "s", lease=0.2)
    asked = []
    entry = log.once(1, "p", "x", lambda p: asked.append(p) or "[]")
    claim = next((tmp_path / "log" / "s").glob("*.json")).with_suffix(".json.claim")
    next((tmp_path / "log" / "s").glob("*.json")).unlink()
    claim.touch()
    began = time.time()
    assert log.once(1, "p", "x", lambda p: asked.append(p) or "[]")["prompt_hash"] == entry["prompt_hash"] and len(asked) == 2 and time.time() - began >= 0.1
    assert log.once(1, "p", "x", lambda p: asked.append(p))["reply"] == "[]" and len(asked) == 2


def test_flagged_rows_are_in_the_prompt(spark, tmp_path):
    df = spark.range(20).selectExpr("id AS row_index", "concat('v', id) AS v")
    got = batches(df, spark.createDataFrame([(3,), (3,), (12,)], "row_index long"), [], 10).collect()
    assert {(r.batch, tuple(r.flagged)) for r in got} == {(0, (3,)), (1, (12,))} and len(got) == 18


def test_a_reviewed_run_keeps_its_calls_and_summary(spark, tmp_path):
    config = parse({"review": {"enabled": True, "batch_size": 20, "write_summary": True}})
    run = run_audit(spark, written(tmp_path), tmp_path / "o", config, "s", Stub("All in good order."))
    assert run.report["summary"] == "All in good order." and not run.errors
    calls = Store(spark, str(tmp_path / "o" / "store")).table("llm_calls")
    assert calls.count() == 2 and verify(tmp_path / "o" / "s_trail.jsonl")[0]  # "All in good order." is no JSON: both have failed
    assert calls.filter("success").count() == 0 and "batch 1 failed" in (tmp_path / "o" / "s_trail.jsonl").read_text()


def test_all_high_findings_are_written(spark, tmp_path, monkeypatch):
    from tallyspark.plans import report

    monkeypatch.setattr(report, "DETAIL_ROWS", 2)
    (tmp_path / "t.csv").write_text("amount,ref\n" + "\n".join(f"{600000001 + k},D{k}" for k in range(5)))
    run = run_audit(spark, str(tmp_path / "t.csv"), tmp_path / "out", session_id="s")
    got = spark.read.json(run.report["high_file"])
    assert sorted(r.row_index for r in got.collect()) == list(range(5)) and len(run.report["high"]) == 2


def test_second_file_from_the_command_line(spark, tmp_path):
    written(tmp_path, bad="TXN901,600000000,V1,I91,2024-02-01,x\nTXN902,700000000,V1,I92,2024-02-01,x\nTXN903,800000000,V1,,2024-02-01,x\n")
    (tmp_path / "bank.csv").write_text("Ref;Paid\nI91;600000000\nI92;1\nI92;700000000\nI50;3\n")
    out = str(tmp_path / "o")
    assert main(["run", str(tmp_path / "in.csv"), "--output-dir", out, "--session", "s", "--cross-file", str(tmp_path / "bank.csv"), "--cross-key", "invoice_no=ref", "--contradicts", "amount != paid"]) == 0
    got = {(r.row_index, r.cross_verify_status, r.cross_verified) for r in spark.read.parquet(f"{out}/store/findings").filter("rule_id = 'R001'").collect()}
    assert got == {(40, "UNCONFIRMED", False), (41, "CONFIRMED", True), (42, "UNVERIFIABLE", False)}
    assert main(["run", str(tmp_path / "in.csv"), "--output-dir", out, "--cross-file", str(tmp_path / "bank.csv")]) == 1
    assert main(["export", "--session", "none", "--output-dir", out]) == StoreError.exit_code
    assert (ReviewError.exit_code, TrailError.exit_code, SourceError.exit_code) == (3, 4, 1)


def test_the_other_file_is_reduced_before_its_shuffle(spark):
    found = spark.range(200).selectExpr("id AS row_index", "id * 7 AS k")
    other = spark.range(100_000).selectExpr("id AS k", "id % 2 AS y")
    maps, bits = key_filter(found, ["k"])
    some = reduced(other, ["k"], maps, bits)
    hit = {r.k for r in some.collect()}
    assert {7 * i for i in range(200)} <= hit and len(hit) < 400
    plan = cross_verify(found, other, "k", F.col("y") == 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("bitmap_construct_agg") and plan.index("BroadcastExchange") > 0
    same = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k long, x string")
    assert sorted(r.cross_verify_status for r in cross_verify(same, other, "k", F.col("y") == 1).collect()) == ["CONFIRMED", "CONFIRMED", "UNCONFIRMED"]
    assert cross_verify(same.limit(0), other, "k").count() == 0 and {r.cross_verify_status for r in cross_verify(same, other.limit(0), "k").collect()} == {"UNVERIFIABLE"}


def test_hash_trees_tell_where_tables_differ(spark):
    rng = random.Random(4)
    rows = [(i, f"v{rng.randrange(50)}") for i in range(5000)]
    changed = [(i, v + "!" if i in (17, 4000) else v) for i, v in rows if i != 2500] + [(5200, "new")]
    df = lambda r: spark.createDataFrame(r, "row_index long, v string").repartition(5)
    a, b = (digest.hash_tree(df(r), leaf=64, fanout=4) for r in (rows, changed))
    want = {}
    for side, r in enumerate((rows, changed)):
        for i, v in r:
            want.setdefault(i // 64, ([], []))[side].append((i, v))
    want = {(64 * k, 64 * k + 63, len(x), len(y)) for k, (x, y) in want.items() if sorted(x) != sorted(y)}
    assert {tuple(r) for r in digest.differing_ranges(a, b, 64, 4).collect()} == want
    assert digest.differing_ranges(a, digest.hash_tree(df(rows[::-1]), leaf=64, fanout=4), 64, 4).count() == 0
    empty = digest.hash_tree(df(rows[:0]), leaf=64, fanout=4)
    assert digest.differing_ranges(empty, empty, 64, 4).count() == 0
    assert sum(r.rows_b for r in digest.differing_ranges(empty, a, 64, 4).collect()) == 5000
    few = digest.hash_tree(df(rows[:10]), leaf=64, fanout=4)
    assert sum(r.rows_a for r in digest.differing_ranges(a, few, 64, 4).collect()) == 5000


def test_hashes_of_texts_records_files_and_tables(spark, tmp_path):
    import hashlib

    (tmp_path / "f").write_bytes(b"abc" * 100_000)
    assert digest.hash_file(spark, f"file://{tmp_path}/f") == hashlib.sha256(b"abc" * 100_000).hexdigest()
    assert digest.hash_text("é") == hashlib.sha256("é".encode()).hexdigest()
    assert digest.hash_record({"b": 1, "a": [2]}) == digest.hash_record({"a": [2], "b": 1}) != digest.hash_record({"a": [2], "b": 2})
    assert digest.verify_hash(digest.hash_text("x").upper(), digest.hash_text("x")) and not digest.verify_hash("0", "1")


def test_a_survey_takes_two_jobs_whatever_the_columns(spark):
    df = spark.range(3000).selectExpr("id AS row_index", *[f"CASE WHEN id > {2000 * (k % 2)} THEN concat('USD ', id) END AS c{k}" for k in range(12)], "CASE WHEN id = 2999 THEN '01/02/2024' END AS rare", "CAST(NULL AS STRING) AS nothing")
    tracker, before = spark.sparkContext.statusTracker(), None
    spark.sparkContext.setJobGroup("survey", "survey")
    facts = profile.survey(df)
    jobs = len(tracker.getJobIdsForGroup("survey"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", before)
    assert facts["c0"].dtype == facts["c1"].dtype == "currency" and facts["rare"].dtype == "date" and facts["nothing"].dtype == "text"
    assert (facts["c1"].null_count, facts["c1"].samples[0], facts["rare"].samples, facts["c0"].codes) == (2001, "USD 2001", ("01/02/2024",), ("USD",))
    assert jobs <= 6  # adaptive execution splits an aggregation into jobs by stage


def test_a_run_over_parquet_with_nested_columns_and_many_renamed_ones(spark, tmp_path):
    spark.range(30).selectExpr("id AS `Txn No`", "id * 1000000000 AS Amount", "map('k', id) AS m", "array(id) AS a", "struct(id) AS s", *[f"CASE WHEN id % 2 = 0 THEN 'x{k}' END AS `Column {k}`" for k in range(40)]).repartition(3).write.parquet(str(tmp_path / "p"))
    run = run_audit(spark, str(tmp_path / "p"), tmp_path / "o", session_id="s")
    assert not run.errors and run.source["rows"] == 30 and run.types["column_7"] == "text"
    assert {r.row_index for r in run.anomalies.filter("rule_id = 'R001'").collect()} == {r.row_index for r in run.table.filter("amount > 500000000").collect()} and run.anomalies.filter("rule_id = 'R001'").count() == 29


def test_duplicate_checks_move_no_whole_rows(spark):
    from tallyspark.operators import integrity

    df = spark.range(50).selectExpr("id AS row_index", "id % 40 AS k", "repeat('wide', 50) AS wide")
    found = integrity.duplicate_findings(df, "IC-003", ["k"], "s", "row_index")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "wide" in x] and sorted(r.row_index for r in found.collect()) == [*range(10), *range(40, 50)]


def test_duplicate_checks_move_each_row_twice_at_most(spark):
    from tallyspark.operators import integrity

    df = spark.range(60).selectExpr("id AS row_index", "CASE WHEN id % 30 < 25 THEN id % 30 END AS k", "CAST(id % 30 AS INT) AS n", "CAST(id % 30 AS DOUBLE) AS x", "id > 50 AS b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for columns, want in ((["k"], range(60)), (["k", "n"], range(60)), (["n", "b"], [*range(21), *range(30, 51)]), (["x", "k"], range(60)), (["k", "x", "b"], [*range(21), *range(30, 51)])):
            found = integrity.duplicate_findings(df, "IC-003", columns, "s", "row_index").select("row_index")
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= 3 and ("sha2" in plan) == ("x" in columns)
            assert sorted(r.row_index for r in found.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bad_configuration_of_the_second_file():
    for bad in ({"file": "x.csv"}, {"file": "x.csv", "keys": {"a": "b"}, "contradicts": [["a", "~", "b"]]}):
        with pytest.raises(ValueError):
            parse({"cross_file": bad})
    assert yaml.safe_load("a: 1") == {"a": 1}
