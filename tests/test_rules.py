import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.rules import Rule, RuleEngine, RuleError, Settings, build, default_rules, errors_of, parse

ROWS = [(0, 10.0, "5", "x1", True, dt.date(2024, 1, 6)), (1, 20.0, "1e1", " b ", False, dt.date(2024, 1, 31)), (2, None, None, None, None, None), (3, float("nan"), "nan", "5d", True, dt.date(2024, 12, 31)), (4, -1.0, "1,000", "", False, dt.date(2024, 6, 30))]
SCHEMA = "row_index long, n double, t string, s string, b boolean, d date"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def hits(df, settings=Settings(), **rule):
    engine = RuleEngine([build({"id": "R001", "name": "r", "severity": "low"} | rule)], settings)
    return sorted(r.row_index for r in engine.evaluate(df).collect())


@pytest.mark.parametrize(
    "rule, want",
    [
        ({"field": "n", "condition": "gt", "threshold": 10}, [1]),
        ({"field": "n", "condition": "gte", "threshold": 10}, [0, 1]),
        ({"field": "n", "condition": "lt", "threshold": 10}, [4]),
        ({"field": "n", "condition": "lte", "threshold": 10}, [0, 4]),
        ({"field": "t", "condition": "gte", "threshold": 5}, [0, 1]),
        ({"field": "s", "condition": "gt", "threshold": 0}, []),
        ({"field": "n", "condition": "eq", "value": 10}, [0]),
        ({"field": "s", "condition": "eq", "value": "b"}, [1]),
        ({"field": "b", "condition": "eq", "value": True}, [0, 3]),
        ({"field": "s", "condition": "neq", "value": "b"}, [0, 3, 4]),
        ({"field": "n", "condition": "neq", "value": 10}, [1, 3, 4]),
        ({"field": "n", "condition": "in", "values": [10, "20"]}, [0]),
        ({"field": "t", "condition": "in", "values": [5]}, []),
        ({"field": "t", "condition": "not_in", "values": ["5", None]}, [1, 3, 4]),
        ({"field": "d", "condition": "in", "values": ["2024-01-31"]}, [1]),
        ({"field": "t", "condition": "is_null"}, [2]),
        ({"field": "t", "condition": "not_null"}, [0, 1, 3, 4]),
        ({"field": "n", "condition": "matches", "pattern": r"0\.0$"}, [0, 1]),
        ({"field": "s", "condition": "not_matches", "pattern": "[0-9]"}, [1, 2, 4]),
        ({"field": "d", "condition": "weekend_transaction"}, [0, 4]),
        ({"field": "d", "condition": "end_of_period"}, [1, 3, 4]),
        ({"field": "d", "condition": "end_of_period", "value": "quarter"}, [3, 4]),
        ({"field": "d", "condition": "end_of_period", "value": "year"}, [3]),
        ({"field": "n", "condition": "cross_field_gt", "reference_field": "t"}, [0, 1]),
        ({"field": "n", "condition": "cross_field_eq", "reference_field": "t"}, []),
        ({"fields": ["n", "t"], "condition": "lt", "threshold": 6}, [0, 4]),
        ({"field": "missing", "condition": "is_null"}, []),
        ({"condition": "compound", "logic": "AND", "conditions": [{"field": "n", "condition": "gt", "threshold": 0}, {"field": "d", "condition": "weekend_transaction"}]}, [0]),
        ({"condition": "compound", "logic": "OR", "conditions": [{"field": "n", "condition": "gt", "threshold": 15}, {"condition": "compound", "logic": "AND", "conditions": [{"field": "b", "condition": "eq", "value": True}, {"field": "d", "condition": "end_of_period", "value": "year"}]}]}, [1, 3]),
        ({"condition": "compound", "logic": "OR", "conditions": [{"field": "n", "condition": "gt", "threshold": 0}, {"field": "missing", "condition": "is_null"}]}, []),
    ],
)
def test_conditions(df, rule, want):
    assert hits(df, **rule) == want


def test_fiscal_year_and_long_lists(df):
    assert hits(df, Settings(6, 30), field="d", condition="end_of_period", value="year") == [4]
    assert hits(df, field="n", condition="in", values=[float(x) for x in range(10, 400)]) == [0, 1]
    assert hits(df, field="t", condition="not_in", values=[str(x) for x in range(400)]) == [1, 3, 4]


@pytest.mark.parametrize(
    "rule, part",
    [
        ({"id": "r1"}, "capital letter"), ({"condition": "near"}, "unknown condition"), ({"severity": "grave"}, "unknown severity"), ({"field": None}, "needs a field"), ({"threshold": None}, "needs threshold"), ({"threshold": "x"}, "must be a number"),
        ({"condition": "matches", "pattern": "("}, "does not compile"), ({"condition": "compound", "logic": "XOR", "conditions": [{"field": "n", "condition": "is_null"}]}, "logic must be"), ({"condition": "compound", "logic": "AND", "conditions": []}, "needs conditions"), ({"name": ""}, "needs a name"),
    ],
)
def test_validation(rule, part):
    base = {"id": "R001", "name": "r", "severity": "low", "field": "n", "condition": "gt", "threshold": 1}
    assert any(part in e for e in errors_of(Rule(**{**base, **rule})))


def test_sets_of_rules():
    one = {"id": "R001", "name": "r", "field": "n", "condition": "is_null"}
    assert parse(None) == [] and parse({"rules": [one]})[0].active
    with pytest.raises(RuleError, match="more than once"):
        parse([one, one])
    assert len(default_rules()) == 20 and len(default_rules("isa")) == 2 and len(default_rules("vas")) == 2


def test_placeholders_and_inactive_rules(spark, df):
    rules = [build({"id": "R001", "name": "a", "field": "t", "condition": "not_in", "values": "__CONFIG_APPROVED_VENDORS__"}), build({"id": "R002", "name": "b", "field": "n", "condition": "gt", "threshold": 0, "active": False})]
    assert RuleEngine(rules).evaluate(df).count() == 0
    assert RuleEngine(rules, Settings(lists={"__CONFIG_APPROVED_VENDORS__": ["5"]})).evaluate(df).count() == 3


def test_fused_and_single_findings_agree_and_one_rule_is_pushed_down(spark, df, tmp_path):
    rules = [build({"id": "R001", "name": "a", "field": "n", "condition": "gt", "threshold": 15}), build({"id": "R002", "name": "b", "field": "t", "condition": "is_null"})]
    fused = {tuple(r) for r in RuleEngine(rules).evaluate(df, snapshot=["n", "t"]).collect()}
    single = {tuple(r) for rule in rules for r in RuleEngine([rule]).evaluate(df, snapshot=["n", "t"]).collect()}
    assert fused == single and len(fused) == 2
    df.write.parquet(str(tmp_path / "t"))
    plan = RuleEngine([rules[1]]).evaluate(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNull(t)]" in plan and "s:string" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("limit", [0, 10**9])
@pytest.mark.parametrize("condition", ["in", "not_in"])
def test_lists_of_any_length_find_the_same_rows(spark, monkeypatch, limit, condition):
    from tallyspark.operators import rules

    monkeypatch.setattr(rules, "LIST_LIMIT", limit)
    stamps = spark.createDataFrame([(0, dt.datetime(2024, 1, 6, 7, 30), "a", 1.0), (1, dt.datetime(2024, 2, 1), "b", 2.5), (2, None, None, None)], "row_index long, ts timestamp, s string, n double").withColumn("local", F.col("ts").cast("timestamp_ntz"))
    days = [str(dt.date(2024, 1, 1) + dt.timedelta(days=k)) for k in range(0, 10)] + [str(dt.date(1990, 1, 1) + dt.timedelta(days=k)) for k in range(250)]
    want = [0] if condition == "in" else [1]
    for field, values in {"ts": days, "local": days, "s": ["a"] + [f"x{k}" for k in range(250)], "n": [1] + list(range(100, 350))}.items():
        for listed in (values, values[:12]):
            assert hits(stamps, field=field, condition=condition, values=listed) == want
