"""Sessions, findings, decisions, rule snapshots and reviewer calls as parquet tables under one folder.

Findings are partitioned by session and never rewritten; decisions are appended and the latest one counts."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..operators.findings import SCHEMA
from ..sources.files import Files

TABLES = {
    "sessions": "session_id string, created_at string, input_path string, input_hash string, config_hash string, status string, report string",
    "decisions": "session_id string, finding_id string, decision string, note string, decided_at string",
    "rule_snapshots": "session_id string, rule_id string, body string, created_at string",
    "llm_calls": "session_id string, batch long, provider string, prompt_tokens long, response_tokens long, latency_ms long, success boolean, created_at string",
    "findings": SCHEMA,
}


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        return Files(self.spark, f"{self.path}/{name}").exists()

    def table(self, name: str) -> DataFrame:
        schema = TABLES[name]
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame | list[dict]) -> None:
        if isinstance(rows, list):
            names = [p.split(" ")[0] for p in TABLES[name].split(", ")]
            rows = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[name]).coalesce(1)
        writer = rows.write.mode("append")
        (writer.partitionBy("session_id") if name == "findings" else writer).parquet(f"{self.path}/{name}")

    def replace_findings(self, session_id: str, rows: DataFrame) -> None:
        """A session's findings, in place of any that a run cut short has left."""
        rows.drop("session_id").write.mode("overwrite").parquet(f"{self.path}/findings/session_id={session_id}")

    def replace_calls(self, session_id: str, calls: DataFrame) -> None:
        """A session's reviewer calls, from its call log, in place of any that a run cut short has left."""
        names = [p.split(" ")[0] for p in TABLES["llm_calls"].split(", ")]
        calls.withColumn("created_at", F.col("answered_at")).select(*names).drop("session_id").write.mode("overwrite").parquet(f"{self.path}/llm_calls/session_id={session_id}")

    def save_session(self, session_id: str, **values) -> None:
        """A new state of a session; the latest counts."""
        self.append("sessions", [{"session_id": session_id, "created_at": now(), **values}])

    def sessions(self, last: int | None = None) -> DataFrame:
        """The latest state of each session, newest first."""
        return latest_sessions(self.table("sessions"), last)

    def findings(self, session_id: str) -> DataFrame:
        """A session's findings with the latest decision on each."""
        found = self.table("findings").filter(F.col("session_id") == session_id)
        latest = self.table("decisions").filter(F.col("session_id") == session_id).groupBy("finding_id").agg(F.max_by(F.struct("decision", "decided_at", "note"), "decided_at").alias("d"))
        got = found.join(latest, "finding_id", "left")
        return got.withColumns({"human_decision": F.coalesce("d.decision", "human_decision"), "human_decision_at": F.coalesce("d.decided_at", "human_decision_at"), "human_decision_note": F.coalesce("d.note", "human_decision_note")}).select(*[p.split(" ")[0] for p in SCHEMA.split(", ")])

    def decide(self, session_id: str, finding_id: str, decision: str, note: str = "") -> None:
        self.append("decisions", [{"session_id": session_id, "finding_id": finding_id, "decision": decision, "note": note, "decided_at": now()}])

    def session(self, session_id: str) -> dict:
        """The latest state of one session."""
        got = self.sessions().filter(F.col("session_id") == session_id).first()
        if got is None:
            raise StoreError(f"no session {session_id}")
        return got.asDict()

    def rules(self, session_id: str) -> list[dict]:
        """The rules that a session ran with."""
        latest = self.table("rule_snapshots").filter(F.col("session_id") == session_id).groupBy("rule_id").agg(F.max_by("body", "created_at").alias("body"))
        return [json.loads(r["body"]) for r in latest.orderBy("rule_id").collect()]

    def save_rules(self, session_id: str, rules) -> None:
        self.append("rule_snapshots", [{"session_id": session_id, "rule_id": r.id, "body": json.dumps(r.__dict__, default=str, sort_keys=True), "created_at": now()} for r in rules])


def latest_sessions(states: DataFrame, last: int | None = None) -> DataFrame:
    """Of states of sessions, the latest of each, the sessions that began last first; of many only the first `last`."""
    state = F.max(F.struct("created_at", "input_path", "input_hash", "config_hash", "status", "report"))
    latest = states.groupBy("session_id").agg(state.alias("s"), F.min("created_at").alias("started_at")).select("session_id", "started_at", "s.*")
    ordered = latest.orderBy(F.desc("started_at"), "session_id")
    return ordered.limit(last) if last is not None else ordered


def llm_stats(calls: DataFrame) -> DataFrame:
    """One row: calls, successes, tokens and mean latency."""
    return calls.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("success").alias("successes"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("long").alias("prompt_tokens"), F.coalesce(F.sum("response_tokens"), F.lit(0)).cast("long").alias("response_tokens"), F.round(F.avg("latency_ms"), 3).alias("latency_ms")
    )
