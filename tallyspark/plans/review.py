"""An optional language-model reviewer of rows that no rule has flagged. Providers are pluggable; replies are validated by
column expressions before any of them becomes a finding."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import redact
from ..operators.findings import SEVERITIES, shaped
from .calls import CallLog

REPLY = "array<struct<row_index: long, severity: string, confidence: double, reasoning: string, column_name: string>>"


class Client(Protocol):
    """What a provider must offer; it travels to executors, so it must pickle."""

    name: str

    def healthy(self) -> bool: ...

    def complete(self, prompt: str) -> str: ...


@dataclass
class Stub:
    """Answers every prompt alike; for tests and dry runs."""

    reply: str = "[]"
    name: str = "stub"

    def healthy(self) -> bool:
        return True

    def complete(self, prompt: str) -> str:
        return self.reply


@dataclass
class HttpClient:
    """A chat endpoint over HTTP. kind `ollama` takes prompt and response at the top level, `chat` a list of messages."""

    name: str
    url: str
    model: str
    kind: str = "chat"
    key: str | None = None
    health_url: str | None = None
    timeout: float = 60.0

    def _call(self, url: str, body: dict | None) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode() if body is not None else None, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}))
        with urllib.request.urlopen(request, timeout=self.timeout) as got:
            return json.loads(got.read() or b"{}")

    def healthy(self) -> bool:
        if self.kind == "chat" and not self.key:
            return False
        try:
            if self.health_url:
                self._call(self.health_url, None)
            return True
        except OSError:
            return False

    def complete(self, prompt: str) -> str:
        if self.kind == "ollama":
            return self._call(self.url, {"model": self.model, "prompt": prompt, "stream": False})["response"]
        return self._call(self.url, {"model": self.model, "messages": [{"role": "user", "content": prompt}]})["choices"][0]["message"]["content"]


def route(clients: list[Client], primary: str | None = None) -> Client | None:
    """The first healthy client, the primary before the others in their order."""
    return next((c for c in sorted(clients, key=lambda c: c.name != primary) if c.healthy()), None)


def unfenced(reply: str) -> str:
    """A reply without the code fence around it."""
    m = re.fullmatch(r"\s*```[a-zA-Z]*\s*(.*?)\s*```\s*", reply, re.S)
    return m[1] if m else reply.strip()


def complete_json(client: Client, prompt: str, retries: int = 2) -> str | None:
    """A reply that is JSON, asked for again with a stricter prompt; None if none is."""
    for attempt in range(retries + 1):
        try:
            got = unfenced(client.complete(prompt if not attempt else f"{prompt}\nAnswer with JSON only, without any other text."))
            json.loads(got)
            return got
        except (ValueError, OSError, KeyError):
            time.sleep(0)
    return None


def batches(df: DataFrame, flagged: DataFrame, hidden: list[str], size: int = 50, row_index: str = "row_index") -> DataFrame:
    """(batch, row_index, row, flagged): rows that no rule has flagged, hidden columns redacted, in batches of about `size`, with
    the numbers of the flagged rows of the batch's stretch.

    A batch is a stretch of row numbers, so no row moves and no window is needed."""
    stretch = lambda c: F.floor(F.col(c) / size).cast("long").alias("batch")
    known = flagged.select(F.col("row_index").cast("long").alias("row_index")).distinct()
    rest = redact(df, hidden).join(known.withColumnRenamed("row_index", row_index), row_index, "left_anti")
    rows = rest.select(stretch(row_index), F.col(row_index).cast("long").alias("row_index"), F.to_json(F.struct(*[c for c in df.columns if c != row_index]), {"ignoreNullFields": "false"}).alias("row"))
    beside = known.groupBy(stretch("row_index")).agg(F.sort_array(F.collect_set("row_index")).alias("flagged"))  # at most `size` each
    return rows.join(beside, "batch", "left").select("batch", "row_index", "row", F.coalesce("flagged", F.array().cast("array<long>")).alias("flagged"))


def prompt_for(columns: list[str], rows: list[tuple[int, str]], flagged: list[int], about: dict[str, str] | None = None) -> str:
    """about: what the columns are, by name."""
    lines = "\n".join(f'{{"row_index": {i}, "data": {row}}}' for i, row in rows)
    told = ", ".join(f"{c} ({about[c]})" if about and about.get(c) else c for c in columns)
    return (
        f"These are records of a ledger with the columns {told}. Name the records that look wrong to an auditor.\nRows already flagged by rules: {', '.join(map(str, flagged)) or 'none'}\n{lines}\n"
        "Answer with a JSON array of objects with row_index, severity (high, medium or low), confidence (0 to 1), column_name and reasoning; the reasoning must quote a value of the record. Answer [] if none looks wrong."
    )


def ask(batched: DataFrame, client: Client, columns: list[str], retries: int = 2, log: CallLog | None = None, about: dict[str, str] | None = None) -> DataFrame:
    """(batch, reply): the client's reply on each batch, null where it fails. A batch is bounded, and batches go to tasks.

    With a log no prompt of its session is asked twice, whatever tasks are run again."""
    import pandas as pd

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        batch = int(pdf["batch"].iloc[0])
        prompt = prompt_for(columns, sorted(zip(pdf["row_index"], pdf["row"])), sorted(pdf["flagged"].iloc[0]), about)
        asked = lambda p: complete_json(client, p, retries)
        reply = log.once(batch, prompt, client.name, asked)["reply"] if log else asked(prompt)
        return pd.DataFrame({"batch": [batch], "reply": [reply]})

    return batched.groupBy("batch").applyInPandas(work, "batch long, reply string")


def validated(replies: DataFrame, batched: DataFrame, session_id: str = "session") -> DataFrame:
    """Findings from replies: the row must be in the batch, the confidence between 0 and 1, the severity known, and the
    reasoning must contain a value of the row of three characters or more. All else is discarded."""
    said = replies.select("batch", F.explode(F.from_json("reply", REPLY)).alias("x")).select("batch", "x.*")
    said = said.filter(F.lower("severity").isin(*SEVERITIES) & F.col("confidence").between(0, 1) & (F.trim("reasoning") != ""))
    joined = said.join(batched.select("batch", "row_index", "row"), ["batch", "row_index"])
    values = F.map_values(F.from_json("row", "map<string,string>"))
    quoted = F.exists(values, lambda v: (F.length(v) >= 3) & F.lower(F.col("reasoning")).contains(F.lower(v)))
    kept = joined.filter(quoted).withColumn("severity", F.lower("severity"))
    same = {"layer": F.lit(3), "finding_type": F.lit("anomaly"), "rule_id": F.lit(None).cast("string"), "rule_name": F.lit("LLM"), "detection_method": F.lit("llm"), "session_id": F.lit(session_id), "row_data": F.col("row")}
    return shaped(kept.withColumns(same).withColumn("finding_id", F.sha2(F.concat_ws("|", F.lit(session_id), F.lit("llm"), F.col("row_index").cast("string"), F.coalesce("column_name", F.lit(""))), 256)))
