"""A log of calls to a language model, consulted before each call, so that tasks that are run again do not ask again."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files

ENTRY = "session_id string, batch long, prompt_hash string, provider string, reply string, success boolean, prompt_tokens long, response_tokens long, latency_ms long, asked_at string, answered_at string"
#: Characters that count as a token where a provider does not say.
TOKEN_CHARS = 4


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


@dataclass(frozen=True)
class CallLog:
    """A folder that driver and executors share, with a file for each answered prompt of a session, named by batch and prompt.

    A file is moved to its place whole, after the answer. In a folder of a file system with exclusive creation (any mounted
    one) a task also claims a prompt before it asks, and others wait for its answer, or for `lease` seconds after a claim whose
    task has died; in object stores, where there is none, switch speculation off for the review."""

    root: str
    session_id: str
    lease: float = 300.0

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(self.root))

    def once(self, batch: int, prompt: str, provider: str, ask: Callable[[str], str | None]) -> dict:
        """The logged entry for the prompt, or that of asking now. A failed call (None) is logged as well."""
        from pyarrow import fs as kinds

        fs, base = self._fs()
        digest = hashlib.sha256(prompt.encode()).hexdigest()
        folder = f"{base}/{self.session_id}"
        place = f"{folder}/{batch:012d}-{digest[:32]}.json"
        fs.create_dir(folder, recursive=True)
        claim = f"{place}.claim" if isinstance(fs, kinds.LocalFileSystem) else None
        while True:
            if fs.get_file_info(place).type == kinds.FileType.File:
                with fs.open_input_stream(place) as f:
                    return json.loads(f.read())
            if claim is None:
                break
            try:
                os.close(os.open(claim, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                break
            except FileExistsError:
                try:
                    if time.time() - os.stat(claim).st_mtime > self.lease:
                        os.rename(claim, f"{claim}.{uuid.uuid4().hex}")  # one of those that wait succeeds
                        continue
                except FileNotFoundError:
                    continue
                time.sleep(0.05)
        try:
            asked, began = _now(), time.time()
            reply = ask(prompt)
            entry = {
                "session_id": self.session_id, "batch": batch, "prompt_hash": digest, "provider": provider, "reply": reply, "success": reply is not None, "prompt_tokens": -(-len(prompt) // TOKEN_CHARS),
                "response_tokens": -(-len(reply or "") // TOKEN_CHARS), "latency_ms": round((time.time() - began) * 1000), "asked_at": asked, "answered_at": _now(),
            }
            part = f"{folder}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                f.write(json.dumps(entry).encode())
            fs.move(part, place)
            return entry
        finally:
            if claim:
                try:
                    os.remove(claim)
                except FileNotFoundError:
                    pass

    def entries(self, spark: SparkSession) -> DataFrame:
        """All logged calls of the session, a row for each batch and prompt."""
        folder = f"{self.root}/{self.session_id}"
        if not Files(spark, folder).exists() or not [1 for p, _ in Files(spark, folder).listed() if p.endswith(".json")]:
            return spark.createDataFrame([], ENTRY)
        return spark.read.schema(ENTRY).json(f"{folder}/*.json")


def trail_rows(calls: DataFrame) -> DataFrame:
    """Two entries a call, in an order that does not depend on which task made them or when: (batch, step, action, summary,
    details, at)."""
    asked = F.struct(F.lit(0).alias("step"), F.lit("REVIEW_ASKED").alias("action"), F.format_string("batch %d asked of %s", "batch", "provider").alias("summary"), F.to_json(F.struct("prompt_hash", "prompt_tokens")).alias("details"), F.col("asked_at").alias("at"))
    summary = F.when(F.col("success"), F.format_string("batch %d answered", "batch")).otherwise(F.format_string("batch %d failed", "batch"))
    answered = F.struct(F.lit(1).alias("step"), F.lit("REVIEW_ANSWERED").alias("action"), summary.alias("summary"), F.to_json(F.struct(F.sha2(F.coalesce("reply", F.lit("")), 256).alias("reply_hash"), "response_tokens", "latency_ms", "success")).alias("details"), F.col("answered_at").alias("at"))
    return calls.select("batch", "prompt_hash", F.inline(F.array(asked, answered))).orderBy("batch", "prompt_hash", "step").drop("prompt_hash")
