"""Outputs of a run's layers, kept so that a run that was cut short goes on where it stopped.

A stage is addressed by a hash of all that it is made from: input, configuration, code. It counts only once its commit marker is
there, which is written whole and last; what an attempt without a marker left is never read."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import CheckpointError
from ..operators.digest import hash_record
from ..sources.files import Files


@cache
def code_version() -> str:
    """A digest of the library's own source files."""
    root = Path(__file__).parent.parent
    digest = hashlib.sha256()
    for path in sorted(p for p in root.rglob("*") if p.suffix in (".py", ".yaml") and "llm" not in p.relative_to(root).parts):
        digest.update(f"{path.relative_to(root)}\n".encode() + path.read_bytes())
    return digest.hexdigest()


class Stages:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def key(*parts) -> str:
        """The address of what is made from the parts by this version of the code."""
        return hash_record({"parts": parts, "code": code_version()})

    def _place(self, layer: str, key: str) -> str:
        return f"{self.root}/{layer}-{key[:32]}"

    def _marker(self, layer: str, key: str) -> Files:
        return Files(self.spark, f"{self._place(layer, key)}/COMMIT.json")

    def load(self, layer: str, key: str) -> tuple[DataFrame, dict] | None:
        """A stage's table and facts, if it has been committed."""
        marker = self._marker(layer, key)
        if not marker.exists():
            return None
        try:
            stated = json.loads(marker.read())
            return self.spark.read.parquet(f"{self._place(layer, key)}/{stated['data']}"), stated["facts"]
        except (ValueError, KeyError, OSError) as error:
            raise CheckpointError(f"{self._place(layer, key)}: {error}") from error

    def save(self, layer: str, key: str, df: DataFrame, facts: dict | Callable[[], dict]) -> tuple[DataFrame, dict]:
        """Write a stage and commit it; its table, read back, and its facts. facts may be what is known only after the write."""
        data = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self._place(layer, key)}/{data}")
        known = facts() if callable(facts) else facts
        self._marker(layer, key).write(json.dumps({"data": data, "facts": known}).encode())
        return self.spark.read.parquet(f"{self._place(layer, key)}/{data}"), known
