"""Make the library importable on executors, wherever the driver found it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the session's executors through Spark's file server, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root, place = Path(__file__).parent.parent, tempfile.mkdtemp(prefix="tallyspark-")
        shutil.copytree(root / "tallyspark", f"{place}/tree/tallyspark", ignore=shutil.ignore_patterns("__pycache__"))
        if (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", f"{place}/tree")
        context.addPyFile(shutil.make_archive(f"{place}/tallyspark", "zip", f"{place}/tree"))
        _SHIPPED.add(context.applicationId)
