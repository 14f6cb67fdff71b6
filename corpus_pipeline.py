"""A pipeline over the documents table: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents. A null text is
not toxic, is one empty line after line dedup, has no near copy, holds no benchmark item and is packed as its end alone.
Rows that repeat an id are one document to the stages that compare documents and go or stay together; rows with a null id are
compared with nothing and stay. Tables without rows give tables without rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from tallyspark.llm.common import durable, join_sized, shared_folder, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of any toxic grade is below one half; the model learns from the labelled rows among docs."""
    return toxicity.clean_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of 10 or more code points that a document of smaller id holds too; n_chars follows."""
    kept = line_dedup.dedup_lines(docs)
    now = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*[now.get(c, F.col("row")[c] if c != "text" else None).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group, and all documents without any."""
    found = near_dup.near_duplicates(docs)
    return join_sized(docs, durable(found.filter(~F.col("kept")).select("doc_id").distinct()), "doc_id", "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"))
    return join_sized(docs, durable(found.select("doc_id").distinct()), "doc_id", "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: Neither the toxicity model nor the tokenizer can be written in SQL; tests/llm/test_pipeline.py has a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared checkpoint folder and read again."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
