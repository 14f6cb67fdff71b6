"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, durable, join_sized, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest_all: bool = False) -> DataFrame:
    """Group the rows of docs whose texts are equal once ASCII white space is deleted.

    Returns a row per input row: id_col, keep_id (of the row that stays: most code points, then smallest id),
    group_size, kept, text_sha256 (of the normalised text; without digest_all only rows that share length and prefix
    have it, as only those are hashed in full).

    A row is compared by (length), then (length, hash of the first `prefix` code points), then (length, SHA-256); each
    level keeps only the rows of groups with more than one. Without digest_all the full hash reads only the texts of the
    groups that are left; with it all texts are hashed, as all digests are asked for, and refinement spares the rest of
    the rows the grouping by digest. Counts are combined before the shuffle; the groups of each level are joined back by
    their measured size, so a hot length or a large group of copies is no task's alone.

    Null text is empty; all empty texts are one group. Rows that repeat an id are rows of their own and all with the
    staying id are kept. A null id is the last choice to stay. Other columns are ignored. An empty table gives an empty result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.regexp_replace(text, f"{SPACE}+", "")
    base = docs.select(F.col(id_col).alias("_id"), F.length(text).alias("_cp"), plain.alias("_plain"))
    base = base.select("_id", "_cp", F.octet_length("_plain").alias("_len"), F.xxhash64(F.substring("_plain", 1, prefix)).alias("_head"), "_plain")
    full = F.sha2("_plain", 256).alias("_sha")
    row = ["_id", "_cp", "_len", "_head"]
    narrow = durable(base.select(*row, *([full] if digest_all else [])))
    more = F.col("count") > 1
    lengths = durable(narrow.groupBy("_len").count().filter(more).select("_len"))
    heads = durable(join_sized(narrow, lengths, "_len", "left_semi").groupBy("_len", "_head").count().filter(more).select("_len", "_head"))
    if digest_all:
        some = join_sized(narrow, heads, ["_len", "_head"], "left_semi")
    else:
        some = durable(join_sized(base, heads, ["_len", "_head"], "left_semi").select(*row, full))
        narrow = join_sized(narrow, heads, ["_len", "_head"], "left_anti").withColumn("_sha", F.lit(None).cast("string")).unionByName(some)
    best = F.max_by(F.struct("_id"), F.struct("_cp", F.col("_id").isNotNull(), F.negative("_id")))
    groups = durable(some.groupBy("_len", "_sha").agg(best.alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_len", "_sha", F.col("_keep._id").alias("_keep"), "_n"))
    keep = F.when(F.col("_n").isNotNull(), F.col("_keep")).otherwise(F.col("_id"))
    return join_sized(narrow, groups, ["_len", "_sha"], "left").select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_sha").alias("text_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every row of documents, with the row of its group that stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept, text_sha256
FROM d
"""
