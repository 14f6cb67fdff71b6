"""Digests of strings, records, files and tables, and hash trees over row numbers that tell where two tables differ."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files

#: Rows of a leaf, and children of a node.
LEAF, FANOUT = 1024, 32
#: A row's SHA-256 is summed in so many parts of 12 hexadecimal digits each; sums can be added up in any order.
PARTS = 5
SUMS = [f"s{k}" for k in range(PARTS)]


def hash_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def hash_record(record: dict) -> str:
    """The digest of a dictionary, whatever the order of its keys."""
    return hash_text(json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str))


def hash_file(spark: SparkSession, path: str) -> str:
    """The SHA-256 of one file of any store that Spark reads."""
    return Files(spark, path).sha256()


def verify_hash(found: str, stated: str) -> bool:
    """Whether two digests are the same, whatever the case of their letters."""
    return hmac.compare_digest(found.lower(), stated.lower())


def text_digest(column: str) -> Column:
    """The digest of each text of a column, as hash_text gives it; null of null."""
    return F.sha2(F.encode(F.col(column), "UTF-8"), 256)


def _row_parts(df: DataFrame, columns: list[str]) -> list[Column]:
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
    return [F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)").alias(SUMS[k]) for k in range(PARTS)]


def hash_table(df: DataFrame) -> str:
    """A digest of a table's content that depends on neither the order of rows nor that of columns; repeated rows count."""
    got = df.select(*_row_parts(df, df.columns)).agg(F.count(F.lit(1)), *[F.sum(s).cast("string") for s in SUMS]).first()
    return hash_text("|".join(str(x) for x in got))


def hash_tree(df: DataFrame, row_index: str = "row_index", leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(level, node, n, s0, …): level 0 has a node for every `leaf` row numbers, each level above one for `fanout` nodes below,
    up to a level with one node. A node's sums are its children's, so each level is counted from the one below; numbers are
    not negative. An empty table has no nodes."""
    own = [c for c in df.columns if c != row_index]
    rows = df.select(F.floor(F.col(f"`{row_index}`") / leaf).cast("long").alias("node"), *_row_parts(df, own))
    sums = [F.sum(s).cast("decimal(38,0)").alias(s) for s in SUMS]
    level = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *sums)
    last = (df.agg(F.max(f"`{row_index}`")).first()[0] or 0) // leaf
    out, k = level.withColumn("level", F.lit(0)), 0
    while last > 0:
        last, k = last // fanout, k + 1
        level = level.groupBy(F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(F.sum("n").alias("n"), *sums)
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select("level", "node", "n", *SUMS)


def save_tree(tree: DataFrame, path: str) -> None:
    """Keep a tree by level, so that a comparison reads of each level only what it needs."""
    tree.write.mode("overwrite").partitionBy("level").parquet(path)


def differing_ranges(a: DataFrame, b: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(first_row, last_row, rows_a, rows_b): the leaves that differ between two trees, each as its range of row numbers.

    Compared from the highest level down: of a level only the children of nodes that differ above are looked at. Of trees of
    different heights the higher one's node 0 has no equal above the lower one's top, so all that is below it is looked at.
    Equal trees give no rows."""
    tops = [t.agg(F.max("level")).first()[0] for t in (a, b)]
    top = max((t for t in tops if t is not None), default=0)
    found = None
    for level in range(top, -1, -1):
        sides = []
        for side, tree in (("a", a), ("b", b)):
            own = tree.filter(F.col("level") == level).select("node", F.col("n").alias(f"n_{side}"), F.struct("n", *SUMS).alias(f"h_{side}"))
            if found is not None:
                own = own.withColumn("above", F.floor(F.col("node") / fanout).cast("long")).join(found.select(F.col("node").alias("above")), "above", "left_semi").drop("above")
            sides.append(own)
        differ = sides[0].join(sides[1], "node", "full_outer").filter(~F.col("h_a").eqNullSafe(F.col("h_b")))
        found = differ.select("node", "n_a", "n_b")
    return found.select((F.col("node") * leaf).alias("first_row"), (F.col("node") * leaf + (leaf - 1)).alias("last_row"), F.coalesce("n_a", F.lit(0)).alias("rows_a"), F.coalesce("n_b", F.lit(0)).alias("rows_b"))
