"""Benchmark decontamination: size-partitioned MinHash containment search, native DataFrame operations only.

A test item is short and a document long, so the Jaccard similarity of their shingle sets is tiny whatever the item's
containment; the search therefore sketches the items alone. Each item gets a bottom-k MinHash sketch (its k smallest
shingle hashes), with k and the number of sketch hashes that a document must hold set by the item's size partition:
of an item with m shingles, a document that contains a share t of them misses at most floor((1 - t) * m), so it holds
at least k - floor((1 - t) * m) of any k. The search thus loses no document; candidates are then verified by exact
containment of the whole shingle sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, durable, join_sized, table

#: What separates words: all but letters, marks and digits.
BETWEEN = r"[^\p{L}\p{M}\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN), lambda x: x != "")


def _shingles(frame: DataFrame, width: int, name: str, hashed: bool) -> DataFrame:
    """frame (…, text) -> (…, name): a row for each distinct shingle of the whole text, as hash or string; rows without words go.

    The arrays are exploded as an expression: of a column, Spark would infer filters of its size and nulls, push them below
    all joins, and so make the shingles of every text up to three times."""
    one = lambda words, i: F.xxhash64(F.slice(words, i, width)) if hashed else F.array_join(F.slice(words, i, width), " ")
    starts = lambda words: F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))
    of = lambda words: F.when(F.size(words) > 0, F.array_distinct(F.transform(starts(words), lambda i: one(words, i))))
    bound = F.transform(F.array(_words(F.col("text"))), of)  # a lambda's variable is evaluated once, a column in a lambda at each step
    return frame.select(*[c for c in frame.columns if c != "text"], F.explode(bound[0]).alias(name))


def sketches(items: DataFrame, threshold: float, width: int, extra: int) -> DataFrame:
    """(hash, item, need, size): the sketch hashes of each item, with the number of them that a document must hold."""
    sets = _shingles(items, width, "hash", True).distinct()
    sets = sets.groupBy("item").agg(F.sort_array(F.collect_set("hash")).alias("set"))
    size, slack = F.size("set"), F.floor(F.size("set") * (1 - threshold) + 1e-9).cast("int")
    part = F.floor(F.log2(size)).cast("int")  # sizes 2^p .. 2^(p+1)-1 share the surplus p + extra, so larger items have more selective sketches
    k = F.least(size, slack + part + F.lit(extra))
    return sets.select("item", size.alias("size"), (k - slack).alias("need"), F.explode(F.slice("set", F.lit(1), k)).alias("hash"))


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = 0.75, width: int = 5, extra: int = 2, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (id_col, item_col, n_shared, n_item, containment): each document with each benchmark item of whose distinct
    word shingles it holds at least the share `threshold`.

    Words are runs of letters, marks and digits, lower-cased; texts of fewer than `width` words are one shingle of all
    their words. Null texts, empty texts and texts without words contain nothing and are contained in nothing. Rows that
    repeat an id count as one text with all their shingles; other columns are ignored; empty tables give an empty result.
    Rows with a null id are left out. Sketches and item sets are broadcast up to `limit` bytes and else joined by a shuffle."""
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col("text"))
    sketch = durable(sketches(items, threshold, width, extra))
    hits = join_sized(_shingles(texts, width, "hash", True), sketch, "hash", "inner", limit)
    hits = hits.groupBy("doc", "item").agg(F.count_distinct("hash").alias("n"), F.first("need").alias("need"))
    pairs = durable(hits.filter("n >= need").select("doc", "item"))
    suspects = durable(pairs.select("doc").distinct())
    sets = durable(_shingles(items, width, "shingle", False).distinct())
    sets = durable(sets.join(sets.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")), "item"))
    held = _shingles(join_sized(texts, suspects, "doc", "left_semi", limit), width, "shingle", False)
    shared = join_sized(join_sized(held, sets, "shingle", "inner", limit), pairs, ["doc", "item"], "left_semi", limit)
    shared = shared.groupBy("doc", "item", "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_item")
    return shared.filter(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_item", share.alias("containment"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every row of documents against every benchmark item."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH t AS (SELECT doc_id AS id, false AS item, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark),
w AS (SELECT id, item, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS ws FROM t),
s AS (SELECT DISTINCT id, item, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT id, item, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE item GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, n.n AS n_item, count(*) / n.n AS containment
FROM s d JOIN s b ON d.g = b.g AND NOT d.item AND b.item JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n HAVING 100 * count(*) >= 75 * n.n
"""
