"""Connected components by repeated edge contraction, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, is_empty, sized


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long) -> (id, component): each id of an edge with the smallest id it can reach.

    Every round hooks each vertex to the first among itself and its neighbours, in the order of their hashes, relabels the
    edges by the hooks and drops loops and repeats, until no edge is left. A star takes two rounds at most, whatever its
    centre, and a chain's hashes have no long run in order, whatever its ids, so rounds grow with the logarithm of a
    component's size. Vertices and edges stay in tables; nothing is gathered."""
    edges = durable(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct().select("id", F.col("id").alias("root"))
    while not is_empty(edges):
        rank = lambda c: F.struct(F.xxhash64(F.col(c)), F.col(c).alias("v"))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = sized(durable(both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least("m", rank("u"))["v"].alias("p"))))
        labels = durable(labels.join(hook.toDF("root", "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root")))
        edges = edges.join(hook, "u").select(F.col("v").alias("u"), F.col("p").alias("a")).join(hook, "u").select("a", F.col("p").alias("b"))
        edges = durable(edges.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    return durable(labels.join(labels.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component"))
