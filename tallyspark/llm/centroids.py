"""Centroid clustering of integer vectors, centroids filtered by n-simplex projection.

Distances from each vector to a few pivots are computed once and kept, as the coordinates of an apex over the simplex that
the pivots span. Distances between apexes bound the true distance from below, and with the last coordinate mirrored from
above, so centroids are ruled out by these bounds and only those left are compared in exact integers. The pivots are the
centroids of the round in which the distances were computed: a centroid near their span has a small height, which is what
makes its bounds tight. When centroids have moved too far from it, distances to the present ones are computed and kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, small_batches, table

#: Components lie within +-LIMIT, so that a squared distance of 64 components fits in 64 bits.
LIMIT = (1 << 27) - 1
#: Vectors, first in hash order, on which the driver tries whether the kept distances still rule centroids out.
TRIAL = 256
#: Rows compared at once.
BLOCK = 2048


class Simplex:
    """The simplex that affinely independent pivots span, in coordinates of as many dimensions less one."""

    def __init__(self, pivots: np.ndarray):
        """pivots: integer rows; a pivot in the span of those before adds no dimension and is left out."""
        self.pivots, self.base = pivots[:1], np.zeros((1, 0))
        for pivot in pivots[1:]:
            apex = self.apexes(pivot[None])[0]
            if apex[-1] > 1e-3 * max(1.0, float(np.abs(apex).max())):
                self.base = np.vstack([np.pad(self.base, ((0, 0), (0, 1))), apex])
                self.pivots = np.vstack([self.pivots, pivot])

    def apexes(self, rows: np.ndarray) -> np.ndarray:
        """For each row the point at its distances from the pivots: its place in their span, and last its height above it."""
        squares = np.stack([squared(rows, p) for p in self.pivots], axis=1).astype(np.float64)
        n = len(self.pivots)
        out = np.zeros((len(rows), n))
        for j in range(1, n):  # the j-th pivot is the first with a part in dimension j - 1, and has none beyond it
            own = self.base[j, :j]
            inner = (squares[:, 0] - squares[:, j] + own @ own) / 2 - out[:, : j - 1] @ own[:-1]
            out[:, j - 1] = inner / own[-1]
        out[:, -1] = np.sqrt(np.maximum(squares[:, 0] - (out[:, :-1] ** 2).sum(1), 0))
        return out


def squared(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    gap = rows - one
    return np.einsum("ij,ij->i", gap, gap)


def nearest(rows: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, the smaller of equals; squared distance; exact comparisons) of each row."""
    own = simplex.apexes(centroids)
    flat = ((apexes[:, None, :-1] - own[None, :, :-1]) ** 2).sum(2)
    low = flat + (apexes[:, None, -1] - own[None, :, -1]) ** 2
    high = flat + (apexes[:, None, -1] + own[None, :, -1]) ** 2
    size = (apexes**2).sum(1)[:, None] + (own**2).sum(1)[None]
    possible = low <= high.min(1)[:, None] + 1e-7 * size + 1e-3  # rounding loses no centroid
    best, which = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int64)
    for k in range(len(centroids)):
        at = np.flatnonzero(possible[:, k])
        got = squared(rows[at], centroids[k])
        less = got < best[at]
        best[at[less]], which[at[less]] = got[less], k
    return which, best, int(possible.sum())


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for start in range(0, batch.num_rows, BLOCK):
        part = batch.slice(start, BLOCK)
        vec, apex = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for c in ("vec", "apex"))
        yield part, vec.astype(np.int64), apex


def _projected(batches, simplex: Simplex, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            vec = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
            apex = simplex.apexes(vec)
            offsets = pa.array(np.arange(0, apex.size + 1, apex.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(kind), batch.column("vec"), pa.ListArray.from_arrays(offsets, pa.array(apex.ravel()))], ["id", "vec", "apex"])


def _summed(batches, centroids: np.ndarray, simplex: Simplex) -> Iterator[pa.RecordBatch]:
    """A row per cluster for all rows of a task: (cluster, n, sums)."""
    n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for batch in batches:
        for _, vec, apex in _blocks(batch):
            which = nearest(vec, apex, centroids, simplex)[0]
            n += np.bincount(which, minlength=len(n))
            np.add.at(sums, which, vec)
    held = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def _assigned(batches, centroids: np.ndarray, simplex: Simplex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, vec, apex in _blocks(batch):
            which, best, looked = nearest(vec, apex, centroids, simplex)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(which.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, vec) of the vectors of exactly `dim` components, none null or non-finite: floor(scale * component) each."""
    v = F.col("_v")
    whole = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("_v")).filter(whole)
    return kept.select("id", F.transform(v, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * scale))).cast("int")).alias("vec"))


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1, refresh: float = 0.5) -> DataFrame:
    """A row per kept vector: id_col, cluster, distance (squared, to its centroid), cluster_inertia, inertia,
    centroid_sha256.

    Vectors with another number of components, or a null or non-finite one, are left out; a component x becomes
    floor(scale * x), held within +-(2^27 - 1). Centroids start as the k vectors of smallest SHA-256 of "seed:id" (equal ids:
    in the order of their components), all vectors if there are fewer; rounds of exact assignment and floored means follow.
    A centroid that is nearest to no vector stays where it is. Rows that repeat an id are vectors of their own; a row with a
    null id starts no centroid but is assigned. With no id at all, or no vectors, the result is empty. Other columns are
    ignored.

    Distances to pivots are computed anew when, on the first TRIAL vectors in hash order, the old ones leave more than the share
    `refresh` of all comparisons; that changes no result. Vectors move in no shuffle: each task sends one row of sums a
    cluster, and k centroids and pivots of dim components are all that goes to every task."""
    small_batches(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType
    arrow = to_arrow_type(kind)
    rows = integer_vectors(vectors, id_col, vector_col, dim, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.filter(F.col("id").isNotNull()).select(order.alias("h"), "vec").orderBy("h", "vec").limit(max(k, TRIAL)).collect()
    shape = f"{id_col} {kind.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], shape)
    trial = np.array([r["vec"] for r in first], np.int64)
    centroids, simplex, kept = trial[:k], None, None

    def projected() -> tuple[Simplex, DataFrame]:
        """The kept distances, if they serve for the present centroids, or new ones to these."""
        if simplex and nearest(trial, simplex.apexes(trial), centroids, simplex)[2] <= refresh * len(trial) * len(centroids):
            return simplex, kept
        own, source = Simplex(centroids), rows if kept is None else kept.select("id", "vec")
        return own, durable(source.mapInArrow(lambda b: _projected(b, own, arrow), f"id {kind.simpleString()}, vec array<int>, apex array<double>"))

    for _ in range(rounds):
        simplex, kept = projected()
        parts = kept.mapInArrow(lambda b, c=centroids, s=simplex: _summed(b, c, s), "cluster int, n long, sums array<long>")
        total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(dim)])
        centroids = centroids.copy()
        for r in total.collect():  # at most k rows
            centroids[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(dim)]
    simplex, kept = projected()
    found = durable(kept.mapInArrow(lambda b: _assigned(b, centroids, simplex), f"id {kind.simpleString()}, cluster int, distance long"))
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = vectors.sparkSession.createDataFrame([(c, s, sum(inertia.values()), _digest(centroids[c])) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # facts: at most k rows


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every kept row of embeddings with its cluster."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = 3) -> str:
    """The same rounds as one statement, distances to all centroids computed."""
    gap = "list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = """WITH r AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM r WHERE vec_id IS NOT NULL QUALIFY c < 16)"""
    for i in range(rounds + 1):
        steps += f",\na{i} AS MATERIALIZED (SELECT r.vec_id, r.v, min(struct_pack(d := {gap}, c := c.c)) AS best FROM r, c{i} c GROUP BY r.vec_id, r.v)"
        if i < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            steps += f",\nm{i} AS (SELECT best.c AS c, p, sum(v[p])::BIGINT AS s, count(*) AS n FROM a{i}, unnest(range(1, 65)) AS u(p) GROUP BY best.c, p)"
            steps += f",\nc{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list({mean} ORDER BY p) AS v FROM m{i} GROUP BY c) m ON c.c = m.c)"
    return steps + f"""
SELECT a.vec_id, a.best.c::INTEGER AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY a.best.c)::BIGINT AS cluster_inertia, sum(a.best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c
"""


SQL = _sql()
