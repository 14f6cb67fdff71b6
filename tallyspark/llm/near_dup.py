"""MinHash near-duplicates with sequential Bayesian verification.

Stages: shingle sets and signatures (one pass over the text); one representative for each different set; band buckets;
a round that compares each bucket's members with two leaders; then, within buckets that still hold several components,
every pair of members of different components, in blocks. A pair survives a comparison of signature batches while the
posterior probability that it reaches the threshold is at least `miss`; survivors are confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, durable, is_empty, join_sized, shingles_of, small_batches, table
from .components import components

HASHES, ROWS, BATCH = 128, 4, 16
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: Members that are compared with one copy of their leader's shingle set.
LEADER_BLOCK = 256
_A = np.random.default_rng(20240607).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 minima, each over one multiply-shift hash of the set."""
    got = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(shingles), 1024):
        part = shingles[start : start + 1024, None] * _A
        np.minimum(got, (part.min(axis=0) >> np.uint64(32)).astype(np.uint32), out=got)
    return got


@cache
def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """For each number of compared hashes, the fewest matches with which P(similarity >= threshold), under a uniform prior, is at least miss."""
    found = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while True:  # P(Beta(1 + m, 1 + n - m) >= t) = P(Binomial(n + 1, t) <= m)
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss or m == n:
                break
            m += 1
        found[n] = m
    return found


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Indices of the rows of two signature matrices that no batch rules out."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, least in least_matches(threshold, miss).items():
        if not len(alive):
            break
        part = slice(n - BATCH, n)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def _signed(batches, width: int) -> Iterator[pa.RecordBatch]:
    for batch in by_slices(batches, "text"):
        n, digest, sig, bands = [], [], [], []
        for text in batch.column("text").to_pylist():
            got = shingles_of(text, width)
            n.append(len(got))
            if not len(got):
                digest.append(None), sig.append(None)
                continue
            digest.append(xxhash.xxh3_128_digest(got.tobytes()))
            sig.append(signature(got).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["id", "n_shingles", "digest", "sig"])


def _banded(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        bands = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES // ROWS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(HASHES // ROWS, dtype=np.uint64), bands.shape[:2]).copy()
        for j in range(ROWS):
            key = (key ^ bands[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        nth = np.tile(np.arange(HASHES // ROWS, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(nth), pa.array(np.repeat(np.asarray(batch.column("id")), HASHES // ROWS))], ["band", "nth", "id"])


def _compared(batches, threshold: float, miss: float) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, sig_u, sig_v) -> those that the signatures don't rule out."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_u", "sig_v"))
            yield batch.select(["u", "v"]).take(pa.array(plausible(a, b, threshold, miss)))


def _runs(batches, columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The runs of equal (band, lo, hi) in rows sorted by them: one pair of blocks each, of bounded size."""
    key, rows = None, []
    for batch in batches:
        d = batch.to_pydict()
        for row in zip(*(d[c] for c in ["band", "lo", "hi", *columns])):
            if row[:3] != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = row[:3], []
            rows.append(row[3:])
    if len(rows) > 1:
        yield key, rows


def _block_pairs(rows: list[tuple], sig: np.ndarray, threshold: float, miss: float) -> Iterator[tuple[int, np.ndarray]]:
    """For rows (nth band, block, component, …) of two blocks or one: a row's index and those of its plausible partners.

    Partners are of another component, in the other block if there are two, and share no earlier band, so that a pair
    comes up in one bucket only."""
    block, comp = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)
    nth = rows[0][0]
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    for i in left:
        other = right[comp[right] != comp[i]]
        if block[i] == block.max():
            other = other[other > i]
        if nth and len(other):
            same = (sig[other, : nth * ROWS] == sig[i, : nth * ROWS]).reshape(len(other), nth, ROWS).all(axis=2).any(axis=1)
            other = other[~same]
        if len(other):
            found = other[plausible(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other], threshold, miss)]
            if len(found):
                yield int(i), found


def _active(batches, threshold: float, miss: float) -> Iterator[pa.RecordBatch]:
    """Sorted rows (band, lo, hi, nth, block, component, id, sig) -> those with a plausible partner, without sig."""
    for (band, lo, hi), rows in _runs(batches, ["nth", "block", "component", "id", "sig"]):
        if lo != hi and len({r[1] for r in rows}) < 2:
            continue
        sig, on = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(-1, HASHES), set()
        for i, found in _block_pairs(rows, sig, threshold, miss):
            on.add(i), on.update(found.tolist())
        if on:
            kept = [rows[i] for i in sorted(on)]
            same = lambda v, n=len(kept), **k: pa.array([v] * n, **k)
            yield pa.RecordBatch.from_arrays([same(band, type=pa.int64()), same(lo, type=pa.int32()), same(hi, type=pa.int32()), *(pa.array([r[j] for r in kept], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64())))], ["band", "lo", "hi", "nth", "block", "component", "id"])


def _linked(batches, threshold: float, miss: float) -> Iterator[pa.RecordBatch]:
    """Sorted rows (band, lo, hi, nth, block, component, id, shingles) -> links between components, enough to connect all
    that are linked: a pair whose components earlier pairs have connected needs no look at its sets."""
    for (_, lo, hi), rows in _runs(batches, ["nth", "block", "component", "id", "shingles"]):
        if lo != hi and len({r[1] for r in rows}) < 2:
            continue
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = c = parent.get(parent[c], parent[c])
            return c

        u, v = [], []
        for i, found in _block_pairs(rows, np.stack([signature(x) for x in sets]), threshold, miss):
            for j in found.tolist():
                a, b = root(rows[i][2]), root(rows[j][2])
                if a != b and similar(sets[i], sets[j], threshold):
                    parent[max(a, b)] = min(a, b)
                    u.append(rows[i][3]), v.append(rows[j][3])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets reach the threshold, in whole percent."""
    percent = round(threshold * 100)
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(batches, width: int) -> Iterator[pa.RecordBatch]:
    for batch in by_slices(batches, "text"):
        sets = [shingles_of(text, width).tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["id", "shingles"])


def _confirmed(batches, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (leader, part, role, id, shingles), the leader's row first in each (leader, part) -> links."""
    held, own = None, np.empty(0, np.uint64)
    for batch in batches:
        u, v = [], []
        for leader, role, id_, data in zip(*(batch.column(c) for c in ("leader", "role", "id", "shingles"))):
            got, leader = np.frombuffer(data.as_buffer(), np.uint64), leader.as_py()
            if not role.as_py():
                held, own = leader, got.copy()
            elif held == leader:
                if similar(own, got, threshold):
                    u.append(leader), v.append(id_.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def confirm(texts: DataFrame, pairs: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs (u, v) of texts (id, text) that reach the threshold on their full shingle sets.

    Members meet one copy of their leader's set per block of pairs, so no leader gathers its members in a task."""
    part = F.pmod(F.xxhash64("v"), F.greatest(F.lit(1), F.ceil(F.col("n") / LEADER_BLOCK)).cast("long")).cast("int")
    pairs = join_sized(pairs, durable(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))), "u", "inner").select("u", "v", part.alias("part"))
    needs = pairs.select(F.col("v").alias("id"), "u", "part", F.lit(1).alias("role")).union(pairs.select(F.col("u").alias("id"), "u", "part", F.lit(0).alias("role")).distinct())
    needs = durable(needs.groupBy("id").agg(F.collect_list(F.struct(F.col("u").alias("leader"), "part", "role")).alias("needs")))
    sets = join_sized(texts, needs.select("id"), "id", "left_semi").mapInArrow(lambda b: _sets(b, width), "id long, shingles binary")
    rows = join_sized(sets, needs, "id", "inner").select("id", "shingles", F.explode("needs").alias("x")).select("x.leader", "x.part", "x.role", "id", "shingles")
    return rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "role").mapInArrow(lambda b: _confirmed(b, threshold), "u long, v long")


def linked_leaders(texts: DataFrame, rest: DataFrame, sig: DataFrame, threshold: float, width: int, miss: float) -> DataFrame:
    """Links (u, v) of the members of each bucket of rest (band, nth, id, component) with the bucket's two leaders: its
    smallest id and the first id in the order of a hash, so that a group of copies has much the same few leaders in all bands."""
    leaders = durable(rest.groupBy("band").agg(F.array_distinct(F.array(F.min("id"), F.min_by("id", F.xxhash64("id")))).alias("lead")))
    pairs = join_sized(rest, leaders, "band", "inner").select("id", F.explode("lead").alias("lead")).filter("id <> lead")
    pairs = pairs.select(F.least("id", "lead").alias("u"), F.greatest("id", "lead").alias("v")).distinct()
    pairs = pairs.join(sig.toDF("u", "sig_u"), "u").join(sig.toDF("v", "sig_v"), "v")
    pairs = pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(lambda b: _compared(b, threshold, miss), "u long, v long")
    return confirm(texts, durable(pairs), threshold, width)


def linked_blocks(texts: DataFrame, rest: DataFrame, sig: DataFrame, threshold: float, width: int, miss: float) -> DataFrame:
    """Links (u, v) that connect the components in each bucket of rest (band, nth, id, component), all pairs considered.

    A bucket is cut into blocks of about BLOCK members and a task compares two blocks, on signatures; only members with a
    plausible partner then send their shingle sets there."""
    size = rest.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    rows = rest.join(size, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    place = ["band", "lo", "hi", "nth", "block", "component", "id"]
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).join(sig, "id").select(*place, "sig")
    rows = rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    active = rows.mapInArrow(lambda b: _active(b, threshold, miss), "band long, lo int, hi int, nth int, block int, component long, id long")
    needs = durable(active.groupBy("id").agg(F.collect_list(F.struct(*place[:-1])).alias("needs")))
    sets = join_sized(texts, needs.select("id"), "id", "left_semi").mapInArrow(lambda b: _sets(b, width), "id long, shingles binary")
    rows = join_sized(sets, needs, "id", "inner").select("id", "shingles", F.explode("needs").alias("x")).select("x.*", "id", "shingles")
    return rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(lambda b: _linked(b, threshold, miss), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, width: int = 5, miss: float = 1e-6) -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept): a row per input row, grouped by links of Jaccard >= threshold.

    A document's set: its distinct word shingles of `width`, of the whole sequence if it has fewer words (A-Z
    lower-cased, split at ASCII white space). Null, empty and blank texts have no shingles, link with nothing and stay.
    component_id is the smallest id reachable over links. Rows that repeat an id share its row's result. Ids are long;
    a row with a null id is its own component, null, and stays. Other columns are ignored; an empty table gives an empty
    result. Banding misses a pair at similarity s with probability (1 - s^4)^32 (5e-6 at 0.75), pruning with `miss`."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = durable(texts.mapInArrow(lambda b: _signed(b, width), "id long, n_shingles long, digest binary, sig binary"))
    reps = durable(signed.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("sig").alias("sig")))
    bands = durable(reps.select("id", "sig").mapInArrow(_banded, "band long, nth int, id long"))
    bands = bands.join(bands.groupBy("band").count().filter("count > 1").select("band"), "band", "left_semi")
    rest = durable(bands.select("band", "nth", "id", F.col("id").alias("component")))
    sig = reps.select("id", "sig")
    links, labels = None, None
    for led in (True, False):
        if is_empty(rest):
            break
        found = linked_leaders if led else linked_blocks
        got = durable(found(texts, rest, sig, threshold, width, miss))
        if is_empty(got):
            continue
        links = got if links is None else links.union(got)
        labels = components(links)
        if led:
            rest = join_sized(rest.drop("component"), labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
            several = rest.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("band")
            rest = durable(rest.join(several, "band", "left_semi").select("band", "nth", "id", "component"))
    classes = reps.select("digest", F.col("id").alias("rep"))
    if labels is not None:
        classes = join_sized(classes, labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    else:
        classes = classes.select("digest", F.col("rep").alias("component"))
    found = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "id"))
    return signed.select("id", "n_shingles", "digest").join(classes, "digest", "left").select(F.col("id").alias(id_col), "n_shingles", found.alias("component_id"), F.col("id").eqNullSafe(found).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the near-duplicate class of every row of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id WHERE r.c < e.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
"""
