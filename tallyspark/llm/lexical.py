"""Ranked lexical search of a query set over all documents, hybrid term-at-a-time and document-at-a-time.

One pass over the documents keeps, segment by segment, the postings of the query set's terms; corpus counts come from the
segments, and a second pass searches each of them. There the short lists of an item are summed term by term into
accumulators, and these serve as one more list, with its greatest sum as bound, beside the long ones: in the order of
documents, stretches whose bounds can't reach the item's present top are skipped, and long lists are looked up only for
documents that still can."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, by_slices, durable, small_batches, table

#: All but letters, digits and what is not ASCII separates terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Documents, and postings, of a segment at most (a document is never split; it has a posting for each query term at most).
SEGMENT_DOCS = 8192
SEGMENT_POSTINGS = 1 << 20
#: Postings that a search task reads at least, and partial tops merged by one key.
TASK_POSTINGS = 1 << 20
MERGED = 64
#: A list of up to this share of a segment's documents is short.
SHORT = 1 / 16
#: Documents whose bounds are looked at together.
STRETCH = 128


def terms_of(text: Column) -> Column:
    """The terms of a text, in order, with repeats."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), BETWEEN), lambda x: x != "")


def _segments(batches, vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) -> segments (n_docs, n_terms, ids, lengths, terms, counts, docs, tfs): ids of documents with a query
    term, ascending, with their lengths; for each query term in the segment the number of its postings, which are pairs of
    a document's place in ids and a frequency, in the order of terms and places. Rows with a null id are counted only:
    their place is -1."""
    held: list[tuple] = []
    n_docs = n_terms = size = 0

    def segment() -> pa.RecordBatch:
        nonlocal held, n_docs, n_terms, size
        held.sort(key=lambda d: (d[0] is None, d[0] or 0))
        named = [d for d in held if d[0] is not None]
        place = np.repeat([i if d[0] is not None else -1 for i, d in enumerate(held)], [len(d[2]) for d in held])
        term, tf = (np.concatenate([np.empty(0, np.int64), *(d[j] for d in held)]) for j in (2, 3))
        order = np.lexsort((place, term))
        terms, counts = np.unique(term, return_counts=True)
        lists = ([d[0] for d in named], [d[1] for d in named], terms, counts, place[order], tf[order])
        row = [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())]
        row += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(np.asarray(x, np.int64)).cast(t)) for x, t in zip(lists, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        held, n_docs, n_terms, size = [], 0, 0, 0
        return pa.RecordBatch.from_arrays(row, ["n_docs", "n_terms", "ids", "lengths", "terms", "counts", "docs", "tfs"])

    for batch in by_slices(batches, "text"):
        for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            words = text.encode().translate(_TO_TERMS).split() if text else []
            if words:
                found = np.array([t for t in map(vocabulary.get, words) if t is not None], np.int64)
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                if len(found):
                    own, tf = np.unique(found, return_counts=True)
                    held.append((id_, len(words), own, tf))
                    size += len(own)
                if n_docs >= SEGMENT_DOCS or size >= SEGMENT_POSTINGS:
                    yield segment()
    if n_docs:
        yield segment()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _exact(x: np.ndarray, greatest: int) -> np.ndarray:
    """x as 64-bit integers where products up to `greatest` fit, else as Python's."""
    return x.astype(np.int64) if greatest < 1 << 63 else x.astype(object)


def impacts(weights: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """The score that each posting adds; lengths: of the postings' documents."""
    m = 100 - 50 + 50 * _exact(lengths, 50 * n * int(lengths.max(initial=0))) * n // total
    tfs = _exact(tfs, 10**9 * int(tfs.max(initial=0)))
    return (weights * ((10**9 * tfs) // (1000 * tfs + 20 * m))).astype(np.int64)


class Top:
    """The best (score, id) seen, equal scores by ascending id, at most so many."""

    def __init__(self, most: int):
        self.most, self.heap = most, []

    @property
    def least(self) -> int:
        """What a score must reach to matter: an equal one still can, by its id."""
        return self.heap[0][0] if len(self.heap) == self.most else 1

    def add(self, score: int, id_: int) -> None:
        if len(self.heap) < self.most:
            heapq.heappush(self.heap, (score, -id_))
        elif (score, -id_) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -id_))


def search(lists: list[tuple[np.ndarray, np.ndarray]], n: int, ids: np.ndarray, top: Top, short: float = SHORT, stretch: int = STRETCH) -> int:
    """Add to top the documents of a segment of n documents by the sums of lists of (ascending places, scores above 0);
    returns how many documents were scored in full.

    Lists of up to n * short postings are summed first, into accumulators that are then a list like the others. A stretch of
    places is skipped where the sum of its lists' greatest scores there is below top.least. In a stretch that is left,
    lists are taken from the greatest bound down until the bounds of the rest can't reach top.least: their documents are the
    only candidates; in the rest, candidates alone are looked up while they can reach it."""
    few = [x for x in lists if len(x[0]) <= n * short]
    many = [x for x in lists if len(x[0]) > n * short]
    if few:
        places, at = np.unique(np.concatenate([p for p, _ in few]), return_inverse=True)
        sums = np.zeros(len(places), np.int64)
        np.add.at(sums, at, np.concatenate([s for _, s in few]))
        many.append((places, sums))
    if not many:
        return 0
    stretches = -(-n // stretch)
    bounds = np.zeros((len(many), stretches), np.int64)
    cuts = []
    for k, (p, s) in enumerate(many):
        np.maximum.at(bounds[k], p // stretch, s)
        cuts.append(np.searchsorted(p, np.arange(stretches + 1) * stretch))
    total, scored = bounds.sum(0), 0
    for b in range(stretches):
        if not total[b] or total[b] < top.least:
            continue
        order = np.argsort(-bounds[:, b], kind="stable")
        rest = np.concatenate([np.cumsum(bounds[order, b][::-1])[::-1], [0]])  # rest[i]: bound of lists i and after
        sums = np.zeros(stretch, np.int64)
        alive = np.zeros(stretch, bool)
        for i, k in enumerate(order):
            lo, hi = cuts[k][b], cuts[k][b + 1]
            p, s = many[k][0][lo:hi] - b * stretch, many[k][1][lo:hi]
            if rest[i] >= top.least:
                sums[p] += s
                alive[p] = True
            else:
                alive &= sums + rest[i] >= top.least
                if not alive.any():
                    break
                sums[p] += np.where(alive[p], s, 0)
        for at in np.flatnonzero(alive & (sums >= top.least)):
            top.add(int(sums[at]), int(ids[b * stretch + at]))
        scored += int(alive.sum())
    return scored


def _searched(batches, items: list[tuple], weights: np.ndarray, n: int, total: int, most: int) -> Iterator[pa.RecordBatch]:
    """Segments -> (item, task, doc, score): each item's best documents in the task's segments. items: (place, term ids)."""
    tops = {item: Top(most) for item, _ in items}
    for batch in batches:
        for row in range(batch.num_rows):
            ids, lengths, terms, counts, docs, tfs = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ids", "lengths", "terms", "counts", "docs", "tfs"))
            ends = np.cumsum(counts)
            named = docs >= 0
            score = np.zeros(len(docs), np.int64)
            score[named] = impacts(np.repeat(weights[terms], counts)[named], tfs[named], lengths[docs[named]], n, total)
            lists = {}
            for t, hi, c in zip(terms.tolist(), ends.tolist(), counts.tolist()):
                some = score[hi - c : hi] > 0  # also leaves out rows without an id
                lists[t] = docs[hi - c : hi][some], score[hi - c : hi][some]
            for item, own in items:
                if found := [lists[t] for t in own if t in lists and len(lists[t][0])]:
                    search(found, len(ids), ids, tops[item])
    task = TaskContext.get().partitionId()
    rows = [(item, task, -doc, score) for item, top in tops.items() for score, doc in top.heap]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["item", "task", "doc", "score"])


def _search_block(texts: DataFrame, items: list[tuple], most: int) -> DataFrame:
    """(item, rank, doc, score) of items (place, terms), whose terms a task can hold."""
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for _, own in items for t in own}))}
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    lists = "ids array<long>, lengths array<long>, terms array<int>, counts array<int>, docs array<int>, tfs array<long>"
    segments = durable(texts.mapInArrow(lambda b: _segments(b, shared.value), f"n_docs long, n_terms long, {lists}"))
    facts = segments.withColumn("part", F.spark_partition_id()).agg(F.sum("n_docs"), F.sum("n_terms"), F.sum(F.size("docs").cast("long")), F.max("part")).first()
    if not facts[0]:
        return spark.createDataFrame([], "item int, rank int, doc long, score long")
    postings = segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in postings.groupBy("x.terms").agg(F.sum("x.counts")).collect():  # a row per term of the block
        weights[term] = weight(facts[0], df)
    asked = [(place, sorted(vocabulary[t.encode()] for t in own)) for place, own in items]
    search_args = spark.sparkContext.broadcast((asked, weights, facts[0], facts[1], most))
    tasks = max(1, min(facts[3] + 1, max(spark.sparkContext.defaultParallelism, (facts[2] or 0) // TASK_POSTINGS)))
    found = segments.coalesce(tasks).mapInArrow(lambda b: _searched(b, *search_args.value), "item int, task int, doc long, score long")
    best = lambda *key: Window.partitionBy(*key).orderBy(F.desc("score"), "doc")
    while tasks > MERGED:
        found = found.withColumn("task", F.floor(F.col("task") / MERGED).cast("int"))
        found = found.withColumn("rank", F.row_number().over(best("item", "task"))).filter(F.col("rank") <= most).drop("rank")
        tasks = -(-tasks // MERGED)
    return found.withColumn("rank", F.row_number().over(best("item"))).filter(F.col("rank") <= most).select("item", "rank", "doc", "score")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = 50, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(item_col, rank, id_col, score): the `most` best documents of each item with a score above 0, ranked from 1, equal
    scores by ascending id.

    Terms are runs of ASCII letters and digits and of all that is not ASCII, A-Z lower-cased. With N documents that have a
    term, L terms in all of them, n terms in a document, df documents with the term and tf occurrences in the document,
    an item's term adds w * (10^9 tf div (1000 tf + 20 m)) once, where w = floor(1000 ln((2N + 2) / (2 df + 1))) and
    m = 50 + (50 n N div L), all in whole numbers. Null, empty and blank texts hold no term: such documents are not counted, and
    such items have no rows. Ids are long. Rows that repeat a document's id are documents of their own; those with a null id are
    counted but not ranked. Rows that repeat an item's id are one item with the terms of all; a null item is left out. Other
    columns are ignored; an empty table gives an empty result.

    Items go through the documents in blocks whose terms are about `limit` bytes, which is what each task holds of them."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.explode(F.array_distinct(terms_of(F.col(item_text_col)))).alias("term"))
    asked = durable(asked.groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms")))
    weight_of = F.aggregate("terms", F.lit(64).cast("long"), lambda n, t: n + 16 + F.octet_length(t))
    blocks = max(1, -(-(asked.agg(F.sum(weight_of)).first()[0] or 0) // limit))
    kind = items.schema[item_col].dataType.simpleString()
    result = docs.sparkSession.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
    for block in range(blocks):
        own = [(r["item"], r["terms"]) for r in asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()]
        if own:
            found = _search_block(texts, [(place, terms) for place, (_, terms) in enumerate(own)], most)
            names = docs.sparkSession.createDataFrame([(place, item) for place, (item, _) in enumerate(own)], f"item int, name {kind}")
            result = result.unionByName(found.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("doc").alias(id_col), "score"))
    return result


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all documents ranked for every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
p AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, n_docs),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // total)))))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50
"""
