"""Toxicity grades by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, by_slices, small_batches, table, words_of

#: Hash space of features while they are selected, and lengths of the word prefixes that are features beside whole words.
BINS = 1 << 22
PREFIXES = (4, 5, 6, 7, 8)
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features_of(word: bytes) -> list[int]:
    """Hashes of a word, without punctuation at its ends, and of its prefixes."""
    text = word.strip(PUNCTUATION).decode()
    return [xxhash.xxh3_64_intdigest(f) % BINS for f in {f"={text}", *(text[:n] for n in PREFIXES if len(text) >= n)}] if text else []


def counted(text: str | None, of) -> tuple[np.ndarray, np.ndarray]:
    """Features of the whole text with the number of distinct words that have them; of(word) gives a word's features."""
    found = [f for word in set(words_of(text)) for f in of(word)]
    return np.unique(np.array(found, np.int64), return_counts=True)


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > k) = sigmoid(w.x - theta_k): one weight vector under ordered thresholds."""

    index: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, x: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x - self.thresholds, -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, most_features: int = 4096, steps: int = 300, l2: float = 2e-4) -> OrdinalModel:
    """Fit to features and grades 0..K-1 (at least two grades that occur) of a bounded sample.

    Features are chosen by a smoothed log-odds test between grade 0 and the rest; then weights and thresholds minimise
    the cumulative-link likelihood, grade 0 and the others weighted alike, by gradient steps over the sparse rows."""
    toxic = grades > 0
    sides = [np.unique(np.concatenate([np.empty(0, np.uint32), *(r[0] for r, t in zip(rows, toxic) if t == side)]), return_counts=True) for side in (False, True)]
    features = np.union1d(sides[0][0], sides[1][0])
    df = np.zeros((2, len(features)), np.int64)
    for side, (own, count) in enumerate(sides):
        df[side, np.searchsorted(features, own)] = count
    n = [max(1, int((toxic == side).sum())) for side in (False, True)]
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    fit_for = np.flatnonzero((df[1] >= max(3, n[1] // 1000)) & (odds > 2))
    gain = odds[fit_for] * df[1][fit_for]
    chosen = features[np.sort(fit_for[np.argsort(-gain, kind="stable")[:most_features]])]
    index = {int(f): i for i, f in enumerate(chosen)}
    row, col, val = [], [], []
    for i, (f, c) in enumerate(rows):
        at = np.minimum(np.searchsorted(chosen, f), max(0, len(chosen) - 1))
        keep = chosen[at] == f if len(chosen) else np.zeros(len(f), bool)
        row.append(np.full(int(keep.sum()), i)), col.append(at[keep]), val.append(np.log1p(c[keep]))
    row, col, val = (np.concatenate(x) if x else np.empty(0) for x in (row, col, val))
    row, col = row.astype(np.int64), col.astype(np.int64)
    k = max(1, int(grades.max(initial=0)))
    weight = np.where(toxic, 0.5 / n[1], 0.5 / n[0])
    w, base, gaps = np.zeros(len(chosen)), 2.0, np.full(k - 1, 0.5)  # theta = base, then positive gaps exp(gaps)
    p = np.concatenate([w, [base], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, theta = p[: len(chosen)], p[len(chosen)] + np.concatenate([[0], np.cumsum(np.exp(p[len(chosen) + 1 :]))])
        x = np.bincount(row, val * w[col], minlength=len(grades))
        q = 1 / (1 + np.exp(-np.clip(x[:, None] - theta, -50, 50)))
        # Likelihood of grade g: P(>g-1) - P(>g); its gradient in the two scores.
        ext = np.concatenate([np.ones((len(grades), 1)), q, np.zeros((len(grades), 1))], axis=1)
        at = np.arange(len(grades)), grades
        hi, lo = ext[at], ext[at[0], grades + 1]
        like = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = weight * hi * (1 - hi) / like, -weight * lo * (1 - lo) / like
        d_theta = np.array([-(d_hi[grades == j + 1].sum() + d_lo[grades == j].sum()) for j in range(k)])
        g = np.zeros_like(p)
        g[: len(chosen)] = np.bincount(col, val * (d_hi + d_lo)[row], minlength=len(chosen)) - l2 * w
        g[len(chosen)] = d_theta.sum()
        g[len(chosen) + 1 :] = np.exp(p[len(chosen) + 1 :]) * np.cumsum(d_theta[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return OrdinalModel(index, p[: len(chosen)], p[len(chosen)] + np.concatenate([[0], np.cumsum(np.exp(p[len(chosen) + 1 :]))]))


#: Words whose features a worker remembers.
REMEMBERED = 60_000


def _known(index: dict[int, int]) -> Remembered:
    """Words' features in the model, as (column, ...) tuples."""
    return Remembered(lambda word: tuple(index[f] for f in features_of(word) if f in index), REMEMBERED)


def _extracted(batches) -> Iterator[pa.RecordBatch]:
    remembered = Remembered(features_of, REMEMBERED // 4)
    for batch in by_slices(batches, "text"):
        rows = [counted(text, remembered.__getitem__) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([r[0].astype(np.uint32).tobytes() for r in rows], pa.binary()), pa.array([r[1].astype(np.uint32).tobytes() for r in rows], pa.binary())], ["grade", "features", "counts"])


def _scored(batches, model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    known = _known(model.index)
    for batch in by_slices(batches, "text"):
        severity, grade, chance = [], [], []
        for text in batch.column("text").to_pylist():
            f, c = counted(text, known.__getitem__)
            above = model.above(float(model.weights[f] @ np.log1p(c)) if len(f) else 0.0)
            severity.append(float(above.sum())), grade.append(int((above >= 0.5).sum())), chance.append(float(above[0]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array(chance, pa.float64())], ["id", "severity", "grade", "chance"])


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(text, grade) of at most `most` labelled rows of each label 0 and 1, by the order of a hash of the id."""
    labels = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("grade"), F.xxhash64(id_col).alias("_h"))
    picked = None
    for side in (0, 1):
        own = labels.filter(F.col("grade") == side).orderBy("_h", id_col).limit(most)
        picked = own if picked is None else picked.union(own)
    return docs.join(F.broadcast(picked.groupBy(id_col).agg(F.max("grade").alias("grade"))), id_col)  # at most 2 * most rows


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 3000) -> OrdinalModel | None:
    """A model of three grades from binary labels, fitted to at most `most` labelled rows of each label.

    Grade 0: label 0. Rows labelled 1 are split at the median of their evidence, the summed log-odds of their features in
    a first, two-grade fit: grade 1 below, 2 from there on. None where either label has no row."""
    small_batches(docs.sparkSession)
    sample = sample_labelled(docs.select(id_col, text_col), labels, id_col, label_col, most)
    spread = sample.select(F.col(text_col).alias("text"), "grade").repartition(docs.sparkSession.sparkContext.defaultParallelism)  # at most 2 * most rows
    got = spread.mapInArrow(_extracted, "grade int, features binary, counts binary").collect()
    got.sort(key=lambda r: (r["grade"], bytes(r["features"])))
    rows = [(np.frombuffer(r["features"], np.uint32), np.frombuffer(r["counts"], np.uint32)) for r in got]
    grades = np.array([r["grade"] for r in got], np.int64)
    if len(set(grades)) < 2:
        return None
    first = fit(rows, grades)
    evidence = np.array([sum(first.weights[first.index[int(f)]] * np.log1p(n) for f, n in zip(*r) if int(f) in first.index) for r in rows])
    grades = np.where(grades > 0, 1 + (evidence >= np.median(evidence[grades > 0])), 0)
    return fit(rows, grades) if (grades == 1).any() else first


def score(docs: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """(id_col, severity, grade, toxic): the expected grade of each whole text, the most likely side of each threshold, and
    whether the chance of any grade above 0 is at least `reject`.

    Null and empty texts have no features; with no model every severity is 0 and nothing is toxic. A row per input row,
    repeated or not; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_features weights
    got = rows.mapInArrow(lambda b: _scored(b, shared.value), f"id {kind}, severity double, grade int, chance double")
    return got.select(F.col("id").alias(id_col), "severity", "grade", (F.col("chance") >= reject).alias("toxic"))


def _passed(batches, model: OrdinalModel, reject: float) -> Iterator[pa.RecordBatch]:
    known = _known(model.index)
    for batch in by_slices(batches, "_text"):
        clean = []
        for text in batch.column("_text").to_pylist():
            f, c = counted(text, known.__getitem__)
            clean.append(not (len(f) and model.above(float(model.weights[f] @ np.log1p(c)))[0] >= reject))
        yield batch.select(["_row"]).filter(pa.array(clean, pa.bool_()))


def clean_documents(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score() does not call toxic."""
    if model is None:
        return docs
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda b: _passed(b, shared.value, reject), f"_row {rows.schema['_row'].dataType.simpleString()}").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the expected severity of every row of documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
