"""Every operator on one odd table: null and repeated ids, null, empty and very long texts (past a worker's slice), ties, repeated
rows, and other columns whose names clash with the operators' own."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm.common import BATCH_SETTINGS, SLICE_BYTES, restore_batches, small_batches
from tallyspark.llm.decontaminate import contained_items
from tallyspark.llm.exact_dedup import exact_dedup
from tallyspark.llm.html_text import main_text
from tallyspark.llm.language import build, predict, training_text
from tallyspark.llm.lexical import ranked_search
from tallyspark.llm.line_dedup import dedup_lines
from tallyspark.llm.lm_score import lm_scores
from tallyspark.llm.near_dup import near_duplicates
from tallyspark.llm.packing import pack_documents
from tallyspark.llm.toxicity import score
from tallyspark.llm.toxicity import train as train_toxicity
from tallyspark.llm.warc import read_warc, write_warc

CLASH = "row int, kept string, id long, text_sha256 string, words int, sig string, band long, u long, v long, n int, at int, batch long, _id int, _text string, _row string"
EXTRA = (1, "k", 5, "s", 2, "g", 3, 4, 5, 6, 7, 8, 9, "t", "r")
ITEM = "the quick brown fox jumps over the lazy dog near the old river bank today"


def long_text(seed=0):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(4000)}" for _ in range(SLICE_BYTES // 4)]
    text = " ".join(words) + "\n" + ITEM
    assert len(text) > 1.2 * SLICE_BYTES
    return text


@pytest.fixture(scope="module")
def rows():
    whole = long_text()
    return [(1, "A first line of text\nshared by some documents\nown words here"), (1, "A first line of text\nshared by some documents\nown words here"), (None, "shared by some documents\nof nobody"), (None, None), (2, None), (3, ""), (4, whole), (5, whole + " end"), (6, "shared by some documents\nof number six"), (7, " \t\n"), (8, ITEM)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], f"doc_id long, text string, {CLASH}").repartition(3).persist()


def ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=lambda x: (x is None, x or 0))


def every(rows):
    return sorted((i for i, _ in rows), key=lambda x: (x is None, x or 0))


def test_line_dedup(docs, rows):
    got = dedup_lines(docs)
    kept = {(r.doc_id, r.k) for r in got.select(F.col("row.doc_id").alias("doc_id"), F.col("kept").alias("k")).collect()}
    assert got.count() == len(rows) and (None, "shared by some documents\nof nobody") in kept and (6, "of number six") in kept and (1, rows[0][1]) in kept
    assert (5, rows[7][1].split("\n")[0] + "\n" + ITEM + " end") not in kept  # its first line is document 4's
    assert (8, "") in kept and max(len(k) for i, k in kept if i == 4) == len(rows[6][1])


def test_warc(spark, rows, tmp_path):
    pages = spark.createDataFrame([(i, "http://a/x", t, *EXTRA) for i, t in rows if i is not None] + [(9, None, "<" * 40_000_000, *EXTRA)], f"page_id long, url string, html string, {CLASH}").repartition(2)
    write_warc(pages, str(tmp_path / "w"))
    got = {(r.id, r.record_type, r.payload_bytes, r.intact) for r in read_warc(spark, str(tmp_path / "w")).collect()}
    want = {(str(i), "response", len((t or "").encode()), True) for i, t in rows if i is not None} | {("9", "response", 40_000_000, True)}
    assert got == want
    assert len([p for p in (tmp_path / "w").glob("*.txt") if p.stat().st_size > 3_000_000]) == 3  # large payloads have files of their own


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, None), (None, ITEM), (12, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contained_items(docs, items).collect()) == [(4, 10), (5, 10), (8, 10)]


def test_main_text(spark):
    html = "<html><body><article><p>" + "Long words of one article. " * 200_000 + "</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a/x", html, *EXTRA), (1, "http://a/x", html, *EXTRA), (None, None, "<p>hm</p>", *EXTRA), (2, None, None, *EXTRA), (3, "", "", *EXTRA)], f"page_id long, url string, html string, {CLASH}")
    got = sorted(((r.page_id, r.n_chars) for r in main_text(pages).collect()), key=repr)
    assert got == [(1, 5_399_999), (1, 5_399_999), (2, 0), (3, 0), (None, 2)]


def test_language(docs, rows):
    labelled = docs.sparkSession.createDataFrame([(k, t, lang) for k in range(8) for t, lang in (("der Hund und die Katze schlafen", "de"), ("the dog and the cat are sleeping", "en"))], "doc_id long, text string, lang string")
    got = predict(docs, build(training_text(labelled, "doc_id", "text", "lang")))
    assert ids(got) == every(rows) and {r.lang_pred for r in got.filter("doc_id in (2, 3, 7)").collect()} == {"und"} and got.filter("doc_id = 8").first().lang_pred == "en"


def test_packing(docs, rows):
    got = pack_documents(docs)
    assert set(ids(got)) == {i for i, _ in rows} and got.filter("doc_id in (2, 3, 7)").agg(F.sum("length")).first()[0] == 3
    assert got.filter("doc_id = 4").agg(F.sum("length")).first()[0] == got.filter("doc_id = 4").first().doc_tokens > 2_000_000


def test_exact_dedup(docs, rows):
    got = exact_dedup(docs, digest_all=True)
    assert ids(got) == every(rows) and {(r.doc_id, r.keep_id, r.group_size) for r in got.filter("group_size > 1").collect()} == {(1, 1, 2), (2, 7, 4), (3, 7, 4), (7, 7, 4), (None, 7, 4)}


def test_lm_score(docs, rows):
    got = lm_scores(docs, F.lit(True))
    assert ids(got) == every(rows) and {r.n_tokens for r in got.filter("doc_id in (2, 3, 7)").collect()} == {1}
    assert got.filter("doc_id = 4").first().n_tokens == len(rows[6][1].split()) + 1


def test_near_duplicates(docs, rows):
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {(1, 1, True), (None, None, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True), (8, 8, True)}


def test_toxicity(docs, rows):
    spark = docs.sparkSession
    words = [("you are awful vile scum", 1), ("a calm walk by the lake", 0)]
    taught = spark.createDataFrame([(100 + 2 * k + y, t, y) for k in range(20) for t, y in words], "doc_id long, text string, toxic int")
    model = train_toxicity(taught.select("doc_id", "text"), taught.select("doc_id", "toxic"))
    bad = docs.unionByName(docs.filter("doc_id = 4").withColumns({"doc_id": F.lit(20).cast("long"), "text": F.concat("text", F.lit(" vile scum awful"))}))
    got = score(bad, model)
    assert ids(got) == sorted([*every(rows), 20], key=lambda x: (x is None, x or 0)) and ids(got.filter("toxic")) == [20]


def test_ranked_search(spark, docs):
    items = spark.createDataFrame([(10, "fox river"), (10, "nobody"), (11, None)], "item_id long, text string")
    got = [(r.item_id, r.rank, r.doc_id) for r in ranked_search(docs, items).orderBy("rank").collect()]
    assert [g[2] for g in got[:1]] == [8] and {g[2] for g in got} == {4, 5, 8}


def test_pipeline_stages(docs, rows, monkeypatch):
    spark = docs.sparkSession
    empty = {"labels": spark.createDataFrame([], "doc_id long, toxic int"), "benchmark": spark.createDataFrame([(1, "one two three four five six seven"), (2, None)], "item_id long, text string")}
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: empty[name])
    now = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), "row", "kept", "id", "band", "u")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, "")
        assert after.columns == now.columns
        now = after
    assert set(ids(now)) == {i for i, _ in rows} and now.filter("doc_id = 5").first().text == ITEM + " end"  # its long line is document 4's


def test_settings_are_given_back(spark):
    restore_batches(spark)
    before = {k: spark.conf.get(k, None) for k in BATCH_SETTINGS}
    small_batches(spark)
    small_batches(spark)
    assert {k: spark.conf.get(k) for k in BATCH_SETTINGS} == {k: str(v) for k, v in BATCH_SETTINGS.items()}
    restore_batches(spark)
    assert {k: spark.conf.get(k, None) for k in BATCH_SETTINGS} == before
