import random
import sys
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from tests.llm.test_dedup import brute_lines  # noqa: E402
from tests.llm.test_near_dup import brute  # noqa: E402


def grams(text):
    w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_stages_match_brute_force(spark, tmp_path):
    rng = random.Random(9)
    calm = [f"calm{i}" for i in range(400)]
    benchmark = [(i, " ".join(rng.choice(calm) for _ in range(30))) for i in range(4)]
    rows, labels = [], []
    for i in range(160):
        bad = i % 5 == 0
        words = [rng.choice(calm) for _ in range(60)] + ["blockhead", "scoundrel"] * (2 * bad)
        text = " ".join(words) + "\na line that many documents have"
        if i % 11 == 3:
            text = rows[-1][1].replace("calm1 ", "calm2 ")
            bad = labels[-1][1]
        if i % 13 == 4:
            text += "\n" + benchmark[i % 4][1]
        rows.append((i, text)), labels.append((i, int(bad)))
    rows += [(500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [(i, t) for i, t in rows if "blockhead" not in (t or "")]
    left = [(i, k) for i, _, _, k in brute_lines(left)]
    left = [(i, t) for i, t in left if {x[0]: x[3] for x in brute(left)}[i]] if left else left
    left = [(i, t) for i, t in left if not any(len(grams(t) & grams(b)) >= 0.75 * len(grams(b)) for _, b in benchmark)]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in left}
    got = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r.doc_id: r.n for r in got} == want and all(r.n == r.d for r in got)

    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
