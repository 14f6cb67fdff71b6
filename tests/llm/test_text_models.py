import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, language, lm_score, toxicity


def test_contained_items_match_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "w" + str(rng.randrange(300))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 8, 20, 40, 60])))) for i in range(25)] + [(90, None), (91, ""), (92, "?!"), (3, "another text of one id")]
    docs = []
    for d in range(60):
        words = [word() for _ in range(rng.choice([0, 3, 30, 400]))]
        for _ in range(rng.choice([0, 1, 2])):
            own = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if own:
                    own[rng.randrange(len(own))] = word()
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words).title()))
    docs += [(100, None), (101, ""), (102, items[0][1])]

    def sets(rows):
        out = {}
        for i, text in rows:
            w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
            out.setdefault(i, set()).update(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)) if w)
        return {i: s for i, s in out.items() if s}

    d, b = sets(docs), sets(items)
    want = {(i, j, len(x & y), len(y)) for i, x in d.items() for j, y in b.items() if len(x & y) >= 0.75 * len(y)}
    left = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, words string, hash int").repartition(3)
    right = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    for limit in (1_000_000, 0):
        got = decontaminate.contained_items(left, right, limit=limit).collect()
        assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == want and len(got) == len(want)
    assert decontaminate.contained_items(left.limit(0), right).count() == 0 == decontaminate.contained_items(left, right.limit(0)).count()


def test_decontamination_runs_no_python(spark):
    left = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    right = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    plan = decontaminate.contained_items(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination_makes_shingles_once_and_of_suspects_only(spark):
    left = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string").persist()
    right = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").persist()
    found = decontaminate.contained_items(left, right)
    assert [(r.doc_id, r.n_shared, r.n_item) for r in found.collect()] == [(1, 2, 2)]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [k for k, line in enumerate(lines) if "split(" in line]
    assert len(made) == 1 and lines[made[0]].count("split(") == 1  # no filter makes them again
    assert any("LeftSemi" in line for line in lines[made[0] :])  # and the join with the suspects comes before
    hashed = decontaminate._shingles(left.select(F.col("doc_id").alias("doc"), "text"), 5, "hash", True)
    assert hashed._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


LANGS = {"aa": ["ba", "lo", "mi", "ta"], "bb": ["xu", "zek", "qo", "ji"], "cc": ["éa", "ßo", "ñu", "rr"]}


def lang_rows(n=90):
    rng = random.Random(3)
    return [(i, " ".join("".join(rng.choice(LANGS[g]) for _ in range(3)) for _ in range(rng.choice([4, 30, 900]))), g) for i in range(n) for g in [rng.choice(list(LANGS))]]


def naive_phrases(text, reference):
    n = at = 0
    text = language.folded(text)
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in reference:
            k += 1
        n, at = n + 1, at + k
    return n


@pytest.mark.parametrize("stretch", [1, 2, 7, 1024])
def test_phrases_match_a_naive_cross_parse(monkeypatch, stretch):
    monkeypatch.setattr(language, "STRETCH", stretch)
    rows = lang_rows(30)
    ref = {g: " ".join(t for _, t, x in rows[:20] if x == g)[:1500] for g in LANGS}
    model = language.build(ref)
    texts = [t for _, t, _ in rows] + ["", "ñandú ΩΩ 12", "b", "b" * 1024, ref["aa"], ref["aa"] + ref["aa"][:700], "x" * 1025]
    assert max(map(len, texts)) > 5000
    got = model.phrases(texts)
    for i, t in enumerate(texts):
        assert got[i].tolist() == [naive_phrases(t, " ".join(language.folded(ref[g]).split())) for g in sorted(LANGS)]


SCRIPTS = {"de": "abcdefghijklmnopqrstuvwxyzäöüß", "el": "αβγδεζηθικλμνξοπρστυφχψω", "ja": "あいうえおかきくけこさしすせそたちつてと日本語東京", "ru": "абвгдежзийклмнопрстуфхцчшщ", "uk": "абвгґдеєжзиіїйклмнопрстуф", "zh": "".join(chr(0x4E00 + 7 * k) for k in range(900))}


def test_all_characters_of_all_scripts_count(spark):
    rng = random.Random(4)
    words = {g: ["".join(rng.choice(c) for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(150)] for g, c in SCRIPTS.items()}

    def text(g, n):
        return " ".join(rng.choice(words[g]) for _ in range(n))

    ref = {g: text(g, 4000 if g == "de" else 900 if g in ("ja", "zh") else 700) for g in SCRIPTS}
    model = language.build(ref)
    assert set("".join(ref.values())) - {" "} <= {chr(p) for p in model.alphabet}
    texts = [(i, text(g, 40), g) for i, g in enumerate(sorted(SCRIPTS) * 6)]
    got = model.phrases([t for _, t, _ in texts])
    assert [row.tolist() for row in got] == [[naive_phrases(t, ref[g]) for g in sorted(SCRIPTS)] for _, t, _ in texts]
    df = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict(df, model).collect()} == {i: g for i, _, g in texts}


def test_training_takes_all_of_each_document(spark):
    rng = random.Random(9)
    words = lambda g, n: " ".join("".join(rng.choice(LANGS[g]) for _ in range(3)) for _ in range(n))
    opening = words("aa", 700)
    assert len(opening) > language.DOC_CHARS
    rows = [(i, opening + f" mark{'xyzuvw'[i % 6]}{'abcdefghij'[i % 10]} " + words(g, 1500) + f" {g}tail", g) for i in range(60) for g in ["bb" if i % 2 else "cc"]]
    got = language.training_text(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    for g in ("bb", "cc"):
        assert got[g].count(g + "tail") == 30 and 0.9 * language.TRAIN_CHARS < len(got[g]) < 1.1 * language.TRAIN_CHARS
    df = spark.createDataFrame([(1, words("bb", 60)), (2, words("cc", 60))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict(df, language.build(got)).collect()} == {1: "bb", 2: "cc"}
    assert language.spread("abcdef", 9) == "abcdef" and language.spread("x" * 150 + "y" * 50, 100) == "x" * 100 and language.level([5, 100, 100], 65) == 30


def test_held_out_accuracy_and_odd_texts(spark):
    rows = lang_rows() + [(200, None, "aa"), (201, "", "aa"), (202, "12 !?", "bb"), (203, "balo", None)]
    df = spark.createDataFrame([(i, t, g, 0.5) for i, t, g in rows], "doc_id long, text string, lang string, score double").repartition(3)
    train = df.filter(~language.held_out("doc_id", 3, 1))
    model = language.build(language.training_text(train, "doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert all(got[i].lang_pred == g and 0 <= got[i].score <= 1 for i, t, g in rows[:90] if zlib.crc32(str(i).encode()) % 3 == 1)
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and got[203].lang_pred == "aa"
    none = language.build(language.training_text(train.limit(0), "doc_id", "text", "lang"))
    assert {r.lang_pred for r in language.predict(df, none).collect()} == {"und"}


def brute_scores(train):
    """A function (n_tokens, n_known, base, score) of a text, with dictionaries only."""
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    words = sorted((w for w in c if w != b"\n"), key=lambda w: (-c[w], lm_score.word_hash(w)))
    top = set(words[: lm_score.TOP_WORDS])
    lead = Counter()
    for w in words:
        if w not in top:
            lead[lm_score.lead_of(w)] += c[w]
    leads = set(sorted(lead, key=lambda x: (-lead[x], x))[: lm_score.LEADS])
    symbol = lambda w: w if w in top or w == b"\n" else (x if (x := lm_score.lead_of(w)) in leads else "other")
    mass = Counter({"other": 1, b"\n": 0} | {x: 1 for x in leads})
    for w in {*c, b"\n"}:
        mass[symbol(w)] += c[w] + 1
    counts = [Counter() for _ in range(lm_score.DEPTH + 1)]
    for t in train:
        s = ["start"] * lm_score.DEPTH + [symbol(w) for w in tokens(t)]
        for i in range(lm_score.DEPTH, len(s)):
            for k in range(lm_score.DEPTH + 1):
                counts[k][tuple(s[i - k : i]), s[i]] += 1
    total, after = Counter(), {}
    for of in counts:
        for (w, a), m in of.items():
            total[w] += m
            after.setdefault(w, {})[a] = m
    least, kept = max(lm_score.MIN_COUNT, math.ceil(lm_score.LEAST_SHARE * n)), {()}
    for w, own in after.items():
        if w and w[:2] != ("start", "start") and total[w] >= least:
            gain = sum(m * math.log(m / total[w] / (after[w[1:]][a] / total[w[1:]])) for a, m in own.items())
            if gain > lm_score.PENALTY * len(own):
                kept.update(w[j:] for j in range(len(w)))

    def p(w, a):
        if not w:
            return mass[a] / sum(mass.values())
        own = after[w]
        up = total[w] + len(own) - sum(m for m in own.values() if m > 1)
        return ((own.get(a, 0) if own.get(a, 0) > 1 else 0) + up * p(w[1:], a)) / (total[w] + len(own))

    def scores(t):
        out, s = 0.0, ["start"] * lm_score.DEPTH + [symbol(w) for w in tokens(t)]
        for i, w in enumerate(tokens(t), lm_score.DEPTH):
            context = next(x for j in range(lm_score.DEPTH + 1) if (x := tuple(s[i - lm_score.DEPTH + j : i])) in kept)
            out += math.log10(p(context, s[i]) * (c[w] + 1) / mass[s[i]])
        return len(tokens(t)), sum(w in c for w in tokens(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), out

    return scores, n, len(kept), (p, kept, mass)


def lm_rows():
    rng = random.Random(5)
    after = {"the": ["end", "hen", "Often"], "of": ["the", "then"], "end": ["of", "the"]}
    rows = []
    for i in range(90):
        words = []
        for _ in range(rng.choice([0, 1, 20, 60])):
            words.append(rng.choice(after.get(words[-1] if words else "", ["the", "of", "end", f"x{rng.randrange(30)}", f"é{rng.randrange(9)}"])))
        rows.append((i, " ".join(words)))
    return rows + [(100, None), (101, " \n"), (102, "zx" * 9000), (103, "the " * 3000)]


@pytest.mark.parametrize("small", [False, True])
def test_scores_match_brute_force(spark, monkeypatch, small):
    rows = lm_rows()
    if small:  # words outside the head, few symbols, counts handed on often
        for name, value in {"HEAD_WORDS": 4, "TOP_WORDS": 3, "LEADS": 2, "HOLD": 5}.items():
            monkeypatch.setattr(lm_score, name, value)
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n int, score string").repartition(3)
    got = {r.doc_id: r for r in lm_score.lm_scores(df, F.col("doc_id") % 3 != 0).collect()}
    brute, n, kept, _ = brute_scores([t for i, t in rows if i % 3])
    assert kept > 5 and len(got) == len(rows)
    for i, t in rows:
        n_tokens, n_known, base, score = brute(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n_tokens, n_known, n)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(got[i].score, score, rel_tol=1e-5)
    held = [i for i, _ in rows if i % 3 == 0]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_every_two_first_bytes_have_a_class(spark):
    """2,000 beginnings of words in several scripts, each of its own class beside more frequent words."""
    starts = [chr(a) + chr(b) for a in range(97, 123) for b in range(97, 123)] + [chr(c) for c in range(0x400, 0x10000, 64) if not 0xD800 <= c < 0xE000] + [f"{a}{chr(b)}" for a in range(10) for b in range(97, 123)]
    beginnings = sorted({lm_score.lead_of(w.encode()) for w in starts})
    often = " ".join(f"zz{i}" for i in range(lm_score.TOP_WORDS))
    rows = [(0, f"{often} " * 3)] + [(i, " ".join(f"{w}{k}" for w in starts)) for i, k in ((1, "x"), (2, "y"), (3, "z"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = df.select("text").mapInArrow(lm_score._word_counts, "key long, lead int, n long").groupBy("key").agg(F.first("lead").alias("lead"), F.sum("n").alias("n"))
    of = lm_score.vocabulary(words)
    got = of.class_of[beginnings]
    assert len(beginnings) > 1900 and len(set(got.tolist())) == len(beginnings) and lm_score.OTHER not in got and of.mass[lm_score.OTHER] == 1
    brute = brute_scores([t for _, t in rows])[0]
    for r in lm_score.lm_scores(df, F.lit(True)).collect():
        assert math.isclose(r.score, brute(rows[r.doc_id][1])[3], rel_tol=1e-5)


def test_distributions_sum_to_one():
    _, _, _, (p, kept, mass) = brute_scores([t for _, t in lm_rows()])
    assert all(math.isclose(sum(p(w, a) for a in mass), 1) for w in kept)


def test_scores_without_training_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = lm_score.lm_scores(df, F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(2, 0, 0, 0.0), (3, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(math.isclose(r.score, r.n_tokens * math.log10(0.5), rel_tol=1e-6) for r in got)
    assert lm_score.lm_scores(df.limit(0), F.lit(True)).count() == 0


def toxic_rows():
    rng = random.Random(8)
    calm, rude = [f"calm{i}" for i in range(200)], ["scoundrel", "blockhead", "rotterish", "rotterling"]
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.25
        words = [rng.choice(calm) for _ in range(rng.choice([3, 40, 400]))]
        for _ in range(rng.choice([1, 2, 5]) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(rude) + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([(i, t, 3, 0.1) for i, t in rows + [(900, None), (901, "")]], "doc_id long, text string, grade int, severity double").repartition(3)
    known = spark.createDataFrame(labels[:250] + [(900, 0), (999, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    want = dict(labels)
    assert sum(got[i].toxic != bool(want[i]) for i in range(250, 400)) <= 2
    assert not got[900].toxic and not got[901].toxic and all(0 <= r.severity <= 2 for r in got.values())
    clean = toxicity.clean_documents(docs, model)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.toxic}
    assert toxicity.train(docs, known.filter("toxic = 0")) is None and not toxicity.score(docs, None).filter("toxic").count()
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_likelihood_and_gradient_of_the_ordinal_fit():
    """The weights of a fit are where the penalised likelihood, written out, has no slope."""
    rng = np.random.default_rng(1)
    grades = np.r_[np.zeros(60, int), np.ones(40, int), np.full(40, 2)]
    rows = [(np.flatnonzero(rng.random(6) < (0.1 if g == 0 else 0.35 + 0.2 * g)).astype(np.uint32), None) for g in grades]
    rows = [(f, rng.integers(1, 400, len(f))) for f, _ in rows]
    model = toxicity.fit(rows, grades, steps=4000, l2=1e-2)
    share = np.where(grades > 0, 0.5 / 80, 0.5 / 60)

    def loss(w, theta):
        x = np.array([sum(w[model.index[int(f)]] * np.log1p(n) for f, n in zip(*r) if int(f) in model.index) for r in rows])
        above = np.column_stack([np.ones(len(x)), 1 / (1 + np.exp(-(x[:, None] - theta))), np.zeros(len(x))])
        return -(share * np.log(above[np.arange(len(x)), grades] - above[np.arange(len(x)), grades + 1])).sum() + 0.5e-2 * (w**2).sum()

    best = loss(model.weights, model.thresholds)
    for k in range(len(model.weights)):
        for d in (-0.05, 0.05):
            w = model.weights.copy()
            w[k] += d
            assert loss(w, model.thresholds) > best - 1e-6
    assert all(loss(model.weights, model.thresholds + d) > best - 1e-6 for d in ([0.05, 0], [-0.05, 0], [0, 0.05], [0, -0.05]))


def test_counts_of_features_are_whole(spark):
    text = " ".join(f"rottenword{i}" for i in range(600))
    f, c = toxicity.counted(text, toxicity.features_of)
    got = spark.createDataFrame([(text, 1)], "text string, grade int").mapInArrow(toxicity._extracted, "grade int, features binary, counts binary").first()
    assert c.max() == 600 and np.frombuffer(got.counts, np.uint32).tolist() == c.tolist() and np.frombuffer(got.features, np.uint32).tolist() == f.tolist()


def test_gradient_of_the_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 400)
    rows = [(np.arange(10, 10 + 2 * g), np.ones(2 * g, np.int64)) for g in grades]
    model = toxicity.fit(rows, grades)
    x = [sum(model.weights[model.index[int(f)]] * np.log(2) for f in r[0] if int(f) in model.index) for r in rows]
    assert [model.above(max(v for v, g in zip(x, grades) if g == k)).sum() > k - 0.5 for k in (1, 2)] == [True, True]
