import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm.exact_dedup import exact_dedup
from tallyspark.llm.line_dedup import CuckooFilter, dedup_lines, empty_index

STRIP = " \t\n\r\x0b\x0c"


def brute_lines(rows):
    first, n = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        for key in {x.strip(STRIP).encode().lower() for x in (text or "").split("\n") if len(x.strip(STRIP)) >= 10}:
            first.setdefault(key, i)
            n.setdefault(key, set()).add(i)
    out = set()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(n.get(k := x.strip(STRIP).encode().lower(), ())) > 1 and first[k] != i)]
        out.add((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_corpus():
    rng = random.Random(4)
    pool = ["  A common Line here", "a COMMON line here\t", "short", "", "exactly10c", "étude in É minor", "unique  line"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {rng.randrange(60)} of text" for _ in range(rng.randint(1, 9)))) for i in range(80)]
    return rows + [(100, None), (101, ""), (102, "\n"), (103, "a common line here\r\na common line here")]


def as_df(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1, "d") for i, t in rows], "doc_id long, text string, kept string, id int, drop string").repartition(4)


def result(df):
    return {(r.doc_id, r.n_lines, r.n_dropped, r.k) for r in df.select("row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("k")).collect()}


def test_lines_match_brute_force_by_either_join(spark):
    rows = line_corpus()
    for limit in (1_000_000, 0):
        assert result(dedup_lines(as_df(spark, rows), increments=3, limit=limit)) == brute_lines(rows)


def test_insertions_and_deletions_are_reversible(spark):
    rows = line_corpus()
    a, b = rows[:50], rows[50:]
    index = empty_index(spark).insert(as_df(spark, a)).insert(as_df(spark, b))
    assert result(index.apply(as_df(spark, rows))) == brute_lines(rows)
    index = index.delete(as_df(spark, a[:30]))
    left = a[30:] + b
    assert result(index.apply(as_df(spark, left))) == brute_lines(left)
    index = index.insert(as_df(spark, a[:30]))
    assert result(index.apply(as_df(spark, rows))) == brute_lines(rows)


def test_lines_of_empty_and_repeated_tables(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "the same long line"), (1, "the same long line"), (None, "the same long line")], "doc_id long, text string")
    assert sorted(r.n_dropped for r in dedup_lines(df).collect()) == [0, 0, 0]


def test_cuckoo_filter_never_misses_and_forgets():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(-(1 << 62), 1 << 62, 20_000) for _ in range(2))
    f = CuckooFilter()
    f.add(h1[:12_000], h2[:12_000])
    f = CuckooFilter.load(f.dump())
    f.add(h1[12_000:], h2[12_000:])
    assert f.contains(h1, h2).all()
    o1, o2 = (rng.integers(-(1 << 62), 1 << 62, 20_000) for _ in range(2))
    assert f.contains(o1, o2).mean() < 0.002
    f.remove(h1[:19_000], h2[:19_000])
    assert f.contains(h1[19_000:], h2[19_000:]).all() and f.contains(h1[:19_000], h2[:19_000]).mean() < 0.01


def test_exact_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a", "b", " ", "\n", " ", "é"]) for _ in range(rng.randint(0, 4)))) for i in range(150)] + [(200, None), (201, "x" * 70 + "a"), (202, "x" * 70 + "b"), (203, "x " * 70 + "a")]
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = {(i, min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, keep_id int, group_size string").repartition(3)
    assert {tuple(r) for r in exact_dedup(df, digest_all=True).collect()} == want
    lazily = {tuple(r) for r in exact_dedup(df).collect()}
    assert {r[:4] for r in lazily} == {r[:4] for r in want} and all(r[4] is None or r in want for r in lazily)
    assert sum(r[4] is None for r in lazily) > 0
    assert exact_dedup(df.limit(0), digest_all=True).count() == 0
    for digest_all in (True, False):
        odd = spark.createDataFrame([(None, "a b"), (2, "ab"), (3, "ab"), (1, "cd"), (1, "ef"), (4, "cd"), (5, "ef"), (None, "x" * 99999), (None, "x" * 99999)], "doc_id long, text string")
        got = sorted((tuple(r)[:4] for r in exact_dedup(odd, digest_all=digest_all).collect()), key=repr)
        assert got == sorted([(None, None, 3, True), (2, None, 3, False), (3, None, 3, False), (1, 1, 2, True), (1, 1, 2, True), (4, 1, 2, False), (5, 1, 2, False), (None, None, 2, True), (None, None, 2, True)], key=repr)
    twice = exact_dedup(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string"), digest_all=True)
    assert [tuple(r)[:4] for r in twice.collect()] == [(1, 1, 2, True)] * 2
