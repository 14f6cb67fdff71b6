import random

from tallyspark.llm.components import components
from tallyspark.llm.near_dup import near_duplicates


def brute(rows, threshold=0.75, width=5):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(i, len(s), root(i), root(i) == i) for i, s in sets.items()}


def corpus(seed):
    rng, rows = random.Random(seed), []
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(40))
    passage = [word() for _ in range(60)]
    while len(rows) < 150:
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 40, 200]))]
        if rng.random() < 0.3:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows) * 3 + 1, rng.choice([" ", "\n", "\t "]).join(own)))
    rows += [(1001, None), (1002, ""), (1003, " \n"), (1004, "é x"), (1005, "É x"), (1006, "One two"), (1007, "oNE  two")]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force_with_ties_nulls_and_clashing_columns(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], "doc_id long, text string, id int, sig string, component_id int").repartition(5)
    assert {tuple(r) for r in near_duplicates(df).collect()} == brute(rows)


def test_blocks_find_links_that_leaders_miss(spark, monkeypatch):
    from tallyspark.llm import near_dup

    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "LEADER_BLOCK", 2)
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(df).collect()} == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(2, "a b"), (2, "a b"), (1, "A b")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3), (500, 400), (400, 500)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 60)}, 400: 400, 500: 400}
