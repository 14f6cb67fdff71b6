import random
import sys
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import packing
from tallyspark.llm.packing import TIERS, StepGroups, pack_documents, token_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_token_bytes_match_the_tokenizer():
    t, rng = Tokenizer.from_file(PATH), random.Random(5)
    parts = ["word", "Éclair", "don't", "'s", "it's", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", " ", "\u0085", " ", "\n", "\x0b", "é", "́", "ΣΑΣ", "İ", "1234", "!!", "(x)", "_a_", "ß", "汉字", "🙂", "K", "--'re", "a‍b", "　", "``", "'", "ª", "µ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 8)))
        want = b"".join(i.to_bytes(4, "little") for i in [*t.encode(text, add_special_tokens=False).ids, 1])
        assert token_bytes(text, PATH) == want, repr(text)


def test_strings_are_looked_up_once_whatever_their_marks_and_case():
    text = " ".join([a + w + z for a in ("", "(", '"') for w in ("alpha", "Alpha", "ALPHA", "Éclair") for z in ("", ",", "!!", "&&&")] * 500)
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    token_bytes("", PATH)  # loads the tokenizer
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        got = token_bytes(text, PATH)
    finally:
        sys.setprofile(None)
    assert got == b"".join(i.to_bytes(4, "little") for i in [*want, 1])
    assert calls["call"] < 2000  # for 24,000 strings


def test_many_texts_with_a_small_memory():
    t, rng = Tokenizer.from_file(PATH), random.Random(8)
    parts = ["alpha", "BETA", "Éclair", "ÿ", "J\u030c", "I\u0307", "A\u0301", "don't", "dogs'", "'s", "'re", "<|endoftext|>", "<|STARTOFTEXT|>", "(<|", "x1", "--", "!!", '"', "_", "</w>", "\u3000", "\u0085", "\xa0", "汉字", "\x00", "ǅ"]
    ids = packing._IDS["small memory"] = packing.WordIds(PATH, 40)
    try:
        for n in (0, 1, 2, 30, 30, 30, 30, 30, 30):
            texts = [rng.choice([None, "", " ", " ".join("".join(rng.choice([*parts, "q" * rng.randrange(60), chr(97 + rng.randrange(26))]) for _ in range(rng.randrange(4))) for _ in range(30))]) for _ in range(n + 2)]
            got = list(packing.token_runs(pa.array(texts, pa.string()).slice(1, n), "small memory"))
            assert got == [b"".join(i.to_bytes(4, "little") for i in [*t.encode(x or "", add_special_tokens=False).ids, 1]) for x in texts[1 : n + 1]]
            assert len(ids.wholes) <= 40 and len(ids.parts) == len(ids.lengths) and ids.lengths.clip(0).sum() == len(ids.flat)
        assert len(ids.parts) < 1000
        before = len(ids.parts)
        list(packing.token_runs(pa.array([" "]), "small memory"))
        assert before <= 40 or len(ids.parts) <= before - before // 2 + 1
    finally:
        del packing._IDS["small memory"]


def test_every_id_lies_in_one_piece_and_windows_are_full(spark):
    rng, t = random.Random(3), Tokenizer.from_file(PATH)
    texts = {i: " ".join(rng.choice(["alpha", "beta,", "gamma!", "x1"]) for _ in range(rng.choice([0, 1, 5, 80, 300, 900, 5000]))) for i in range(120)} | {120: None, 121: ""}
    df = spark.createDataFrame([(i, x, "z", 1) for i, x in texts.items()], "doc_id long, text string, length string, tier int").repartition(3)
    rows = pack_documents(df).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r), by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        data = b"".join(x.to_bytes(4, "little") for x in [*t.encode(texts[i] or "", add_special_tokens=False).ids, 1])
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(data) // 4)
            assert r.ids_crc32 == zlib.crc32(data[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(data) // 4
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].tier <= 2048 and at & (at - 1) == 0
        assert len({r.step_group for r in own}) == 1


def test_step_groups_are_full_over_a_whole_split():
    for step in (65_536, 3000):
        groups, rng, got = StepGroups(10, TIERS, step), random.Random(step), {}
        windows = {s: rng.choice([*TIERS, 2048]) for s in range(3000)} | {5000 + k: 64 >> k for k in range(4)}
        for s, t in windows.items():
            for row in groups.add(t, [(s, "a"), (s, "b")]):
                got.setdefault(row[0], set()).add(row[2])
        for row in groups.finish():
            got.setdefault(row[0], set()).add(row[2])
        assert got.keys() == windows.keys() and all(len(g) == 1 for g in got.values())
        tokens = Counter()
        for s, (g,) in got.items():
            tokens[g] += windows[s]
        assert sorted(tokens) == list(range(10, 10 + len(tokens)))
        last = max(tokens)
        assert all(step - 2048 < n <= step for g, n in tokens.items() if g != last) and tokens[last] <= step
        assert step % 2048 or all(n == step for g, n in tokens.items() if g != last)
    assert StepGroups(3, TIERS, 65_536).finish() == []


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string").coalesce(1)
    assert pack_documents(df).agg(F.sum("length")).first()[0] == 8
