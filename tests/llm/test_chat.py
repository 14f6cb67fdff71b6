import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyspark.llm.chat import CONTROLS, HOSTILE, TEMPLATE, conversation_digests, format_conversations, read_back
from tallyspark.llm.chat_template import Apply, Const, For, Out, Rendered, TemplateError, compile_template, escape, escape_line, fold, parse, unescape, unescape_line

SHAPE = "conv_id long, turn long, role string, text string, piece string, n_turns int"


def render(source, turns, constants=None):
    out, t = Rendered(), compile_template(source, constants)
    for i, (role, text) in enumerate(turns):
        t.render({"role": role, "text": text}, i, i + 1 == len(turns), out)
    return "".join(out.parts), out.spans


def brute(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in talks.items():
        turns = [t[2:] for t in sorted(turns)]
        text, _ = render(TEMPLATE, turns, CONTROLS)
        said = "".join(t for r, t in turns if r == "assistant")
        assert read_back(text) == turns
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), digest(said), len(text)))
    return sorted(out, key=repr)


def talk():
    rng = random.Random(2)
    pool = ["hello", "", None, HOSTILE, "<", "|x", "<\\|", "a\nb", "é" * 50, "\\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole <|im_end|>\\"]), rng.choice(pool)) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(1000, t % 700, "assistant" if t % 2 else "user", f"turn {t} <|") for t in range(900)]  # a conversation over all partitions
    rows += [(5, None, "user", "first"), (5, 0, "user", "hello"), (5, 0, "user", "hello"), (None, 1, "user", "nobody"), (None, 0, "assistant", "x")]
    rows += [(2000, 0, "assistant", "long " * 300_000), (2000, 1, "assistant", "<|" * 200_000), (-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_digests_match_brute_force(spark, coalesced):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        df = spark.createDataFrame([(*r, "x", 1) for r in talk()], SHAPE).repartition(5)
        whole, shared = format_conversations(df)
        assert (shared.count() > 0) == (coalesced == "false")
        got = conversation_digests(whole, shared)
        assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(talk())
        pieces = whole.unionByName(shared).filter("conv_id = 2000").orderBy("piece").collect()
        assert [r.n_turns for r in pieces] == [1, 1]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_equal_rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        none = spark.createDataFrame([], SHAPE)
        assert conversation_digests(*format_conversations(none)).collect() == []
        same = [(1, 0, "assistant", "again")] * 300
        whole, shared = format_conversations(spark.createDataFrame([(*r, "", 0) for r in same], SHAPE))
        assert shared.count() > 1 and [tuple(r) for r in conversation_digests(whole, shared).collect()] == brute(same)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


TEXT = st.text(st.sampled_from(list("<|\\n\n>im_startend é")), max_size=30)


@given(TEXT)
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text and unescape_line(escape_line(text)) == text
    assert "<|" not in escape(text) and "<|" not in escape_line(text) and "\n" not in escape_line(text)


@given(st.lists(st.tuples(TEXT | st.just("assistant"), TEXT), min_size=1, max_size=5))
def test_rendered_conversations_read_back(turns):
    text, spans = render(TEMPLATE, turns, CONTROLS)
    assert read_back(text) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_place_in_the_loop_and_what_stands_around_it():
    source = "{# remark #}<s>{% for m in messages %}{% if loop.first and m.role != 'system' %}[{{ default | upper }}]{% endif %}{{ loop.index }}:{{ m['text'] | trim }}{{ '' if loop.last else ', ' }}{% endfor %}</s>"
    assert render(source, [("user", " a "), ("user", "b")], {"default": "be kind"})[0] == "<s>[BE KIND]1:a, 2:b</s>"
    assert render(source, [("system", "a")], {"default": "be kind"})[0] == "<s>1:a</s>"


def test_constants_fold_to_one_text():
    nodes = fold(parse("{% for m in messages %}a{{ start ~ 1 ~ ('x' if on else m.text) }}{% if not on %}{{ m.role }}{% elif 1 < 2 %}b{% else %}c{% endif %}{{ none }}{% endfor %}"), {"start": "<", "on": True})
    assert nodes == (For("m", (Out(Const("a<1xb")),)),)
    kept = fold(parse("{% for m in messages %}{{ 'a' ~ 'b' ~ m.text }}{% endfor %}"), {})
    assert isinstance(kept[0].body[0].value, Apply) and kept[0].body[0].value.args[0] == Const("ab")


@pytest.mark.parametrize("source, said", [
    ("no loop", "one loop"), ("{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "stands alone"),
    ("{% for m in messages %}{{ os }}{% endfor %}", "unknown names: os"), ("{% for m in messages %}{{ m.text() }}{% endfor %}", "unexpected '('"),
    ("{% for m in messages %}{{ m | eval }}{% endfor %}", "no filter"), ("{% for m in messages %}", "endfor is missing"), ("{% set x = 1 %}{% for m in messages %}{% endfor %}", "unknown tag"),
    ("{% for m in messages %}{{ m.text }{% endfor %}", "not closed"), ("{% for m in messages %}{% endfor %}{{ 'a", "not closed"), ("{% for m in messages %}{{ 'a' < 1 }}{% endfor %}", "constant expression"), ("{% for m in messages %}{{ 3.real }}{% endfor %}", "constant expression"), ("{{ m.role }}{% for m in messages %}{% endfor %}", "unknown names: m"),
])
def test_rules_are_kept(source, said):
    with pytest.raises(TemplateError, match=said.replace("(", r"\(")):
        compile_template(source)


def test_fields_are_looked_up_in_records_only():
    with pytest.raises(TypeError, match="only records"):
        render("{% for m in messages %}{{ m.text.__class__ }}{% endfor %}", [("user", "a")])
    assert render("{% for m in messages %}{{ m.__class__ }}{% endfor %}", [("user", "a")])[0] == ""
