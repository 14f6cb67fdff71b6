import hashlib
import random
import time

import pytest

from tallyspark.llm import html_text
from tallyspark.llm.html_text import lines_of, main_text, shared_lines
from tallyspark.llm.warc import read_warc, write_warc


@pytest.mark.parametrize("few", [0, 4096])
def test_longest_common_subsequence(monkeypatch, few):
    monkeypatch.setattr(html_text, "FEW_PLACES", few)
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        got = shared_lines(a, b)
        it = iter(b)
        assert len(got) == t[-1][-1] and got == sorted(set(got)) and all(a[i] in it for i in got)


def test_many_equal_lines_end_soon():
    began = time.time()
    n = 20_000
    assert len(shared_lines([7] * n, [7] * (n - 5))) == n - 5
    a, b = [1, 7, 2] * n, [7, 3] * n
    got = shared_lines(a, b)
    assert len(got) == n and all(a[i] == 7 for i in got) and time.time() - began < 60


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head><body><nav><ul><li><a>Menu</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy</div>
<article><h1>Head &amp; tail &lt;b&gt;</h1><header><p>By me</p></header><p><b>One  two
three<br><p>Fo<i>ur</i> &#233;&nbsp;x</p><p></p><aside>side</aside><form>f<input></form><div class="cookie-notice">c</div><pre>a > b</pre><section id="comments"><p>first!</p></section></article><footer>foot</footer></body></html>"""


def test_structure():
    main = [t for r, t in lines_of(PAGE) if r == 0]
    assert main == ["Head & tail <b>", "By me", "One two three", "Four é x", "a > b"]
    assert lines_of(None) == lines_of("") == [] and [t for _, t in lines_of("<p>cut <b")] == ["cut"]


def test_wrappers_and_headings_are_no_furniture():
    body = "<article><h2 class='section-header'>Head</h2><p class='share-price'>Text</p><div class='share'>Tweet</div><p class='ad'>Buy</p><form>field</form></article>"
    texts = lambda page, roles=(0,): [t for r, t in lines_of(page) if r in roles]
    for before, after in (("", ""), ("<form id='aspnetForm'>", "</form>"), ("<div class='content has-sidebar'>", "</div>"), ("<div><form><div id='page-header-search'>", "</div></form></div>"), ("<div class='layout_with_comments'>", "</div>"), ("<main><form>", "</form></main>")):
        assert texts(f"<body>{before}{body}{after}</body>") == ["Head", "Text"]
    assert texts("<body><form id='f'><p>Lead</p></form></body>", (1,)) == texts("<div class='no-sidebar'><p>Lead</p></div>", (1,)) == ["Lead"]
    for outer in ("nav", "aside", "footer", "div class='comments'", "div class='related has-x'", "div hidden"):
        assert texts(f"<body><{outer}><article><p>teaser</p></article></{outer.split()[0]}></body>", (0, 1)) == []
    assert texts("<article><p>a</p><div class='sidebar'><article>b</article></div></article>") == ["a"]


def plain(*lines):
    return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"


def test_pages_without_an_article_lose_the_lines_of_their_neighbour(spark):
    rows = [(1, "http://h/a/1", plain("Welcome to us", "text one", "Imprint")), (2, "http://h/a/2", plain("Welcome to us", "text two", "Imprint")), (3, "http://H/b", plain("Welcome to us", "text three")), (4, "http://other/a", plain("Welcome to us")), (5, None, None), (6, "http://h/zz", PAGE), (None, "http://h/a/3", plain("Imprint"))]
    df = spark.createDataFrame([(i, u, h, "t", 1) for i, u, h in rows], "page_id long, url string, html string, text string, id int").repartition(3)
    got = {r.page_id: (r.text, r.n_chars) for r in main_text(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "text one", 2: "text two", 3: "text three", 4: "Welcome to us", 5: "", 6: "Head & tail <b>\nBy me\nOne two three\nFour é x\na > b", None: "Imprint"}
    assert all(n == len(t) for t, n in got.values())
    assert main_text(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "http://h/a", plain("x y"))] * 2, "page_id long, url string, html string")
    assert [r.text for r in main_text(twice).collect()] == ["x y"] * 2


def test_differencing_decides_about_lines_outside_the_article(spark):
    def page(head, lead, body, after):
        return f"<body><div>Welcome</div><h1>{head}</h1><p>{lead}</p><nav>menu {head}</nav><article><p>One sentence of both.</p><p>{body}</p></article><div>{after}</div><div>Imprint</div></body>"

    rows = [(1, "http://h/1", page("Head 1", "Lead 1", "Body 1", "More 1")), (2, "http://h/2", page("Head 2", "Lead 2", "Body 2", "All rights")), (3, "http://h/3", page("Head 3", "Lead 3", "Body 3", "All rights"))]
    got = {r.page_id: r.text.split("\n") for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    both = "One sentence of both."
    assert got == {1: ["Head 1", "Lead 1", both, "Body 1", "More 1"], 2: ["Head 2", "Lead 2", both, "Body 2", "All rights"], 3: ["Head 3", "Lead 3", both, "Body 3"]}


def test_warc_round_trip_with_magic_in_payloads(spark, tmp_path):
    rng = random.Random(2)
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nHello\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(i, f"http://x/{i}", rng.choice([trap, trap * 3, "é" * 60, "é" * 40, "", None, f"own {i}" * 40])) for i in range(60)] + [(60, None, "x\r\n\r\n"), (61, "http://a\nb", "y")]
    df = spark.createDataFrame([(i, u, h, "t") for i, u, h in rows], "page_id long, url string, html string, payload string").repartition(3)
    write_warc(df, str(tmp_path / "w"))
    first, want = {}, set()
    for i, _, h in rows:
        data = (h or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and first.setdefault(digest, i) != i
        want.add((str(i), len(data), digest, "revisit" if again else "response", str(first[digest]) if again else None))
    got = read_warc(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert {(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(rows)
    assert all(r.intact for r in got)
    assert {r.id: bytes(r.payload) for r in got if r.record_type == "response"} == {str(i): (h or "").encode() for i, _, h in rows if (str(i), "response") in {(w[0], w[3]) for w in want}}
    write_warc(df.limit(0), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0


def test_damaged_archive_is_reported(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://x", "abcdef")], "page_id long, url string, html string")
    write_warc(df, str(tmp_path / "w"))
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    for part in (tmp_path / "w").glob("part-*"):
        part.write_bytes(part.read_bytes().replace(b"abcdef", b"abcdeX"))
    assert [r.intact for r in read_warc(spark, str(tmp_path / "w")).collect()] == [False]
