"""Main text of web pages by differencing each page with the page of the nearest URL on its host.

A page is read into text lines, one per block, each with a role from the markup around it: main (inside an article or main
element), furniture (inside menus, headers, footers, sidebars, notices, adverts, forms, comments) or plain. Pages of a host
are sorted by URL path and each is paired with the page before it (the first with the page after it); their lines are
aligned by a longest common subsequence. Furniture is deleted in any case, and of the plain lines, on pages with an article
or without, those that both pages have. Lines inside a page's own article are not up for deletion: differencing alone would
delete sentences that several articles share and keep menus and adverts that differ from page to page."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import by_slices, durable, join_sized, small_batches, table

MAIN, PLAIN, FURNITURE = 0, 1, 2
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HIDDEN = frozenset("head script style noscript template textarea title xmp noembed noframes iframe svg math object select option button canvas audio video map datalist".split())
BOUND = frozenset("nav aside footer form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup "
    "sidebar aside widget related recommended share sharing social breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond replies nav navbar navigation menu header footer masthead toolbar login search".split()
)
#: Those of WORDS that also name wrappers of whole pages and the heads of sections: an article below is none the less one.
LOOSE = frozenset("banner notice notification alert modal overlay subscribe subscription signup sidebar aside widget share sharing social nav navbar navigation menu header footer masthead toolbar login search".split())
#: What follows these in a class says what the page around has, not what the element is.
MODIFIERS = frozenset("has have with without no".split())
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Kinds of furniture: what an article or main element inside undoes, and what it does not.
WRAPS, FIRM = 1, 2
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?", re.I)
SPACES = re.compile(r"\s+")
#: Pairs of equal lines that are searched directly.
FEW_PLACES = 4096


def _named(value: str) -> set[str]:
    """The words of a class or id, without those after a modifier."""
    found = set()
    for name in value.split():
        for word in re.split(r"[_-]+", name):
            if word in MODIFIERS:
                break
            found.add(word)
    return found


def _furnishes(tag: str, attributes: str, inside_main: bool, parent: str) -> int:
    """0, or the kind of furniture that the element is."""
    found = 0
    if tag in BOUND or tag == "header" and not inside_main:
        found = FIRM if tag != "form" else 0 if parent == "body" else WRAPS
    if not attributes:
        return found
    for name, *value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(value).lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return FIRM
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            words = WORDS & _named(value)
            if words - LOOSE:
                return FIRM
            if words and not (inside_main and tag in TEXTUAL):
                found = found or WRAPS
        if name in ("class", "id") and tag in ("article", "main") and not {"comment", "comments", "ad", "advert", "related"}.isdisjoint(_named(value)):
            return FIRM
    return found


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of each block of a whole page, in page order: references decoded, white space one space, trimmed."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, hidden, furniture, main
    hidden = main = False
    furniture = 0
    held: list[str] = []
    role, at, end = PLAIN, 0, len(page)

    def flush() -> None:
        if held:
            text = SPACES.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((role, text))

    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not hidden:
            now = FURNITURE if furniture else MAIN if main else PLAIN
            if now != role:
                flush()
                role = now
            held.append(page[at:stop])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    _, hidden, furniture, main = stack[k]
                    del stack[k:]
                    break
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "math")):
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
                continue
            own = _furnishes(tag, m[3], main, stack[-1][0] if stack else "")
            article = tag in ("article", "main") or "role=\"main\"" in m[3]
            undone = article and furniture == WRAPS and all(open_[0] != "article" for open_ in stack)
            stack.append((tag, hidden, furniture, main))
            hidden = hidden or tag in HIDDEN
            furniture = own if undone else max(furniture, own)
            main = main or article
    flush()
    return out


def _few_places(a: list[int], b: list[int], places: dict[int, list[int]]) -> list[int]:
    """Places of a in a longest common subsequence of a and b (Hunt and Szymanski's, over equal places from the right)."""
    tails: list[int] = []
    nodes: list[tuple] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j), nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    found, node = [], nodes[-1] if nodes else None
    while node:
        found.append(node[0])
        node = node[1]
    return found[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each beginning of b, the empty one first; a bit for each line of b."""
    marks: dict[int, int] = {}
    for j, x in enumerate(b):
        marks[x] = marks.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        if x in marks:
            both = row & marks[x]
            row = ((row + both) | (row - both)) & every
    zero = 1 - np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(zero, dtype=np.int64)])


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places of a in a longest common subsequence of a and b, in linear space however often lines repeat: common ends go
    first; where few places are equal they are searched directly, else a is halved where the lengths say (Hirschberg's)."""
    found: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append(a1)
        if a0 == a1 or b0 == b1:
            continue
        own, other = a[a0:a1], b[b0:b1]
        places: dict[int, list[int]] = {}
        for j in range(len(other) - 1, -1, -1):
            places.setdefault(other[j], []).append(j)
        if sum(len(places.get(x, ())) for x in own) <= FEW_PLACES or len(own) == 1:
            found += [a0 + i for i in _few_places(own, other, places)]
            continue
        half = len(own) // 2
        k = int((_lengths(own[:half], other) + _lengths(own[half:][::-1], other[::-1])[::-1]).argmax())
        work += [(a0, a0 + half, b0, b0 + k), (a0 + half, a1, b0 + k, b1)]
    return sorted(found)


def _outlined(batches) -> Iterator[pa.RecordBatch]:
    """Pages (id, html) -> the roles and line hashes of pages that have lines which differencing may delete."""
    for batch in by_slices(batches, "html"):
        roles, hashes = [], []
        for page in batch.column("html").to_pylist():
            got = lines_of(page)
            roles.append(bytes(r for r, _ in got))
            hashes.append(np.array([xxhash.xxh3_64_intdigest(t) for _, t in got], np.uint64).view(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), pa.array(roles, pa.binary()), pa.array(hashes, pa.binary())], ["id", "host", "path", "roles", "lines"])


def _chained(batches) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, host, path, id) -> each with the ids before and after it in its part; edge marks a part's ends."""
    last, part = None, None
    for batch in batches:
        d = batch.to_pydict()
        rows = list(zip(d["part"], d["host"], d["path"], d["id"]))
        out = [(row, (rows[k - 1] if k else last)) for k, row in enumerate(rows)]
        if rows:
            last, part = rows[-1], rows[-1][0]
        same = [before if before is not None and before[0] == row[0] else None for row, before in out]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r, _ in out], pa.int32()), pa.array([r[1] for r, _ in out], pa.string()), pa.array([r[2] for r, _ in out], pa.string()), pa.array([r[3] for r, _ in out], pa.int64()),
            pa.array([b and b[1] for b in same], pa.string()), pa.array([b and b[3] for b in same], pa.int64()), pa.array([b is None for b in same], pa.bool_()),
        ], ["part", "host", "path", "id", "host_before", "before", "first"])


def neighbours(outline: DataFrame) -> DataFrame:
    """outline (id, host, path) -> (id, other): the id before in the order of host, path and id, or after it for a host's first.

    Pages are range-partitioned, so a host of any size is spread over tasks; only each task's first and last row are put
    in order in one task."""
    order = ["host", "path", "id"]
    placed = outline.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    chain = durable(placed.select("part", *order).mapInArrow(_chained, "part int, host string, path string, id long, host_before string, before long, first boolean"))
    ends = chain.filter("first").select(*order, F.lit(True).alias("first")).union(chain.groupBy("part").agg(F.max(F.struct(*order)).alias("x")).select("x.*", F.lit(False).alias("first")))
    w = Window.orderBy(*order, F.desc("first"))
    ends = ends.select("id", "first", F.lag("host").over(w).alias("h"), F.lag("id").over(w).alias("b")).filter("first").select("id", "h", "b")
    chain = chain.join(ends, "id", "left").select("id", "host", F.coalesce("host_before", "h").alias("h"), F.coalesce("before", "b").alias("b"))
    before = durable(chain.select("id", F.when(F.col("h").eqNullSafe(F.col("host")), F.col("b")).alias("other")))
    after = before.filter("other is not null").select(F.col("other").alias("id"), F.col("id").alias("after"))
    lone = before.filter("other is null").select("id").join(after, "id").groupBy("id").agg(F.min("after").alias("other"))
    return before.filter("other is not null").union(lone)


def _deleted(batches) -> Iterator[pa.RecordBatch]:
    """Pairs (id, roles, lines, other lines) -> the places of a page's plain lines that it shares with the other page."""
    for batch in batches:
        ids, gone = [], []
        for id_, roles, own, other in zip(*(batch.column(c).to_pylist() for c in ("id", "roles", "lines", "other_lines"))):
            at = [i for i in shared_lines(np.frombuffer(own, np.int64).tolist(), np.frombuffer(other, np.int64).tolist()) if roles[i] == PLAIN]
            if at:
                ids.append(id_), gone.append(at)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["id", "gone"])


def _texts(batches) -> Iterator[pa.RecordBatch]:
    for batch in by_slices(batches, "html"):
        texts = []
        for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist()):
            got, gone = lines_of(page), set(gone or ())
            texts.append("\n".join(t for i, (r, t) in enumerate(got) if r != FURNITURE and i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page.

    The text is what a page's article or main element holds besides furniture, and the page's other lines that are not
    furniture and that its neighbour does not share, in page order. Null and empty pages have an empty text. Null urls and urls without a host are one
    host; rows that repeat an id count once as neighbours and have a result each; other columns are ignored. Rows with a
    null id are extracted, without differencing."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    outline = rows.filter("id is not null").select("id", host.alias("host"), path.alias("path"), "html").mapInArrow(_outlined, "id long, host string, path string, roles binary, lines binary")
    outline = durable(outline.dropDuplicates(["id"]))
    lines = outline.select("id", "roles", "lines")
    pairs = neighbours(outline).join(lines, "id").join(lines.select(F.col("id").alias("other"), F.col("lines").alias("other_lines")), "other")
    gone = durable(pairs.select("id", "roles", "lines", "other_lines").mapInArrow(_deleted, "id long, gone array<int>"))
    texts = join_sized(rows, gone, "id", "left").select("id", "url", "html", "gone").mapInArrow(_texts, "id long, url string, text string")
    return texts.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
