"""WARC archives written and read with Spark's own readers and writers, records found by boundary-chain verification.

Writing: each record is one string and the text writer's line separator is the blank lines that end a record, so archives
go through Spark's commit protocol to any store. Reading: tasks list every place that looks like a record's start together
with the place where that record would end; pointer jumping from each file's start, doubling the distance in each round,
then keeps the places that the chain of records really reaches. A record's magic inside a payload is never reached."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, is_empty, join_sized, shared_folder, table

MAGIC = b"WARC/1.1\r\n"
CRLF = "\r\n"
_MAGIC, _BLANK = re.compile(re.escape(MAGIC)), re.compile(rb"\r\n\r\n")
#: Records of an archive at most, which bounds the rounds of pointer jumping, by the payload's bytes: files of up to 64 MB, or
#: of one record.
FILE_RECORDS = ((1 << 16, 1000), (1 << 20, 64), (1 << 24, 4), (None, 1))
#: Bytes in which a record's header must end.
HEAD_BYTES = 1 << 16
#: Payloads shorter than this are stored each time.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record per row: a response, or a revisit of the row of smallest id with the same payload of REVISIT_BYTES or more.

    Null payloads are empty; null urls are left out; rows that repeat an id with one payload are responses both; other
    columns are ignored. An empty table gives archives without records."""
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    base = base.withColumns({"n": F.octet_length("payload"), "digest": F.sha2("payload", 256)})
    tier = F.coalesce(*[F.when(F.col("n") <= most, k) for k, (most, _) in enumerate(FILE_RECORDS) if most], F.lit(len(FILE_RECORDS) - 1))
    narrow = durable(base.filter(F.col("n") >= REVISIT_BYTES).select("id", "digest", tier.alias("tier")))
    first = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    again = durable(narrow.join(first, "digest").filter("id <> first").select("id", "first").distinct())
    rows = join_sized(base, again, "id", "left").withColumn("first", F.when(F.col("n") >= REVISIT_BYTES, F.col("first")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *[F.lit(v) if isinstance(v, str) else v for v in value], F.lit(CRLF))
    revisit = F.col("first").isNotNull()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    record = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", "<urn:x-page:", text("id"), ">"), line("WARC-Date", "2024-01-01T00:00:00Z"),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "")), F.lit("")), line("WARC-Payload-Digest", "sha256:", F.col("digest")), line("WARC-Payload-Length", text("n")),
        F.when(revisit, F.concat(line("WARC-Refers-To", "<urn:x-page:", text("first"), ">"), line("WARC-Profile", PROFILE))).otherwise(F.lit("")),
        line("Content-Type", "application/http; msgtype=response"), line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")), F.lit(CRLF), http, F.when(revisit, "").otherwise(F.col("payload")),
    )
    large = {r["tier"] for r in narrow.select("tier").distinct().collect()} - {0}
    for k, (_, records) in enumerate(FILE_RECORDS):
        if k == 0 or k in large:
            part = rows.filter(tier == k).select(record.alias("record"))
            part.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records).mode("append" if k else "errorifexists").text(path)


def _candidates(batches, with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Files (path, content) -> a row for each place in them that starts like a record."""
    names = ["file", "at", "next", "record_type", "id", "refers_to", "payload_bytes", "payload_digest", "intact"] + ["payload"] * with_payload
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * with_payload
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            data, rows = memoryview(content.as_buffer()), []
            for m in _MAGIC.finditer(data):
                gap = _BLANK.search(data, m.end(), m.end() + HEAD_BYTES)
                head = dict(re.findall(rb"(?m)^([A-Za-z-]+): ?(.*?)\r?$", data[m.end() : gap.start()])) if gap else {}
                size = head.get(b"Content-Length", b"")
                if not size.isdigit():
                    continue
                block = gap.end()
                stop = block + int(size)
                kind, text = head.get(b"WARC-Type", b"").decode("utf-8", "replace"), lambda k, head=head: head.get(k, b"").decode("utf-8", "replace")
                http = _BLANK.search(data, block, stop)
                payload = data[http.end() : stop] if http else data[block:stop]
                stored = text(b"WARC-Payload-Digest").removeprefix("sha256:")
                # Only a place whose end another record's start, or the file's end, follows can be whole: others need no digest.
                ends = stop + 4 >= len(data) or data[stop : stop + 4 + len(MAGIC)] == b"\r\n\r\n" + MAGIC
                if kind == "revisit":
                    length = text(b"WARC-Payload-Length")
                    digest, n, intact = stored, int(length) if length.isdigit() else 0, True
                else:
                    digest, n = sha256(payload).hexdigest() if ends else None, len(payload)
                    intact = ends and stop <= len(data) and stored in ("", digest)
                bare = lambda k: text(k).strip("<>").removeprefix("urn:x-page:") or None
                rows.append((path, m.start(), stop + 4, kind, bare(b"WARC-Record-ID"), bare(b"WARC-Refers-To"), n, digest, intact, *([bytes(payload)] if with_payload else [])))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def reached(links: DataFrame) -> DataFrame:
    """Of links (file, at, next), the places (file, at) that the chain from the file's place 0 reaches.

    After round k each place knows its successor 2^k records on, and those within 2^k records of the start are marked: a
    marked place marks its successor, then all successors double their distance. One table of all places, rewritten."""
    places = durable(links.select("file", "at", "next", (F.col("at") == 0).alias("on")))
    while not is_empty(places.filter("next is not null")):
        marks = places.filter("on and next is not null").select("file", F.col("next").alias("at"), F.lit(True).alias("mark"))
        far = places.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        places = durable(places.join(marks, ["file", "at"], "left").withColumn("on", F.col("on") | F.coalesce("mark", F.lit(False))).join(far, ["file", "next"], "left").select("file", "at", F.col("far").alias("next"), "on"))
    return places.filter("on").select("file", "at")


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives under path: record_type, id, refers_to, payload_bytes, payload_digest, intact (whether a
    response's payload has the digest that its header states), and the payload if asked for.

    Archives are read whole, a file to a task at a time, so they should be of bounded size, as write_warc makes them. A record
    that does not end before another one, or at the file's end, is not intact and has no digest."""
    rest = ", payload binary" if with_payload else ""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(lambda b: _candidates(b, with_payload), f"file string, at long, next long, record_type string, id string, refers_to string, payload_bytes long, payload_digest string, intact boolean{rest}")
    if not with_payload:
        found = durable(found)
    links = found.select("file", "at", "next") if not with_payload else durable(found.select("file", "at", "next"))
    return found.join(reached(links), ["file", "at"], "left_semi").drop("file", "at", "next")


def shared_place(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every page, as its record reads in the archives."""
    place = shared_place(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), place)
    got = read_warc(spark, place)
    whole = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("id"))))
    return got.select(F.expr("try_cast(id AS long)").alias("page_id"), "payload_bytes", whole.cast("string").alias("payload_digest"), "record_type", F.expr("try_cast(refers_to AS long)").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
