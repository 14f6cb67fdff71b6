import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.coerce import NA_TOKENS
from tallyspark.sources.charset import detect_encoding
from tallyspark.sources.csv_splits import Quotes
from tallyspark.sources.readers import INDEX, open_csv, open_parquet, open_source
from tallyspark.sources.sniff import SourceError


def cells(rng, sep):
    pool = ["plain", "", "NA", "a b", f"x{sep}y", 'say "hi"', "two\nlines", "cr\r\nlf", '"', '""', "é", "\n", f'",{sep}"\n"', "1" * 40]
    return [rng.choice(pool) for _ in range(3)]


def written(rows, sep=",", end="\r\n"):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator=end).writerows(rows)
    return out.getvalue()


def told(text, sep=","):
    """What Python's csv reads below the header, without blank lines, marks for null as None."""
    got = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if any(c.strip() for c in r) or len(r) > 1][1:]
    return [(i, *(None if c in NA_TOKENS else c for c in r)) for i, r in enumerate(got)]


def in_small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def split(spark):
    yield lambda size: in_small_splits(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("sep, end, size", [(",", "\r\n", 64), (";", "\n", 100), ("\t", "\n", 300), ("|", "\n", 1 << 20)])
def test_quoted_line_ends_at_split_bounds(spark, split, tmp_path, sep, end, size):
    rng = random.Random(size)
    text = written([["a", "b", "c"]] + [cells(rng, sep) for _ in range(400)], sep, end)
    (tmp_path / "x.csv").write_text(text, encoding="utf-8", newline="")
    split(size)
    source = open_csv(spark, f"file://{tmp_path}/x.csv", sep)
    assert source.table.columns == [INDEX, "a", "b", "c"]
    got = source.table.collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == told(text, sep)
    assert source.counts() == {"records": len(got), "bad_lines": 0} and source.rejected.count() == 0


def test_files_without_crossing_records_do_not_change_the_cuts(spark, split, tmp_path):
    want = [(str(i), "two\nlines " * (i % 7)) for i in range(600)]
    (tmp_path / "f0.csv").write_text("id,v\n")
    (tmp_path / "f1.csv").write_text(written([["id", "v"], *want], end="\n"), newline="")
    split(1 << 20)
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    got = open_csv(spark, str(tmp_path)).table.select("id", F.coalesce("v", F.lit(""))).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_bad_lines_are_counted_in_the_same_action_and_kept(spark, split, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,2\n1,2,3\n\n4\n"x\ny",5,6,7\n8,"9\n"\n')
    split(12)
    source = open_csv(spark, str(tmp_path / "x.csv"))
    assert sorted(map(tuple, source.table.collect())) == [(0, "1", "2"), (2, "4", None), (4, "8", "9\n")]
    assert source.counts() == {"records": 5, "bad_lines": 2}
    assert sorted(map(tuple, source.rejected.collect())) == [(1, "1,2,3"), (3, '"x\ny",5,6,7')]


def test_files_of_a_folder_are_numbered_in_the_order_of_their_paths(spark, split, tmp_path):
    rng, want = random.Random(1), []
    for k in (3, 0, 2, 1):
        rows = [[f"{k}-{i}", "two\nlines" if i % 3 else "one"] for i in range(rng.randrange(5, 60))]
        (tmp_path / f"f{k}.csv").write_text("intro, not a row\n" + written([["id", "v"], *rows]), newline="")
    for k in range(4):
        text = (tmp_path / f"f{k}.csv").read_text().split("\n", 1)[1]
        want += [r[1] for r in told(text)]
    split(80)
    got = {r[0]: r[1] for r in open_csv(spark, str(tmp_path), skip_rows=1).table.collect()}
    assert [got[i] for i in range(len(got))] == want
    (tmp_path / "f9.csv").write_text("intro\nid,other\n1,2\n")
    with pytest.raises(Exception, match="header is"):
        open_csv(spark, str(tmp_path), skip_rows=1).table.collect()


def test_parquet_rows_are_numbered_over_files_of_shuffled_sizes(spark, split, tmp_path):
    for k, n in enumerate((500, 3, 900, 40)):
        spark.range(n).select(F.lit(k).alias("k"), "id", F.lit("x" * 50).alias("pad")).coalesce(1).write.parquet(str(tmp_path / f"d{k}"))
    files = sorted(str(p) for p in tmp_path.glob("d*/*.parquet"))
    folder = tmp_path / "all"
    folder.mkdir()
    for k, p in enumerate(files):
        (folder / f"part-{k}.parquet").write_bytes(open(p, "rb").read())
    split(2000)
    got = sorted(tuple(r) for r in open_parquet(spark, str(folder)).table.select(INDEX, "k", "id").collect())
    assert got == [(i, k, j) for i, (k, j) in enumerate((k, j) for k, n in enumerate((500, 3, 900, 40)) for j in range(n))]


def test_any_store_that_spark_reads(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shop.link./in", f"file://{tmp_path}")
    (tmp_path / "x.csv").write_text('a,b\n"1\n2",3\n')
    assert [tuple(r) for r in open_source(spark, "viewfs://shop/in/x.csv").table.collect()] == [(0, "1\n2", "3")]
    with pytest.raises(SourceError, match="does not exist"):
        open_source(spark, "viewfs://shop/in/y.csv")


def test_what_can_not_be_read(spark, split, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b\n1,"open\n2,3\n')
    with pytest.raises(SourceError, match="not closed"):
        open_csv(spark, str(p))
    p.write_text("a,b\n")
    assert open_csv(spark, str(p)).table.count() == 0
    p.write_text("one\ntwo\nthree, four\n" * 9)
    split(20)
    with pytest.raises(SourceError, match="first split"):
        open_csv(spark, str(p), ",", skip_rows=8)


def test_quotes_follow_the_csv_rules():
    q = Quotes(",")
    for line, outside, inside in [('a,"b', True, False), ('a"b,c', False, False), ('"a""b', True, False), ('"a"b"c', False, False), ("", False, True), ('x",y', False, False), ('x","y', True, True), ('""', False, True), ('"""', True, False)]:
        assert (q.open(line, False), q.open(line, True)) == (outside, inside), line
    rng = random.Random(0)
    for _ in range(3000):
        line = "".join(rng.choice('ab,"') for _ in range(rng.randrange(9)))
        for inside in (False, True):
            fed = ('"' if inside else "") + line + "\n" + 'END"'  # a field that stays open swallows the next line
            assert q.open(line, inside) == (len(list(csv.reader(io.StringIO(fed, newline="")))) == 1), (line, inside)


WEST = "Le café coûte 5 €, déjà payé à la fête. Der Bär läuft über die Straße, außerdem schöne Grüße. El niño comió piñas en Málaga. "
VIET = "Công ty đã thanh toán tiền thuê nhà tháng mười hai cho ông Nguyễn Văn Hưng ở Đà Nẵng, số tiền là năm trăm triệu đồng. "


def in_1258(text):
    import unicodedata

    out = []
    for c in text:
        try:
            c.encode("windows-1258")
            out.append(c)
        except UnicodeEncodeError:
            d = unicodedata.normalize("NFD", c)
            tones = [x for x in d if x in "̣̀́̃̉"]
            out.append(unicodedata.normalize("NFC", "".join(x for x in d if x not in tones)) + "".join(tones))
    return "".join(out).encode("windows-1258")


@pytest.mark.parametrize("data, charset", [
    (WEST.encode("windows-1252"), "windows-1252"), ((WEST * 40).encode("windows-1252"), "windows-1252"), (in_1258(VIET), "windows-1258"), (in_1258(VIET * 40), "windows-1258"), (WEST.encode("utf-16-le"), "utf-16-le"), (VIET.encode("utf-16-be"), "utf-16-be"),
    (("﻿" + WEST).encode("utf-16-le"), "utf-16-le"), (WEST.encode(), "utf-8"), (VIET.encode(), "utf-8"), (b"plain,text\n", "utf-8"), (b"\xef\xbb\xbfa,b", "utf-8-sig"), ((VIET * 2000).encode()[: 100 * 1024], "utf-8"), ("a|b\n1|café\n".encode("latin-1"), "windows-1252"),
])
def test_charsets(data, charset):
    found, sure = detect_encoding(data)
    assert found == charset and sure >= 0.7


def test_noise_is_a_guess():
    assert detect_encoding(bytes(random.Random(3).choices(range(128, 256), k=5000)))[1] < 0.7


def test_charsets_through_the_reader(spark, split, tmp_path):
    for data, want in ((in_1258("tên,số\n" + VIET.replace(",", "") + ',"1\n2"\n'), VIET.replace(",", "")), (("a,b\n" + WEST.replace(",", "") + ',"1\n2"\n').encode("utf-16-le"), WEST.replace(",", ""))):
        (tmp_path / "x.csv").write_bytes(data)
        import unicodedata

        for size in (1 << 20, 64):
            split(size)
            (row,) = open_csv(spark, str(tmp_path / "x.csv"), ",").table.collect()
            assert unicodedata.normalize("NFC", row[1]) == want and row[2] == "1\n2"
