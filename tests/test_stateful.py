import random

import pytest

from tallyspark.streaming.stateful import repeated_stream, sequence_stream

SHAPE = "row_index long, ts timestamp, txn string, amount double, invoice string, vendor string"


def ledger():
    import datetime as dt

    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=rng.randrange(300)), f"TXN{rng.randrange(60):03d}" if rng.random() < 0.9 else None, float(rng.randrange(3)), f"I{rng.randrange(90)}" if rng.random() < 0.9 else None, rng.choice("AB")) for i in range(150)]
    rng.shuffle(rows)  # partners come in any order, across files
    return rows


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("kind", ["sequence", "repeated"])
def test_stream_and_batch_agree_on_rows_in_any_order(spark, rocks, tmp_path, kind):
    rows = ledger()
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    make = (lambda df: sequence_stream(df, "ts", "txn", "amount", ["vendor"], "1 day", "2 days")) if kind == "sequence" else (lambda df: repeated_stream(df, "ts", ["invoice", "vendor"], "1 day", "2 days"))
    want = sorted(r.row_index for r in make(spark.createDataFrame(rows, SHAPE)).collect())
    stream = make(spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName(f"found_{kind}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = sorted(r.row_index for r in spark.table(f"found_{kind}").collect())
    assert got == want and len(got) > 10


def test_batch_finds_text_ids(spark):
    rows = [(0, None, "TXN009", 5.0, None, "A"), (1, None, "TXN010", 5.0, None, "A"), (2, None, "TXN011", 6.0, None, "A"), (3, None, "B010", 5.0, None, "A"), (4, None, "TXN010", 5.0, None, "B")]
    assert sorted(r.row_index for r in sequence_stream(spark.createDataFrame(rows, SHAPE), "ts", "txn", "amount", ["vendor"]).collect()) == [1]
