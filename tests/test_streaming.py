"""A stream gives what the batch gives."""

import pytest
from pyspark.sql import functions as F

from factspan.operators import ledger, units
from factspan.streaming import windows


@pytest.fixture
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_windows_match_the_batch(spark, events, tmp_path):
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    s = windows.read_appended(spark, str(tmp_path / "in"), events.schema)
    drain(windows.tumbling(s, "1 hour").writeStream.format("memory").queryName("tumble").outputMode("complete").start())
    got = sorted(map(tuple, spark.table("tumble").collect()))
    assert got == sorted(map(tuple, windows.tumbling(events, "1 hour").collect()))


def test_incremental_index_equals_rebuild(spark, tmp_path):
    sents = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} x") for i in range(40)], "sid long, sent string")
    sents.repartition(4).write.parquet(str(tmp_path / "in"))
    s = windows.read_appended(spark, str(tmp_path / "in"), sents.schema, maxFilesPerTrigger="1")
    q = windows.index_incrementally(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    key = lambda df: sorted((r.unit, r.block, tuple(r.sids)) for r in df.collect())
    assert key(windows.merged_index(spark, str(tmp_path / "out"))) == key(units.postings(units.once(sents), "WORD"))


def test_streaks_carry_over_batches(spark, tmp_path):
    rows = [("r", i, "a") for i in range(12)] + [("r", 12, "b")]
    spark.createDataFrame(rows, "run string, seq long, key string").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = windows.read_appended(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    drain(windows.streaks(s).writeStream.format("memory").queryName("streaks").outputMode("append").start())
    got = spark.table("streaks").orderBy(F.col("key"), "streak").collect()
    assert [r.refused for r in got] == [False] * 8 + [True] * 4 + [False]


def test_uncommitted_sessions_stay_invisible(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "session long, v string")
    assert [r.v for r in windows.committed(rows, rows.where("session = 2")).collect()] == ["y"]


def test_sealed_batches_equal_one_seal(spark, tmp_path):
    rows = [(r, i, f"b{i}") for r in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "run long, o long, body string")
    for k in range(2):
        df.where(f"o div 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = windows.read_appended(spark, str(tmp_path / "in"), df.schema, maxFilesPerTrigger="1")
    windows.seal_batches(s, str(tmp_path / "out"), str(tmp_path / "cp"), "run", "o", F.col("body")).awaitTermination()
    key = lambda d: sorted((r.run, r.i, r.body, r.prev, r.sha) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(ledger.seal(df, "run", "o", F.col("body")))
