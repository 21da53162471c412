"""A stream's memory against the batch that sees all rows at once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citewright.streaming import memory

TTL = 7200
KIND = "user_id long, ts timestamp, url string"


def rows_of(df):
    return sorted(((r["user_id"], r["ts"], r["url"], r["hit"], r["fresh"]) for r in df.collect()), key=repr)


def run(spark, source, out, state, ttl=TTL):
    looked = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    q = memory.stream_memory(looked, ttl, "user_id").writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return q


def put(spark, rows, folder, n):
    """One file of the source, and so one micro-batch; files are taken in order of their times."""
    import os

    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}-{n}")
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(f"{folder}-{n}") if f.startswith("part-"))
    os.rename(f"{folder}-{n}/{part}", f"{folder}/{n:03d}.parquet")
    os.utime(f"{folder}/{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


@pytest.fixture(scope="module")
def looked(spark, sf):
    """Events look up the pages; a user's pages come again."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("p"), "url")
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 + F.col("user_id") % 5).alias("p"))
    return [tuple(r) for r in e.filter("ts is not null").join(pages, "p", "left").select("user_id", "ts", "url").orderBy("ts", "user_id").collect()]


def test_stream_equals_batch_over_three_batches_with_a_restart(spark, looked, tmp_path):
    looked = looked[:1500]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    third = len(looked) // 3
    # a batch does not split a time, so that order inside it is told by time alone
    cuts = [next(i for i in range(k, len(looked)) if looked[i][1] != looked[i - 1][1]) for k in (third, 2 * third)]
    late = (looked[0][0], looked[0][1] - timedelta(days=1), "http://late.org")
    put(spark, looked[: cuts[0]], source, 0)
    put(spark, looked[cuts[0] : cuts[1]], source, 1)
    run(spark, source, out, state)
    before = spark.read.parquet(out).count()
    assert before == cuts[1]
    put(spark, [*looked[cuts[1] :], late], source, 2)  # the stream starts again from its checkpoint
    run(spark, source, out, state)
    got = rows_of(spark.read.parquet(out))
    want = rows_of(memory.batch_memory(spark.createDataFrame(looked, KIND), TTL, "user_id"))
    assert len(got) == len(looked) and got == want  # the late row is dropped
    assert {r[3] for r in got} == {True, False} and {r[4] for r in got} == {True, False}


def test_a_retry_in_a_later_batch_knows_its_urls(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    put(spark, [(1, at(0), "a"), (1, at(1), "b"), (2, at(2), "a"), (None, at(2), "a"), (1, at(3), None)], source, 0)
    put(spark, [(1, at(50), "a"), (1, at(51), "c"), (None, at(52), "a")], source, 1)
    put(spark, [(1, at(99), "b"), (1, at(100), "a"), (1, at(101), "b"), (2, at(5000), "a"), (1, None, "z")], source, 2)
    run(spark, source, out, state, ttl=100)
    got = rows_of(spark.read.parquet(out))
    assert got == sorted([
        (1, at(0), "a", False, True), (1, at(1), "b", True, True), (2, at(2), "a", False, True), (None, at(2), "a", False, True), (1, at(3), None, True, None),
        (1, at(50), "a", True, False), (1, at(51), "c", True, True), (None, at(52), "a", True, False), (1, at(99), "b", True, False), (1, at(100), "a", False, True), (1, at(101), "b", True, True), (2, at(5000), "a", False, True),
    ], key=repr)
    whole = spark.read.parquet(source)
    assert got == rows_of(memory.batch_memory(whole, 100, "user_id"))
