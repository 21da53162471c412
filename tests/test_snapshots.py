"""Writers that take turns, die, come late, or write at the same time."""

import os
import threading

import pytest

from citewright.operators import corpus
from citewright.operators.snapshots import Busy, Snapshots


def write(spark, at, out, n):
    rows = [] if at is None else [r[0] for r in spark.read.parquet(f"{at}/t").collect()]
    spark.createDataFrame([(x,) for x in [*rows, n]], "n int").coalesce(1).write.parquet(f"{out}/t")


def held(spark, s):
    return sorted(r[0] for r in spark.read.parquet(f"{s.current()}/t").collect())


def test_a_dead_writers_lock_is_passed_over(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"), keep=2, lease_s=1000)
    (tmp_path / "s").mkdir()
    lock = tmp_path / "s" / "_00000000.lock"
    lock.write_text("")
    with pytest.raises(Busy, match="another writer"), s.writer():
        pass
    os.utime(lock, (1, 1))  # its writer has been silent for long
    for n in range(3):
        with s.writer() as (at, out):
            write(spark, at, out, n)
    assert held(spark, s) == [0, 1, 2] and s.current().rsplit("/", 1)[1].startswith("00000003")
    names = sorted(p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith("."))
    assert [n for n in names if n.endswith(".lock")] == ["_00000002.lock", "_00000003.lock"] and len(names) == 4


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    with s.writer() as (at, out):
        write(spark, at, out, 1)
    with pytest.raises(ZeroDivisionError), s.writer() as (at, out):
        write(spark, at, out, 2)
        assert held(spark, s) == [1]  # not yet to be read
        1 / 0
    assert held(spark, s) == [1]
    with s.writer() as (at, out):
        write(spark, at, out, 3)
    assert held(spark, s) == [1, 3]


def test_a_writer_that_was_passed_over_fails(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"), lease_s=0)
    with pytest.raises(Busy, match="lease"), s.writer() as (at, out):
        write(spark, at, out, 1)
        with s.writer() as (at2, out2):
            write(spark, at2, out2, 2)
    assert held(spark, s) == [2]


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"), keep=10)

    def run(n):
        with s.writer(wait_s=120) as (at, out):
            write(spark, at, out, n)

    threads = [threading.Thread(target=run, args=(n,)) for n in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert held(spark, s) == list(range(5))


def test_store_goes_on_after_a_dead_writer(spark, tmp_path):
    documents = spark.createDataFrame([("a", "m")], "doc_id string, embedding_model string")
    chunks = spark.createDataFrame([("a", "1", [1.0])], "doc_id string, chunk_id string, embedding array<float>")
    (tmp_path / "_00000000.lock").write_text("")
    os.utime(tmp_path / "_00000000.lock", (1, 1))
    store = corpus.Store(spark, str(tmp_path))
    store.add(documents, chunks)
    assert store.tables()[0].count() == 1 and store.remove(documents) and store.tables()[0].count() == 0


def test_long_documents_keep_their_first_chunks(spark):
    text = "\n\n".join(f"Paragraph number {i} is long enough to be a chunk of its own." for i in range(30))
    docs = spark.createDataFrame([("a", text), ("b", "too short")], "doc_id string, text string")
    whole, rejects = corpus.chunk_documents(docs)
    first, same = corpus.chunk_documents(docs, 7)
    assert whole.count() == 30 and [tuple(r) for r in rejects.collect()] == [tuple(r) for r in same.collect()] == [("b", "no_chunks")]
    assert sorted(r["chunk_index"] for r in first.collect()) == list(range(7))
