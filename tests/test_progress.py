"""Frames are told while requests are answered, in order, and a reader may leave and come back."""

import json
import time

import pytest
from citewright.config import Policy
from citewright.plans.answer import Models, answer
from citewright.streaming import progress
from tests.test_answer import FACT, RESULT, Judge, Scripted, draft

A = "doc_1_chunk_A"


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    """Three requests: answered, answered anew after a second search (the judge refuses it), and failing."""
    path = str(tmp_path_factory.mktemp("progress")) + "/frames"
    years = (1900, 1908, 1910)
    drafts = {"q1900": [draft([(A, FACT.format(1900)[:-1])], [])], "q1908": [draft([(A, FACT.format(1908)[:-1])])], "q1910": [TimeoutError("late")]}
    requests = spark.createDataFrame([(y, f"q{y} tower built year {y}") for y in years], "request_id long, query string")
    found = spark.createDataFrame([(y, 0, 0, f"https://one.org/{y}", FACT.format(y), None, "raw") for y in years], RESULT)
    frames, seen = progress.Frames(spark, path), []

    def search(queries):
        seen.append([(r["request_id"], r["type"], json.loads(r["data"])) for r in frames.read().orderBy("step", "request_id", "ord").collect()])
        return found.join(queries.select("request_id").distinct(), "request_id", "left_semi")

    response, _, _ = answer(requests, search, Models(Scripted(drafts), Judge()), Policy(max_rewrite_loops=1), frames)
    response.count()
    return path, frames, seen


def test_frames_of_a_pass_are_there_before_the_next_one_starts(told):
    _, frames, seen = told
    assert [(r, t) for r, t, _ in seen[0]] == [(1900, "accepted"), (1908, "accepted"), (1910, "accepted")]
    again = [(r, t, d.get("stage") or d.get("kind")) for r, t, d in seen[1]]
    for expected in ((1900, "stage", "retrieved"), (1900, "stage", "verified"), (1900, "sentence", None), (1900, "complete", None), (1910, "error", None), (1908, "loop", "retrieve")):
        assert expected in again
    assert (1908, "complete", None) not in again  # it is still open
    last = [r["type"] for r in frames.read().filter("request_id = 1908").orderBy("step", "ord").collect()]
    assert last[0] == "accepted" and last[-1] == "complete" and last.count("loop") == 1 and last.count("stage") == 4


def test_frames_stand_in_order(told):
    _, frames, _ = told
    rows = frames.read().filter("request_id = 1900").orderBy("step", "ord").collect()
    assert [r["type"] for r in rows] == ["accepted", "stage", "stage", "sentence", "sentence", "complete"]
    assert [json.loads(r["data"])["sent_ord"] for r in rows if r["type"] == "sentence"] == [0, 1]


def read(spark, stream, write, state):
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def test_a_reader_comes_back(spark, told, tmp_path):
    path, _, _ = told
    frames = progress.Frames(spark, str(tmp_path / "f"))
    whole = [(r["request_id"], r["type"], r["data"]) for r in progress.Frames(spark, path).read().orderBy("step", "request_id", "ord").collect()]
    got: list = []
    write = progress.ordered(lambda df, epoch: got.extend(tuple(r) for r in df.select("request_id", "type", "data").collect()))
    half = len(whole) // 2
    for part, expected in ((whole[:half], half), (whole[half:], len(whole))):
        for r in part:
            frames(r[1], spark.createDataFrame([(r[0], r[2])], "request_id long, body string"))
        frames = progress.Frames(spark, str(tmp_path / "f"))  # another run goes on with the numbers
        read(spark, progress.follow(spark, str(tmp_path / "f")), write, str(tmp_path / "state"))
        assert len(got) == expected
    assert [(g[0], g[1], json.loads(g[2])["body"]) for g in got] == whole
    late: list = []
    read(spark, progress.follow(spark, str(tmp_path / "f")), progress.ordered(lambda df, epoch: late.extend(df.select("step", "frame").collect()), (half, 0)), str(tmp_path / "state2"))
    assert [r["step"] for r in late] == list(range(half + 1, len(whole))) and late[0]["frame"].startswith(f"id: {half + 1}-0\nevent: ")


def test_state_is_what_was_told_last(spark, told, tmp_path):
    path, _, _ = told
    write = progress.merged(spark, str(tmp_path / "merged"))
    rows = spark.read.schema(progress.fields("long")).parquet(path)
    write(rows.filter("step >= 3"), 0)  # batches may come in any order, and twice
    write(rows.filter("step < 3"), 1)
    write(rows.filter("step < 3"), 1)
    got = {r["request_id"]: r["state"] for r in progress.state_of(spark, str(tmp_path / "merged")).collect()}
    assert got[1900]["last"] == "complete" and got[1900]["is_answerable"] == "true" and got[1900]["query"].startswith("q1900")
    assert got[1910]["last"] == "error" and got[1908]["retries"] == "0" and got[1908]["kind"] == "retrieve" and got[1908]["last"] == "complete"


def test_connections_stay_open(spark, tmp_path):
    progress.Frames(spark, str(tmp_path / "f"))
    got: list = []
    q = progress.follow(spark, str(tmp_path / "f"), keep_alive_s=1).writeStream.foreachBatch(lambda df, epoch: got.extend(r["frame"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "s")).trigger(processingTime="1 second").start()
    until = time.time() + 60
    while len(got) < 2 and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert got[:2] == [progress.KEEP_ALIVE] * 2
