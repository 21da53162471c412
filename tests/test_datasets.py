"""Loaders of evaluation data sets on small files."""

import json

import pytest

from citewright.operators import evaluate


@pytest.fixture
def claims(tmp_path):
    def lines(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")

    lines("corpus.jsonl", [{"doc_id": 1, "title": "T1", "abstract": ["one.", "two.", "three."]}, {"doc_id": 2, "title": "T2", "abstract": ["four."]}])
    lines(
        "claims_dev.jsonl",
        [
            {"id": 10, "claim": "c10", "evidence": {"1": [{"sentences": [0, 2, 9], "label": "SUPPORT"}, {"sentences": [1], "label": "SUPPORT"}]}},
            {"id": 11, "claim": "c11", "evidence": {"1": [{"sentences": [1], "label": "CONTRADICT"}], "2": [{"sentences": [0], "label": "CONTRADICT"}]}},
            {"id": 12, "claim": "c12", "evidence": {}},
            {"id": 13, "claim": "c13", "evidence": {"2": [{"sentences": [7], "label": "SUPPORT"}]}},
        ],
    )
    lines("paraphrases.jsonl", [{"claim_id": "10", "original": "c10", "paraphrase": "first"}, {"claim_id": "11", "original": "c11", "paraphrase": "other"}, {"claim_id": "10", "original": "c10", "paraphrase": "last"}])
    return tmp_path


def test_claims(spark, claims):
    corpus, queries, qrels = evaluate.load_claims(spark, str(claims))
    assert {tuple(r) for r in corpus.collect()} == {("1", "T1. one. two. three."), ("2", "T2. four.")}
    assert {tuple(r) for r in queries.collect()} == {("10", "c10"), ("11", "c11"), ("13", "c13")}
    assert {tuple(r) for r in qrels.collect()} == {("10", "1"), ("11", "1"), ("11", "2"), ("13", "2")}


def test_the_last_paraphrase_counts(spark, claims):
    _, queries, _ = evaluate.load_claims(spark, str(claims), paraphrases=str(claims / "paraphrases.jsonl"))
    assert {tuple(r) for r in queries.select("query_id", "query").collect()} == {("10", "last"), ("11", "other")}


def test_triples(spark, claims):
    got = {tuple(r) for r in evaluate.load_triples(spark, str(claims)).select("example_id", "claim", "quote", "label").collect()}
    assert got == {("10:1", "c10", "one. three.", "SUPPORT"), ("11:1", "c11", "two.", "CONTRADICT"), ("11:2", "c11", "four.", "CONTRADICT")}


def test_sample_is_fixed(spark):
    q = spark.range(100).withColumnRenamed("id", "q")
    one, two = ([r["q"] for r in evaluate.sample(q.repartition(n), "q", 10, 3).collect()] for n in (1, 7))
    assert sorted(one) == sorted(two) and len(one) == 10 and evaluate.sample(q, "q", 0).count() == 100
    assert sorted(r["q"] for r in evaluate.sample(q, "q", 10, 4).collect()) != sorted(one)


def test_retrieval_from_the_command_line(spark, tmp_path, capsys):
    """The five small documents and their questions; one question has no word in common with any document."""
    from citewright.__main__ import main

    docs = [("d1", "solar panels turn sunlight into power"), ("d2", "wind turbines turn moving air into power"), ("d3", "cats sleep most of the day"), ("d4", "dogs guard the house at night"), ("d5", "power lines carry power to the house")]
    asked = [("q1", "solar power", "d1"), ("q2", "moving air", "d2"), ("q3", "cats sleep", "d3"), ("q5", "zzz", "d5")]
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("".join(json.dumps({"_id": d, "title": "", "text": t}) + "\n" for d, t in docs))
    (tmp_path / "queries.jsonl").write_text("".join(json.dumps({"_id": q, "text": t}) + "\n" for q, t, _ in asked))
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"{q}\t{d}\t1\n" for q, _, d in asked))
    (tmp_path / "ok.json").write_text(json.dumps([{"metric": "rr", "floor": 0.8}]))
    (tmp_path / "high.json").write_text(json.dumps([{"metric": "rr", "floor": 0.9}]))
    assert main(["retrieval", str(tmp_path), "--baseline", str(tmp_path / "ok.json"), "--out", str(tmp_path / "out")]) == 0
    assert main(["retrieval", str(tmp_path), "--baseline", str(tmp_path / "high.json")]) == 1
    assert spark.read.json(str(tmp_path / "out" / "summary")).first()["summary"]["rr"] == 0.8  # three firsts and, without a hit, the fifth of five
    (tmp_path / "cases.jsonl").write_text(json.dumps({"id": "a", "query": "tower", "search_results": [], "expect": {"answerable": True}}) + "\n")
    assert main(["golden", str(tmp_path / "cases.jsonl")]) == 1 and main(["golden", str(tmp_path / "cases.jsonl"), "--floor", "0"]) == 0
    assert "validate_pass_rate 0.0" in capsys.readouterr().out


def test_a_seeded_shuffle_is_that_of_a_list(spark):
    import random

    names = [f"q{i:03d}" for i in range(60)]
    q = spark.createDataFrame([(n, len(n)) for n in names], "q string, pos_ int")
    for seed in (13, 7):
        want = list(names)
        random.Random(seed).shuffle(want)
        for parts in (1, 6):
            got = evaluate.shuffled(q.repartition(parts), "q", limit=25, seed=seed).orderBy("pos").collect()
            assert [(r["q"], r["pos"]) for r in got] == [(n, i) for i, n in enumerate(want[:25])]
    assert evaluate.shuffled(q, "q").count() == 60 and evaluate.shuffled(q.limit(0), "q", limit=3).count() == 0
