"""Evaluation runs, caches of vectors, result files, audit trails, web search and streams that stop."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from citewright.config import Policy, Settings
from citewright.operators import corpus, dense, evaluate, judge, runs, usage
from citewright.plans.answer import Models, answer
from citewright.sources import search
from citewright.streaming import streams

#: Five small documents and six questions, one without a word in common and one empty.
DOCS = [("d1", "solar panels turn sunlight into power"), ("d2", "wind turbines turn moving air into power"), ("d3", "cats sleep most of the day"), ("d4", "dogs guard the house at night"), ("d5", "power lines carry power to the house")]
ASKED = [("q1", "solar power"), ("q2", "moving air"), ("q3", "sleeping cats sleep"), ("q4", "night house guard"), ("q5", "zzz"), ("q6", "")]
FACT = "The tall tower of the town was built of grey stone in the year {}."


@pytest.fixture(scope="module")
def mini(spark):
    return spark.createDataFrame(DOCS, "doc_id string, text string"), spark.createDataFrame(ASKED, "query_id string, query string")


@pytest.mark.parametrize("method", ["bm25", "dense", "hybrid"])
def test_every_document_has_a_rank(spark, mini, method):
    got = runs.rank(method, *mini, dense.HashEmbedder(32)).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    assert {q: sorted(x) for q, x in by.items()} == {q: [1, 2, 3, 4, 5] for q, _ in ASKED}
    if method == "bm25":
        assert by["q1"][1] == "d1" and by["q2"][1] == "d2" and by["q4"][1] == "d4"
        assert [by["q5"][i] for i in range(1, 6)] == [by["q6"][i] for i in range(1, 6)] == ["d1", "d2", "d3", "d4", "d5"]  # no hit: corpus order
    with pytest.raises(ValueError):
        runs.rank("other", *mini)
    if method != "bm25":
        with pytest.raises(ValueError):
            runs.rank(method, *mini)


def test_dense_ranks_equal_brute_force(spark, mini):
    e = dense.HashEmbedder(32)
    d, q = (np.array(e([t for _, t in rows])) for rows in (DOCS, ASKED))
    score = np.round(q @ d.T, 9)
    want = {(ASKED[i][0], DOCS[j][0], n) for i in range(len(ASKED)) for n, j in enumerate(sorted(range(len(DOCS)), key=lambda j: (-score[i, j], j)), 1)}
    assert {tuple(r) for r in runs.rank("dense", *mini, e).select("query_id", "doc_id", "rank").collect()} == want


def test_corpus_evaluation(spark):
    text = "{} and this makes the text longer than forty characters"
    docs = spark.createDataFrame([(d, text.format(t)) for d, t in DOCS] + [("none", "short")], "doc_id string, text string")
    queries = spark.createDataFrame([(q, text.format(next(t for d, t in DOCS if d == want))) for q, want in (("a", "d1"), ("b", "d3"))], "query_id string, query string")
    qrels = spark.createDataFrame([("a", "d1"), ("b", "d3")], "query_id string, doc_id string")
    metrics, summary, n = runs.corpus_eval(docs, queries, qrels, dense.HashEmbedder(64))
    assert n == 5 and metrics.count() == 2 and summary.first()["recall_1"] == 1.0 and summary.first()["rr"] == 1.0


class Refusal(Exception):
    def __init__(self, **about):
        self.__dict__ |= about


class Throttled:
    """Refuses twice, then answers."""

    def __init__(self, error):
        self.error, self.left = error, 2

    def __call__(self, prompts, temperature=0.0):
        if self.left:
            self.left -= 1
            raise self.error
        return ["ok"] * len(prompts)


def test_calls_are_made_again_as_the_policy_says():
    slept = []
    calm = runs.RetryPolicy(delays=(1.0, 3.0), jitter=0.0)
    for error in (Refusal(status_code=429), Refusal(status=503), TimeoutError(), ConnectionResetError()):
        assert runs.Retrying(Throttled(error), calm, slept.append)(["a"]) == ["ok"] and slept == [1.0, 3.0]
        slept.clear()
    assert runs.Retrying(Throttled(Refusal(status_code=429, retry_after=90)), calm, slept.append)(["a"]) == ["ok"] and slept == [60.0, 60.0]
    for error, policy in ((RuntimeError("429"), calm), (Refusal(status_code=400), calm), (Refusal(status_code=429), runs.RetryPolicy(delays=(1.0,)))):
        with pytest.raises(type(error)):
            runs.Retrying(Throttled(error), policy, slept.append)(["a"])
    assert runs.RetryPolicy(delays=(4.0,), jitter=0.5).pause(TimeoutError(), 0, lambda: 1.0) == 6.0


def test_judge_evaluation(spark):
    class Judge:
        def __call__(self, prompts, temperature=0.0):
            out = []
            for p in prompts:
                if "late" in p:
                    raise TimeoutError("late")
                out.append("nonsense" if "odd" in p else json.dumps({"semantic_check": "failed", "failure_reason": "no"} if "false" in p else {"semantic_check": "passed"}))
            return out

    rows = [("1", "true a", "SUPPORT"), ("2", "false b", "CONTRADICT"), ("3", "false c", "SUPPORT"), ("4", "late d", "SUPPORT"), ("5", "odd e", "CONTRADICT"), ("6", "true f", "CONTRADICT")]
    triples = spark.createDataFrame([(i, c, "quote", "chunk", label) for i, c, label in rows], "example_id string, claim string, quote string, chunk string, label string")
    records, summary = runs.judge_eval(triples, Judge())
    got = {r["example_id"]: (r["expected"], r["got"], r["correct"], r["failure_reason"]) for r in records.collect()}
    assert got == {"1": ("passed", "passed", True, None), "2": ("failed", "failed", True, "no"), "3": ("passed", "failed", False, "no"), "4": ("passed", "error", False, "TimeoutError"), "5": ("failed", "error", False, "ValueError"), "6": ("failed", "passed", False, None)}
    s = summary.first()
    assert (s["n"], s["errors"], s["tp"], s["fp"], s["fn"], s["tn"]) == (6, 2, 1, 1, 1, 1)


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "cases.jsonl"
    page = lambda y, host="one.org": {"url": f"https://{host}/{y}", "content": FACT.format(y), "title": "t"}
    cases = [
        {"id": "good", "query": "tower built in the year 1900 stone", "search_results": [page(1900)], "expect": {"answerable": True, "status_in": ["success"], "max_tier5": 0}},
        {"id": "empty", "query": "tower", "search_results": [], "expect": {"answerable": False, "status_in": ["unanswerable"]}},
        {"id": "banned", "query": "tower built in the year 1900 stone", "search_results": [page(1900, "bad.org")], "app_config": {"banned_domains": ["bad.org"]}, "expect": {"answerable": True}},
    ]
    path.write_text("\n".join(json.dumps(c) for c in cases) + "\n\n")
    return evaluate.load_golden(spark, str(path)), path


def test_golden_cases(spark, golden, tmp_path):
    results = runs.run_golden(golden[0], Models(judge.QuoteSynthesiser(), judge.OverlapJudge(0.0)))
    got = {r["id"]: (r["passed"], list(r["failures"])) for r in results.collect()}
    assert got == {"good": (True, []), "empty": (True, []), "banned": (False, ["answerable"])}
    metrics = runs.observed(results)
    assert {r["metric"]: r["value"] for r in metrics.collect()} == {"pass_rate": 0.6667, "cost_usd": 0.0}
    checks = evaluate.gate(metrics, spark.createDataFrame([("pass_rate", 0.9, None, 0.0)], "metric string, floor double, ceiling double, tolerance double"))
    assert not evaluate.gate_verdict(checks).first()["ok"] and evaluate.gate_verdict(checks, enforce=False).first()["ok"]
    runs.write_result(str(tmp_path / "r"), "golden", metrics.groupBy().pivot("metric", ["pass_rate", "cost_usd"]).agg(F.first("value")), results, model="scripted")
    assert spark.read.json(str(tmp_path / "r" / "summary")).first()["summary"]["pass_rate"] == 0.6667 and spark.read.json(str(tmp_path / "r" / "records")).count() == 3


def test_golden_cases_without_a_model(golden):
    got = {r["id"]: (r["passed"], r["gate"], r["chunks"]) for r in runs.validate_golden(golden[0]).collect()}
    assert got == {"good": (True, "clears", 1), "empty": (True, "fires", 0), "banned": (False, "fires", 0)}
    assert runs.observed(runs.validate_golden(golden[0]), True).first()["value"] == 0.6667


def test_broken_golden_cases_are_named(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "x", "query": "q", "search_results": []}\n')
    with pytest.raises(Exception, match="golden case x lacks expect"):
        evaluate.load_golden(spark, str(tmp_path / "c.jsonl")).collect()
    assert runs.merged_policy({"banned_domains": ["a"], "expertise_level": "x"}, {"max_rewrite_loops": 5}) == Policy(banned_domains=("a",), max_rewrite_loops=5)


def test_hybrid_falls_back(spark):
    ranked = spark.createDataFrame([(1, "a", "cats sleep", 0.9, 1), (1, "b", "solar power", 0.8, 2)], "request_id int, chunk_id string, text string, ranking_score double, rank int")
    requests = spark.createDataFrame([(1, "solar power")], "request_id int, query string")
    fused, error = runs.hybrid_rank(ranked, requests, dense.HashEmbedder(64))
    assert error is None and {r["chunk_id"]: r["ranking_mode"] for r in fused.collect()} == {"a": "hybrid", "b": "hybrid"}
    assert fused.filter("chunk_id = 'b'").first()["dense_score"] == pytest.approx(1.0, abs=1e-5)

    def broken(texts):
        raise ConnectionError("down")

    fused, error = runs.hybrid_rank(ranked, requests, broken)
    assert error and [r["chunk_id"] for r in fused.orderBy("fused_rank").collect()] == ["a", "b"] and fused.first()["ranking_mode"] == "bm25"


def test_vectors_are_embedded_once(spark, tmp_path):
    path, log = str(tmp_path / "cache"), tmp_path / "log"

    def embedder(texts):
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    first = spark.createDataFrame([("a",), ("bb",), ("bb",), (None,)], "t string")
    assert sorted(r["embedding"][0] for r in runs.embed_cached(first, "t", embedder, "m", path, "p:").collect() if r["embedding"]) == [3.0, 4.0, 4.0]
    second = spark.createDataFrame([("bb",), ("ccc",)], "t string")
    assert sorted(r["embedding"][0] for r in runs.embed_cached(second, "t", embedder, "m", path, "p:").collect()) == [4.0, 5.0]
    assert sorted(log.read_text().split()) == ["p:a", "p:bb", "p:ccc"]
    assert runs.embed_cached(second, "t", embedder, "other", path, "p:").count() == 2 and len(log.read_text().split()) == 5
    made = runs.HttpEmbedder(lambda body: {"embeddings": [[1.0]] * len(body["input"])}, "m")
    assert made(["a", "b"]) == [[1.0], [1.0]]
    with pytest.raises(ValueError):
        runs.HttpEmbedder(lambda body: {"embeddings": []}, "m")(["a"])


def test_paraphrases_go_on(spark, tmp_path):
    claims = spark.createDataFrame([(str(i), f"claim {i}") for i in (1, 10, 2, 3)], "query_id string, query string")

    class Model:
        def __call__(self, prompts, temperature=0.0):
            return [" other words " + p.rsplit(" ", 1)[1] for p in prompts]

    path = str(tmp_path / "p")
    assert {r["claim_id"]: r["paraphrase"] for r in runs.paraphrases(claims, Model(), path, 2).collect()} == {"1": "other words 1", "10": "other words 10"}
    assert runs.paraphrases(claims, Model(), path).count() == 4 and spark.read.json(path).count() == 4


def test_web_results(spark):
    def fetch(query, most):
        if query == "bad":
            raise ConnectionError("down")
        return [{"url": f"https://a.org/{i}", "title": "t", "content": "snippet", "raw_content": "  page " if i == 0 else " "} for i in range(9)]

    q = spark.createDataFrame([(1, 0, "good"), (1, 1, "bad")], "request_id long, query_ord int, query string")
    got = search.web_results(q, fetch, max_results=2, cap=3, sleep=lambda s: None).collect()
    assert sorted((r["query_ord"], r["result_ord"], r["content"], r["content_mode"]) for r in got if not r["error"]) == [(0, 0, "pag", "raw"), (0, 1, "snippet", "snippet")]
    assert [(r["query_ord"], r["error"]) for r in got if r["error"]] == [(1, "ConnectionError: down")]
    assert [(r["request_id"], r["all_failed"]) for r in search.all_failed(spark.createDataFrame(got)).collect()] == [(1, False)]


def test_audit_trail_of_answers(spark, tmp_path):
    requests = spark.createDataFrame([(1, "tower built in the year 1900 stone"), (2, "nothing")], "request_id long, query string")
    found = spark.createDataFrame([(1, 0, 0, "https://one.org", FACT.format(1900), None, "raw")], "request_id long, query_ord int, result_ord int, url string, content string, title string, content_mode string")
    responses, citations, counters = answer(requests, lambda q: found.join(q.select("request_id").distinct(), "request_id", "left_semi"), Models(judge.QuoteSynthesiser(), judge.OverlapJudge(0.0)))
    trail = usage.audit_trail(counters, citations, responses, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    kinds = {(r["request_id"], r["event_type"]) for r in trail.collect()}
    assert kinds == {(1, "retriever_complete"), (1, "mechanical_result"), (1, "semantic_citation_result"), (1, "verification_complete"), (1, "usage_summary"), (2, "synthesizer_unanswerable"), (2, "verification_complete")}
    path = str(tmp_path / "events")
    usage.keep_events(trail, path)
    usage.keep_events(trail, path)
    assert spark.read.parquet(path).count() == len(trail.collect()) == 7
    assert usage.audit_log(spark.read.parquet(path).drop("day")).filter("request_id = 1").count() == 5
    counts = {(r["metric"], r["labels"]): r["value"] for r in usage.metric_counters(responses, responses.select("request_id", F.explode("final_response").alias("s")).select("request_id", "s.tier"), citations, cache=spark.createDataFrame([(True,), (False,), (True,)], "hit boolean")).collect()}
    assert counts[("requests_by_status", '{"status":"success"}')] == 1 and counts[("cache_hits", "{}")] == 2 and counts[("cache_misses", "{}")] == 1 and counts[("semantic_degradations", "{}")] == 0


def test_timer_and_tags(spark):
    timer = usage.Timer()
    with timer("ranker"), usage.tagged(spark, "r1", "ranker") as tag:
        assert tag in spark.sparkContext.getJobTags()
        spark.range(5).count()
    assert tag not in spark.sparkContext.getJobTags() and usage.histogram(timer.frame(spark), "seconds", [0.1, 60], ["node"]).filter("le = '60'").first()["n"] == 1
    rows = usage.describe(Settings.load({}) if hasattr(Settings, "load") else Settings(), spark.createDataFrame([("a", "m")], "doc_id string, embedding_model string"), spark.range(3))
    assert ("corpus.documents", "1") in rows and ("corpus.chunks", "3") in rows


def test_store_refuses_what_it_cannot_search(spark, tmp_path):
    store = corpus.Store(spark, str(tmp_path / "s"), keep=2)
    documents = spark.createDataFrame([("a", "m"), ("b", "m")], "doc_id string, embedding_model string")
    vectors = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, chunk_id string, embedding array<float>")
    for bad in ([("a", "1", [1.0]), ("a", "2", [1.0, 2.0]), ("b", "3", [1.0])], [("a", "1", []), ("b", "2", [1.0])], [("a", "1", None), ("b", "2", [1.0])], [("a", "1", [1.0])]):
        with pytest.raises(ValueError):
            store.add(documents, vectors(*bad))
    good = vectors(("a", "1", [1.0]), ("b", "2", [1.0]))
    for _ in range(4):
        store.add(documents, good)
    kept = sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir())
    assert len(kept) == 2 and kept[-1].startswith("00000003") and store.tables()[0].count() == 2
    (tmp_path / "s" / "_00000004.lock").write_text("")  # somebody else writes
    with pytest.raises(RuntimeError, match="another writer"):
        store.add(documents, good)


def test_cache_order_and_eviction(spark):
    import random
    from datetime import datetime, timedelta

    rng, t0 = random.Random(1), datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), t0 + timedelta(seconds=rng.randint(0, 500))) for _ in range(300)]
    want, at = [], {}
    for k, t in sorted(rows):
        hit = k in at and (t - at[k]).total_seconds() < 60
        at[k] = at[k] if hit else t
        want.append((k, t, hit, at[k]))
    got = [tuple(r) for r in corpus.cache_state(spark.createDataFrame(rows, "key string, ts timestamp").repartition(5), 60).collect()]
    assert sorted(got) == sorted(want)
    cache = spark.createDataFrame([(f"k{i}", i) for i in range(9)], "key string, used_at int")
    assert {r["key"] for r in corpus.evict(cache, 3).collect()} == {"k6", "k7", "k8"}


def test_ring_of_a_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    path = str(tmp_path / "ring")
    write = streams.keep_last(path, 3)
    t0 = datetime(2024, 1, 1)
    batch = lambda *ns: spark.createDataFrame([(n, t0 + timedelta(seconds=n)) for n in ns], "n int, ts timestamp")
    for epoch, ns in enumerate([(1, 9, 3), (4,), (5, 2), ()]):
        write(batch(*ns), epoch)
    assert {r["n"] for r in streams.last_kept(spark, path).collect()} == {9, 5, 4}
    write(batch(), 3)  # a repeated epoch
    assert {r["n"] for r in streams.last_kept(spark, path).collect()} == {9, 5, 4} and len(list((tmp_path / "ring").iterdir())) <= 3


def test_progress_frames_and_stopping(spark, tmp_path):
    answers = spark.createDataFrame([(1, ["retriever"], ["rewrite"], ["s"], "success")], "request_id int, stages array<string>, loops array<string>, sentences array<string>, status string")
    assert [r["type"] for r in streams.progress_events(answers).orderBy("event_id").collect()] == ["accepted", "stage", "loop", "sentence", "complete"]
    seen = []
    streams.progress_writer(lambda df, epoch: seen.extend(r["frame"] for r in df.collect()))(answers, 0)
    assert seen[0].startswith("event: accepted\ndata: ") and seen[-1].endswith("\n\n")
    query = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    assert streams.run_until(query, lambda: True, 0.2) and not query.isActive
    assert not streams.run_until(query, lambda: True)


@pytest.mark.parametrize("method", ["bm25", "dense", "hybrid"])
def test_no_full_ranking_is_sorted_by_one_task(spark, method):
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 3)}") for i in range(12)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "alpha beta"), (1, "gamma")], "query_id long, query string")
    ranked = runs.rank(method, docs, queries, dense.HashEmbedder(8))
    assert "row_number" not in ranked._jdf.queryExecution().executedPlan().toString()
    rows = ranked.collect()
    assert sorted((r["query_id"], r["rank"]) for r in rows) == [(q, i + 1) for q in range(2) for i in range(12)]
    if method == "bm25":
        assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"]))][12:] == list(range(12))


def test_corpus_evaluation_embeds_each_text_once(spark, tmp_path):
    log = str(tmp_path / "texts")

    def embedder(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return dense.HashEmbedder(8)(texts)

    docs = spark.createDataFrame([(str(i), f"document number {i} has a text that is long enough to be a chunk") for i in range(6)], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "document number one")], "query_id long, query string")
    qrels = spark.createDataFrame([(1, "1")], "query_id long, doc_id string")
    metrics, _, n = runs.corpus_eval(docs, queries, qrels, embedder)
    texts = [t for t in open(log).read().splitlines() if t.endswith("chunk")]
    assert n == 6 and metrics.count() == 1 and len(texts) == len(set(texts)) == 6


def test_corpus_evaluation_reads_texts_to_their_end(spark):
    """The words asked for stand after 2,000 chunks of a document, and far behind the limit of a chunk in a sentence without an end."""
    many = "\n\n".join(f"paragraph {i} is filled with words that nobody asks for" for i in range(corpus.MAX_CHUNKS))
    docs = [("many", f"{many}\n\nviolet harbour lantern quarry meadow thistle"), ("long", "filling " * 2000 + "copper saddle orchard tunnel glacier compass " * 30)]
    docs = spark.createDataFrame(docs + [(f"other{i}", f"other document number {i} with words of its own about nothing") for i in range(5)], "doc_id string, text string")
    queries = spark.createDataFrame([("a", "violet harbour lantern quarry meadow thistle"), ("b", "copper saddle orchard tunnel glacier compass")], "query_id string, query string")
    qrels = spark.createDataFrame([("a", "many"), ("b", "long")], "query_id string, doc_id string")
    metrics, summary, n = runs.corpus_eval(docs, queries, qrels, dense.HashEmbedder(256), depth=3)
    assert n == 7 and metrics.count() == 2 and summary.first()["recall_1"] == 1.0


def test_long_sentences_lose_no_word():
    from citewright.functions import text as T

    for s in ("word " * 1000 + "end.", "x" * 4000 + " end.", "\u00a0".join(["ab"] * 2000), "y" * T.MAX_CHUNK + " z"):
        pieces = T.piece_list(s)
        assert "".join("".join(pieces).split()) == "".join(s.split()) and max(map(len, pieces)) <= T.MAX_CHUNK
    words = [f"w{i}" for i in range(3000)]
    assert {w for c in T.chunk_list(" ".join(words), whole=True) for w in c.split()} == set(words) > {w for c in T.chunk_list(" ".join(words)) for w in c.split()}
