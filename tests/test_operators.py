"""Retrieval, verification, corpus, evaluation, loop, sources and streams on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from citewright.config import Policy
from citewright.functions import trust
from citewright.operators import corpus, dense, evaluate, fuse, lexical, retrieve, usage, verify
from citewright.plans import loop
from citewright.sources import files, search
from citewright.streaming import streams

RESULT = "request_id long, query_ord int, result_ord int, url string, content string, title string, content_mode string"
LONG = "This sentence has more than forty characters in it, {}."


def test_url_and_chunk_dedup_keep_the_first(spark):
    rows = [(1, 0, 0, "https://a.org/X/", "", None, "raw"), (1, 0, 1, "https://A.org/x", LONG.format(1), None, "raw"), (1, 0, 2, "https://b.org", LONG.format(2), None, "raw"), (1, 1, 0, "https://c.org", LONG.format(2), None, "snippet"), (1, 1, 1, "http://localhost/", LONG.format(3), None, "raw"), (1, 1, 2, "https://sub.bad.org", LONG.format(4), None, "raw"), (1, 1, 3, "https://d.org", LONG.format(2) + "\n\n" + LONG.format(5), None, "raw")]
    fates = retrieve.classify(spark.createDataFrame(rows, RESULT), Policy(banned_domains=("BAD.org",)))
    parts = retrieve.pieces(fates)
    assert {(r["url"], r["fate"]) for r in fates.collect()} == {("https://a.org/X/", "empty"), ("https://A.org/x", "duplicate"), ("https://b.org", "kept"), ("https://c.org", "kept"), ("http://localhost/", "unsafe"), ("https://sub.bad.org", "banned"), ("https://d.org", "kept")}
    got = {r["chunk_id"] for r in retrieve.number(parts, retrieve.by_page(parts), Policy()).collect()}
    assert got == {"doc_1_chunk_A", "doc_3_chunk_B"}  # document 2 took a number, label A of document 3 is a repetition
    seen = spark.createDataFrame([(1, "https://b.org")], "request_id long, norm_url string")
    assert retrieve.classify(spark.createDataFrame(rows, RESULT), Policy(), seen).filter("url = 'https://b.org'").first()["fate"] == "duplicate"


def test_cap_takes_whole_documents(spark):
    rows = [(1, 0, i, f"https://a.org/{i}", "\n\n".join(LONG.format(f"{i} {j}") for j in range(3)), None, "raw") for i in range(4)]
    got = retrieve.retrieve(spark.createDataFrame(rows, RESULT), Policy(max_chunks_per_request=4))
    assert got.count() == 6


def test_counters_stop_where_the_cap_stops(spark):
    """Brute force: results are taken one by one until the number of chunks reaches the cap."""
    import random

    rng = random.Random(6)
    rows = []
    for q in range(4):
        for i in range(8):
            url = rng.choice(["https://a.org/%d" % rng.randint(0, 12), "http://localhost/", "https://bad.org/x", "https://b.org/%d" % rng.randint(0, 9)])
            text = rng.choice(["", "short", "\n\n".join(LONG.format(rng.randint(0, 15)) for _ in range(rng.randint(1, 3)))])
            rows.append((1, q, i, url, text, None, rng.choice(["raw", "snippet"])))
    failed = spark.createDataFrame([(1, 0), (1, 2), (1, 9), (2, 0)], "request_id long, query_ord int")
    for cap in (1, 4, 9, 1000):
        n = dict.fromkeys(["total_search_results", "failed_queries", "banned_filtered", "unsafe_urls_filtered", "duplicate_urls_skipped", "duplicate_chunks_skipped", "total_chunks", "snippet_only_docs"], 0)
        urls, hashes, stop = set(), set(), None
        for _, q, i, url, text, _, mode in rows:
            n["total_search_results"] += 1
            if "localhost" in url:
                n["unsafe_urls_filtered"] += 1
            elif "bad.org" in url:
                n["banned_filtered"] += 1
            elif url in urls:
                n["duplicate_urls_skipped"] += 1
            else:
                urls.add(url)
                n["snippet_only_docs"] += bool(text) and mode == "snippet"
                for c in text.split("\n\n"):
                    if len(c) >= 40:
                        n["duplicate_chunks_skipped"] += c in hashes
                        hashes.add(c)
                n["total_chunks"] = len(hashes)
                if len(text) >= 40 and len(hashes) >= cap:
                    stop = q
                    break
        n["failed_queries"] = sum(stop is None or q < stop for q in (0, 2, 9))
        chunks, got = retrieve.counted(spark.createDataFrame(rows, RESULT), Policy(banned_domains=("bad.org",), max_chunks_per_request=cap), failed=failed)
        got = {r["request_id"]: r.asDict() for r in got.collect()}
        assert got[1] == {"request_id": 1, **n} and chunks.count() == n["total_chunks"]
        assert got[2]["failed_queries"] == 1 and got[2]["total_search_results"] == 0


def test_backends(spark):
    one = lambda: spark.createDataFrame([("u", 1)], "url string, n int")

    def broken():
        raise OSError("down")

    frame, errors = retrieve.isolated(broken, one, one)
    assert frame.count() == 2 and errors == ["OSError: down"] and retrieve.isolated(broken)[0] is None
    assert retrieve.choose_backends("both", None, one) == [one] and retrieve.choose_backends("both", broken, one) == [broken, one] and retrieve.choose_backends("web", one) == [one]
    for bad in (("web", None, one), ("corpus", one, None), ("both", one, None), ("other", one, one)):
        with pytest.raises(ValueError):
            retrieve.choose_backends(*bad)


def test_pick_content(spark):
    df = spark.createDataFrame([(" page ", "s"), (" ", "s"), (None, None)], "r string, s string")
    assert [tuple(x[0]) for x in df.select(retrieve.pick_content(F.col("r"), F.col("s"), True, 3)).collect()] == [("pag", "raw"), ("s", "snippet"), ("", "snippet")]


def test_postings_equal_brute_force(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, ""), (4, None), (5, "the of and")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "apple durian"), (2, ""), (3, "zzz")], "query_id long, query string")
    got = {(r["query_id"], r["doc_id"]): r["relevance_score"] for r in lexical.bm25_corpus(docs, queries).collect()}
    import math

    idf = math.log((5 - 1 + 0.5) / 1.5 + 1)
    want = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 1.0)) / (idf + 1.0)
    assert got == {(1, 1): round(want, 4)}


def test_fusion(spark):
    rows = [(1, "doc_10_chunk_A", 0.9, 0.1, 1), (1, "doc_2_chunk_A", 0.5, 0.9, 2), (1, "doc_3_chunk_A", 0.5, 0.5, 3), (2, "only", 0.4, 0.4, 1), (3, "a", 0.2, None, 1), (3, "b", 0.9, None, 2)]
    out = fuse.fuse_request(spark.createDataFrame(rows, "request_id long, chunk_id string, ranking_score double, dense_score double, pos int"))
    got = {(r["request_id"], r["fused_rank"]): (r["chunk_id"], r["ranking_mode"]) for r in out.collect()}
    assert got[1, 1] == ("doc_2_chunk_A", "hybrid") and got[2, 1] == ("only", "bm25") and got[3, 1] == ("b", "bm25")


def test_knn_equals_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(dense, "QUERIES", 7)
    rng = np.random.RandomState(2)
    rows = [(i, rng.randint(-2, 3, 3 if i % 3 else 4).astype(float).tolist(), "m%d" % (i % 2)) for i in range(200)] + [(900, None, "m0")]
    queries = [(i, rng.randint(-2, 3, 3 if i % 2 else 4).astype(float).tolist(), "m%d" % (i % 2)) for i in range(20)] + [(99, None, "m0")]
    c = spark.createDataFrame(rows, "vec_id long, embedding array<double>, model string").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, query_embedding array<double>, model string")
    for part in (None, "model"):
        want = set()
        for i, v, m in queries[:-1]:
            near = sorted((-float(np.dot(v, w)), k) for k, w, n in rows[:-1] if len(v) == len(w) and (part is None or m == n))[:4]
            want |= {(i, k, rank, -s) for rank, (s, k) in enumerate(near, 1)}
        assert {(r["query_id"], r["vec_id"], r["rank"], r["score"]) for r in dense.knn(c, q, 4, partition=part).collect()} == want


def test_full_ranks_equal_brute_force(spark):
    import random

    rng = random.Random(9)
    docs = spark.createDataFrame([(i * 3,) for i in range(50)], "doc_id long").repartition(4)
    run, want, asked = [], set(), []
    for q in range(5):
        hits = rng.sample(range(50), rng.randint(0, 20))
        run += [(q, d * 3, n) for n, d in enumerate(hits, 1)]
        order = hits + [d for d in range(50) if d not in hits]
        picked = rng.sample(range(50), 12)
        asked += [(q, d * 3) for d in picked]
        want |= {(q, d * 3, order.index(d) + 1) for d in picked}
    got = lexical.full_ranks(spark.createDataFrame(run, "query_id int, doc_id long, rank int"), docs, spark.createDataFrame(asked, "query_id int, doc_id long"))
    assert {tuple(r) for r in got.select("query_id", "doc_id", "rank").collect()} == want


def test_knn_edges(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_embedding array<float>")
    assert sorted((r["vec_id"], r["rank"]) for r in dense.knn(c, q, 5).collect()) == [(1, 1), (2, 2)]
    assert dense.knn(c, q, 0).count() == 0
    packed = c.filter("vec_id = 1").select(dense.unpack(dense.pack("embedding")).alias("v")).first()
    assert packed["v"] == [1.0, 0.0]
    assert c.select(dense.l2_normalise(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]


def cites(spark, *rows):
    return spark.createDataFrame(rows, "request_id long, sentence_id long, cit_ord int, citation_id string, chunk_id string, quote string")


def test_mechanical_cases(spark):
    chunk = "The “Quick” brown fox — jumps over the lazy dog. Ünïcode 東京都庁舎の展望台からの眺め"
    chunks = spark.createDataFrame([(1, "doc_1_chunk_A", chunk, "u", "t", "d.org")], "request_id long, chunk_id string, text string, source_url string, title string, domain string")
    quotes = ['the "quick" brown FOX', "fox jumps", "unicode 東京都庁舎の展望台からの", "the lazy brown dog ran", "...", "over the lazy dog"]
    got = verify.check_citations(cites(spark, *[(1, 1, i, f"c{i}", "doc_1_chunk_A", q) for i, q in enumerate(quotes)], (1, 1, 9, "c9", "doc_9_chunk_A", "any thing at all here")), chunks)
    status = {r["citation_id"]: (r["mechanical_check"], r["tier"]) for r in got.collect()}
    assert [status[f"c{i}"][0] for i in range(6)] == ["passed", "failed", "passed", "failed", "failed", "passed"] and status["c9"] == ("failed", 5)


def test_roll_up_order_of_faults(spark):
    kind = "request_id long, sentence_id long, cit_ord int, tier int, semantic_check string, failure_reason string, domain string"
    c = spark.createDataFrame([(1, 1, 0, 4, "failed", "m", "a.org"), (1, 1, 1, 5, "skipped", "h2", "b.org"), (1, 1, 2, 5, "skipped", "h3", "b.org"), (1, 2, 0, 3, "passed", None, "a.org"), (1, 2, 1, 3, "passed", None, "b.org"), (1, 3, 0, 1, "passed", None, "x.gov"), (1, 4, 0, 3, "skipped", "off", "x.gov"), (1, 5, 0, 3, "passed", None, "")], kind)
    s = spark.createDataFrame([(1, i, i != 7) for i in range(1, 8)], "request_id long, sentence_id long, is_cited boolean")
    got = {r["sentence_id"]: (r["tier"], r["semantic_check"], r["failure_reason"]) for r in verify.roll_up(s, c, trust.domain_sets(Policy())).collect()}
    assert got == {1: (5, "skipped", "h2"), 2: (2, "passed", None), 3: (1, "passed", None), 4: (3, "skipped", "off"), 5: (3, "passed", None), 6: (5, "skipped", "Sentence has no verified citations."), 7: (3, "skipped", None)}


def test_confidence_and_status(spark):
    r = spark.createDataFrame([(1, True), (2, True), (3, False)], "request_id long, is_answerable boolean")
    s = spark.createDataFrame([(1, 1), (1, 3), (1, 4), (3, 1)], "request_id long, tier int")
    got = {x["request_id"]: (x["overall_score"], x["status"]) for x in verify.confidence(r, s).collect()}
    assert got == {1: (0.6, "partial"), 2: (0.0, "unanswerable"), 3: (1.0, "unanswerable")}


def test_drafts_contract(spark):
    s = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 1, False)], "request_id long, sentence_id long, is_cited boolean")
    c = cites(spark, (1, 1, 0, "c1", "doc_1_chunk_AB", "q"), (3, 1, 0, "c1", "bad", "q"))
    assert {r["request_id"]: r["ok"] for r in verify.valid_drafts(s, c).collect()} == {1: True, 2: False, 3: False}


def test_store_replaces_and_removes(spark, tmp_path):
    store = corpus.Store(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([("a", LONG.format(1), "A", "s"), ("b", LONG.format(2), "B", "s"), ("c", " ", "C", "s")], "doc_id string, text string, title string, source string")
    documents, chunks, rejects = corpus.ingest(docs, "m")
    assert [tuple(r) for r in rejects.collect()] == [("c", "no_text")]
    store.add(documents, chunks)
    new = spark.createDataFrame([("a", LONG.format(3) + "\n\n" + LONG.format(4), "A2", "s")], docs.schema)
    d2, c2, _ = corpus.ingest(new, "m")
    store.add(d2, c2)
    d, c = store.tables()
    assert {(r["doc_id"], r["chunk_count"]) for r in d.collect()} == {("a", 2), ("b", 1)} and c.count() == 3
    assert store.remove(spark.createDataFrame([("a",)], "doc_id string")) and not store.remove(spark.createDataFrame([("zz",)], "doc_id string"))
    d, c = store.tables()
    assert [r["doc_id"] for r in d.collect()] == ["b"] and c.count() == 1
    q = spark.createDataFrame([(1, 0, LONG.format(2)), (1, 1, " ")], "request_id long, query_ord int, query string")
    assert [(r["url"], r["result_ord"]) for r in search.corpus_results(c, q).collect()] == [("https://corpus.local/doc/b#chunk-0", 1)]


def test_gate(spark):
    base = spark.createDataFrame([("a", 0.9, None, 0.01), ("b", None, 0.1, 0.0), ("c", 0.5, None, None)], "metric string, floor double, ceiling double, tolerance double")
    got = {r["metric"]: r["passed"] for r in evaluate.gate(spark.createDataFrame([("a", 0.895), ("b", 0.2)], "metric string, value double"), base).collect()}
    assert got == {"a": True, "b": False, "c": False}
    bad = spark.createDataFrame([("a", 0.9, 0.9, 0.0)], base.schema)
    with pytest.raises(Exception, match="exactly one bound"):
        evaluate.gate(spark.createDataFrame([("a", 1.0)], "metric string, value double"), bad).collect()


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id long, doc_id long, rank int")
    q = spark.createDataFrame([(1, 11), (1, 99), (2, 98)], "query_id long, doc_id long")
    got = {r["query_id"]: r for r in evaluate.ir_metrics(run, q).collect()}
    import math

    assert got[1]["recall_1"] == 0 and got[1]["recall_5"] == 0.5 and got[1]["rr"] == 0.5 and math.isclose(got[1]["ndcg"], (1 / math.log2(3)) / (1 + 1 / math.log2(3))) and got[2]["rr"] == 0


def test_loop_makes_one_rewrite_fewer_than_passes(spark):
    spark.sparkContext  # the loop writes checkpoints
    state = spark.createDataFrame([(1, True, 1, 0, 0, 0), (2, True, 1, 0, 0, 0), (3, False, 1, 0, 0, 0)], "request_id long, is_answerable boolean, pending int, loop_count int, retries int, passes int")

    def one_pass(s):
        return s.withColumn("passes", F.col("passes") + 1).withColumn("pending", F.when((F.col("request_id") == 2) & (F.col("passes") == 2), 0).otherwise(F.col("pending")))

    got = {r["request_id"]: r["passes"] for r in loop.run(state, one_pass, max_loops=3, max_retries=0).collect()}
    assert got == {1: 3, 2: 2, 3: 1}
    assert {r["request_id"]: r["passes"] for r in loop.run(state, one_pass, max_loops=3, max_retries=1).collect()}[1] == 6
    # what is reset when request 1 searches again is gone, and its next pass ends it
    assert {r["request_id"]: r["passes"] for r in loop.run(state, one_pass, max_loops=3, max_retries=1, reset={"pending": F.lit(0)}).collect()}[1] == 4


def test_search_source_isolates_failures(spark):
    df = search.mock_results(spark, ["q1", "q2"], [{"url": "u1", "content": "c"}, {"url": "u2"}], fail=json.dumps(["q2"]), backoff_s="0")
    got = sorted((r["query"], r["result_ord"], r["url"], r["error"]) for r in df.collect())
    assert got[:2] == [("q1", 0, "u1", None), ("q1", 1, "u2", None)] and "ConnectionError" in got[2][3]


def test_files(spark, tmp_path):
    for name, data in (("a.txt", "héllo".encode()), ("b.html", b"<html><body><p>Hi &amp; bye</p></body></html>"), ("c.pdf", b"%PDF-1.4 broken"), ("d.txt", b"bad \xff byte"), ("e.txt", b"  ")):
        (tmp_path / name).write_bytes(data)
    got = {r["filename"]: (r["text"], r["error"]) for r in files.extract_text(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a.txt"] == ("héllo", None) and got["b.html"] == ("Hi & bye", None) and got["d.txt"] == ("bad � byte", None) and got["e.txt"][1] == "no text" and got["c.pdf"][1]


def test_data_sets(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x"}\n{"_id": "d2", "title": "", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "a"}\n{"_id": "q2", "text": "b"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq2\td2\t0\n")
    c, q, r = evaluate.load_beir(spark, str(tmp_path))
    assert {tuple(x) for x in c.collect()} == {("d1", "T. x"), ("d2", "y")} and [tuple(x) for x in q.collect()] == [("q1", "a")] and r.count() == 1


def test_histogram_and_budget(spark):
    h = usage.histogram(spark.createDataFrame([(0.5,), (3.0,), (None,)], "v double"), "v", [1, 2])
    assert {tuple(r) for r in h.collect()} == {("1", 1), ("2", 1), ("+Inf", 2)}
    calls = spark.createDataFrame([(1, i, 10) for i in range(4)], "request_id long, call_ord int, total_tokens int")
    assert [r["refused"] for r in usage.budget(calls, 3, 0).orderBy("call_ord").collect()] == [False, False, False, True]
    assert [r["refused"] for r in usage.budget(calls, 9, 15).orderBy("call_ord").collect()] == [False, False, True, True]


def stream(spark, sf, tmp_path, plan, mode, name):
    import shutil

    (tmp_path / "in").mkdir(exist_ok=True)
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    q = plan(streams.timed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))).writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streamed_rate_limit_equals_batch(spark, sf, tmp_path):
    got = stream(spark, sf, tmp_path, lambda e: streams.rate_limit(e, 1, "user_id"), "complete", "limits")
    batch = usage.rate_limit(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), 1, "user_id")
    assert got.exceptAll(batch.select(got.columns)).count() == 0 and got.count() == batch.count()


def test_streamed_cache_equals_batch(spark, sf, tmp_path):
    got = stream(spark, sf, tmp_path, lambda e: streams.ttl_cache(e.select("user_id", "ts"), 7200, "user_id"), "append", "cache")
    batch = corpus.cache_state(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), 7200, "user_id").select("user_id", "ts", "hit")
    assert got.select("user_id", "ts", "hit").exceptAll(batch).count() == 0 and got.count() == batch.count()


def test_progress_events(spark):
    df = spark.createDataFrame([(1, ["retrieve", "rank"], ["s"], "success")], "request_id long, stages array<string>, sentences array<string>, status string")
    got = [(r["event_id"], r["type"]) for r in streams.progress_events(df).orderBy("event_id").collect()]
    assert got == [(0, "accepted"), (1, "stage"), (2, "stage"), (3, "sentence"), (4, "complete")]
    assert streams.sse(streams.progress_events(df)).first()["frame"].startswith("event: ")


def test_cache_probe_and_store(spark):
    from datetime import datetime

    r = spark.createDataFrame([(1, "k1"), (2, "k2")], "request_id long, key string")
    c = spark.createDataFrame([("k1", "{}", datetime(2024, 1, 1)), ("k2", "{}", datetime(2023, 1, 1))], "key string, response string, expires_at timestamp")
    hits, misses = usage.probe(r, c, F.lit("2023-06-01").cast("timestamp"))
    assert [x["request_id"] for x in hits.collect()] == [1] and [x["request_id"] for x in misses.collect()] == [2]
    done = spark.createDataFrame([(1, "k1", "success", 3), (2, "k2", "error", 3)], "request_id long, key string, status string, usage int")
    out = usage.cacheable(done, 300, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()
    assert [(x["key"], x["response"], str(x["expires_at"])) for x in out] == [("k1", '{"status":"success"}', "2024-01-01 00:05:00")]


def test_command_line(capsys):
    from citewright.__main__ import main

    assert main(["settings"]) == 0 and "cache_ttl_s" in capsys.readouterr().out
    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out


def test_texts_reach_python_in_small_batches(spark):
    """Of 3,000 pages in one partition no worker is given more than 1,000 at once; the same holds for checks of citations."""
    import pandas as pd

    @F.pandas_udf("string")
    def batch(s: pd.Series) -> pd.Series:
        return pd.Series([str(len(s))] * len(s))

    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(limit)
    rows = spark.range(3000, numPartitions=1).select(
        F.lit(1).cast("long").alias("request_id"), F.lit(0).alias("query_ord"), F.col("id").cast("int").alias("result_ord"), F.concat(F.lit("https://a.org/"), "id").alias("url"), F.lit("text").alias("content"), F.lit(None).cast("string").alias("title"), F.lit("raw").alias("content_mode")
    )
    fates = retrieve.classify(rows, Policy(), clean=batch)
    assert max(int(r["clean"]) for r in fates.select("clean").collect()) <= 1000
    spark.conf.unset(limit)
    c = spark.createDataFrame([(1, 1, 0, "c", "doc_1_chunk_A", "q")], "request_id long, sentence_id long, cit_ord int, citation_id string, chunk_id string, quote string")
    chunks = spark.createDataFrame([(1, "doc_1_chunk_A", "u", "t", "d", "text")], "request_id long, chunk_id string, source_url string, title string, domain string, text string")
    verify.check_citations(c, chunks)
    assert int(spark.conf.get(limit)) <= 1000
