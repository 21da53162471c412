"""Evaluation runs: rankers by name, corpus and judge evaluation, golden cases, and what they leave behind."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.config import Policy
from citewright.operators import corpus as C
from citewright.operators import dense, evaluate, fuse, judge, lexical
from citewright.operators.frames import materialise, numbered, ranked_within

DEPTH = 200


# ---- rankers -----------------------------------------------------------------------------------------------------------


def rank(method: str, docs: DataFrame, queries: DataFrame, embedder: Callable | None = None) -> DataFrame:
    """query_id, doc_id, rank of every document for every query of a stated set: by bm25, dense or hybrid. docs: doc_id, text; queries: query_id, query.

    Documents of equal score stand in the order of doc_id, those without a hit last.
    """
    if method not in ("bm25", "dense", "hybrid"):
        raise ValueError(f"unknown ranking method {method!r}")
    if method != "bm25" and embedder is None:
        raise ValueError(f"ranking by {method} needs an embedder")
    order = lambda rows: ranked_within(rows.select("query_id", "doc_id", "score"), "query_id", F.desc("score"), "doc_id").select("query_id", "doc_id", "rank")
    if queries.limit(dense.QUERIES + 1).count() > dense.QUERIES:
        raise ValueError(f"a full ranking takes at most {dense.QUERIES} queries")
    arms = []
    if method != "dense":
        hits = lexical.bm25_corpus(docs, queries)
        pairs = docs.select("doc_id").crossJoin(F.broadcast(queries.select("query_id")))  # the stated set, checked above
        arms.append(order(pairs.join(hits, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("relevance_score", F.lit(0.0)))))
    if method != "bm25":
        d, q = embedded(docs, queries, embedder)
        arms.append(order(dense.scored(d, q, key="doc_id").withColumn("score", F.round("score", 9))))
    return arms[0] if len(arms) == 1 else fuse.fuse_rankings(*arms, "query_id", "doc_id").select("query_id", "doc_id", "rank")


def embedded(docs: DataFrame, queries: DataFrame, embedder: Callable) -> tuple[DataFrame, DataFrame]:
    """Unit vectors of documents (embedding) and queries (query_embedding)."""
    d = dense.embed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "embedding", embedder)
    q = dense.embed(queries.select("query_id", F.coalesce("query", F.lit("")).alias("query")), "query", "query_embedding", embedder)
    unit = lambda df, c: df.withColumn(c, dense.l2_normalise(F.col(c)))
    return unit(d, "embedding"), unit(q, "query_embedding")


def hybrid_rank(ranked: DataFrame, requests: DataFrame, embedder: Callable) -> tuple[DataFrame, str | None]:
    """(ranked chunks of each request fused with the similarity of their vectors to the question's, error). Question and chunks are embedded in one pass; if the embedder fails
    the order by BM25 stands, and the error says why."""
    chunks = ranked.select("request_id", "chunk_id", F.col("text").alias("t"))
    asked = requests.select("request_id", F.lit(None).cast("string").alias("chunk_id"), F.col("query").alias("t"))
    try:
        v = materialise(dense.embed(chunks.unionByName(asked).withColumn("t", F.coalesce("t", F.lit(""))), "t", "v", embedder))
    except Exception as e:
        return fuse.fuse_request(ranked.withColumn("dense_score", F.lit(None).cast("double")).withColumn("pos", F.col("rank"))), type(e).__name__
    q = v.filter("chunk_id is null").select("request_id", F.col("v").alias("qv"))
    near = v.filter("chunk_id is not null").join(q, "request_id").select("request_id", "chunk_id", F.round(dense.dot(dense.l2_normalise(F.col("v")), dense.l2_normalise(F.col("qv"))), 6).alias("dense_score"))
    return fuse.fuse_request(ranked.join(near, ["request_id", "chunk_id"], "left").withColumn("pos", F.col("rank"))), None


# ---- embeddings --------------------------------------------------------------------------------------------------------


class HttpEmbedder:
    """An embedding service behind a function: post({"model": .., "input": [..]}) gives {"embeddings": [[..], ..]}."""

    def __init__(self, post: Callable[[dict], dict], model: str):
        self.post, self.model = post, model

    def __call__(self, texts: list[str]) -> list[list[float]]:
        got = self.post({"model": self.model, "input": texts})["embeddings"]
        if len(got) != len(texts):
            raise ValueError(f"{len(texts)} texts, but {len(got)} vectors")
        return got


def embed_cached(df: DataFrame, text: str, embedder: Callable, model: str, path: str, prefix: str = "", out: str = "embedding") -> DataFrame:
    """dense.embed() with a Parquet cache under path: only texts that no run embedded with this model and prefix are embedded, then they are added to the cache."""
    spark = df.sparkSession
    digest = F.sha2(F.concat_ws("\x02", F.lit(model), F.lit(prefix), F.col("t")), 256)
    wanted = df.select(F.col(text).alias("t")).filter("t is not null").distinct().withColumn("digest", digest)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = None
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        known = spark.read.parquet(path)
    missing = wanted if known is None else wanted.join(known.select("digest"), "digest", "left_anti")
    fresh = materialise(dense.embed(missing, "t", "v", embedder, prefix).select("digest", "v"))
    if not fresh.isEmpty():
        fresh.write.mode("append").parquet(path)
    every = fresh if known is None else known.select("digest", "v").unionByName(fresh)
    made = wanted.join(every.dropDuplicates(["digest"]), "digest").select(F.col("t").alias(text), F.col("v").alias(out))
    return df.join(made, text, "left")


# ---- corpus and judge evaluation -----------------------------------------------------------------------------------------


def corpus_eval(docs: DataFrame, queries: DataFrame, qrels: DataFrame, embedder: Callable, model: str = "hash", depth: int = DEPTH) -> tuple[DataFrame, DataFrame, int]:
    """(metrics of each query, their means, number of documents taken in): documents are chunked and embedded as an ingest does, but with all their chunks and all
    of a long sentence, searches take the `depth` best chunks, and each document stands at its best chunk's place. Documents without chunks are left out."""
    source = docs.select("doc_id", "text", F.lit("").alias("title"), F.lit("").alias("source"))
    documents, chunks, _ = C.ingest(source, model, embedder, max_chunks=None, whole=True)
    documents, chunks = materialise(documents), materialise(chunks)
    q = dense.embed(queries.select("query_id", "query"), "query", "query_embedding", embedder)
    hits = dense.knn(chunks, q.withColumn("query_embedding", dense.l2_normalise(F.col("query_embedding"))), depth, key="chunk_id")
    run = evaluate.collapse(hits.join(chunks.select("chunk_id", F.col("doc_id").alias("of")), "chunk_id"), F.col("of"), depth).withColumnRenamed("doc", "doc_id")
    metrics = materialise(evaluate.ir_metrics(run, qrels))
    return metrics, evaluate.summary(metrics), documents.count()


@dataclass(frozen=True)
class RetryPolicy:
    """When a call that failed is made again. `delays`: seconds before each further attempt, so there are as many; each is stretched by up to `jitter` of itself, so that the tasks of a stage
    do not come back together. Errors say by their attributes what they are: one whose `status_code` or `status` is in `again`, or that is a TimeoutError or ConnectionError, is worth another attempt; its
    `retry_after` (seconds) counts where it asks for more than the delay, up to `longest`."""

    delays: tuple[float, ...] = (0.5, 2.0, 8.0)
    jitter: float = 0.25
    longest: float = 60.0
    again: frozenset[int] = frozenset({408, 425, 429, 500, 502, 503, 504})

    def pause(self, error: Exception, attempt: int, chance: Callable[[], float] = random.random) -> float | None:
        """Seconds to wait after the attempt (from 0) that failed; none: give up."""
        passing = isinstance(error, (TimeoutError, ConnectionError)) or any(getattr(error, name, None) in self.again for name in ("status_code", "status"))
        if not passing or attempt >= len(self.delays):
            return None
        asked = getattr(error, "retry_after", None)
        own = self.delays[attempt] * (1 + self.jitter * chance())
        return min(self.longest, max(own, float(asked))) if isinstance(asked, (int, float)) else own


class Retrying:
    """A model behind a retry policy."""

    def __init__(self, model, policy: RetryPolicy = RetryPolicy(), sleep: Callable[[float], None] = time.sleep):
        self.model, self.policy, self.sleep = model, policy, sleep

    def __call__(self, prompts: list[str], temperature: float = 0.0) -> list:
        attempt = 0
        while True:
            try:
                return self.model(prompts, temperature)
            except Exception as error:
                wait = self.policy.pause(error, attempt)
                if wait is None:
                    raise
            self.sleep(wait)
            attempt += 1


def judge_eval(triples: DataFrame, model) -> tuple[DataFrame, DataFrame]:
    """(records, summary) of a judge on labelled triples (example_id, claim, quote, chunk, label: SUPPORT or another). A positive is a quote to refuse; answers that fail are
    errors, which count for the error rate alone."""
    meta = F.lit('{"domain": "eval.invalid", "title": ""}')
    rows = triples.withColumn("prompt", judge.judge_prompt(F.col("claim"), F.substring("quote", 1, 2000), F.col("chunk"), meta))
    told = judge.parse_verdicts(judge.ask(rows, F.col("prompt"), model, ["example_id", "label"], attempts=1))
    expected = F.when(F.col("label") == "SUPPORT", "passed").otherwise("failed")
    got = F.when(F.col("error").isNotNull(), "error").otherwise(F.col("semantic_check"))
    why = F.coalesce("error", F.when(F.col("semantic_check") == "error", "ValueError"), "reason")
    records = materialise(told.select("example_id", "label", expected.alias("expected"), got.alias("got"), (expected == got).alias("correct"), why.alias("failure_reason")))
    return records, evaluate.confusion(records, F.col("expected") == "failed", F.col("got") == "failed", F.col("got") == "error")


# ---- golden cases ------------------------------------------------------------------------------------------------------


def merged_policy(app: dict | None, stages: dict | None, base: Policy = Policy()) -> Policy:
    """A case's settings over the defaults, one level deep."""
    from dataclasses import fields, replace

    known = {f.name for f in fields(Policy)}
    over = {k: tuple(v) if isinstance(v, list) else v for part in (app or {}, stages or {}) for k, v in part.items() if v is not None and k in known}
    return replace(base, **over)


def by_policy(cases: DataFrame, base: Policy):
    """(policy, its cases) for each distinct setting: they are settings, so there are few."""
    settings = F.to_json(F.struct("app_config", "pipeline_config"))
    rows = cases.withColumn("settings", settings)
    for r in rows.select("settings").distinct().collect():
        said = json.loads(r["settings"])
        yield merged_policy(said.get("app_config"), (said.get("pipeline_config") or {}).get("stages"), base), rows.filter(F.col("settings") == r["settings"]).drop("settings")


def results_of(cases: DataFrame) -> DataFrame:
    r = cases.select(F.col("id").alias("request_id"), F.posexplode("search_results").alias("result_ord", "r"))
    return r.select("request_id", F.lit(0).alias("query_ord"), "result_ord", "r.url", "r.content", "r.title", F.coalesce("r.content_mode", F.lit("unknown")).alias("content_mode"))


def run_golden(cases: DataFrame, models, base: Policy = Policy()) -> DataFrame:
    """id, passed, failures, status, is_answerable, overall_score, cost of each case (rows of load_golden): each is answered from its own search results."""
    from citewright.plans.answer import answer

    out = None
    for policy, mine in by_policy(cases, base):
        found = results_of(mine)
        search = lambda q, found=found: found.join(q.select("request_id").distinct(), "request_id", "left_semi")
        r, _, _ = answer(mine.select(F.col("id").alias("request_id"), "query"), search, models, policy)
        e = F.col("expect")
        seen = mine.join(r.withColumnRenamed("request_id", "id"), "id").select(
            "id", e["answerable"].alias("exp_answerable"), F.col("is_answerable").alias("answerable"), e["status_in"].alias("exp_status_in"), "status", F.col("tier_5_claims").alias("tier5"), e["max_tier5"].alias("exp_max_tier5"),
            F.col("tier_1_claims").alias("tier1"), e["max_tier1"].alias("exp_max_tier1"), "overall_score", e["min_overall_score"].alias("exp_min_score"), F.coalesce(F.col("usage")["cost"], F.lit(0.0)).alias("cost"),
        )
        seen = materialise(seen)
        checked = evaluate.expectations(seen).join(seen.select("id", "status", F.col("answerable").alias("is_answerable"), "overall_score", "cost"), "id")
        out = checked if out is None else out.unionByName(checked)
    return out


def validate_golden(cases: DataFrame, base: Policy = Policy()) -> DataFrame:
    """The same without a model: id, passed, failures, chunks, best_ranking, gate. Only the gate before drafting can be told: a case that expects an answer must pass it."""
    from citewright.plans.answer import ranked_evidence

    out = None
    for policy, mine in by_policy(cases, base):
        requests = mine.select(F.col("id").alias("request_id"), "query")
        ranked = ranked_evidence(requests, results_of(mine), policy)[2]
        best = requests.join(ranked.groupBy("request_id").agg(F.count("*").alias("chunks"), F.max("ranking_score").alias("best")), "request_id", "left")
        fires = F.coalesce(F.col("best") < policy.answerability_floor, F.lit(True))
        told = best.join(mine.select(F.col("id").alias("request_id"), "expect"), "request_id").withColumn("fires", fires)
        bad = F.coalesce(F.col("expect")["answerable"], F.lit(False)) & F.col("fires")
        rows = told.select(F.col("request_id").alias("id"), (~bad).alias("passed"), F.when(bad, F.array(F.lit("answerable"))).otherwise(F.array().cast("array<string>")).alias("failures"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("best", F.lit(0.0)).alias("best_ranking"), F.when(F.col("fires"), "fires").otherwise("clears").alias("gate"))
        out = rows if out is None else out.unionByName(rows)
    return out


def observed(results: DataFrame, validate_only: bool = False) -> DataFrame:
    """metric, value of golden results: the share that passed and what they cost."""
    share = F.round(F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)), 4)
    if validate_only:
        return results.agg(share.alias("value")).select(F.lit("validate_pass_rate").alias("metric"), "value")
    g = results.agg(share.alias("p"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("c"))
    return g.select(F.inline(F.array(F.struct(F.lit("pass_rate").alias("metric"), F.col("p").alias("value")), F.struct(F.lit("cost_usd").alias("metric"), F.col("c").alias("value")))))


def write_result(path: str, name: str, summary: DataFrame, records: DataFrame, **about: str) -> None:
    """A run's files under path: summary (one line: the name, what the run was about, and the summary's columns) and records."""
    head = summary.select(F.lit(name).alias("eval"), *[F.lit(v).alias(k) for k, v in sorted(about.items())], F.struct(*summary.columns).alias("summary"))
    head.coalesce(1).write.mode("errorifexists").json(f"{path}/summary")
    records.write.mode("errorifexists").json(f"{path}/records")


def paraphrases(claims: DataFrame, model, path: str, limit: int = 0) -> DataFrame:
    """claim_id, original, paraphrase of the first `limit` claims by id as text (0: all). Those that an earlier run left under path are not asked for again; new ones are added."""
    spark = claims.sparkSession
    rows = claims.select(F.col("query_id").cast("string").alias("claim_id"), F.col("query").alias("original"))
    if limit:
        rows = numbered(rows, "claim_id").filter(F.col("pos") <= limit).drop("pos")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.schema("claim_id string, original string, paraphrase string").json(path).filter("paraphrase != ''") if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None
    missing = rows if known is None else rows.join(known.select("claim_id"), "claim_id", "left_anti")
    prompt = F.concat(F.lit("Say the following in other words. Keep its meaning; give the new sentence and nothing else.\n\n"), F.col("original"))
    made = materialise(judge.ask(missing, prompt, model, ["claim_id", "original"], attempts=1).filter("error is null").select("claim_id", "original", F.trim("raw").alias("paraphrase")))
    if not made.isEmpty():
        made.write.mode("append").json(path)
    every = made if known is None else known.unionByName(made)
    return every.join(rows.select("claim_id"), "claim_id", "left_semi").dropDuplicates(["claim_id"])
