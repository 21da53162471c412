"""The whole plan: questions -> searches -> chunks -> scores -> ranks -> drafts -> checks -> verdicts -> answers, over all requests at once.

A pass drafts, checks and judges all requests that are still open; the driver loops over passes, of which there are at most
(max_rewrite_loops) x (max_retrieval_retries + 1). What a pass gives is written to the checkpoint folder, so a model is asked once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.config import Policy
from citewright.functions.text import rewrite_request
from citewright.functions.trust import domain_sets, score_chunks
from citewright.functions.urls import expand_query
from citewright.operators import judge as J
from citewright.operators import usage as U
from citewright.operators import verify as V
from citewright.operators.frames import materialise
from citewright.operators.lexical import answerable, evidence, rank_chunks
from citewright.operators.retrieve import counted, retrieve
from citewright.plans.loop import route


@dataclass(frozen=True)
class Models:
    """What answers prompts. Without a judge quotes are checked only mechanically; without `agreement` tier 2 means several domains, not corroboration."""

    synthesiser: J.Model
    judge: J.Model | None = None
    agreement: J.Model | None = None


def ranked_evidence(requests: DataFrame, results: DataFrame, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(indexed, scored, ranked) chunks."""
    indexed = retrieve(results, policy)
    scored = materialise(score_chunks(indexed, policy))
    return indexed, scored, rank_chunks(scored, requests, policy.max_ranked_chunks, policy.relevance_weight, policy.quality_weight)


def verified(requests: DataFrame, indexed: DataFrame, sentences: DataFrame, citations: DataFrame, verdicts: DataFrame | None, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(citations, sentences, answers) with their verdicts."""
    sets = domain_sets(policy)
    checked = V.judge_verdicts(V.check_citations(citations, indexed), verdicts, sets)
    rolled = V.roll_up(sentences, checked, sets)
    return checked, rolled, V.confidence(requests, rolled)


def searches(state: DataFrame) -> DataFrame:
    """request_id, query_ord, query of open requests; on a retry other ones."""
    return state.select("request_id", F.posexplode(expand_query(F.col("query"), F.col("retries") > 0)).alias("query_ord", "query"))


def drafts_of(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sentences, citations) of parsed drafts, in the order of the draft."""
    s = answers.filter("draft.is_answerable").select("request_id", F.posexplode("draft.sentences").alias("sent_ord", "s"))
    sentences = s.select("request_id", "s.sentence_id", "sent_ord", "s.text", "s.is_cited")
    citations = s.select("request_id", "s.sentence_id", F.col("s.text").alias("claim"), F.posexplode("s.citations").alias("cit_ord", "c"))
    return sentences, citations.select("request_id", "sentence_id", "claim", "cit_ord", "c.citation_id", "c.chunk_id", F.col("c.exact_source_quote").alias("quote"))


def judged(checked: DataFrame, chunks: DataFrame, model: J.Model) -> DataFrame:
    """request_id, sentence_id, citation_id, semantic_check, reason and the call's columns: the judge sees only quotes that stand in their chunk."""
    passed = checked.filter("mechanical_check = 'passed'")
    meta = F.to_json(F.struct("source_url", "domain", "title"))
    asked = J.ask(passed.withColumn("prompt", J.judge_prompt(F.col("claim"), F.col("quote"), F.col("chunk_text"), meta)), F.col("prompt"), model, ["request_id", "sentence_id", "citation_id"], attempts=1)
    told = J.parse_verdicts(asked)
    # a service that failed and an answer that is none are the same to the tier, but not to the reason
    return told.withColumn("reason", F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("semantic_check") == "error", "ValueError").otherwise(F.col("reason")))


def agreed(sentences: DataFrame, citations: DataFrame, model: J.Model) -> DataFrame:
    """request_id, sentence_id, corroborated, reasoning and the call's columns for sentences that would be tier 2."""
    sources = V.first_by_domain(citations).groupBy("request_id", "sentence_id").agg(F.array_sort(F.collect_list(F.struct("cit_ord", "domain", "quote"))).alias("sources"))
    two = sentences.filter("tier = 2").join(sources, ["request_id", "sentence_id"]).filter("size(sources) >= 2")
    asked = J.ask(two.withColumn("prompt", J.agreement_prompt(F.col("text"), F.col("sources"))), F.col("prompt"), model, ["request_id", "sentence_id"], attempts=1)
    told = J.parse_corroborations(asked)
    return told.withColumn("reasoning", F.when(F.col("corroborated").isNull(), F.coalesce("error", F.lit("ValueError"))).otherwise(F.col("reasoning")))


def ledger(answers: DataFrame, node: str, model: str) -> DataFrame:
    """Calls of a stage for the usage summary: one row for each asked prompt."""
    return answers.select("request_id", F.lit(node).alias("node"), F.lit(model).alias("model"), "calls", "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.lit(0.0).alias("cost"))


def usage_of(calls: DataFrame) -> DataFrame:
    """request_id, usage: totals and a map by model, as respond() takes it."""
    s = U.usage_summary(calls.withColumn("call", F.explode(F.sequence(F.lit(1), F.greatest("calls", F.lit(1))))).withColumn("first", F.col("call") == 1).select("request_id", "model", *[F.when(F.col("first"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "cost")]))
    return s.select("request_id", F.struct(*[c for c in s.columns if c != "request_id"]).alias("usage"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def one_pass(live: DataFrame, indexed: DataFrame, scored: DataFrame, ranked: DataFrame, models: Models, policy: Policy) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(state, sentences, citations, calls) after drafting, checking and judging the open requests once."""
    sets, k = domain_sets(policy), policy.max_ranked_chunks
    shown = evidence(ranked, scored, indexed, k).join(indexed.select("request_id", "chunk_id", "text"), ["request_id", "chunk_id"]).withColumnRenamed("pos", "rank")
    block = J.chunks_block(shown)
    gate = answerable(live, ranked, policy.answerability_floor).join(shown.select("request_id").distinct().withColumn("any", F.lit(True)), "request_id", "left")
    # chunks that were never ranked are no reason to give up; rewrites always get their try
    gate = gate.withColumn("reason", F.when(F.col("any").isNull(), "no_chunks").when(F.col("reason") == "low_relevance", "low_relevance")).select("request_id", "reason")
    state = live.drop("reason", "error").join(gate, "request_id", "left").join(block, "request_id", "left")
    state = state.withColumn("reason", F.when(F.size("requests") > 0, None).otherwise(F.col("reason")))
    tried = state.filter("reason is null")
    asked = J.ask(tried.withColumn("prompt", J.synthesis_prompt(F.col("query"), F.col("level"), F.coalesce("block", F.lit("")), F.col("requests"))), F.col("prompt"), models.synthesiser, ["request_id"], check=J.draft_error)
    answers = materialise(J.parse_drafts(asked.withColumnRenamed("error", "failure")).withColumn("error", F.coalesce("failure", "error")))
    sentences, citations = drafts_of(answers.filter("error is null"))
    checked = materialise(V.check_citations(citations, indexed).withColumn("audit_proof", V.audit_proof()))
    calls = [ledger(answers, "synthesizer", "synthesiser")]
    verdicts = None
    if models.judge is not None and policy.semantic_verification:
        verdicts = materialise(judged(checked, indexed, models.judge))
        calls.append(ledger(verdicts, "semantic", "judge"))
    verified_ = materialise(V.judge_verdicts(checked, verdicts, sets))
    rolled = V.roll_up(sentences, verified_, sets)
    if models.agreement is not None and verdicts is not None:
        rolled = materialise(rolled)
        agree = materialise(agreed(rolled, verified_, models.agreement))
        calls.append(ledger(agree, "corroboration", "agreement"))
        rolled = V.corroborate(rolled, verified_, agree)
    faults = verified_.filter("tier in (4, 5)").withColumn("request", F.when(F.col("tier") == 5, rewrite_request(5, *map(F.col, FAULT))).otherwise(rewrite_request(4, *map(F.col, FAULT))))
    order = F.struct((F.col("tier") == 4).alias("late"), "sentence_id", "cit_ord", "request")
    wishes = faults.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["request"]).alias("wishes"))
    told = answers.select("request_id", F.col("error"), F.coalesce("draft.is_answerable", F.lit(False)).alias("yes"))
    after = state.drop("block", "requests", "is_answerable", "pending").join(told, "request_id", "left").join(wishes, "request_id", "left")
    after = after.withColumn("is_answerable", F.coalesce("yes", F.lit(False))).withColumn("requests", F.coalesce("wishes", F.array().cast("array<string>"))).drop("yes", "wishes")
    after = after.withColumn("pending", F.size("requests")).withColumn("loop_count", F.col("loop_count") + 1)
    return after, rolled, verified_, union(calls)


FAULT = ("sentence_id", "citation_id", "chunk_id", "failure_reason")


def answer(requests: DataFrame, search: Callable[[DataFrame], DataFrame], models: Models, policy: Policy = Policy(), progress: Callable[..., None] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(responses, citations with their proofs, retrieval counters).

    progress (streaming.progress.Frames) is told of each step when it is done: progress(type, rows of request_id and what there is to tell, names of columns that order a request's rows).

    requests: request_id, query, and level if readers differ. search: from rows request_id, query_ord, query to results (request_id, query_ord, result_ord, url, content,
    title, content_mode); it may give rows with an `error` column for searches that failed. A request whose drafting fails ends with status error; others go on.
    """
    kind = requests.schema["request_id"].dataType.simpleString()
    level = F.col("level") if "level" in requests.columns else F.lit("intermediate")
    live = materialise(requests.select("request_id", "query", level.alias("level"), F.lit(True).alias("is_answerable"), F.lit(0).alias("pending"), F.lit(0).alias("loop_count"), F.lit(0).alias("retries"), F.array().cast("array<string>").alias("requests"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("reason")))
    seen = requests.sparkSession.createDataFrame([], f"request_id {kind}, norm_url string")
    numbers = None
    done: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    calls: list[DataFrame] = []
    counts: list[DataFrame] = []
    sizes: list[DataFrame] = []
    fresh = True
    tell = progress or (lambda *args: None)
    tell("accepted", live.select("request_id", "query"))
    for _ in range(policy.max_rewrite_loops * (policy.max_retrieval_retries + 1)):
        if fresh:
            found = materialise(search(searches(live)))
            failed = found.filter("error is not null").select("request_id", "query_ord").distinct() if "error" in found.columns else None
            results = found.filter("error is null").drop("error") if failed is not None else found
            if numbers is not None:
                results = results.join(numbers, "request_id", "left").withColumn("next_doc", F.coalesce("next_doc", F.lit(1)))
            indexed, counters = counted(results, policy, seen, failed=failed)
            indexed = materialise(indexed)
            counts.append(materialise(counters))
            scored = materialise(score_chunks(indexed, policy))
            ranked = materialise(rank_chunks(scored, live.select("request_id", "query"), policy.max_ranked_chunks, policy.relevance_weight, policy.quality_weight))
            seen = materialise(seen.unionByName(results.select("request_id", F.regexp_replace(F.lower("url"), "/+$", "").alias("norm_url")).distinct()))
            last = indexed.groupBy("request_id").agg((F.max("doc_index") + 1).alias("next_doc"))
            numbers = materialise(last if numbers is None else numbers.unionByName(last).groupBy("request_id").agg(F.max("next_doc").alias("next_doc")))
            sizes.append(indexed.groupBy("request_id").agg(F.count("*").alias("chunks_retrieved")).join(ranked.groupBy("request_id").agg(F.count("*").alias("chunks_ranked")), "request_id", "left"))
            tell("stage", live.select("request_id").join(sizes[-1], "request_id", "left").select("request_id", F.lit("retrieved").alias("stage"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks_retrieved", "chunks_ranked")]))
        state, sentences, citations, used = one_pass(live, indexed, scored, ranked, models, policy)
        calls.append(used)
        state = materialise(state.withColumn("route", F.when(F.col("error").isNotNull(), "end").otherwise(route(policy.max_rewrite_loops, policy.max_retrieval_retries))))
        ended = state.filter("route = 'end'").select("request_id")
        mine = lambda df, ids=ended: materialise(df.join(ids, "request_id", "left_semi"))
        done.append((state.filter("route = 'end'"), mine(sentences), mine(citations)))
        if progress:
            tell("stage", state.select("request_id", F.lit("verified").alias("stage"), "pending"))
            tell("sentence", done[-1][1].select("request_id", "sentence_id", "sent_ord", "text", "tier"), "sent_ord")
            tell("loop", state.filter("route != 'end'").select("request_id", F.col("route").alias("kind"), F.col("loop_count").alias("loop"), "retries"))
            tell("error", state.filter("route = 'end' and error is not null").select("request_id", "error"))
            tell("complete", state.filter("route = 'end' and error is null").select("request_id", "is_answerable"))
        again = state.filter("route = 'retrieve'")
        # rewriting goes on with the chunks at hand; once no request rewrites, those that wait search anew, with nothing left of what was checked before
        rewriting = state.filter("route = 'rewrite'").drop("route")
        waiting = again.drop("route").withColumns({"retries": F.col("retries") + 1, "loop_count": F.lit(0), "requests": F.array().cast("array<string>"), "pending": F.lit(0), "is_answerable": F.lit(True)})
        fresh = rewriting.isEmpty()
        live = waiting if fresh else rewriting
        if live.isEmpty():
            break
    ends = union([d[0] for d in done])
    latest = lambda frames, name: union(frames).groupBy("request_id").agg(F.max(name).alias(name))
    stats = ends.select("request_id", "loop_count", F.col("retries").alias("retrieval_retry_count"))
    for name in ("chunks_retrieved", "chunks_ranked"):
        stats = stats.join(latest([s.select("request_id", F.coalesce(name, F.lit(0)).alias(name)) for s in sizes], name), "request_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    sentences, citations = union([d[1] for d in done]), union([d[2] for d in done])
    response = V.respond(ends.select("request_id", "is_answerable"), sentences, citations, stats=stats, usage=usage_of(union(calls)), errors=ends.filter("error is not null"))
    return response, citations, union(counts)
