"""Citation checks and their roll-up to sentences and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.functions.text import normalise_quote
from citewright.functions.trust import DomainSets, primary
from citewright.operators.frames import small_batches

MIN_TOKENS, MIN_CHARS = 4, 12
#: What the tiers are called and weigh (in hundredths).
LABELS = {1: "authoritative", 2: "multi_source", 3: "model_assisted", 4: "misrepresented", 5: "hallucinated", 6: "conflicted"}
WEIGHTS = {1: 100, 2: 85, 3: 60, 4: 20, 5: 0, 6: 40}


def mechanical(norm_quote: Column, norm_chunk: Column, chunk_id: Column) -> tuple[Column, Column]:
    """(status, reason) of a quote against the text that it claims to come from, both normalised."""
    n = F.when(norm_quote == "", 0).otherwise(F.size(F.split(norm_quote, " ")))
    short = (n < MIN_TOKENS) & (F.length(norm_quote) < MIN_CHARS)
    too_short = F.format_string(f"Quote is too short after normalization (%d tokens < {MIN_TOKENS} required and %d chars < {MIN_CHARS} required).", n, F.length(norm_quote))
    reason = (
        F.when(norm_chunk.isNull(), F.concat(F.lit("Chunk "), chunk_id, F.lit(" not found in indexed_chunks.")))
        .when(F.coalesce(norm_quote, F.lit("")) == "", "Quote is empty after normalization.")
        .when(short, too_short)
        .when(~norm_chunk.contains(norm_quote), "Normalized quote not found in the chunk.")
    )
    return F.when(reason.isNull(), "passed").otherwise("failed"), reason


def check_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (request_id, sentence_id, cit_ord, citation_id, chunk_id, quote) with the verdict of the text itself.

    Cited chunks are looked up among all chunks of the request; each is normalised once, not once a citation.
    """
    small_batches(citations.sparkSession)  # texts that are not ASCII go through Python
    keys = citations.select("request_id", "chunk_id").distinct()
    cited = chunks.join(keys, ["request_id", "chunk_id"], "left_semi").select("request_id", "chunk_id", "source_url", "title", "domain", F.col("text").alias("chunk_text"), normalise_quote(F.col("text")).alias("norm_chunk"))
    rows = citations.withColumn("norm_quote", normalise_quote(F.coalesce(F.col("quote"), F.lit("")))).join(cited, ["request_id", "chunk_id"], "left")
    status, reason = mechanical(F.col("norm_quote"), F.col("norm_chunk"), F.col("chunk_id"))
    return rows.withColumn("mechanical_check", status).withColumn("failure_reason", reason).withColumn("tier", F.when(F.col("mechanical_check") == "passed", 3).otherwise(5)).drop("norm_chunk")


def audit_proof() -> Column:
    """The evidence of a citation's text check, from the columns of check_citations: of a passed one the quote and its tokens, of a failed one the tier, the reason, and both forms of the quote."""
    quote, norm = F.coalesce("quote", F.lit("")), F.col("norm_quote")
    ok = F.col("mechanical_check") == "passed"
    tokens = F.when(norm == "", 0).otherwise(F.size(F.split(norm, " ")))
    fail = lambda c: F.when(~ok, c)
    return F.struct(
        F.lit("mechanical_verification").alias("check"), F.col("mechanical_check").alias("status"), fail(F.lit(5)).alias("tier"), fail(F.lit(LABELS[5])).alias("tier_label"), F.col("chunk_id"),
        fail(F.col("failure_reason")).alias("failure_reason"), fail(quote).alias("raw_quote"), norm.alias("norm_quote"), F.when(ok, tokens).alias("norm_quote_tokens"),
        fail(F.substring(norm, 1, 200)).alias("norm_quote_snippet"), F.lit("full_chunk").alias("verification_scope"),
    )


def judge_verdicts(checked: DataFrame, verdicts: DataFrame | None, sets: DomainSets) -> DataFrame:
    """Tiers after the judge: verdicts has request_id, citation_id, semantic_check (passed, failed or error), reason.

    Only citations that passed the text check count; no verdicts at all means that judging is off.
    """
    if verdicts is None:
        off = F.when(F.col("mechanical_check") == "passed", F.lit("Semantic verification disabled by server policy."))
        return checked.withColumn("semantic_check", F.lit("skipped")).withColumn("failure_reason", F.coalesce("failure_reason", off))
    v = verdicts.select("request_id", "citation_id", F.col("semantic_check").alias("v"), F.col("reason").alias("why"))
    j = checked.join(v, ["request_id", "citation_id"], "left")
    ok = F.col("mechanical_check") == "passed"
    tier = F.when(~ok, 5).when(F.col("v") == "passed", F.when(primary(F.coalesce("domain", F.lit("")), sets), 1).otherwise(3)).when(F.col("v") == "failed", 4).otherwise(3)
    check = F.when(~ok, "skipped").when(F.col("v").isin("passed", "failed"), F.col("v")).otherwise("skipped")
    why = F.when(~ok, F.col("failure_reason")).when(F.col("v") == "passed", None).when(F.col("v") == "failed", F.coalesce("why", F.lit("Semantic mismatch."))).otherwise(F.concat(F.lit("Semantic check unavailable: "), F.coalesce("why", F.lit("no verdict"))))
    return j.withColumn("tier", tier).withColumn("semantic_check", check).withColumn("failure_reason", why).drop("v", "why")


def roll_up(sentences: DataFrame, citations: DataFrame, sets: DomainSets) -> DataFrame:
    """One verdict for each sentence (request_id, sentence_id, is_cited) from those of its citations.

    Any failed quote makes it tier 5, else any misread one 4; all judged right and one from a primary source 1, or from two domains 2; else 3. The reason
    is that of the first citation, in their order, that has the deciding fault. Sentences without citations are 3 if they
    claim none, else 5.
    """
    first = lambda cond: F.min_by(F.when(cond, F.col("failure_reason")), F.when(cond, F.col("cit_ord")))
    dom = F.nullif(F.coalesce("domain", F.lit("")), F.lit(""))
    g = citations.groupBy("request_id", "sentence_id").agg(
        F.count("*").alias("n"),
        F.bool_or(F.col("tier") == 5).alias("any5"), F.bool_or(F.col("tier") == 4).alias("any4"),
        F.every(F.col("semantic_check") == "passed").alias("all_passed"),
        F.bool_or(primary(dom, sets)).alias("any_primary"), F.count_distinct(dom).alias("n_domains"),
        first(F.col("tier") == 5).alias("why5"), first(F.col("tier") == 4).alias("why4"), first(F.col("failure_reason").isNotNull()).alias("why"),
    )
    s = sentences.join(g, ["request_id", "sentence_id"], "left")
    none, passed = F.col("n").isNull(), F.coalesce("all_passed", F.lit(False))
    tier = (
        F.when(none, F.when(F.col("is_cited"), 5).otherwise(3)).when(F.col("any5"), 5).when(F.col("any4"), 4)
        .when(passed & F.coalesce("any_primary", F.lit(False)), 1).when(passed & (F.col("n_domains") >= 2), 2).otherwise(3)
    )
    out = s.withColumn("tier", tier)
    mechanical_ = F.when(none & ~F.col("is_cited"), "skipped").when(F.col("tier") == 5, "failed").otherwise("passed")
    semantic = F.when(F.col("tier").isin(1, 2), "passed").when(F.col("tier") == 4, "failed").when((F.col("tier") == 3) & passed & ~none, "passed").otherwise("skipped")
    reason = F.when(none & F.col("is_cited"), "Sentence has no verified citations.").when(F.col("tier") == 5, F.col("why5")).when(F.col("tier") == 4, F.col("why4")).when(F.col("tier") == 3, F.col("why"))
    return out.select(*sentences.columns, F.col("tier").cast("int").alias("tier"), label(F.col("tier")).alias("tier_label"), mechanical_.alias("mechanical_check"), semantic.alias("semantic_check"), reason.alias("failure_reason"))


def label(tier: Column) -> Column:
    out = F.lit(None).cast("string")
    for t, name in LABELS.items():
        out = F.when(tier == t, name).otherwise(out)
    return out


def first_by_domain(citations: DataFrame) -> DataFrame:
    """One citation for each distinct domain of a sentence: the first."""
    w = Window.partitionBy("request_id", "sentence_id", "domain").orderBy("cit_ord")
    return citations.filter("coalesce(domain, '') != ''").withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def corroborate(sentences: DataFrame, citations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Tier 2 stands only if the judge finds that the sources agree. verdicts: request_id, sentence_id, corroborated (null: no answer, reasoning then names the error), reasoning."""
    n = first_by_domain(citations).groupBy("request_id", "sentence_id").agg(F.count("*").alias("sources"))
    s = sentences.join(n, ["request_id", "sentence_id"], "left").join(verdicts.select("request_id", "sentence_id", "corroborated", "reasoning"), ["request_id", "sentence_id"], "left")
    down = (F.col("tier") == 2) & (F.coalesce("sources", F.lit(0)) >= 2) & ~F.coalesce("corroborated", F.lit(False))
    unknown = F.concat(F.lit("Corroboration unavailable: "), F.coalesce("reasoning", F.lit("no verdict")))
    why = F.when(F.col("corroborated").isNull(), unknown).otherwise("Sources cover different aspects of the claim but do not independently corroborate it.")
    s = s.withColumn("failure_reason", F.when(down, why).otherwise(F.col("failure_reason"))).withColumn("tier", F.when(down, 3).otherwise(F.col("tier")))
    return s.withColumn("tier_label", label(F.col("tier"))).select(*sentences.columns)


def confidence(requests: DataFrame, sentences: DataFrame) -> DataFrame:
    """request_id, tier counts, overall_score: the mean weight, in whole hundredths until the one division."""
    weight = F.lit(None).cast("long")
    for t, w in WEIGHTS.items():
        weight = F.when(F.coalesce("tier", F.lit(3)) == t, F.lit(w).cast("long")).otherwise(weight)
    g = sentences.groupBy("request_id").agg(F.count("*").alias("n_sentences"), *[F.count_if(F.coalesce("tier", F.lit(3)) == t).alias(f"tier_{t}_claims") for t in LABELS], F.sum(weight).alias("w"), F.bool_or(F.col("tier") >= 4).alias("faulty"))
    out = requests.join(g, "request_id", "left")
    zero = [F.coalesce(f"tier_{t}_claims", F.lit(0)).alias(f"tier_{t}_claims") for t in LABELS]
    # half up at the fourth digit, by whole numbers
    score = F.when(F.coalesce("n_sentences", F.lit(0)) == 0, F.lit(0.0)).otherwise(F.floor((F.col("w") * 200 + F.col("n_sentences")) / (F.col("n_sentences") * 2)).cast("double") / 10000)
    status = F.when(~F.coalesce("is_answerable", F.lit(True)) | (F.coalesce("n_sentences", F.lit(0)) == 0), "unanswerable").when(F.col("faulty"), "partial").otherwise("success")
    return out.select("request_id", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), *zero, score.alias("overall_score"), status.alias("status"))


def respond(requests: DataFrame, sentences: DataFrame, citations: DataFrame, *, stats: DataFrame | None = None, usage: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """One nested row for each request: status, confidence, sentences in order with their citations in order, pipeline_stats, usage, error_message.

    stats: request_id, chunks_retrieved, chunks_ranked, loop_count, retrieval_retry_count; usage: request_id, usage; errors: request_id of requests that failed: they
    have status error, a score of 0, no sentences, and a message that says nothing of the cause.
    """
    c = citations.groupBy("request_id", "sentence_id").agg(F.array_sort(F.collect_list(F.struct("cit_ord", "citation_id", "chunk_id", "quote", "tier", "mechanical_check", "semantic_check", "failure_reason", F.when(F.col("source_url").isNotNull(), F.struct("source_url", "title", "domain")).alias("source")))).alias("citations"))
    s = sentences.join(c, ["request_id", "sentence_id"], "left")
    order = [F.col("sent_ord")] if "sent_ord" in s.columns else []  # a draft's own order, else that of the ids
    nested = s.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(*order, "sentence_id", "text", "tier", "tier_label", "mechanical_check", "semantic_check", "failure_reason", "citations"))).alias("final_response"))
    out = confidence(requests, sentences).join(nested, "request_id", "left")
    answerable = requests.select("request_id", F.coalesce("is_answerable", F.lit(True)).alias("is_answerable"))
    out = out.join(answerable, "request_id")
    failed = F.lit(False)
    if errors is not None:
        out = out.join(errors.select("request_id").distinct().withColumn("failed", F.lit(True)), "request_id", "left")
        failed = F.coalesce("failed", F.lit(False))
    parts = F.struct("chunks_retrieved", "chunks_ranked", "loop_count", "retrieval_retry_count").alias("pipeline_stats")
    if stats is not None:
        out = out.join(stats.select("request_id", parts), "request_id", "left")
    if usage is not None:
        out = out.join(usage.select("request_id", "usage"), "request_id", "left")
    counts = [F.when(failed, 0).otherwise(F.col(c)).alias(c) for c in ("n_sentences", *[f"tier_{t}_claims" for t in LABELS])]
    message = F.when(failed, F.concat(F.lit("Internal pipeline error — see server logs for request "), F.col("request_id").cast("string"), F.lit(".")))
    more = [c for c in ("pipeline_stats", "usage") if c in out.columns]
    return out.select("request_id", F.when(failed, "error").otherwise(F.col("status")).alias("status"), (F.col("is_answerable") & ~failed).alias("is_answerable"), *counts, F.when(failed, 0.0).otherwise(F.col("overall_score")).alias("overall_score"), F.when(~failed, F.col("final_response")).alias("final_response"), message.alias("error_message"), *more)


def valid_drafts(sentences: DataFrame, citations: DataFrame) -> DataFrame:
    """request_id, ok: cited exactly if there are citations, citation ids unique, chunk ids well-formed, quotes of 1 to 2000 characters."""
    n = citations.groupBy("request_id", "sentence_id").agg(F.count("*").alias("n"))
    flags = sentences.join(n, ["request_id", "sentence_id"], "left").groupBy("request_id").agg(F.every(F.col("is_cited") == (F.coalesce("n", F.lit(0)) > 0)).alias("a"))
    fine = citations.groupBy("request_id").agg((F.count("citation_id") == F.count_distinct("citation_id")).alias("b"), F.every(F.col("chunk_id").rlike("^doc_\\d+_chunk_[A-Z0-9]+$") & F.length("quote").between(1, 2000)).alias("c"))
    return flags.join(fine, "request_id", "left").select("request_id", (F.col("a") & F.coalesce("b", F.lit(True)) & F.coalesce("c", F.lit(True))).alias("ok"))
