"""BM25 over postings. Statistics and ranks are those of a group (a request), or of one whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.functions.text import tokens
from citewright.operators.frames import materialise, numbered, ranked_within, stored

K1, B, UNKNOWN_IDF, BROADCAST_TERMS = 1.2, 0.75, 1.0, 1_000_000


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", group: list[str] | None = None) -> DataFrame:
    """group.., key, term, tf, dl: one row for each distinct term of a text."""
    group = group or []
    t = docs.select(*group, key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    return t.select(*group, key, F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy(*group, key, "term").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", group: list[str] | None = None) -> DataFrame:
    """group.., key, dl; texts without terms count, with length 0."""
    return docs.select(*(group or []), key, F.size(tokens(F.coalesce(F.col(text), F.lit("")))).alias("dl"))


def corpus_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", group: list[str] | None = None) -> DataFrame:
    """group.., n (texts) and avgdl (mean length)."""
    return lengths(docs, key, text, group).groupBy(*(group or [])).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def document_frequencies(post: DataFrame, stats: DataFrame, group: list[str] | None = None) -> DataFrame:
    """group.., term, df, idf."""
    group = group or []
    df = post.groupBy(*group, "term").agg(F.count("*").alias("df"))
    with_n = df.join(stats, group) if group else df.crossJoin(F.broadcast(stats))  # stats of one corpus are one row
    return with_n.select(*group, "term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """key, term: distinct terms of each query."""
    return queries.select(key, F.explode(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("term"))


def term_score(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(avgdl, F.lit(1.0))))


def _asked_tokens(docs: DataFrame, terms: DataFrame, key: str, group: list[str], text: str, ends: bool = False) -> DataFrame:
    """group.., key, dl, term of each place of a text where a term stands that is asked for (in the same group): others leave in the task that reads them, against the distinct terms while those are few (counted).

    ends: every text has one row with a null term besides."""
    wanted = terms.select(*group, "term").distinct()
    few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    t = docs.select(*group, key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    t = t.select(*group, key, F.size("ts").alias("dl"), F.explode(F.concat("ts", F.array(F.lit(None).cast("string"))) if ends else F.col("ts")).alias("term"))
    wanted = F.broadcast(wanted) if few else wanted
    if not ends:
        return t.join(wanted, [*group, "term"], "left_semi")
    return t.join(wanted.withColumn("_asked", F.lit(True)), [*group, "term"], "left").filter("_asked or term is null").drop("_asked")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def asked_postings(docs: DataFrame, terms: DataFrame, key: str, group: list[str] | None = None, text: str = "text") -> DataFrame:
    """postings() of the terms that are asked for (in the same group)."""
    group = group or []
    t = _asked_tokens(docs, terms, key, group, text)
    # dealt by text, in which scores are summed up: from here on no sum needs another shuffle
    return t.repartition(_partitions(docs), *group, key).groupBy(*group, key, "term").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))


def bm25_corpus(docs: DataFrame, queries: DataFrame, key: str = "doc_id", qkey: str = "query_id") -> DataFrame:
    """Scores of all texts with a term of the query: qkey, key, relevance_score in 0..1. See full_ranks for texts without one.

    Postings of the terms asked for are counted before they move, and written once by columns; dealt by text they meet the queries' terms by broadcast while those are few (counted), so no hit moves to be summed.
    """
    terms = materialise(query_terms(queries, qkey))
    tokens_ = _asked_tokens(docs, terms, key, [], "text", ends=True)  # texts are read once: their ends tell how many there are, and how long
    rows = stored(tokens_.groupBy(key, "term").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("all")))
    stats = materialise(rows.filter("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum("all") / F.sum("tf")).alias("avgdl")))
    post = rows.filter("term is not null").drop("all")
    df = document_frequencies(post, stats)
    known = materialise(terms.join(df.select("term", "idf"), "term", "left").withColumn("idf", F.coalesce("idf", F.lit(UNKNOWN_IDF))))
    best = known.groupBy(qkey).agg(F.sum("idf").alias("most"))
    few = known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    near = F.broadcast if few else lambda side: side
    hits = post.repartition(_partitions(docs), key).join(near(known), "term").crossJoin(F.broadcast(stats.select("avgdl")))  # one row
    score = hits.groupBy(qkey, key).agg(F.sum(F.col("idf") * term_score(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("s"))
    return score.join(near(best), qkey).select(qkey, key, F.round(F.least(F.lit(1.0), F.col("s") / F.col("most")), 4).alias("relevance_score"))


def asked_ranks(scored: DataFrame, docs: DataFrame, asked: DataFrame, key: str = "doc_id", qkey: str = "query_id") -> DataFrame:
    """Ranks of the asked (qkey, key) pairs in the full ranking of docs. scored: the hits of all queries (qkey, key, relevance_score), of which equal ones stand in the order of key.

    Hits are written once and dealt once by ranges of (query, score), with a mark on the asked ones; where an asked document has no hit, once more by (query, key).
    """
    asked = materialise(asked.select(qkey, key).distinct())
    hits = stored(scored.select(qkey, key, "relevance_score"))
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    mark = asked.withColumn("mark", F.lit(True))
    marked = hits.join(F.broadcast(mark) if few else mark, [qkey, key], "left")
    ranked = ranked_within(marked, qkey, F.desc("relevance_score"), key).filter("mark").select(qkey, key, "rank")
    return full_ranks(hits, docs, asked, key, qkey, ranked)


def full_ranks(run: DataFrame, docs: DataFrame, asked: DataFrame, key: str = "doc_id", qkey: str = "query_id", ranked: DataFrame | None = None) -> DataFrame:
    """Ranks of the asked (qkey, key) pairs in the full ranking, in which every document has a place: those in run (qkey, key, rank, 1 to its number of rows) come
    first, the rest after them in the order of key. The rest is never listed: its places follow from counts, taken in ranges of (query, key), so no query is one task.

    ranked: the asked rows of run with their rank, where those are known; run then needs no rank."""
    place = numbered(docs.select(key), key, name="p")
    asked = materialise(asked.select(qkey, key).distinct().join(place, key))
    if ranked is None:
        run = ranked = materialise(run.select(qkey, key, "rank"))
    found = materialise(asked.join(ranked, [qkey, key], "left"))
    missing = found.filter("rank is null").select(qkey, key, "p")
    need = materialise(missing.select(qkey).distinct())
    if need.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        need = F.broadcast(need)
    # hits of the run up to a missing one's key: its number among both, less its number among the missing
    mine = missing.select(qkey, F.col(key).alias("k"), "p")
    marks = run.join(need, qkey, "left_semi").select(qkey, F.col(key).alias("k"), F.lit(None).cast("long").alias("p")).unionByName(mine)
    both = ranked_within(marks, qkey, "k", F.col("p").isNotNull(), name="both").filter("p is not null").select(qkey, "k", "p", "both")
    counted = both.join(ranked_within(mine, qkey, "k", name="own").select(qkey, "k", "own"), [qkey, "k"]).withColumn("before", F.col("both") - F.col("own"))
    total = run.groupBy(qkey).agg(F.count("*").alias("m"))
    after = counted.join(total, qkey, "left").select(qkey, F.col("k").alias(key), (F.coalesce("m", F.lit(0)) + F.col("p") - F.col("before")).cast("int").alias("rank"))
    return found.filter("rank is not null").select(qkey, key, "rank").unionByName(after)


def top(scored: DataFrame, k: int, by: str, score: str, tie: str, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def bm25_request(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Relevance of each chunk to its own request, with the statistics of the request's chunks. Chunks without a hit score 0."""
    g, chunks = ["request_id"], materialise(chunks)  # read three times
    stats = corpus_stats(chunks, "chunk_id", "text", g)
    terms = materialise(query_terms(requests, "request_id", "query"))
    post = materialise(asked_postings(chunks, terms, "chunk_id", g))
    df = document_frequencies(post, stats, g)
    known = terms.join(df.select("request_id", "term", "idf"), ["request_id", "term"], "left").withColumn("idf", F.coalesce("idf", F.lit(UNKNOWN_IDF)))
    best = known.groupBy("request_id").agg(F.sum("idf").alias("most"))
    hits = post.join(known, ["request_id", "term"]).join(stats, "request_id")
    score = hits.groupBy("request_id", "chunk_id").agg(F.sum(F.col("idf") * term_score(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("s"))
    score = score.join(best, "request_id").select("request_id", "chunk_id", F.round(F.least(F.lit(1.0), F.col("s") / F.col("most")), 4).alias("relevance_score"))
    return chunks.join(score, ["request_id", "chunk_id"], "left").withColumn("relevance_score", F.coalesce("relevance_score", F.lit(0.0)))


def ranking_score(relevance: Column, quality: Column, wr: float = 0.6, wq: float = 0.4) -> Column:
    return F.round(F.lit(float(wr)) * relevance + F.lit(float(wq)) * F.coalesce(quality, F.lit(0.5)), 4)


def rank_chunks(chunks: DataFrame, requests: DataFrame, k: int = 10, wr: float = 0.6, wq: float = 0.4) -> DataFrame:
    """Scored chunks -> the k best of each request by blended score, ties by chunk id as text."""
    out = bm25_request(chunks, requests).withColumn("ranking_score", ranking_score(F.col("relevance_score"), F.col("quality_score"), wr, wq))
    return top(out, k, "request_id", "ranking_score", "chunk_id", "rank")


def answerable(requests: DataFrame, ranked: DataFrame, floor: float = 0.15) -> DataFrame:
    """request_id, best_score, reason: why no answer is tried (null: one is). Chunks that were not ranked (no ranking_score) are tried if there are any."""
    if "ranking_score" not in ranked.columns:
        ranked = ranked.withColumn("ranking_score", F.lit(None).cast("double"))
    best = ranked.groupBy("request_id").agg(F.max("ranking_score").alias("best_score"), F.count("*").alias("n"))
    reason = F.when(F.coalesce("n", F.lit(0)) == 0, "no_chunks").when(F.col("best_score") < floor, "low_relevance")
    return requests.select("request_id").join(best, "request_id", "left").select("request_id", "best_score", reason.alias("reason"))


def evidence(ranked: DataFrame, scored: DataFrame, indexed: DataFrame, k: int = 10) -> DataFrame:
    """Ranked chunks of a request; without any the first k scored ones; without those the first k indexed ones."""
    cols = ["request_id", "chunk_id", "pos", "level"]
    rows = ranked.select("request_id", "chunk_id", F.col("rank").alias("pos"), F.lit(1).alias("level"))
    rows = rows.unionByName(scored.select("request_id", "chunk_id", F.col("scored_pos").alias("pos"), F.lit(2).alias("level")).filter(F.col("pos") <= k))
    rows = rows.unionByName(indexed.select("request_id", "chunk_id", F.col("retrieval_pos").alias("pos"), F.lit(3).alias("level")).filter(F.col("pos") <= k))
    best = rows.groupBy("request_id").agg(F.min("level").alias("level"))
    return rows.join(best, ["request_id", "level"]).select(*cols)
