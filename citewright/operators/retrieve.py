"""From search results to numbered chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.config import Policy
from citewright.functions import text as T
from citewright.functions import urls as U
from citewright.operators.frames import materialise, small_batches

ORDER = ["query_ord", "result_ord"]


def pick_content(raw: F.Column, snippet: F.Column, full: bool = True, cap: int = 200_000):
    """(text, mode): the page where it is wanted and not blank, else the snippet."""
    page = T.strip(F.coalesce(raw, F.lit("")))
    use = F.lit(full) & (page != "")
    return F.when(use, F.struct(F.substring(page, 1, cap).alias("content"), F.lit("raw").alias("mode"))).otherwise(F.struct(F.coalesce(snippet, F.lit("")).alias("content"), F.lit("snippet").alias("mode")))


def union_backends(*frames: DataFrame) -> DataFrame:
    """All results, each backend's after those of the one before."""
    out = None
    for i, f in enumerate(frames):
        g = f.withColumn("backend_ord", F.lit(i))
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    return out


def classify(results: DataFrame, policy: Policy, seen: DataFrame | None = None, clean=T.strip_fragment) -> DataFrame:
    """Each result with what becomes of it: unsafe, banned, duplicate, empty or kept; and its clean text.

    The first of equal URLs wins, among results that are safe and not banned; a page without text still uses up its URL.
    """
    small_batches(results.sparkSession)  # pages go through Python
    # a generator, so that what it gives is worked out once and not copied into every filter and window below
    facts = F.struct(U.domain(F.col("url")).alias("domain"), U.normal_form(F.col("url")).alias("norm_url"), U.url_safety(F.col("url")).alias("safety"))
    r = results.select(*[c for c in results.columns if c not in ("domain", "norm_url", "safety")], F.inline(F.array(facts)))
    r = r.withColumn("fate", F.when(F.col("safety") != "ok", "unsafe").when(U.banned(F.col("domain"), list(policy.banned_domains)), "banned"))
    open_ = r.filter("fate is null")
    first = Window.partitionBy("request_id", "norm_url").orderBy(*ORDER)
    open_ = open_.withColumn("fate", F.when(F.row_number().over(first) > 1, "duplicate"))
    if seen is not None:
        old = seen.select("request_id", "norm_url").distinct().withColumn("old", F.lit(True))
        open_ = open_.join(old, ["request_id", "norm_url"], "left").withColumn("fate", F.when(F.col("old"), "duplicate").otherwise(F.col("fate"))).drop("old")
    live = open_.filter("fate is null").withColumn("clean", clean(F.coalesce(F.col("content"), F.lit(""))))
    live = live.withColumn("fate", F.when(F.col("clean") == "", "empty").otherwise("kept"))
    none = F.lit(None).cast("string").alias("clean")
    cols = [c for c in r.columns if c != "clean"]
    return r.filter("fate is not null").select(*cols, none).unionByName(open_.filter("fate is not null").select(*cols, none)).unionByName(live.select(*cols, "clean"))


def pieces(fates: DataFrame, next_doc: int = 1) -> DataFrame:
    """All chunks of the kept results in order, with doc_index (pages with text take the next number, also when they yield no chunk) and nth: the how manieth
    of equal chunks of the request it is."""
    small_batches(fates.sparkSession)
    by = Window.partitionBy("request_id").orderBy(*ORDER)
    start = F.col("next_doc") if "next_doc" in fates.columns else F.lit(next_doc)  # a request that searches again goes on counting
    docs = fates.filter("fate = 'kept'").withColumn("doc_index", (F.row_number().over(by) + start - 1).cast("int"))
    rows = docs.select("request_id", *ORDER, "url", "domain", "title", "doc_index", "content_mode", F.posexplode(T.chunks(F.col("clean"))).alias("chunk_index", "text"))
    equal = Window.partitionBy("request_id", T.content_hash(F.col("text"))).orderBy("doc_index", "chunk_index")
    return rows.withColumn("nth", F.row_number().over(equal))


def by_page(rows: DataFrame) -> DataFrame:
    """request_id, doc_index, its place, chunks, new chunks, and new chunks of the pages before: one row a page for the running sum."""
    per = rows.groupBy("request_id", "doc_index").agg(*[F.first(c).alias(c) for c in ORDER], F.count("*").alias("n"), F.count_if(F.col("nth") == 1).alias("fresh"))
    before = F.sum("fresh").over(Window.partitionBy("request_id").orderBy("doc_index").rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumn("before", F.coalesce(before, F.lit(0)))


def number(rows: DataFrame, pages: DataFrame, policy: Policy) -> DataFrame:
    """Chunks of pieces: request_id, chunk_id, text, source_url, domain, doc_index, chunk_index, retrieval_pos.

    Of equal chunks of a request the first stays, with its own label, so labels may have gaps. Pages are added whole until the number of chunks reaches the cap.
    """
    rows = rows.filter("nth = 1").withColumn("chunk_id", F.concat(F.lit("doc_"), F.col("doc_index").cast("string"), F.lit("_chunk_"), T.chunk_label(F.col("chunk_index"))))
    rows = rows.join(pages.filter(F.col("before") < policy.max_chunks_per_request).select("request_id", "doc_index"), ["request_id", "doc_index"], "left_semi")
    pos = F.row_number().over(Window.partitionBy("request_id").orderBy("doc_index", "chunk_index"))
    return rows.select("request_id", "chunk_id", "text", F.col("url").alias("source_url"), "domain", "title", "doc_index", "chunk_index", "content_mode", pos.alias("retrieval_pos"))


def counters(fates: DataFrame, pages: DataFrame, policy: Policy, failed: DataFrame | None = None) -> DataFrame:
    """The eight counters of a request's retrieval. Results count up to the page at which the number of chunks reaches the cap: later ones are never looked at.

    failed: request_id, query_ord of searches that gave an error; those before the stop count.
    """
    cap = policy.max_chunks_per_request
    stop = pages.filter(F.col("before") + F.col("fresh") >= cap).groupBy("request_id").agg(F.min(F.struct(*ORDER)).alias("stop"))
    seen = fates.select("request_id", *ORDER, "fate", "content_mode").join(stop, "request_id", "left").filter("stop is null or struct(query_ord, result_ord) <= stop")
    n = lambda cond: F.count_if(cond)
    out = seen.groupBy("request_id").agg(
        F.count("*").alias("total_search_results"), n(F.col("fate") == "banned").alias("banned_filtered"), n(F.col("fate") == "unsafe").alias("unsafe_urls_filtered"),
        n(F.col("fate") == "duplicate").alias("duplicate_urls_skipped"), n((F.col("fate") == "kept") & (F.col("content_mode") == "snippet")).alias("snippet_only_docs"),
    )
    chunks = pages.filter(F.col("before") < cap).groupBy("request_id").agg(F.sum(F.col("n") - F.col("fresh")).alias("duplicate_chunks_skipped"), F.sum("fresh").alias("total_chunks"))
    out = out.join(chunks, "request_id", "left")
    if failed is None:
        out = out.withColumn("failed_queries", F.lit(0).cast("long"))
    else:
        bad = failed.select("request_id", "query_ord").join(stop, "request_id", "left").filter("stop is null or query_ord < stop.query_ord").groupBy("request_id").agg(F.count("*").alias("failed_queries"))
        out = out.join(bad, "request_id", "full")
    names = ["total_search_results", "failed_queries", "banned_filtered", "unsafe_urls_filtered", "duplicate_urls_skipped", "duplicate_chunks_skipped", "total_chunks", "snippet_only_docs"]
    return out.select("request_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def counted(results: DataFrame, policy: Policy = Policy(), seen: DataFrame | None = None, next_doc: int = 1, clean=T.strip_fragment, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, counters): pages are cleaned and chunked once for both."""
    fates = classify(results, policy, seen, clean)
    rows = materialise(pieces(fates, next_doc))
    pages = by_page(rows)
    return number(rows, pages, policy), counters(fates, pages, policy, failed)


def retrieve(results: DataFrame, policy: Policy = Policy(), seen: DataFrame | None = None, next_doc: int = 1, clean=T.strip_fragment) -> DataFrame:
    rows = materialise(pieces(classify(results, policy, seen, clean), next_doc))
    return number(rows, by_page(rows), policy)


def isolated(*scans) -> tuple[DataFrame | None, list[str]]:
    """(union of what the backends gave, errors of those that did not answer). scans: functions without arguments that give a frame; each is run here, so
    that a failing one is skipped, not met later in the plan."""
    frames, errors = [], []
    for scan in scans:
        try:
            frames.append(materialise(scan()))
        except Exception as e:  # a backend's failure is data
            errors.append(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    return (union_backends(*frames) if frames else None), errors


def choose_backends(kind: str, web=None, corpus=None) -> list:
    """The scans of a setting: web, corpus or both. `both` without a web search means the corpus alone; what is asked for and missing is an error."""
    if kind not in ("web", "corpus", "both"):
        raise ValueError(f"search backend must be web, corpus or both, not {kind!r}")
    if kind == "web" and web is None:
        raise ValueError("the web backend needs a search function")
    if kind != "web" and corpus is None:
        raise ValueError(f"the {kind} backend needs a corpus and an embedder")
    return [s for s in ((web, corpus) if kind == "both" else (web,) if kind == "web" else (corpus,)) if s is not None]
