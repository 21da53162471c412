"""Retrieval metrics, classification metrics and regression gates."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.operators.frames import materialise, numbered


def ir_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20), depth: int = 10, qkey: str = "query_id", key: str = "doc_id") -> DataFrame:
    """One row for each query of qrels: recall at each k, nDCG at depth (binary), reciprocal rank. run: qkey, key, rank."""
    rel = qrels.select(qkey, key).distinct()
    n = rel.groupBy(qkey).agg(F.count("*").alias("n_relevant"))
    hits = run.join(rel, [qkey, key], "left_semi")
    gain = F.when(F.col("rank") <= depth, 1.0 / F.log2(F.col("rank") + 1.0))
    g = hits.groupBy(qkey).agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks], F.sum(gain).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(depth)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    out = n.join(g, qkey, "left")
    return out.select(qkey, "n_relevant", *[(F.coalesce(f"h{k}", F.lit(0)) / F.col("n_relevant")).alias(f"recall_{k}") for k in ks], (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def summary(metrics: DataFrame, qkey: str = "query_id") -> DataFrame:
    """Means over queries, four digits."""
    cols = [c for c in metrics.columns if c not in (qkey, "n_relevant")]
    return metrics.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in cols])


def collapse(run: DataFrame, chunk_to_doc: Column, depth: int = 200, qkey: str = "query_id") -> DataFrame:
    """Ranked chunks to ranked documents: each at its best chunk's place."""
    d = run.filter(F.col("rank") <= depth).groupBy(qkey, chunk_to_doc.alias("doc")).agg(F.min("rank").alias("best"))
    return d.select(qkey, "doc", F.row_number().over(Window.partitionBy(qkey).orderBy("best", "doc")).alias("rank"))


def confusion(rows: DataFrame, truth: Column, got: Column, error: Column) -> DataFrame:
    """Counts, precision, recall, F1, accuracy and error rate; erroneous rows count for the rate alone."""
    ok = ~error
    g = rows.agg(F.count("*").alias("n"), F.count_if(error).alias("errors"), F.count_if(ok & truth & got).alias("tp"), F.count_if(ok & ~truth & got).alias("fp"), F.count_if(ok & truth & ~got).alias("fn"), F.count_if(ok & ~truth & ~got).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = div(tp, tp + fp), div(tp, tp + fn)
    return g.select("n", "errors", "tp", "fp", "fn", "tn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(div(2 * p * r, p + r), 4).alias("f1"), F.round(div(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"), F.round(div(F.col("errors"), F.col("n")), 4).alias("error_rate"))


def gate(observed: DataFrame, baseline: DataFrame) -> DataFrame:
    """baseline: metric, floor, ceiling, tolerance (exactly one bound); observed: metric, value. A bound whose metric was not measured fails."""
    b = baseline.withColumn("tolerance", F.coalesce("tolerance", F.lit(0.0)))
    bad = (F.col("floor").isNull() == F.col("ceiling").isNull()) | (F.col("tolerance") < 0)
    b = b.withColumn("direction", F.when(bad, F.raise_error(F.concat(F.lit("metric "), F.col("metric"), F.lit(" needs exactly one bound and a tolerance of 0 or more")))).when(F.col("floor").isNotNull(), "floor").otherwise("ceiling"))
    bound = F.when(F.col("direction") == "floor", F.col("floor") - F.col("tolerance")).otherwise(F.col("ceiling") + F.col("tolerance"))
    out = b.join(observed, "metric", "left").withColumn("bound", bound)
    passed = F.coalesce(F.when(F.col("direction") == "floor", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound")), F.lit(False))
    return out.select("metric", "direction", "bound", F.col("value").alias("observed"), passed.alias("passed"))


def gate_verdict(checks: DataFrame, enforce: bool = True) -> DataFrame:
    return checks.agg(F.every("passed").alias("metrics_ok"), F.count("*").alias("n")).select("metrics_ok", (F.col("metrics_ok") | F.lit(not enforce)).alias("ok"), "n")


def sample(queries: DataFrame, key: str, limit: int, seed: int = 13) -> DataFrame:
    """A fixed sample for quick looks (0: all)."""
    return queries if limit <= 0 else queries.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(limit)


#: Queries that a seeded shuffle takes; the shuffle itself, of that many numbers, is the driver's.
SHUFFLED = 1_000_000


def shuffled(queries: DataFrame, *order, limit: int = 0, seed: int = 13) -> DataFrame:
    """queries with `pos`, their place (from 0) in the list that Python's generator of this seed makes of them when it shuffles them in the given order; the first `limit` of it (0: all).

    The same seed gives the same sample as an evaluation that shuffles a list. A shuffle depends on the number of rows alone, so only places are drawn, and rows are joined to them.
    """
    placed = materialise(numbered(queries, *order, name="_n"))
    n = placed.count()
    if n > SHUFFLED:
        raise ValueError(f"a seeded shuffle takes at most {SHUFFLED} queries; use sample for more")
    places = list(range(n))
    random.Random(seed).shuffle(places)
    drawn = [(p + 1, i) for i, p in enumerate(places[:limit] if limit > 0 else places)]
    return placed.join(queries.sparkSession.createDataFrame(drawn, "_n long, pos long"), "_n").drop("_n")


def expectations(cases: DataFrame) -> DataFrame:
    """cases: id, expected fields and observed ones -> id, failures (empty: passed). A null expectation is none."""
    checks = F.array_compact(
        F.array(
            F.when(F.col("exp_answerable") != F.col("answerable"), F.lit("answerable")),
            F.when(~F.array_contains("exp_status_in", F.col("status")), F.lit("status")),
            F.when(F.col("tier5") > F.col("exp_max_tier5"), F.lit("tier5")),
            F.when(F.col("tier1") > F.col("exp_max_tier1"), F.lit("tier1")),
            F.when(F.col("overall_score") < F.col("exp_min_score"), F.lit("overall_score")),
        )
    )
    return cases.select("id", checks.alias("failures"), (F.size(checks) == 0).alias("passed"))


# ---- data sets of files ------------------------------------------------------------------------------------------------


def load_beir(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus: doc_id, text; queries with a relevant text: query_id, query; qrels)."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{root}/corpus.jsonl").select(F.col("_id").alias("doc_id"), F.concat_ws(". ", F.nullif("title", F.lit("")), "text").alias("text"))
    qrels = spark.read.schema("`query-id` string, `corpus-id` string, score int").csv(f"{root}/qrels/{split}.tsv", sep="\t", header=True).filter("score > 0").select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"))
    queries = spark.read.schema("_id string, text string").json(f"{root}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("query")).join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    return corpus, queries, qrels


def load_claims(spark: SparkSession, root: str, split: str = "dev", paraphrases: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of a claims data set: corpus.jsonl and claims_<split>.jsonl; only claims with evidence. The last paraphrase of a claim replaces it."""
    corpus = spark.read.schema("doc_id long, title string, abstract array<string>").json(f"{root}/corpus.jsonl").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.col("title"), F.lit(". "), F.array_join("abstract", " ")).alias("text"))
    kind = "id long, claim string, evidence map<string, array<struct<sentences: array<int>, label: string>>>"
    claims = spark.read.schema(kind).json(f"{root}/claims_{split}.jsonl").filter("size(evidence) > 0")
    queries = claims.select(F.col("id").cast("string").alias("query_id"), F.col("claim").alias("query"))
    if paraphrases:
        p = spark.read.schema("claim_id string, paraphrase string").json(paraphrases).withColumn("line", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))  # files and their blocks in order, rows as they stand in them
        queries = queries.drop("query").join(p.groupBy(F.col("claim_id").alias("query_id")).agg(F.max_by("paraphrase", "line").alias("query")), "query_id")
    return corpus, queries, claims.select(F.col("id").cast("string").alias("query_id"), F.explode(F.map_keys("evidence")).alias("doc_id"))


def load_triples(spark: SparkSession, root: str, split: str = "dev") -> DataFrame:
    """Labelled (claim, quote, text) triples: the first evidence set of each claim and text, whose sentence numbers exist."""
    corpus = spark.read.schema("doc_id long, title string, abstract array<string>").json(f"{root}/corpus.jsonl").select(F.col("doc_id").cast("string").alias("doc_id"), "abstract")
    kind = "id long, claim string, evidence map<string, array<struct<sentences: array<int>, label: string>>>"
    e = spark.read.schema(kind).json(f"{root}/claims_{split}.jsonl").select("id", "claim", F.explode("evidence").alias("doc_id", "sets")).filter("size(sets) > 0").select("id", "claim", "doc_id", F.col("sets")[0].alias("e")).join(corpus, "doc_id")
    inside = F.filter("e.sentences", lambda i: (i >= 0) & (i < F.size("abstract")))
    quote = F.array_join(F.transform(inside, lambda i: F.get("abstract", i)), " ")
    return e.select(F.concat_ws(":", "id", "doc_id").alias("example_id"), "claim", quote.alias("quote"), F.array_join("abstract", " ").alias("chunk"), F.col("e.label").alias("label")).filter("quote != ''")


GOLDEN = (
    "id string, comment string, query string, search_results array<struct<url: string, content: string, title: string, content_mode: string>>, app_config struct<banned_domains: array<string>, authoritative_domains: array<string>, low_quality_domains: array<string>, expertise_level: string>, "
    "pipeline_config struct<stages: struct<max_rewrite_loops: int, max_retrieval_retries: int, max_ranked_chunks: int, semantic_verification: boolean>>, expect struct<answerable: boolean, status_in: array<string>, max_tier5: int, max_tier1: int, min_overall_score: double>, broken string"
)


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases; one without id, query, search results or expectations is an error that names what it lacks, not a case less. Blank lines are skipped."""
    rows = spark.read.schema(GOLDEN).option("columnNameOfCorruptRecord", "broken").json(path)
    lacks = F.when(F.col("broken").isNotNull(), F.lit("is no JSON object"))
    for name in ("id", "query", "search_results", "expect"):
        lacks = F.coalesce(lacks, F.when(F.col(name).isNull(), F.lit(f"lacks {name}")))
    fine = F.when(lacks.isNotNull(), F.raise_error(F.concat(F.lit("golden case "), F.coalesce("id", F.lit("?")), F.lit(" "), lacks)).cast("string")).otherwise(F.col("id"))
    return rows.withColumn("id", fine).drop("broken")
