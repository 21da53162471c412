"""Search results as a Spark data source, and the ways to put backends together."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from citewright.functions.urls import chunk_url
from citewright.operators.dense import embed, knn

SCHEMA = "query string, query_ord int, result_ord int, url string, title string, content string, content_mode string, error string"
BACKENDS: dict[str, Callable[[str], list[dict]]] = {}


def with_retry(search: Callable[[str], list[dict]], query: str, attempts: int = 3, base_s: float = 1.0, cap_s: float = 4.0) -> list[dict]:
    """Exponential back-off between attempts; the last error is raised."""
    for i in range(attempts):
        try:
            return search(query)
        except Exception:
            if i + 1 == attempts:
                raise
            time.sleep(min(cap_s, base_s * 2**i))
    return []


class _Query(InputPartition):
    def __init__(self, query: str, ord_: int):
        super().__init__((query, ord_))


class SearchReader(DataSourceReader):
    def __init__(self, queries: list[str], search: Callable[[str], list[dict]], base_s: float):
        self.queries, self.search, self.base_s = queries, search, base_s

    def partitions(self):
        return [_Query(q, i) for i, q in enumerate(self.queries)]

    def read(self, partition):
        query, ord_ = partition.value
        try:
            results = with_retry(self.search, query, base_s=self.base_s)
        except Exception as e:  # one failing query is a row, not a failed scan
            yield (query, ord_, 0, None, None, None, None, f"{type(e).__name__}: {e}")
            return
        for i, r in enumerate(results):
            yield (query, ord_, i, r.get("url"), r.get("title"), r.get("content", ""), r.get("content_mode", "unknown"), None)


class SearchSource(DataSource):
    """format("citewright_search"): option queries (a JSON list), results (a JSON list for every query) or fail."""

    @classmethod
    def name(cls):
        return "citewright_search"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        results = json.loads(self.options.get("results", "[]"))
        fail = set(json.loads(self.options.get("fail", "[]")))

        def search(q: str) -> list[dict]:
            if q in fail:
                raise ConnectionError("backend does not answer")
            return results

        return SearchReader(json.loads(self.options["queries"]), search, float(self.options.get("backoff_s", "1.0")))


def mock_results(spark: SparkSession, queries: list[str], results: list[dict], **options: str) -> DataFrame:
    spark.dataSource.register(SearchSource)
    reader = spark.read.format("citewright_search").option("queries", json.dumps(queries)).option("results", json.dumps(results))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def all_failed(results: DataFrame) -> DataFrame:
    """request-level check: true where every query of it failed."""
    return results.groupBy("request_id").agg(F.every(F.col("error").isNotNull()).alias("all_failed"))


def corpus_results(chunks: DataFrame, queries: DataFrame, k: int = 5, embedder=None, prefix: str = "") -> DataFrame:
    """The k best corpus chunks of each query (request_id, query_ord, query) as search results. Blank queries find nothing."""
    q = embed(queries.filter(F.trim(F.coalesce("query", F.lit(""))) != ""), "query", "query_embedding", embedder, prefix).withColumn("query_id", F.struct("request_id", "query_ord"))
    hits = knn(chunks, q.select("query_id", "query_embedding"), k, key="chunk_id").join(chunks.select("chunk_id", "doc_id", "chunk_index", "text"), "chunk_id")
    return hits.select("query_id.request_id", "query_id.query_ord", F.col("rank").alias("result_ord"), chunk_url(F.col("doc_id").cast("string"), F.col("chunk_index")).alias("url"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"), F.lit("raw").alias("content_mode"))


def web_results(queries: DataFrame, fetch: Callable[[str, int], list[dict]], *, max_results: int = 5, full_pages: bool = True, cap: int = 200_000, attempts: int = 3, pool: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Results of a web search behind a function: fetch(query, max_results) gives rows with url, title, content (a snippet) and raw_content (the page, may be blank).

    Queries (request_id, query_ord, query) are asked on the executors, `pool` at a time in each task. A search that fails is tried again after 1, 2, 4 seconds; if it fails for
    good it is one row with its error, and others go on. A page is taken where it is wanted and not blank, its first `cap` characters, else the snippet.
    """
    kind = queries.schema["request_id"].dataType.simpleString()

    def one(query: str) -> tuple[list[dict], str | None]:
        for n in range(attempts):
            try:
                return fetch(query, max_results)[:max_results], None
            except Exception as e:  # becomes a row
                if n == attempts - 1:
                    return [], f"{type(e).__name__}: {e}"
                sleep(min(4.0, 2.0**n))
        return [], None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(pool) as ex:
            for f in frames:
                rows = []
                for (request, order), (found, error) in zip(f[["request_id", "query_ord"]].itertuples(index=False), ex.map(one, f["query"])):
                    if error:
                        rows.append((request, order, None, None, None, None, None, error))
                    for i, r in enumerate(found):
                        page = (r.get("raw_content") or "").strip() if full_pages else ""
                        rows.append((request, order, i, r.get("url") or "", page[:cap] or r.get("content") or "", r.get("title") or "", "raw" if page else "snippet", None))
                yield pd.DataFrame(rows, columns=["request_id", "query_ord", "result_ord", "url", "content", "title", "content_mode", "error"])

    return queries.select("request_id", "query_ord", "query").mapInPandas(run, f"request_id {kind}, query_ord int, result_ord int, url string, content string, title string, content_mode string, error string")
