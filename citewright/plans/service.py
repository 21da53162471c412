"""A service put together from settings: rate limits, cache, answers, budgets and audit trail over a table of requests."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.config import Policy, Settings
from citewright.operators import usage as U
from citewright.operators.corpus import Store, evict, ring
from citewright.operators.frames import materialise
from citewright.operators.retrieve import choose_backends, isolated
from citewright.operators.snapshots import Snapshots
from citewright.plans.answer import Models, answer

STORED = "key string, response string, expires_at timestamp, used_at timestamp"


def resolve(providers: list[tuple[str, str, Callable[[str], object]]], settings: Settings):
    """The first model client that the settings allow: (name, setting with its key, factory); an empty setting name needs no key. None that fits is an error that names them."""
    for name, setting, make in providers:
        key = getattr(settings, setting) if setting else ""
        if key or not setting:
            return make(key)
    raise ValueError(f"no model provider is set up: {', '.join(n for n, _, _ in providers) or 'none is known'}")


def per_minute(rate: str) -> int:
    """`20/minute` as a number; 0 for no limit."""
    m = re.fullmatch(r"\s*(\d+)\s*/\s*(second|minute|hour)\s*", rate)
    if not m:
        raise ValueError(f"not a rate: {rate!r}")
    n = int(m[1])
    return {"second": n * 60, "minute": n, "hour": -(-n // 60)}[m[2]]


@dataclass
class Service:
    """settings decide; models, web (a scan of searches) and store (an own corpus with its scan) are what there is.

    cache and audit are folders of Parquet files, or none to do without.
    """

    spark: SparkSession
    settings: Settings
    models: Models
    policy: Policy = Policy()
    web: Callable[[DataFrame], DataFrame] | None = None
    corpus: Callable[[DataFrame], DataFrame] | None = None
    store: Store | None = None
    cache: str | None = None
    audit: str | None = None

    def __post_init__(self) -> None:
        self.backends = choose_backends(self.settings.search_backend, self.web, self.corpus)
        self.limit = per_minute(self.settings.rate_limit)

    def search(self, queries: DataFrame) -> DataFrame:
        """The results of all backends, one after the other; one that fails is left out, and if all do, every search is an error."""
        found, errors = isolated(*[lambda b=b: b(queries) for b in self.backends])
        if found is not None:
            place = F.row_number().over(Window.partitionBy("request_id", "query_ord").orderBy("backend_ord", "result_ord")) - 1
            return found.withColumn("result_ord", place.cast("int")).drop("backend_ord")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("result_ord", "int"), ("url", "string"), ("content", "string"), ("title", "string"), ("content_mode", "string"))]
        return queries.select("request_id", "query_ord", *none, F.lit("; ".join(errors)).alias("error"))

    def entries(self) -> DataFrame | None:
        at = self.cache and self._snapshots().current()
        return self.spark.read.parquet(f"{at}/entries") if at else None

    def _snapshots(self) -> Snapshots:
        return Snapshots(self.spark, self.cache, lease_s=600)

    def run(self, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
        """(responses, refused): requests: request_id, tenant, query, ts. refused are those above their tenant's rate; of equal questions of a tenant one is answered.

        responses: request_id, cached, body (JSON without request id and usage). Answers that succeeded at least in part are kept for cache_ttl_s, the cache_size used last.
        """
        by = Window.partitionBy("tenant", F.window("ts", "1 minute")).orderBy("ts", "request_id")
        placed = requests.withColumn("nth", F.row_number().over(by)) if self.limit else requests.withColumn("nth", F.lit(0))
        key = U.cache_key(F.col("tenant"), F.struct("query"))
        taken = materialise(placed.filter(F.col("nth") <= (self.limit or 0)).drop("nth").withColumn("key", key))
        refused = placed.filter(F.col("nth") > (self.limit or 0)).select("request_id", "tenant")
        known = self.entries()
        hits = None
        missing = taken
        if known is not None:
            hits, missing = U.probe(taken, known, now)
        asked = missing.groupBy("key").agg(F.min_by("request_id", F.struct("ts", "request_id")).alias("request_id"), F.first("query").alias("query"))
        responses, citations, counters = answer(asked.select("request_id", "query"), self.search, self.models, self.policy)
        responses = materialise(responses)
        keyed = responses.join(asked.select("request_id", "key"), "request_id")
        body = F.to_json(F.struct(*[c for c in responses.columns if c not in ("request_id", "usage")]))
        made = keyed.select("key", F.col("request_id").alias("asked_as"), body.alias("body"))
        out = missing.join(made, "key").select("request_id", (F.col("request_id") != F.col("asked_as")).alias("cached"), "body")
        if hits is not None:
            out = out.unionByName(hits.select("request_id", F.lit(True).alias("cached"), F.col("response").alias("body")))
        out = materialise(out)
        if self.cache:
            fresh = materialise(U.cacheable(keyed, self.settings.cache_ttl_s, now).withColumn("used_at", now))
            # merged with what is there now, which another run may have added to since this one looked
            with self._snapshots().writer(wait_s=60) as (at, to):
                if at:
                    there = self.spark.read.parquet(f"{at}/entries").filter(F.col("expires_at") > now).join(fresh.select("key"), "key", "left_anti")
                    if hits is not None:
                        used = hits.select("key").distinct().withColumn("hit", F.lit(True))
                        there = there.join(used, "key", "left").withColumn("used_at", F.when(F.col("hit"), F.greatest(now, "used_at")).otherwise(F.col("used_at"))).drop("hit")
                    fresh = fresh.unionByName(there)
                evict(fresh, self.settings.cache_size).write.parquet(f"{to}/entries")
        if self.audit and self.settings.audit_retention:
            U.keep_events(U.audit_trail(counters, citations, responses, now), self.audit)
        return out, refused

    def trails(self) -> DataFrame:
        """The events of the audit_retention requests that ended last."""
        events = self.spark.read.parquet(self.audit)
        last = ring(events.groupBy("request_id").agg(F.max("timestamp_utc").alias("t")), self.settings.audit_retention, [F.desc("t"), F.asc("request_id")])
        return events.join(last.select("request_id"), "request_id", "left_semi")

    def status(self) -> list[tuple[str, str]]:
        """What is set, without secrets, and how large the corpus is."""
        now = self.store.tables() if self.store else None
        return U.describe(self.settings, *now) if now else U.describe(self.settings)
