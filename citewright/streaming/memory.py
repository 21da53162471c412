"""What a stream remembers of each request: one keyed state for the cache of its answer and for the URLs it has met.

The state of a key is the time of its cache entry and a map from URL to the time it was first met; neither is renewed by later look-ups, and both end `ttl_s` after that time, in event
time. Timers drop what has ended once the watermark has passed it, so a key that falls silent leaves nothing behind. State and timers live in RocksDB, checkpointed
with the stream, so a restart goes on where the last micro-batch ended, and a request that is tried again in a later batch still knows its URLs.

batch_memory gives the same rows of a finished table. Rows later than the watermark allows are dropped by the stream; others are taken up batch by batch, in order of time inside one.
Null keys are a key; rows without a time are dropped; a null URL is never met (fresh is null).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from citewright.operators.corpus import cache_state

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Remember(StatefulProcessor):
    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "t long")
        self.urls = handle.getMapState("urls", "url string", "t long")

    def _keep(self, t: int) -> int:
        """An entry of time t ends at t + ttl; the first whole millisecond from then on rings."""
        self.handle.registerTimer(-(-(t + self.ttl) // 1000))
        return t

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values(["t", "url"], na_position="last", kind="stable")
        stored = self.entry.get()[0] if self.entry.exists() else None
        met: dict[str, int] = {}  # what this batch changes or has looked up
        hits, fresh = [], []
        for t, url in zip(held["t"].tolist(), held["url"].tolist()):
            hit = stored is not None and t - stored < self.ttl
            if not hit:
                stored = self._keep(t)
                self.entry.update((t,))
            hits.append(hit)
            if url is None:
                fresh.append(None)
                continue
            if url not in met and self.urls.containsKey((url,)):
                met[url] = self.urls.getValue((url,))[0]
            new = url not in met or t - met[url] >= self.ttl
            if new:
                met[url] = self._keep(t)
                self.urls.updateValue((url,), (t,))
            fresh.append(new)
        yield pd.DataFrame({"key": held["key"], "t": held["t"], "url": held["url"], "hit": hits, "fresh": pd.array(fresh, dtype="boolean")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.entry.exists() and self.entry.get()[0] + self.ttl <= now:
            self.entry.clear()
        for url, t in list(self.urls.iterator()):
            if t[0] + self.ttl <= now:
                self.urls.removeKey(url)
        return iter([])

    def close(self) -> None:
        pass


def prepared(spark: SparkSession) -> None:
    """Streams with timers and maps need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def stream_memory(events: DataFrame, ttl_s: int, key: str, url: str = "url", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """key, ts, url, hit (the key's cache entry serves this look-up), fresh (the URL is new to the key) of a stream of look-ups, in append mode."""
    prepared(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    at = F.col(ts).cast("timestamp")
    rows = events.filter(at.isNotNull()).select(F.col(key).alias("key"), at.alias("ts"), F.unix_micros(at).alias("t"), F.col(url).alias("url")).withWatermark("ts", delay)
    made = rows.groupBy("key").transformWithStateInPandas(Remember(ttl_s), f"key {kind}, t long, url string, hit boolean, fresh boolean", "Append", "EventTime")
    return made.select(F.col("key").alias(key), F.timestamp_micros("t").alias("ts"), "url", "hit", "fresh")


def batch_memory(events: DataFrame, ttl_s: int, key: str, url: str = "url", ts: str = "ts") -> DataFrame:
    """The same rows of a whole table: the cache of each key, and of each URL of a key, read in order of time."""
    at = F.col(ts).cast("timestamp")
    rows = events.filter(at.isNotNull()).select(F.col(key).alias("key"), at.alias("ts"), F.col(url).alias("url"))
    # look-ups of one key at one time differ only in what they find first: the least URL
    of_key = cache_state(rows.select("key", "ts"), ttl_s, "key").groupBy("key", "ts").agg(F.count_if(~F.col("hit")).alias("misses"))
    of_url = cache_state(rows.filter("url is not null").select(F.struct("key", "url").alias("ku"), "ts"), ttl_s, "ku").select("ku.key", "ku.url", "ts", (~F.col("hit")).alias("fresh"))
    all_rows = of_url.unionByName(rows.filter("url is null").select("key", "url", "ts", F.lit(None).cast("boolean").alias("fresh")))
    nth = F.row_number().over(Window.partitionBy("key", "ts").orderBy(F.col("url").asc_nulls_last(), F.col("fresh").desc()))
    placed = all_rows.withColumn("nth", nth).join(of_key.select(F.col("key").alias("k"), F.col("ts").alias("s"), "misses"), F.col("key").eqNullSafe(F.col("k")) & (F.col("ts") == F.col("s")))
    return placed.select(F.col("key").alias(key), "ts", "url", (F.col("nth") > F.col("misses")).alias("hit"), "fresh")
