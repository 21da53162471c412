"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Event time in UTC with a watermark; local timestamps are taken as UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def rate_limit(events: DataFrame, per_minute: int, key: str) -> DataFrame:
    """Fixed one-minute windows for each key, and how many events were over the limit."""
    g = events.groupBy(F.window("ts", "1 minute").alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("window_start"), "n", F.greatest(F.col("n") - per_minute, F.lit(0)).alias("n_limited"))


def sliding_rates(events: DataFrame, by: str) -> DataFrame:
    g = events.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), by, "n", (F.col("n") / 300.0).alias("per_second"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    g = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_urls(results: DataFrame, key: list[str]) -> DataFrame:
    """The first of equal URLs within the watermark."""
    return results.dropDuplicatesWithinWatermark(key)


def ttl_cache(events: DataFrame, ttl_s: int, key: str) -> DataFrame:
    """key, ts, hit: look-ups of a cache whose hits do not renew the expiry. State is one time for each key, dropped when it has expired."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.get[0] if state.exists else None
        rows = pd.concat(list(frames))["ts"].sort_values()
        out = []
        for t in rows:
            now = t.value // 1000
            hit = stored is not None and now - stored < ttl_s * 1_000_000
            if not hit:
                stored = now
            out.append((k[0], t, hit))
        state.update((stored,))
        expiry = stored // 1000 + ttl_s * 1000
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "ts", "hit"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, ts timestamp, hit boolean", "stored long", "append", GroupStateTimeout.EventTimeTimeout)


def keep_last(path: str, keep: int, key: str | None = None):
    """A foreachBatch function for a bounded audit ring under path: the newest `keep` rows of the whole stream (with a key, of each key's newest row).

    Each epoch writes a snapshot of at most `keep` rows beside the one before; a repeated epoch replaces its own. last_kept() reads the newest.
    """
    from citewright.operators.corpus import ring

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = last_kept(spark, path, epoch)
        rows = batch if before is None else before.unionByName(batch)
        ring(rows, keep, [F.desc("ts")], key).write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")
        fs, root = _fs(spark, path)
        for old in sorted(s.getPath().getName() for s in fs.listStatus(root))[:-2]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, old), True)

    return write


def _fs(spark, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def last_kept(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The rows that keep_last() kept last (of an epoch below `before`)."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return None
    done = sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    done = [n for n in done if before is None or int(n.split("=")[1]) < before]
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None


def progress_writer(sink: Callable[[DataFrame, int], None]):
    """A foreachBatch function that hands the frames of a batch of answers on, those of a request in order."""

    def write(batch: DataFrame, epoch: int) -> None:
        sink(sse(progress_events(batch)).orderBy("request_id", "event_id"), epoch)

    return write


def run_until(query, cancelled: Callable[[], bool], every_s: float = 1.0) -> bool:
    """Wait for a streaming query, and stop it as soon as cancelled() says so, as when the reader of its frames has gone. Returns whether it was stopped."""
    while not query.awaitTermination(every_s):
        if cancelled():
            query.stop()
            return True
    return False


def progress_events(answers: DataFrame) -> DataFrame:
    """Ordered progress frames of answered requests: accepted, stages, loops, sentences, complete or error. answers: request_id, stages, sentences, status, and if requests
    may loop, loops (array of what each further pass was: rewrite or retrieve)."""
    loops = F.col("loops") if "loops" in answers.columns else F.array().cast("array<string>")
    frames = F.concat(
        F.array(F.struct(F.lit("accepted").alias("type"), F.to_json(F.struct("request_id")).alias("data"))),
        F.transform("stages", lambda s: F.struct(F.lit("stage").alias("type"), F.to_json(F.struct(s.alias("stage"))).alias("data"))),
        F.transform(F.coalesce(loops, F.array().cast("array<string>")), lambda s, i: F.struct(F.lit("loop").alias("type"), F.to_json(F.struct((i + 1).alias("loop"), s.alias("kind"))).alias("data"))),
        F.transform("sentences", lambda s: F.struct(F.lit("sentence").alias("type"), F.to_json(F.struct(s.alias("sentence"))).alias("data"))),
        F.array(F.struct(F.when(F.col("status") == "error", "error").otherwise("complete").alias("type"), F.to_json(F.struct("status")).alias("data"))),
    )
    return answers.select("request_id", F.posexplode(frames).alias("event_id", "f")).select("request_id", "event_id", "f.type", "f.data")


def sse(events: DataFrame) -> DataFrame:
    """Progress events as text frames of an event stream."""
    return events.select("request_id", "event_id", F.concat(F.lit("event: "), "type", F.lit("\ndata: "), "data", F.lit("\n\n")).alias("frame"))
