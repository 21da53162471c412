"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.operators.frames import ranked_within


def fuse_request(chunks: DataFrame, k: int = 60) -> DataFrame:
    """Ranked chunks with ranking_score, dense_score and pos (the order they came in) -> fused_score and fused_rank.

    Either arm breaks ties by pos, the fused order by chunk id. Requests with one chunk, or one without a dense score, keep their order.
    """
    by = Window.partitionBy("request_id")
    a = F.row_number().over(by.orderBy(F.desc("ranking_score"), "pos"))
    b = F.row_number().over(by.orderBy(F.desc("dense_score"), "pos"))
    ready = (F.count("*").over(by) >= 2) & (F.count("dense_score").over(by) == F.count("*").over(by))
    out = chunks.withColumn("ra", a).withColumn("rb", b).withColumn("ready", ready)
    out = out.withColumn("fused_score", F.when(F.col("ready"), F.round(F.lit(1.0) / (k + F.col("ra")) + F.lit(1.0) / (k + F.col("rb")), 6)))
    order = F.row_number().over(by.orderBy(F.desc("fused_score"), F.when(F.col("ready"), F.lit(0)).otherwise(F.col("ra")), "chunk_id"))
    return out.withColumn("fused_rank", order).withColumn("ranking_mode", F.when(F.col("ready"), "hybrid").otherwise("bm25")).drop("ra", "rb", "ready")


def fuse_rankings(a: DataFrame, b: DataFrame, by: str, key: str, k: int = 60) -> DataFrame:
    """Two rankings by, key, rank -> by, key, fused_score, rank. A row that only one ranking has counts there."""
    rows = a.select(by, key, "rank").unionByName(b.select(by, key, "rank"))
    fused = rows.groupBy(by, key).agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("fused_score"))
    return ranked_within(fused, by, F.desc("fused_score"), key)  # no ranking is one task
