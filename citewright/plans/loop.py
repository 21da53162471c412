"""The bounded rewrite loop as a driver loop over lazily built plans: one action a pass, over all requests at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.operators.frames import materialise


def route(max_loops: int = 3, max_retries: int = 1) -> Column:
    """Where a request goes after verification: end, rewrite or retrieve.

    loop_count is counted after each verification, so max_loops passes of verification make one rewrite fewer.
    """
    return (
        F.when(~F.coalesce("is_answerable", F.lit(True)), "end")
        .when(F.coalesce("pending", F.lit(0)) == 0, "end")
        .when(F.coalesce("loop_count", F.lit(0)) < max_loops, "rewrite")
        .when(F.coalesce("retries", F.lit(0)) < max_retries, "retrieve")
        .otherwise("end")
    )


def run(state: DataFrame, one_pass: Callable[[DataFrame], DataFrame], *, max_loops: int = 3, max_retries: int = 1, reset: dict[str, Column] | None = None) -> DataFrame:
    """state: request_id, is_answerable, pending, loop_count, retries and whatever one_pass needs; it returns rows with the same columns.

    Each pass is written to the checkpoint folder, so a pass is worked out once and survives lost executors. Requests that are done leave the loop.
    reset: columns that start anew when a request searches again, and what with, so that nothing stale of its checks is left.
    """
    done = None
    live = state.withColumn("route", F.lit("rewrite"))
    for _ in range(max_loops * (max_retries + 1)):
        after = one_pass(live.drop("route")).withColumn("loop_count", F.col("loop_count") + 1).withColumn("route", route(max_loops, max_retries))
        again = F.col("route") == "retrieve"
        after = after.withColumn("retries", F.when(again, F.col("retries") + 1).otherwise(F.col("retries"))).withColumn("loop_count", F.when(again, F.lit(0)).otherwise(F.col("loop_count")))
        after = materialise(after.withColumns({c: F.when(again, x).otherwise(F.col(c)) for c, x in (reset or {}).items()}))
        ended = after.filter("route = 'end'")
        done = ended if done is None else done.unionByName(ended)
        live = after.filter("route != 'end'")
        if live.isEmpty():
            break
    return done.unionByName(live.withColumn("route", F.lit("end"))) if not live.isEmpty() else done


def exhausted(sentences: DataFrame, state: DataFrame) -> DataFrame:
    """request_id, n: tier-5 sentences of requests that end with rewrites still pending."""
    left = state.filter("route = 'end' and pending > 0").select("request_id")
    return sentences.join(left, "request_id", "left_semi").groupBy("request_id").agg(F.count_if(F.col("tier") == 5).alias("n"))
