"""Connected components of a table of links by alternating star contraction.

A round turns every node's larger neighbours, then its smaller ones, into links to the smallest node that it sees; of the order of log n
rounds do. Each is cut into the shared folder. Minima are combined before the shuffle, and the joins are
plain equi-joins that adaptive execution can split, so a node with very many links is no single task's work. Once at most BASE links are
left, one task solves them in memory (16 bytes a link). No links, components or nodes come to the driver: only a count and a checksum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.llm.common import cut

BASE = 500_000


def roots(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Of nodes 0 .. size - 1: the smallest node that the links i-j reach."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def solve(batches):
    """Links u, v of one partition: u, v again, v now being the smallest node that u reaches."""
    held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = roots(at[: len(u)], at[len(u) :], len(nodes))
    moved = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["u", "v"])


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link. Loops and nulls in links are ignored."""
    e = links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u is not null and v is not null and u != v").distinct()
    e = cut(e)
    seen, left = None, e.count()
    while left > BASE:
        # large star: neighbours above a node go to the smallest of the node and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: neighbours below a node, and the node itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == (now["n"], now["s"]):
            break
        seen, left = (now["n"], now["s"]), now["n"]
    else:
        e = cut(e.coalesce(1).mapInArrow(solve, "u long, v long"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
