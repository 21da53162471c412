"""Exact nearest neighbours from stored vectors, without the distances that the triangle inequality rules out.

The greatest inner products with a query are the least Euclidean distances, once every vector gets one more coordinate that brings it to the norm of the longest one. So that a few long vectors
do not drown all others, those whose norms have one nearest power of two make a group of their own. A group's pivots are chosen from a bounded sample, each as far as possible from those before it; a vector
belongs to the cell of its nearest pivot and keeps its distance r to it. Rows are
stored in order of (cell, r), and of each cell the number of rows and the least and greatest r.

A search scores the cells whose pivots are the best answers to a query, until they hold k rows; the k-th score found bounds all distances. A cell is read only if some query may have a neighbour there:
d(q, p) - greatest r, least r - d(q, p) and half of d(q, p) less the distance to the nearest pivot are all lower bounds. In a cell only rows whose r differs from d(q, p) by no
more than the bound are scored. What is left is scored in full and ranked, so the result is exact, ties included.

Null vectors are left out; vectors of another length than the query's are no neighbours; an empty table gives an index that finds nothing. Ids may repeat: each row is a neighbour of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.operators.dense import QUERIES
from citewright.operators.frames import materialise, numbered

PIVOTS, SAMPLE, SLACK = 64, 4000, 1e-7


def farthest(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of x, each the farthest from those before it."""
    chosen, gap = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, values and starts of a batch of vectors."""
    dims = np.diff(np.asarray(column.offsets))
    return dims, np.asarray(column.flatten(), dtype=np.float64), np.r_[0, np.cumsum(dims)]


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(0.0, longest**2 - (x * x).sum(axis=1)))]


def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def bands(norm: np.ndarray) -> np.ndarray:
    """The nearest power of two of each norm (unit vectors are one band, whatever rounding does to them); -2000 for 0."""
    return np.where(norm > 0, np.round(np.log2(np.where(norm > 0, norm, 1.0))), -2000).astype(np.int64)


def build(corpus: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> VectorIndex:
    """Write the index of the corpus under path (a folder that does not exist yet). `pivots` is written last: with it the index is whole."""
    spark = corpus.sparkSession
    kind = corpus.schema[key].dataType.simpleString()
    rows = corpus.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))

    def measure(batches):
        for b in batches:
            dims, flat, ends = rows_of(b.column(1))
            norm = np.sqrt(np.add.reduceat(np.r_[flat * flat, 0.0], ends[:-1]) * (dims > 0)) if len(dims) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims.astype(np.int32)), pa.array(bands(norm).astype(np.int32)), pa.array(norm)], names=["k", "v", "dim", "band", "norm"])

    measured = rows.mapInArrow(measure, f"k {kind}, v array<double>, dim int, band int, norm double")
    about = {(r["dim"], r["band"]): r["m"] for r in measured.groupBy("dim", "band").agg(F.max("norm").alias("m")).collect()}  # a row for each length of vectors and power of two
    first = Window.partitionBy("dim", "band").orderBy(F.xxhash64("v"))
    sample: dict[tuple[int, int], list] = {}
    for r in measured.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= SAMPLE).select("dim", "band", "v").collect():
        sample.setdefault((r["dim"], r["band"]), []).append(r["v"])
    chosen = {g: farthest(lifted(np.array(vs, dtype=np.float64).reshape(-1, g[0]), about[g]), pivots) for g, vs in sample.items()}
    start = dict(zip(chosen, np.r_[0, np.cumsum([len(p) for p in chosen.values()])].astype(int).tolist()))
    shared = spark.sparkContext.broadcast((chosen, about, start))  # pivots of each group

    def place(batches):
        chosen, about, start = shared.value
        for b in batches:
            _, flat, ends = rows_of(b.column(1))
            dims, band = b.column(2).to_numpy(), b.column(3).to_numpy()
            cell, r = np.zeros(len(dims), dtype=np.int64), np.zeros(len(dims))
            for (d, w), p in chosen.items():
                mine = np.flatnonzero((dims == d) & (band == w))
                if len(mine):
                    gap = between(lifted(flat[(ends[mine][:, None] + np.arange(d)).ravel()].reshape(len(mine), d), about[d, w]), p)
                    cell[mine], r[mine] = start[d, w] + gap.argmin(axis=1), gap.min(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(r)], names=["k", "v", "cell", "r"])

    placed = measured.mapInArrow(place, f"k {kind}, v array<double>, cell long, r double")
    placed.repartitionByRange("cell", "r", "k").sortWithinPartitions("cell", "r", "k").write.parquet(f"{path}/vectors")
    spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).coalesce(1).write.parquet(f"{path}/cells")
    listed = [(d, w, start[d, w] + i, float(about[d, w]), [float(c) for c in p]) for (d, w), ps in chosen.items() for i, p in enumerate(ps)]
    spark.createDataFrame(listed, "dim int, band int, cell long, longest double, p array<double>").coalesce(1).write.parquet(f"{path}/pivots")
    return VectorIndex(spark, path)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.groups: dict[tuple[int, int], tuple[list[int], list]] = {}
        self.longest: dict[tuple[int, int], float] = {}
        for r in spark.read.parquet(f"{path}/pivots").orderBy("cell").collect():  # PIVOTS rows for each group
            ids, ps = self.groups.setdefault((r["dim"], r["band"]), ([], []))
            self.longest[r["dim"], r["band"]] = r["longest"]
            ids.append(r["cell"])
            ps.append(r["p"])
        self.cells = {r["cell"]: (r["n"], r["lo"], r["hi"]) for r in spark.read.parquet(f"{path}/cells").collect()}

    def _scan(self, wanted: dict[int, list[tuple[int, np.ndarray, float, float]]], k: int) -> DataFrame:
        """cell -> (number of query, its vector, its distance to the pivot, its bound) of those that look there: q, k, score of what may be among a query's k best, and rows with how many distances were worked out (n)."""
        vectors = self.spark.read.parquet(f"{self.path}/vectors").filter(F.col("cell").isin(sorted(wanted))).select("k", "v", "cell", "r")
        kind = vectors.schema["k"].dataType.simpleString()
        packed = {c: (np.array([a[0] for a in asked]), np.array([a[1] for a in asked], dtype=np.float64), np.array([a[2] for a in asked]), np.array([a[3] for a in asked])) for c, asked in wanted.items()}
        shared = self.spark.sparkContext.broadcast(packed)  # a block of queries, each once for each cell it looks into

        def run(batches):
            best: dict[int, np.ndarray] = {}
            worked: dict[int, int] = {}
            for b in batches:
                cells, r = b.column(2).to_numpy(), b.column(3).to_numpy()
                _, flat, ends = rows_of(b.column(1))
                for c in np.unique(cells).tolist():
                    ids, y, gap, bound = shared.value[c]
                    mine = np.flatnonzero(cells == c)
                    near = np.abs(gap[:, None] - r[mine][None, :]) <= bound[:, None]
                    asks, rows = np.flatnonzero(near.any(axis=1)), near.any(axis=0)
                    if not len(asks):
                        continue
                    mine, near = mine[rows], near[np.ix_(asks, rows)]
                    d = y.shape[1]
                    score = y[asks] @ flat[(ends[mine][:, None] + np.arange(d)).ravel()].reshape(len(mine), d).T
                    got = []
                    for i, q in enumerate(ids[asks].tolist()):
                        worked[q] = worked.get(q, 0) + int(near[i].sum())
                        s = np.where(near[i], score[i], -np.inf)
                        top = np.concatenate([best.get(q, np.full(k, -np.inf)), s])
                        best[q] = top = np.partition(top, -k)[-k:]
                        at = np.flatnonzero((s >= top.min() - 1e-9) & near[i])  # ties with the last stay: keys break them later
                        got.append((np.full(len(at), q), mine[at], s[at]))
                    q, at, s = (np.concatenate(x) for x in zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), b.column(0).take(pa.array(at)), pa.array(s), pa.nulls(len(q), pa.int64())], names=["q", "k", "score", "n"])
            if worked:
                yield pa.RecordBatch.from_arrays([pa.array(list(worked), pa.int64()), pa.nulls(len(worked), b.column(0).type), pa.nulls(len(worked), pa.float64()), pa.array(list(worked.values()), pa.int64())], names=["q", "k", "score", "n"])

        return vectors.mapInArrow(run, f"q long, k {kind}, score double, n long")

    def _ranked(self, near: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 12)), "k")
        return near.filter("n is null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int, key: str = "vec_id", qkey: str = "query_id", qvector: str = "query_embedding") -> tuple[DataFrame, DataFrame]:
        """(qkey, key, score, rank of the k vectors with the greatest inner product; qkey, rows, worked: vectors of the query's length, and to how many of them a distance was worked out).

        Queries go in blocks of at most QUERIES; each makes two passes over the cells that it needs. Null queries have no neighbours.
        """
        if k <= 0:
            raise ValueError("k must be 1 or more")
        asked = numbered(queries.filter(F.col(qvector).isNotNull()).select(F.col(qkey).alias("id"), F.col(qvector).cast("array<double>").alias("v")), F.xxhash64("id"), name="q")
        total, found = asked.count(), None
        for low in range(0, max(1, total), QUERIES):
            block = asked.filter(F.col("q").between(low + 1, low + QUERIES)).select("q", "v").collect()
            views = []
            for r in block:
                y, near = np.array(r["v"], dtype=np.float64), []
                for g, (ids, ps) in self.groups.items():
                    if g[0] != len(y):
                        continue
                    gaps = between(np.r_[y, 0.0][None, :], np.array(ps))[0]
                    near += [(-float(a), c, float(d), g, float(gaps.min())) for a, c, d in zip(np.array(ps)[:, :-1] @ y, ids, gaps) if c in self.cells]
                views.append((r["q"], y, sorted(near)))
            first: dict[int, list] = {}
            seen: dict[int, set] = {}
            for q, y, near in views:
                held, seen[q] = 0, set()
                for _, c, gap, _, _ in near:
                    first.setdefault(c, []).append((q, y, gap, np.inf))
                    seen[q].add(c)
                    held += self.cells[c][0]
                    if held >= k:
                        break
            seeds = materialise(self._scan(first, k))
            last = {r["q"]: r["score"] for r in self._ranked(seeds, k).filter(F.col("rank") == k).select("q", "score").collect()}  # one row for each query of the block
            then: dict[int, list] = {}
            for q, y, near in views:
                for _, c, gap, g, least in near:
                    bound = np.inf
                    if q in last:
                        scale = self.longest[g] ** 2 + float(y @ y)
                        # rounding may hide a difference of squares of about 1e-16 of their size, less than SLACK allows for
                        bound = float(np.sqrt(max(0.0, scale - 2 * last[q]) + SLACK**2 * scale)) + SLACK * float(np.sqrt(scale))
                    _, lo, hi = self.cells[c]
                    if c not in seen[q] and max(gap - hi, lo - gap, (gap - least) / 2) <= bound:
                        then.setdefault(c, []).append((q, y, gap, bound))
            near = seeds.unionByName(self._scan(then, k)) if then else seeds
            found = near if found is None else found.unionByName(near)
        best = self._ranked(found, k).join(asked.select("q", "id"), "q").select(F.col("id").alias(qkey), F.col("k").alias(key), "score", "rank")
        sizes: dict[int, int] = {}
        for (d, _), (ids, _) in self.groups.items():
            sizes[d] = sizes.get(d, 0) + sum(self.cells[c][0] for c in ids if c in self.cells)
        held = F.coalesce(*[F.when(F.size("v") == d, F.lit(n)) for d, n in sizes.items()], F.lit(0)).cast("long")
        counts = asked.join(found.groupBy("q").agg(F.sum("n").alias("worked")), "q", "left").select(F.col("id").alias(qkey), held.alias("rows"), F.coalesce("worked", F.lit(0)).alias("worked"))
        return best, counts
