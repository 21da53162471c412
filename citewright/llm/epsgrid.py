"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length one, where cosine >= c is distance <= sqrt(2 - 2c) = eps. They are turned onto their principal
axes (covariances are summed over all rows, one small matrix comes to the driver) and sorted by label and by the grid cells, eps wide, of the
leading axes. Runs of SEGMENT vectors of that sequence are the units of work. Two segments can only meet if their boxes on the leading axes
lie within eps of each other on every axis; candidates are found by an equi-join on label and the cells of the first two axes.
Inside a pair of segments the intervals are halved and joined recursively, skipping those whose boxes are farther apart than eps; what is left is compared
by a matrix product in double precision.

Equal vectors of one label, told by 128 bits of hash, are joined once, with their number. A segment travels once for each segment whose box lies within eps; segments are large,
so that these are few, and the recursion finds what inside them is close. A pair of segments gives counts of links and a spanning forest of them,
never all pairs; the forests meet in distributed connected components. Vectors of different length or of different or null labels never link, nor do
null, zero, or non-finite ones (they are components of their own). Repeated rows are vectors of their own; rows that share a vec_id
give one row each with equal results. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.llm.common import cut, small_batches
from citewright.llm.components import components, roots

AXES, SEGMENT, LEAF = 6, 8192, 128


def usable(v) -> F.Column:
    """Not null, no null or non-finite component, not zero."""
    d = v.cast("array<double>")
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(d, lambda x: x != 0)


def identity(v: F.Column) -> tuple[F.Column, F.Column]:
    """128 bits that tell vectors apart: two hashes that run over the components from different seeds."""
    return F.xxhash64(v), F.xxhash64(F.lit(7), v)


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The principal axes (columns, leading first) of the unit vectors of each length."""

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, x in by_length(b.column(0)):
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                m = np.c_[np.ones(len(x)), x]
                sums[dim] = sums.get(dim, 0) + m.T @ m
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, dim), pa.int32()), pa.array(np.arange(s.size), pa.int32()), pa.array(s.ravel())], names=["dim", "at", "x"])

    rows = vectors.select("v").mapInArrow(moments, "dim int, at int, x double").groupBy("dim", "at").agg(F.sum("x").alias("x")).collect()
    out = {}
    for dim in {r["dim"] for r in rows}:
        s = np.zeros((dim + 1) ** 2)
        for r in rows:
            if r["dim"] == dim:
                s[r["at"]] = r["x"]
        s = s.reshape(dim + 1, dim + 1)
        mean = s[0, 1:] / s[0, 0]
        val, vec = np.linalg.eigh(s[1:, 1:] / s[0, 0] - np.outer(mean, mean))
        out[dim] = np.ascontiguousarray(vec[:, ::-1])
    return out


def by_length(column: pa.Array):
    """(length, matrix of the vectors of that length), in no order; one matrix if all have one length, as they came."""
    n = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    at = np.r_[0, np.cumsum(n)]
    for dim in np.unique(n):
        rows = np.flatnonzero(n == dim)
        yield int(dim), flat[(at[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)


def forest(i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the links i-j among `size` nodes: (node, smallest node of its component)."""
    label = roots(i, j, size)
    moved = np.flatnonzero(label != np.arange(size))
    return moved, label[moved]


def join_intervals(pa_: np.ndarray, pb: np.ndarray, eps: float):
    """Recursively pair the intervals of two sequences of projections; yields (a begin, a end, b begin, b end) of those that may hold links."""

    def corners(p, lo, hi):
        return p[lo:hi].min(0), p[lo:hi].max(0)

    stack = [(0, len(pa_), 0, len(pb))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        la, ha = corners(pa_, a0, a1)
        lb, hb = corners(pb, b0, b1)
        gap = np.maximum(0, np.maximum(la - hb, lb - ha))
        if gap @ gap > eps * eps:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            yield a0, a1, b0, b1
            continue
        if a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            stack += [(a0, m, b0, b1), (m, a1, b0, b1)]
        else:
            m = (b0 + b1) // 2
            stack += [(a0, a1, b0, m), (a0, a1, m, b1)]


def near_duplicates(df: DataFrame, cosine: float = 0.98, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id and kept of every row."""
    spark = df.sparkSession
    small_batches(spark, rows=10_000)
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("lab"), F.col(vector).alias("v"))
    single = np.float32 if rows.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    good = rows.filter(F.col("lab").isNotNull() & F.col("id").isNotNull()).filter(usable(F.col("v")))
    good = good.withColumns(dict(zip("hg", identity(F.col("v")))))  # only one copy of equal vectors travels
    groups = cut(good.groupBy("lab", "h", "g").agg(F.min("id").alias("id"), F.count("*").alias("many"), F.first("v").alias("v")))
    turn = axes(groups)
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9)
    kind = df.schema[label].dataType.simpleString()

    def project(batches):
        for b in batches:
            n = np.diff(np.asarray(b.column(1).offsets))
            cells = np.zeros((len(n), AXES), dtype=np.int32)
            for dim, x in by_length(b.column(1)):
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                p = x @ turn[dim][:, : min(AXES, dim)]
                cells[n == dim, : p.shape[1]] = np.floor(p / eps)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32()), *[pa.array(cells[:, k]) for k in range(AXES)]], names=["lab", "v", "id", "many", "dim", *[f"c{k}" for k in range(AXES)]])

    cells = [f"c{k}" for k in range(AXES)]
    placed = groups.select("lab", "v", "id", "many").mapInArrow(project, f"lab {kind}, v {rows.schema['v'].dataType.simpleString()}, id long, many long, dim int, " + ", ".join(f"{c} int" for c in cells))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "lab", "dim", *cells, "id").sortWithinPartitions("lab", "dim", *cells, "id")

    def segments(batches):
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        held, group, lab_type = [], None, None

        def emit():
            nonlocal count, held
            lab, dim = group
            x = np.array([h[1] for h in held], dtype=np.float64)
            p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn[dim][:, : min(AXES, dim)]
            p = np.pad(p, ((0, 0), (0, AXES - p.shape[1])))
            seg = part << 32 | count
            count += 1
            ids, many = np.array([h[0] for h in held], dtype=np.int64), np.array([h[2] for h in held], dtype=np.int64)
            held = []
            cols = [pa.array([seg], pa.int64()), pa.array([lab], lab_type), pa.array([dim], pa.int32()), pa.array([p.min(0).tolist()], pa.list_(pa.float64())), pa.array([p.max(0).tolist()], pa.list_(pa.float64())), pa.array([ids.tobytes()]), pa.array([many.tobytes()]), pa.array([x.astype(single).tobytes()])]
            return pa.RecordBatch.from_arrays(cols, names=["seg", "lab", "dim", "lo", "hi", "ids", "many", "x"])

        for b in batches:
            lab_type = b.column(0).type
            for lab, dim, i, m, v in zip(*(c.to_pylist() for c in b.columns)):
                if (lab, dim) != group or len(held) == SEGMENT:
                    if held:
                        yield emit()
                    group = (lab, dim)
                held.append((i, v, m))
        if held:
            yield emit()

    packed = ordered.select("lab", "dim", "id", "many", "v").mapInArrow(segments, f"seg long, lab {kind}, dim int, lo array<double>, hi array<double>, ids binary, many binary, x binary")
    packed = cut(packed)
    # candidates: boxes within eps on each axis; met through the cells of the first two axes, of which a unit vector has at most (2 / eps + 2) ** 2
    meta = packed.select("seg", "lab", "dim", "lo", "hi")
    cell = lambda side, axis: F.floor(F.col(side)[axis] / eps).cast("long")
    left = meta.withColumn("a", F.explode(F.sequence(cell("lo", 0), cell("hi", 0)))).withColumn("b", F.explode(F.sequence(cell("lo", 1), cell("hi", 1))))
    right = meta.withColumn("a", F.explode(F.sequence(cell("lo", 0) - 1, cell("hi", 0) + 1))).withColumn("b", F.explode(F.sequence(cell("lo", 1) - 1, cell("hi", 1) + 1)))
    near = F.forall(F.sequence(F.lit(0), F.lit(AXES - 1)), lambda k: (F.col("l.lo")[k] <= F.col("r.hi")[k] + eps) & (F.col("r.lo")[k] <= F.col("l.hi")[k] + eps))
    same = (F.col("l.lab") == F.col("r.lab")) & (F.col("l.dim") == F.col("r.dim")) & (F.col("l.a") == F.col("r.a")) & (F.col("l.b") == F.col("r.b"))
    pairs = left.alias("l").join(right.alias("r"), same & (F.col("l.seg") <= F.col("r.seg")) & near).select(F.col("l.seg").alias("s"), F.col("r.seg").alias("t")).distinct()
    side = lambda n, k: packed.select(F.col("seg").alias(n), *[F.col(c).alias(f"{c}{k}") for c in ("dim", "ids", "many", "x")])
    work = pairs.join(side("s", 1), "s").join(side("t", 2).drop("dim2"), "t").select((F.col("s") == F.col("t")).alias("own"), "dim1", "ids1", "many1", "x1", "ids2", "many2", "x2")

    def link(batches):
        for b in batches:
            for own, dim, i1, m1, x1, i2, m2, x2 in zip(*(c.to_pylist() for c in b.columns)):
                ids, many, unit, proj = [], [], [], []
                for i, m, x in ((i1, m1, x1), (i2, m2, x2)):
                    ids.append(np.frombuffer(i, dtype=np.int64))
                    many.append(np.frombuffer(m, dtype=np.int64))
                    v = np.frombuffer(x, dtype=single).astype(np.float64).reshape(-1, dim)
                    unit.append(v / np.linalg.norm(v, axis=1, keepdims=True))
                    proj.append(unit[-1] @ turn[dim][:, : min(AXES, dim)])
                gi, gj = [], []
                for a0, a1, b0, b1 in join_intervals(*proj, eps):
                    if own and a0 > b0:
                        continue
                    i, j = np.nonzero(unit[0][a0:a1] @ unit[1][b0:b1].T >= cosine)
                    if own and a0 == b0:
                        keep = i < j
                        i, j = i[keep], j[keep]
                    gi.append(i + a0)
                    gj.append(j + b0)
                i = np.concatenate(gi) if gi else np.zeros(0, dtype=np.int64)
                j = np.concatenate(gj) if gj else i
                if not len(i):
                    continue
                n = len(ids[0])
                nodes = ids[0] if own else np.r_[ids[0], ids[1]]
                counts = np.bincount(i, many[1][j], minlength=len(nodes))
                shift = 0 if own else n
                counts = counts + np.bincount(j + shift, many[0][i], minlength=len(nodes))
                node, root = forest(i, j + shift, len(nodes))
                touched = np.flatnonzero(counts)
                out = [np.r_[nodes[touched], nodes[node]], np.r_[counts[touched].astype(np.int64), np.zeros(len(node), dtype=np.int64)]]
                to = pa.array([None] * len(touched) + nodes[root].tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), to], names=["id", "n", "to"])

    found = cut(work.mapInArrow(link, "id long, n long, to long"))
    comp = components(found.filter("to is not null").select(F.col("id").alias("src"), F.col("to").alias("dst")))
    counts = found.filter("to is null").groupBy("id").agg(F.sum("n").alias("n"))
    reps = groups.join(counts, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    reps = reps.select("lab", "h", "g", "many", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("component"))
    linked = good.drop("v").join(reps, ["lab", "h", "g"]).select("id", (F.col("n") + F.col("many") - 1).alias("n_links"), F.col("component").alias("component_id"))
    bad = rows.filter(~(F.col("lab").isNotNull() & F.col("id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(bad).select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))

