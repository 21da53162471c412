"""Embedding whitening from upper-triangle column aggregates.

Entries become whole numbers x = floor(SCALE * c). The fit list holds each distinct x-vector once, so copies do not weigh on the model. Over it one aggregation
gives n and each dimension's sum, and another one the sums of centred products of every pair of dimensions, as generated SQL expressions; both combine on the map side, so a
few numbers for each task are all that moves. The driver assembles the covariance (dimensions squared, whatever the number of rows), lets LAPACK decompose it, and writes the
projections into the plan as expressions again. A last aggregation measures how far the whitened fit list's covariance is from the identity.

Products are centred at the whole number nearest to the mean, which keeps them whole: their sums and the covariance's numerator are exact, then
rounded once. Only if n times the largest product may pass 2 ** 63 (checked first) are they centred at the mean and summed as doubles.

Defined cases: a vector that is null or empty, or holds a null or non-finite entry, is dropped, as is one of another length than most have (of equally frequent ones, the greatest); a row without
id is kept; repeated rows each get their rows, but count once in the fit; an eigenvalue within rounding of 0 gives whitened 0 and stays out of identity_error;
with fewer dimensions than components there are as many components; equal eigenvalues may take any basis of their space; extra columns never enter; an empty table, or one without a whole
vector, gives an empty result. An x beyond a long becomes the nearest long. A deviation beyond a long is null.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.llm.common import cut

SCALE, COMPONENTS = 256, 4


def total(terms: list[str]) -> str:
    """Terms added up as a tree of little depth."""
    while len(terms) > 1:
        terms = [f"({' + '.join(terms[i : i + 8])})" for i in range(0, len(terms), 8)]
    return terms[0]


def quantised(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """The id and x of each row with a whole vector, and the number of dimensions."""
    c = F.col("v")
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    whole = rows.filter(F.size(c) > 0).filter(~F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    usual = whole.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual["d"] if usual else 0
    return whole.filter(F.size(c) == d).select("id", F.transform(c, lambda e: F.floor(e * F.lit(float(SCALE))).cast("long")).alias("x")), d


def covariance(fit: DataFrame, d: int) -> tuple[int, list[int], int, np.ndarray]:
    """Of the fit list (columns x0, x1, ...): n, the sums of each dimension, the largest distance from a mean rounded up, and the covariance with divisor n."""
    first = fit.agg(F.count("*").alias("n"), *[f(f"x{i}").alias(f"{name}{i}") for i in range(d) for name, f in (("lo", F.min), ("hi", F.max))], *[F.sum(F.col(f"x{i}").cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)]).first()
    n = first["n"]
    if not n:
        return 0, [], 0, np.zeros((0, 0))
    sums = [int(first[f"s{i}"]) for i in range(d)]
    centre = [round(Fraction(s, n)) for s in sums]
    width = max(max(first[f"hi{i}"] - c, c - first[f"lo{i}"]) for i, c in enumerate(centre))
    exact = n * width * width < 1 << 62
    # no x is null, and sums of what cannot be null take half the time
    shifted = fit.selectExpr(*[f"coalesce(x{i} - {f'{c}L, 0L' if exact else f'{float(Fraction(s, n))!r}D, 0D'}) AS y{i}" for i, (c, s) in enumerate(zip(centre, sums))])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    got = shifted.selectExpr(*[f"sum(y{i} * y{j}) AS p{i}_{j}" for i, j in pairs]).first()
    out = np.zeros((d, d))
    rest = [s - n * c if exact else 0 for s, c in zip(sums, centre)]  # what centring at whole numbers leaves
    for (i, j), p in zip(pairs, got):
        out[i, j] = out[j, i] = float(Fraction(n * p - rest[i] * rest[j], n * n)) if exact else p / n
    return n, sums, width + 1, out


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit eigenvectors as rows, each with its largest entry positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors.T[::-1]
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return values, vectors * sign[:, None]


def whitened_sql(sums: list[int], n: int, vector: np.ndarray, e: float, x) -> str:
    """x less the mean, projected and scaled. x(i): the expression of dimension i."""
    if not e > 0:
        return "0.0D"
    return f"{total([f'({x(i)} - {float(Fraction(s, n))!r}D) * {float(w)!r}D' for i, (s, w) in enumerate(zip(sums, vector))])} / {float(np.sqrt(e))!r}D"


def deviation_sql(sums: list[int], n: int, width: int) -> str:
    """The sum of (n * x - S) ** 2 over the dimensions of x as a long; null if it is none. As decimals where longs may not hold it."""
    if len(sums) * (n * width) ** 2 < 1 << 63:
        return total([f"({n}L * get(x, {i}) - {s}L) * ({n}L * get(x, {i}) - {s}L)" for i, s in enumerate(sums)])
    apart = [f"try_subtract(try_multiply(CAST({n} AS DECIMAL(18,0)), CAST(get(x, {i}) AS DECIMAL(19,0))), CAST('{s}' AS DECIMAL(38,0)))" for i, s in enumerate(sums)]
    out = f"CAST(try_multiply({apart[0]}, {apart[0]}) AS DECIMAL(38,0))"
    for t in apart[1:]:
        out = f"CAST(try_add({out}, CAST(try_multiply({t}, {t}) AS DECIMAL(38,0))) AS DECIMAL(38,0))"
    return f"try_cast({out} AS BIGINT)"


def whiten(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """For each row and component up to k: key, component, n, deviation, whitened, explained, identity_error."""
    rows, d = quantised(df, key, vector)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = df.sparkSession.createDataFrame([], schema)
    if not d:
        return empty
    fit = cut(rows.select("x").distinct()).select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(d)])
    n, sums, width, v = covariance(fit, d)
    if not n:
        return empty
    values, vectors = components(v)
    k = min(k, d)
    trace = float(np.trace(v))
    floor = max(values[0], 0.0) * d * np.finfo(float).eps
    e = [float(x) if x > floor else 0.0 for x in values[:k]]
    white = fit.selectExpr(*[f"{whitened_sql(sums, n, vectors[c], e[c], lambda i: f'x{i}')} AS w{c}" for c in range(k)])
    error = identity_error(white, e)

    at = lambda i: f"get(x, {i})"
    each = [f"{c + 1}, {whitened_sql(sums, n, vectors[c], e[c], at)}, {e[c] / trace if trace > 0 else 0.0!r}D" for c in range(k)]
    # stack, as Spark would compute an exploded array twice, once to see that it is not empty
    out = rows.selectExpr("id", f"{deviation_sql(sums, n, width)} AS deviation", f"stack({k}, {', '.join(each)}) AS (component, whitened, explained)")
    return out.select(F.col("id").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


def identity_error(white: DataFrame, e: list[float]) -> float:
    """The largest absolute entry of the covariance, centred before multiplying, of w0, w1, ... minus the identity; components of eigenvalue 0 stay out."""
    live = [c for c, value in enumerate(e) if value > 0]
    if not live:
        return 0.0
    means = white.agg(*[F.avg(f"w{c}") for c in live]).first()
    centred = white.select(*[(F.col(f"w{c}") - F.lit(m)).alias(f"w{c}") for c, m in zip(live, means)])
    pairs = [(a, b) for i, a in enumerate(live) for b in live[i:]]
    got = centred.agg(*[F.avg(F.col(f"w{a}") * F.col(f"w{b}")) for a, b in pairs]).first()
    return max(abs(g - (a == b)) for (a, b), g in zip(pairs, got))
