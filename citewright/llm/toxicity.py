"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The unit is a token of a sentence: a whitespace token as written, the same without what is not a letter or digit, and runs of
single characters put together. Its kernel features are its subsequences of three characters, boundaries included, with at most
GAP characters skipped inside, weighted DECAY ** span; so an insult with gaps or inserted characters shares most of
its features with the plain one. Landmarks are learned tokens; the Nyström map is k(x, landmarks) K^-1/2, the machine is linear in it. As
k(x, l) is a product of feature vectors, the sum over landmarks folds into one weight for each feature: scoring a token is
a few look-ups, whatever the number of landmarks, with the same value.

A labelled sentence (multiple-instance learning: labels mark whole texts) has the decision values of its tokens; its TOP largest ones, each of another token, are put
together by two logistic layers that are trained on the labelled texts themselves, one over the largest value alone and one over all of them; the higher result counts. So
one plain insult is enough, and several words that are each doubtful are, too. Tokens
that carry the label are found by a greedy cover of the toxic texts, so that hundreds of copies of one toxic text do not make its harmless words
insults. In GROW passes they are joined by words that the machine finds close to them and that toxic texts have far more often than clean ones: the other forms of
a stem. Clean tokens that score high are added as negatives in ROUNDS passes.

Training uses a sample of labelled rows: SAMPLE_TOXIC and SAMPLE_CLEAN rows in expectation, picked by a hash of the id, and of its tokens those that stand in three
texts or more and have 64 characters or fewer, the VOCABULARY most frequent ones at most. Scoring reads all tokens of whole texts, long tokens in overlapping windows.
Features are hashed from code points, so all scripts are told apart alike.

Defined cases: null or empty text, or no token: the score of a text whose tokens all lie where no feature is known; very long texts are read whole; extra columns
never enter, whatever their names; labels that are null or not 0/1
teach nothing; a document labelled twice is toxic if any label is 1; repeated rows give repeated results; without labels of both
kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.llm.common import crc_bucket, small_batches

SAMPLE_TOXIC, SAMPLE_CLEAN, VOCABULARY = 4000, 8000, 150_000
GAP, DECAY, LANDMARKS, ROUNDS, NEAR, DOUBTFUL, CACHE = 3, 0.6, 384, 8, -0.6, 0.3, 250_000
WINDOW, STRIDE, FEW = 24, 2, 4
#: Largest decision values of a text that count, passes that add forms of a stem, and hashed features.
TOP, GROW, FEATURES = 3, 3, 1 << 19
NOISE = re.compile(r"[\W_]+")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SPACED = re.compile(r"(?<!\S)(?:\w[^\w\s]*\s+){2,}\w(?!\w)")
STEPS = [(a, b) for a in range(1, GAP + 2) for b in range(1, GAP + 2) if a + b - 2 <= GAP]


def forms(raw: str) -> list[str]:
    """What a whitespace token may stand for."""
    if raw.isalpha():
        return [raw]
    bare = EDGE.sub("", raw)
    if not bare:
        return []
    squeezed = NOISE.sub("", bare)
    return [bare] if squeezed == bare else [bare, squeezed]


def tokens(text: str) -> set[str]:
    low = text.lower()
    out = set(low.split())
    got = {t for t in out if t.isalpha()}
    for t in out - got:
        got.update(forms(t))
    for run in SPACED.findall(low):
        got.add(NOISE.sub("", run))
    return got


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words in one array, each between boundaries, and the word of each place; long words in overlapping windows.

    What is shorter than WINDOW, as all trained forms are, stands whole in some window.
    """
    text, owner = [], []
    for i, w in enumerate(words):
        if len(w) <= WINDOW:
            text.append(f"\0{w}\0")
            owner.append(i)
        else:
            for at in range(0, len(w) - WINDOW + STRIDE, STRIDE):
                text.append(f"\0{w[at : at + WINDOW]}\0")
                owner.append(i)
    cp = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    part = np.repeat(np.arange(len(text)), [len(t) for t in text])
    return cp, part, np.array(owner, dtype=np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each part of a word: (part, feature, weight) as flat arrays, and the word of each part. Weights have unit length for each part."""
    cp, part, owner = codes(words)
    first, second, third = (cp * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
    ps, fs, vs = [], [], []
    for a, b in STEPS:
        n = len(cp) - a - b
        if n <= 0:
            continue
        ok = part[:n] == part[a + b :]
        at = np.flatnonzero(ok)
        ps.append(part[at])
        h = first[at] ^ (second[at + a] << np.uint32(7) | second[at + a] >> np.uint32(25)) ^ (third[at + a + b] << np.uint32(15) | third[at + a + b] >> np.uint32(17))
        fs.append(((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(13)).astype(np.int64) % FEATURES)
        vs.append(np.full(len(at), DECAY ** (a + b + 1)))
    p, f, v = np.concatenate(ps), np.concatenate(fs), np.concatenate(vs)
    norm = np.sqrt(np.bincount(p, v * v, minlength=len(owner)))
    return p, f, v / np.maximum(norm[p], 1e-12), owner


class ToxicModel:
    """weights: one for each feature; bias; and the logistic layers over the largest decision values of a text."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.layers: list[np.ndarray] = [np.array([1.0, 0.0])]  # weights and a constant

    def margins(self, words: list[str]) -> np.ndarray:
        """Decision value of each word; of a long word the largest of its windows."""
        if not words:
            return np.zeros(0)
        out = np.full(len(words), -np.inf)
        for at in range(0, len(words), 20_000):
            p, f, v, owner = features(words[at : at + 20_000])
            m = np.bincount(p, v * self.weights[f], minlength=len(owner)) + self.bias
            np.maximum.at(out, owner + at, m)
        return out

    def score(self, top: np.ndarray) -> np.ndarray:
        """top: one row of TOP decision values, largest first, for each text."""
        z = np.max([top[:, : len(w) - 1] @ w[:-1] + w[-1] for w in self.layers], axis=0)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def nystrom(landmarks: list[str]) -> np.ndarray:
    """Landmark features as a dense matrix over the features that they have."""
    p, f, v, owner = features(landmarks)
    used, col = np.unique(f, return_inverse=True)
    m = np.zeros((len(owner), len(used)))
    np.add.at(m, (p, col), v)
    return m, used


def altered(words: list[str]) -> list[str]:
    """Each word with one character inserted, at every place inside: what disguised insults look like."""
    return [w[:i] + c + w[i:] for w in words for i in range(1, len(w)) for c in "x*"]


def fit(positive: list[str], negative: list[str], forms_: list[str] = ()) -> ToxicModel:
    """Squared-hinge machine in the Nyström space of landmarks taken from both sides, by Newton steps.

    Altered forms of the positive words are examples too, but no landmarks. forms_: words that are insults less surely; they need to reach DOUBTFUL only.
    """
    half = LANDMARKS // 2
    marks = [w[:WINDOW] for w in (positive + list(forms_))[:half] + negative[:half]]
    positive = positive + altered([w[: WINDOW - 1] for w in positive])
    goal = np.r_[np.ones(len(positive)), np.full(len(forms_), DOUBTFUL), np.ones(len(negative))]
    positive += forms_
    m, used = nystrom(marks)
    k = m @ m.T
    val, vec = np.linalg.eigh(k)
    root = vec @ np.diag(np.where(val > 1e-6, 1 / np.sqrt(np.maximum(val, 1e-6)), 0)) @ vec.T
    both = [w[:WINDOW] for w in positive + negative]
    col = np.full(FEATURES, -1)
    col[used] = np.arange(len(used))
    p, f, v, owner = features(both)
    keep = col[f] >= 0
    x = np.zeros((len(both), len(marks)))
    for at in range(0, len(marks), 32):  # k(x, landmark), a few landmarks at a time
        for j in range(at, min(at + 32, len(marks))):
            x[:, j] = np.bincount(p[keep], v[keep] * m[j][col[f[keep]]], minlength=len(both))
    phi = np.c_[x @ root, np.ones(len(both))]
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    c = np.where(y > 0, max(1.0, (len(negative) / max(1, len(positive))) ** 0.5), 1.0)
    u, reg = np.zeros(phi.shape[1]), np.r_[np.full(phi.shape[1] - 1, 0.05), 1e-4]
    for _ in range(50):
        active = y * (phi @ u) < goal
        a = phi[active] * c[active, None]
        new = np.linalg.solve(phi[active].T @ a + np.diag(reg), a.T @ (y * goal)[active])
        if np.allclose(new, u, atol=1e-8):
            break
        u = 0.5 * (u + new) if _ > 25 else new
    beta = root @ u[:-1]
    weights = np.zeros(FEATURES, dtype=np.float32)
    weights[used] = beta @ m
    return ToxicModel(weights, float(u[-1]))


def cover(docs: list[list[str]], clean: dict[str, int], least: int) -> list[str]:
    """Words that account for the toxic texts.

    First greedily: the word in most unexplained texts, as long as it explains `least` of them. Then those that share their texts with
    other insults: a word joins if it stands in `least` texts that hold at most FEW suspects besides the words chosen so far, which
    tells it from the words of a text that was copied many times.
    """
    everywhere: dict[str, set[int]] = defaultdict(set)
    for i, ws in enumerate(docs):
        for w in ws:
            everywhere[w].add(i)
    where = {w: set(v) for w, v in everywhere.items()}
    out = []
    while where:
        w = max(where, key=lambda x: (len(where[x]), -clean.get(x, 0), x))
        hit = where.pop(w)
        if len(hit) < least:
            break
        out.append(w)
        for x in list({x for i in hit for x in docs[i]} & where.keys()):
            where[x] -= hit
            if len(where[x]) < least:
                del where[x]
    chosen, fresh = set(out), True
    while fresh:
        alone: dict[str, int] = defaultdict(int)
        for ws in docs:
            rest = [w for w in ws if w not in chosen]
            if len(rest) <= FEW:
                for w in rest:
                    alone[w] += 1
        fresh = sorted(w for w, n in alone.items() if n >= least and clean.get(w, 0) <= len(everywhere[w]) / 20)
        out += fresh
        chosen.update(fresh)
    return out


def logistic(top: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights (none below 0) and constant of the layer, by Newton steps with smoothed targets."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    t = np.where(toxic > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.c_[top, np.ones(len(top))], np.r_[1.0, np.zeros(top.shape[1])]
    free = np.ones(len(w), dtype=bool)
    while True:
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(w))
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(h[np.ix_(free, free)], (x.T @ (p - t) + 1e-2 * w)[free])
            w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        below = np.flatnonzero((w[:-1] < 0) & free[:-1])
        if not len(below):
            w[0] = max(w[0], 1e-3)
            return w
        free[below[0]], w[below[0]] = False, 0.0


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicModel | None:
    """docs: the rows to learn from; labels: key and label."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    marked = marked.filter(crc_bucket("k", 4) != 2)
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    draw = F.pmod(F.xxhash64("k", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("y") == 1, min(1.0, SAMPLE_TOXIC / sizes[1])).otherwise(min(1.0, SAMPLE_CLEAN / sizes[0]))
    picked = F.broadcast(marked.filter(draw < rate))  # SAMPLE_TOXIC + SAMPLE_CLEAN ids in expectation, whatever the size of the table
    sample = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(picked, "k").select("k", "y", "t")

    def count(batches):
        for b in batches:
            got: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for w in tokens(t):
                    got[w][y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array([v[0] for v in got.values()], pa.int64()), pa.array([v[1] for v in got.values()], pa.int64())], names=["w", "c", "x"])

    df = sample.mapInArrow(count, "w string, c long, x long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("x").alias("x"))
    vocabulary = [(r["w"], r["c"], r["x"]) for r in df.filter("c + x >= 3 and length(w) <= 64").orderBy(F.desc(F.col("c") + F.col("x")), "w").limit(VOCABULARY).collect()]
    n1, n0 = min(sizes[1], SAMPLE_TOXIC), min(sizes[0], SAMPLE_CLEAN)
    # far more frequent in toxic texts: the rate there is at least ten times that in clean ones, and 4 texts or more have the word
    suspects = {w for w, c, x in vocabulary if x >= 4 and (x / n1) >= 10 * (c / n0)}
    if not suspects:
        return None
    chosen = spark.sparkContext.broadcast(suspects)

    def evidence(batches):
        for b in batches:
            rows = [(y, sorted(tokens(t) & chosen.value)) for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()) if y == 1]
            rows = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["ws"])

    # many suspects together are a text and its copies, which count once
    sets = sample.mapInArrow(evidence, "ws array<string>").groupBy("ws").agg(F.count("*").alias("n")).collect()
    texts = [r["ws"] for r in sets for _ in range(r["n"] if len(r["ws"]) <= FEW else 1)]
    # so many texts that chance gives no word of the vocabulary as many, all toxic
    least = max(4, math.ceil(0.7 * math.log(1000 * len(vocabulary)) / math.log((n1 + n0) / n1)))
    positive = cover(texts, {w: c for w, c, _ in vocabulary}, least)
    if not positive:
        return None
    pool = [(w, c) for w, c, x in vocabulary if w not in suspects and c > 0]
    pool.sort(key=lambda r: (-r[1], r[0]))
    common = [w for w, _ in pool]
    spread = common[:: max(1, len(common) // 3000)]
    negative = list(dict.fromkeys(common[:1000] + spread))

    stems: list[str] = []

    def settle(negative: list[str]) -> tuple[ToxicModel, list[str]]:
        """The machine, with the clean tokens added that it takes for insults."""
        model = fit(positive, negative, stems)
        for _ in range(ROUNDS):
            m = model.margins(common)
            known = set(negative)
            fresh = [common[i] for i in np.argsort(-m, kind="stable")[:400] if m[i] > -0.5 and common[i] not in known]
            if not fresh:
                break
            negative = fresh + negative  # also the first landmarks
            model = fit(positive, negative, stems)
        return model, negative

    model, negative = settle(negative)
    words = [w for w, _, _ in vocabulary]
    often = {w: (x + 1) / (n1 + 1) / ((c + 1) / (n0 + 1)) for w, c, x in vocabulary if x >= 3}
    for _ in range(GROW):
        m = model.margins(words)
        taken = {*positive, *stems}
        fresh = [w for w, v in zip(words, m) if v > NEAR and w not in taken and often.get(w, 0) >= 8]
        if not fresh:
            break
        stems += fresh
        gone = set(fresh)
        common = [w for w in common if w not in gone]
        model, negative = settle([w for w in negative if w not in gone])
    kind = f"k {docs.schema[key].dataType.simpleString()}, y int, " + ", ".join(f"m{i} double" for i in range(TOP))
    scored = sample.mapInArrow(_margins(spark.sparkContext.broadcast(model), 2), kind).drop("k").toPandas()
    top, toxic = scored[[f"m{i}" for i in range(TOP)]].to_numpy(), scored["y"].to_numpy()
    model.layers = [logistic(top[:, :n], toxic) for n in (1, TOP)]
    return model


def _margins(shared, where: int, keep: int | None = None, score: bool = False):
    """The first `keep` columns (all before `where`, if not given) and the TOP largest decision values, or the score, of the text at column `where`."""
    keep = where if keep is None else keep

    def run(batches):
        model, cache = shared.value, {}
        for b in batches:
            if len(cache) > CACHE:
                cache = {}
            sets = [tokens(t) if t else set() for t in b.column(where).to_pylist()]
            new = list(set().union(*sets) - cache.keys()) if sets else []
            cache.update(zip(new, model.margins(new).tolist()))
            top = np.full((len(sets), TOP), float(model.bias))
            for row, s in zip(top, sets):
                got = nlargest(TOP, map(cache.__getitem__, s))
                row[: len(got)] = got
            out = {"score": model.score(top)} if score else {f"m{i}": top[:, i] for i in range(TOP)}
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], *map(pa.array, out.values())], names=[*[f"c{i}" for i in range(keep)], *out])

    return run


def score(df: DataFrame, model: ToxicModel | None, *, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """key and score (under `name`) of every row, and the columns named in extra, unchanged."""
    keep = [key, *extra]
    if model is None:
        return df.select(*keep, F.lit(0.0).alias(name))
    small_batches(df.sparkSession)
    cols = keep if text in keep else [*keep, text]
    # columns go by place: the caller's names may clash with ours
    schema = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", score double"
    run = _margins(df.sparkSession.sparkContext.broadcast(model), cols.index(text), len(keep), score=True)
    return df.select(*cols).mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(name))


def held_out(key: str = "doc_id") -> Column:
    return crc_bucket(key, 4) == 2


def score_documents(df: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from the rows that are not held out, score all."""
    model = train(df.filter(~held_out()), labels)
    out = score(df, model).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
