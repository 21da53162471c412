"""N-gram Jaccard join by universe partitions and the pigeonhole principle; exact.

A text is the set of its distinct SHINGLE-word shingles. For sets x and y with |x| <= |y| and Jaccard >= 0.8, |y| <= 1.25 |x| and at most H = |x| / 4
elements are not common. A hash deals the universe into segments; over any choice of segments whose allowances (an equal segment: 0, one
element more or less: 1) come to H + 1 in sum of (allowance + 1), one segment must differ by no more than it is allowed.

Sets are dealt by size band (edges grow by 1.5625). In a band of small sets each shingle is a segment of its own; in others there are somewhat more
segments than the largest H + 1. A set indexes all its segments, in its own band and, if it is among the sizes that smaller sets may match, in the
band below, and of every DESIGNATED-th segment also the neighbourhood of one deletion. As the smaller partner it probes with the cheapest choice of
equal segments and one-deletion neighbourhoods; a segment costs what a sample of the texts says its rarest shingle occurs, so passages that
many texts share are not probed while others suffice. The sample steers cost alone, never the result.

Signatures meet by a shuffle and are read in sorted order, by size, askers before the sets that they may match. Of a run (the sets with one signature) the reader holds
the askers that still reach the size in hand, as a queue of ever larger hashes (expected length: the logarithm of their number), and two rows: memory does not grow with the run.
Each set that an asker of the run may match is paired with one of them (a star, not all pairs), candidates are verified on whole sets, and links give
components. Then, wherever a run holds sets of different components, these are compared too: pair by pair in short runs; long ones are joined in
blocks, once for all runs with the same leader. What is left unlinked is not similar: no pair is lost, and pairs inside a component are
never enumerated. Texts with equal sets are one set throughout. A run of any length is read by one task, in a time linear in its rows (30 bytes each).

Sets are identified by 64-bit hashes, as are shingles: two different ones meet with a probability of about (number of sets) ** 2 / 2 ** 65.

Defined cases: texts without words (null, empty, only white space) have 0 shingles and stay alone; texts of fewer words than SHINGLE have one; repeated rows
and equal texts form a component; rows with a null id link like others, but a component_id is never theirs unless the whole component has no id (then null); very long texts
are joined whole; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.llm.common import cut, release, small_batches
from citewright.llm.components import components

SHINGLE, GROWTH, FINE, DESIGNATED = 5, 1.5625, 200, 32
SAMPLE_DOCS, HOT_LEAST, HOT_MOST, WORDS, SHARED_ROWS = 10_000, 4, 200_000, 250_000, 1_000_000
#: Sets in a run that are compared pair by pair; more meet as a family, in blocks of so many elements.
FEW, BLOCK = 12, 200_000
#: Roles of a signature: indexed segment, own deletion indexed; askers: probe for an equal segment, probe for one with a deletion, own deletion probing.
INDEX, DELETED, PROBE, GROW, SHRUNK = 1, 2, 4, 8, 16
#: A row holds size << 8 | LATE - roles: at one size askers sort first.
LATE = 255
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


class WordHash(dict):
    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        self[w] = h
        return h


class Sets:
    """Shingle sets of texts, a batch at a time."""

    def __init__(self):
        self.hash = WordHash()

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text the sorted hashes of its distinct shingles."""
        if len(self.hash) > WORDS:
            self.hash.clear()
        at, flat, sizes = self.hash, [], []
        for t in texts:
            ws = t.encode("utf-8", "surrogatepass").lower().split() if t else []
            flat += [at[w] for w in ws]
            sizes.append(len(ws))
        x = np.array(flat, dtype=U)
        n = max(0, len(x) - SHINGLE + 1)
        h = np.zeros(n, dtype=U)
        for i in range(SHINGLE):
            h = mix(h ^ x[i : n + i])
        out, begin = [], 0
        for k in sizes:
            if k >= SHINGLE:
                out.append(np.unique(h[begin : begin + k - SHINGLE + 1]))
            elif k:
                short = U(k)
                for w in x[begin : begin + k]:
                    short = mix(np.array([short ^ w], dtype=U))[0]
                out.append(np.array([short], dtype=U))
            else:
                out.append(np.zeros(0, dtype=U))
            begin += k
        return out


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def band_of(n: int) -> int:
    k = int(np.log(n) / np.log(GROWTH))
    while GROWTH ** (k + 1) <= n:
        k += 1
    while k and GROWTH**k > n:
        k -= 1
    return k


def segments_of(band: int) -> int:
    """Segments of a band; 0: each shingle is one."""
    edge = GROWTH ** (band + 1)
    if edge <= FINE:
        return 0
    need = (int(np.ceil(edge)) - 1) // 4 + 1
    # spare segments: more than stay empty, by seven standard deviations or more
    return need + int(0.03 * need + 1.4 * need**0.5) + 4


def choose(cost: np.ndarray, size: np.ndarray, designated: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest way to `need`: (segments probed for equality, those of them probed with one deletion more).

    An upgrade costs as much as the signatures that it adds, and is open to designated segments of two elements or more.
    """
    up = np.flatnonzero(designated & (size >= 2))
    price = np.r_[cost, np.maximum(cost[up] + 1, 2 + size[up])]
    order = np.argsort(price, kind="stable")[:need]
    if len(order) < need:
        raise ValueError("a set falls into too few segments for an exact search")
    taken = order[order < len(cost)]
    return taken, up[order[order >= len(cost)] - len(cost)]


def signatures(s: np.ndarray, cost: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, roles) of a set. cost: what each element is estimated to occur."""
    n, own, out, fine = len(s), band_of(len(s)), [], False
    for band in (own, own - 1):
        lower = band != own
        if lower and (band < 0 or n > 1.25 * (int(np.ceil(GROWTH**own)) - 1)):
            continue
        m = segments_of(band)
        need = 0 if lower else n // 4 + 1
        if m == 0:
            if fine:
                continue  # the same signatures as in the own band
            fine = True
            role = np.full(n, INDEX)
            role[np.argsort(cost, kind="stable")[:need]] |= PROBE
            out.append((mix(s ^ U(0x5851F42D4C957F2D)), role))
            continue
        seg = (mix(s ^ U(band * 2 + 1)) >> U(11)) % U(m)
        order = np.argsort(seg, kind="stable")
        sorted_seg, v = seg[order], mix(s[order] + U(band))
        head = np.flatnonzero(np.r_[True, sorted_seg[1:] != sorted_seg[:-1]])
        size = np.diff(np.r_[head, n])
        total = np.add.reduceat(v, head)
        which = sorted_seg[head]
        salt = mix(which + U(band << 32))
        value = mix(total ^ salt)
        role = np.full(len(head), INDEX)
        designated = which % U(DESIGNATED) == 0
        up = np.zeros(0, dtype=np.int64)
        if need:
            price = np.maximum(1, np.minimum.reduceat(cost[order], head))
            taken, up = choose(price, size, designated, need)
            role[taken] |= PROBE
            role[up] |= GROW
        out.append((value, role))
        cut_ = np.flatnonzero(designated & (size >= 2))
        if len(cut_):
            part = np.repeat(np.arange(len(head)), size)
            inside = np.isin(part, cut_)
            less = mix((total[part] - v) ^ salt[part])[inside]
            roles = np.where(np.isin(part[inside], up), DELETED | SHRUNK, DELETED)
            out.append((less, roles))
    return out


# ---- runs --------------------------------------------------------------------------------------------------------------


class Probes:
    """Asking sets of at least 0.8 of the size in hand, and the one of them with the smallest hash."""

    def __init__(self):
        self.queue: list[tuple[int, int, int]] = []  # hashes grow: the first is the smallest
        self.head = 0

    def push(self, n: int, sid: int) -> None:
        h = sid * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        q = self.queue
        while len(q) > self.head and q[-1][0] >= h:
            q.pop()
        q.append((h, n, sid))

    def best(self, n: int) -> int | None:
        q = self.queue
        while self.head < len(q) and q[self.head][1] * 5 < n * 4:
            self.head += 1
        if self.head > 1000:
            del q[: self.head]
            self.head = 0
        return q[self.head][2] if self.head < len(q) else None


class Run:
    """One signature from its first asker on. pair(a, b) takes candidates, keep(sig, set, size << 8 | roles) all sets that ask or are asked for, if there are three or more."""

    def __init__(self, sig: int, pair, keep):
        self.sig, self.pair, self.keep = sig, pair, keep
        self.windows = (INDEX, PROBE | SHRUNK, Probes()), (DELETED, GROW, Probes())
        self.last = None
        self.held: list[tuple[int, int]] = []  # rows of the first two sets
        self.first: set[int] = set()

    def add(self, n: int, sid: int, role: int) -> None:
        if (n, sid, role) == self.last:
            return
        self.last = n, sid, role
        met = role >= PROBE
        for target, _, window in self.windows:
            if role & target:
                asker = window.best(n)
                if asker is not None:
                    met = True
                    if asker != sid:
                        self.pair(asker, sid)
        if not met:
            return
        for _, asks, window in self.windows:
            if role & asks:
                window.push(n, sid)
        if self.held is None:
            self.keep(self.sig, sid, n << 8 | role)
            return
        self.first.add(sid)
        self.held.append((sid, n << 8 | role))
        if len(self.first) > 2:
            for x, packed in self.held:
                self.keep(self.sig, x, packed)
            self.held = None

    def close(self) -> None:
        if self.held and len(self.first) == 2:
            self.pair(*self.first)  # whichever asks


def runs(batches):
    """Rows sig, size << 8 | LATE - roles, set, doc, sorted: yields kind 0 (pair of sets), kind 1 (sig, set, size << 8 | roles) of runs with three sets or more, kind 2 (doc, set, n)."""
    out: list[list] = [[], [], [], []]

    def put(*row):
        for column, x in zip(out, row):
            column.append(x)

    def flush():
        got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int8(), pa.int64(), pa.int64(), pa.int64()))], names=["kind", "a", "b", "c"])
        for x in out:
            x.clear()
        return got

    def pair(a, b):
        put(0, min(a, b), max(a, b), 0)

    def keep(sig, sid, packed):
        put(1, sig, sid, packed)

    run = None
    for batch in batches:
        sig, packed, sid = (np.asarray(x) for x in batch.columns[:3])
        n, role = packed >> 8, LATE - (packed & 255)
        docs = role == 0
        if docs.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(docs.sum()), 2, dtype=np.int8)), batch.column(3).filter(pa.array(docs)), pa.array(sid[docs]), pa.array(n[docs])], names=["kind", "a", "b", "c"])
            kept = ~docs
            sig, n, sid, role = sig[kept], n[kept], sid[kept], role[kept]
        if not len(sig):
            continue
        head = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        ends = np.r_[head[1:], len(sig)]
        asking = role >= PROBE
        live = np.logical_or.reduceat(asking, head) & (ends - head > 1)
        live[-1] = live[0] = True  # may go on in another batch
        # most runs hold two rows: these are told all at once
        two = np.flatnonzero(live[1:-1] & (ends - head == 2)[1:-1]) + 1
        if len(two):
            live[two] = False
            x, y = head[two], head[two] + 1
            meets = lambda a, b: (role[a] & (PROBE | SHRUNK) > 0) & (role[b] & INDEX > 0) | (role[a] & GROW > 0) & (role[b] & DELETED > 0)
            hit = (sid[x] != sid[y]) & (n[y] * 4 <= n[x] * 5) & (meets(x, y) | (n[x] == n[y]) & meets(y, x))
            a, b = sid[x[hit]], sid[y[hit]]
            zero = np.zeros(len(a), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int8)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(zero)], names=["kind", "a", "b", "c"])
        for k in np.flatnonzero(live):
            lo, hi = int(head[k]), int(ends[k])
            value = int(sig[lo])
            if run is None or run.sig != value:
                ask = np.flatnonzero(asking[lo:hi])
                if not len(ask):
                    continue  # what comes before the first asker is asked for by no set
                if run is not None:
                    run.close()
                run, lo = Run(value, pair, keep), lo + int(ask[0])
            for at in range(lo, hi, 100_000):  # a run may fill a batch
                part = slice(at, min(hi, at + 100_000))
                for row in zip(n[part].tolist(), sid[part].tolist(), role[part].tolist()):
                    run.add(*row)
        if len(out[0]) > 200_000:
            yield flush()
    if run is not None:
        run.close()
    yield flush()


# ---- the join ----------------------------------------------------------------------------------------------------------


def hot_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the sampled texts have, and in how many; SAMPLE_DOCS texts in expectation."""
    total = docs.count()
    if not total:
        return np.zeros(0, dtype=U), np.zeros(0)
    draw = F.pmod(F.xxhash64("id", F.lit(31)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches):
        sets = Sets()
        for b in batches:
            got = [s for s in sets.of(b.column(1).to_pylist()) if len(s)]
            if got:
                h, c = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    counts = docs.filter(draw < min(1.0, SAMPLE_DOCS / total)).select("id", "t").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    rows = counts.filter(F.col("c") >= HOT_LEAST).orderBy(F.desc("c"), "h").limit(HOT_MOST).toPandas()
    h = rows["h"].to_numpy(dtype=np.int64).view(U)
    order = np.argsort(h)
    return h[order], rows["c"].to_numpy(dtype=np.float64)[order]


def join(df: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """key, n_shingles and component_id of every row. percent must be 80 or more: bands and allowances are made for 80."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100")
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    hot = spark.sparkContext.broadcast(hot_shingles(docs))

    def sign(batches):
        sets, seen = Sets(), set()
        h, c = hot.value
        for b in batches:
            sig, n, sid, role, doc = [], [], [], [], []
            for d, s in zip(b.column(0).to_pylist(), sets.of(b.column(1).to_pylist())):
                own = set_id(s)
                sig.append(mix(np.array([own & 0xFFFFFFFFFFFFFFFF], dtype=U)))
                n.append([len(s)])
                sid.append([own])
                role.append([0])
                doc.append(d)
                if not len(s) or own in seen:
                    continue
                seen.add(own)
                cost = np.ones(len(s))
                if len(h):
                    at = np.minimum(np.searchsorted(h, s), len(h) - 1)
                    cost = np.where(h[at] == s, c[at], 1.0)
                for value, r in signatures(s, cost):
                    sig.append(value)
                    n.append(np.full(len(value), len(s)))
                    sid.append(np.full(len(value), own))
                    role.append(r)
                    doc += [None] * len(value)
            if sig:
                packed = np.concatenate(n).astype(np.int64) << 8 | LATE - np.concatenate(role)
                cols = [np.concatenate(sig).view(np.int64), packed, np.concatenate(sid).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(doc, pa.int64())], names=["sig", "packed", "sid", "doc"])

    rows = docs.mapInArrow(sign, "sig long, packed long, sid long, doc long").repartition("sig").sortWithinPartitions("sig", "packed", "sid")
    small_batches(spark, rows=100_000)
    found = cut(rows.mapInArrow(runs, "kind byte, a long, b long, c long"))
    small_batches(spark)
    del rows
    release(spark)
    members = found.filter("kind = 2").select(F.col("a").alias("id"), F.col("b").alias("sid"), F.col("c").alias("n"))
    first = found.filter("kind = 0").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    links = verify(docs, members, first, percent)
    comp = components(links, "x", "y")
    # runs that hold sets of different components: a set may still match others that its leader did not stand for
    shared = found.filter("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("sid"), F.shiftright("c", 8).alias("n"), F.col("c").bitwiseAND(255).alias("r"))
    told = shared.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mixed = told.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("sig")
    told = cut(told.join(mixed, "sig", "left_semi"))
    order = F.xxhash64("sid")
    sizes = told.groupBy("sig").agg(F.count("*").alias("g"), F.min_by("sid", order).alias("leader"))
    sized = cut(told.join(sizes, "sig"))
    small = sized.filter(F.col("g") <= FEW)
    one, two = small.alias("p"), small.alias("q")
    asks = (F.col("p.r").bitwiseAND(PROBE | SHRUNK) > 0) & (F.col("q.r").bitwiseAND(INDEX) > 0) | (F.col("p.r").bitwiseAND(GROW) > 0) & (F.col("q.r").bitwiseAND(DELETED) > 0)
    fits = (F.col("p.n") <= F.col("q.n")) & (F.col("p.n") * 5 >= F.col("q.n") * 4)
    rest = one.join(two, (F.col("p.sig") == F.col("q.sig")) & (F.col("p.component") != F.col("q.component")) & fits & asks)
    second = rest.select(F.least("p.sid", "q.sid").alias("x"), F.greatest("p.sid", "q.sid").alias("y")).distinct().join(first, ["x", "y"], "left_anti")
    more = verify(docs, members, second, percent).unionByName(families(docs, members, sized.filter(F.col("g") > FEW), percent))
    last = components(links.unionByName(more), "x", "y").withColumnRenamed("node", "sid")
    placed = members.filter("n > 0").join(last, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    out = placed.join(least, "component").select("id", "n", "component_id").unionByName(members.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def sets_of(docs: DataFrame, members: DataFrame, needed: DataFrame) -> DataFrame:
    """sid, s: the sets with the ids in needed (one column sid), made anew from their texts; a set may stand more than once."""
    named = cut(members.join(needed, "sid", "left_semi").groupBy("sid").agg(F.min("id").alias("id")))
    ids = named.filter("id is not null").select("id").distinct()
    few = ids.count() <= SHARED_ROWS
    chosen = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def build(batches):
        sets = Sets()
        for b in batches:
            got = [s for s in sets.of(b.column(0).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in got], pa.int64()), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], names=["sid", "s"])

    made = lambda rows: rows.select("t").mapInArrow(build, "sid long, s array<long>")
    nameless = named.filter("id is null").select("sid")
    if nameless.isEmpty():
        return made(chosen)
    # sets that only rows without id have: all such rows are read
    few = nameless.count() <= SHARED_ROWS
    return made(chosen).unionByName(made(docs.filter("id is null")).join(F.broadcast(nameless) if few else nameless, "sid", "left_semi").dropDuplicates(["sid"]))


def families(docs: DataFrame, members: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Links x, y between different components inside large runs.

    Runs with one leader hold much the same sets, so they are joined once, as a family, in blocks of BLOCK elements. Blocks of one and the same component are
    not compared with each other, nor blocks whose sizes rule links out. A block pair gives one link for each set and
    component that it links to, not all pairs.
    """
    member = large.groupBy("leader", "sid").agg(F.first("n").alias("n"), F.first("component").alias("component"))
    before = F.sum("n").over(Window.partitionBy("leader").orderBy("component", "n", "sid").rowsBetween(Window.unboundedPreceding, 0))
    member = cut(member.withColumn("block", F.floor(before / BLOCK)))
    if member.isEmpty():
        return member.select(F.col("sid").alias("x"), F.col("sid").alias("y"))
    box = member.groupBy("leader", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("component").alias("c"), F.max("component").alias("d"))
    p, q = box.alias("p"), box.alias("q")
    reach = (F.col("p.lo") * 4 <= F.col("q.hi") * 5) & (F.col("q.lo") * 4 <= F.col("p.hi") * 5)
    pure = (F.col("p.c") == F.col("p.d")) & (F.col("q.c") == F.col("q.d")) & (F.col("p.c") == F.col("q.c"))
    pairs = p.join(q, (F.col("p.leader") == F.col("q.leader")) & (F.col("p.block") <= F.col("q.block")) & reach & ~pure).select(F.col("p.leader").alias("leader"), F.col("p.block").alias("i"), F.col("q.block").alias("j"))
    sets = sets_of(docs, members, member.select("sid").distinct())
    packed = cut(member.join(sets, "sid").dropDuplicates(["leader", "sid"]).groupBy("leader", "block").agg(F.collect_list(F.struct("sid", "component", "s")).alias("m")))
    side = lambda n, m: packed.select("leader", F.col("block").alias(n), F.col("m").alias(m))
    work = pairs.join(side("i", "a"), ["leader", "i"]).join(side("j", "b"), ["leader", "j"]).select("a", "b")

    def link(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                got = list(block_links(*(unpack(batch.column(c)[k].values) for c in range(2)), percent))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["x", "y"])

    return cut(work.mapInArrow(link, "x long, y long").distinct())


def unpack(m: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sets, components, offsets, elements) of a packed block."""
    s = m.field("s")
    return np.asarray(m.field("sid")), np.asarray(m.field("component")), np.asarray(s.offsets) - s.offsets[0].as_py(), np.asarray(s.flatten())


def block_links(a, b, percent: int):
    """For each set of b one link to each other component of a that it has links to."""
    (ida, ca, oa, xa), (idb, cb, ob, xb) = a, b
    na, nb = np.diff(oa), np.diff(ob)
    order = np.argsort(xa, kind="stable")
    owner, values = np.repeat(np.arange(len(ida)), na)[order], xa[order]
    lo, hi = np.searchsorted(values, xb, "left"), np.searchsorted(values, xb, "right")
    for k in range(len(idb)):
        begin, n = lo[ob[k] : ob[k + 1]], (hi - lo)[ob[k] : ob[k + 1]]
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(total)
        common = np.bincount(owner[at], minlength=len(ida))
        hit = np.flatnonzero((common * 100 >= (na + nb[k] - common) * percent) & (ca != cb[k]))
        for i in hit[np.unique(ca[hit], return_index=True)[1]]:
            yield min(int(ida[i]), int(idb[k])), max(int(ida[i]), int(idb[k]))


def verify(docs: DataFrame, members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs x, y of sets that are similar, by whole sets."""
    pairs = cut(pairs)
    needed = pairs.select(F.col("x").alias("sid")).unionByName(pairs.select(F.col("y").alias("sid"))).distinct()
    sets = sets_of(docs, members, needed)
    both = pairs.join(sets.select(F.col("sid").alias("y"), F.col("s").alias("sy")), "y").join(sets.select(F.col("sid").alias("x"), F.col("s").alias("sx")), "x")
    common = F.size(F.array_intersect("sx", "sy"))
    return cut(both.select("x", "y", common.alias("i"), (F.size("sx") + F.size("sy")).alias("n")).filter(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("x", "y").distinct())  # rows that share an id repeat a set


#: The same by brute force.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM d, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id WHERE r.c < l.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(least(r.c, d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL
"""
