"""Importance resampling towards a target by hashed n-gram features.

A feature is a run of up to N words; it counts in the bucket of its CRC. What the target and the raw documents have in each bucket gives the bucket's gain, the logarithm of the
ratio of smoothed shares, in thousandths. A document's weight is the sum of the gains of its features; weight plus Gumbel noise seeded by its id is its score, and the
highest scores are a sample without replacement in proportion to the weights.

Each task holds a trie of the words it reads: a node is a run of words, and holds how often it was met and the CRC state of its bytes, from which each child's CRC goes on, so no
feature is ever put together as text. A trie that has grown to NODES nodes hands its bucket totals over and starts anew. A task gives a row for each bucket at most; their sums, one
for each bucket, are all that the driver sees. Documents are then scored by the same walk, with gains attached to the nodes. Ranks come from a sort by ranges of score and a count for each
range: no rows meet in one task.

Defined cases: a null or empty text, or one without words, has no features and weight 0; very long texts are read whole; repeated rows count as often as they stand
there, and are ranked each, equal ones in any order among themselves; ties go to the smaller id, a null id (the text `null` in the seed) after all others; extra columns never enter; an empty target has no features (T = 0);
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.llm.common import cut, small_batches

RUN, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
NODES = 400_000
#: Bytes that are in words (digits, a-z, all beyond ASCII) stay, A-Z go to lower case, others become blanks.
BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split() if text else []


class First(dict):
    """The nodes below the root: word -> node."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        node = self[word] = self.trie.add(zlib.crc32(word), word)
        return node


class Trie:
    """Runs of up to `run` words. state: the CRC of each node's bytes; word: its last word."""

    def __init__(self, run: int):
        self.run = run
        self.state: list[int] = []
        self.word: list[bytes] = []
        self.first = First(self)
        self.below: dict[int, int] = {}  # node << 32 | node of the next word alone -> node

    def __len__(self) -> int:
        return len(self.state)

    def add(self, state: int, word: bytes) -> int:
        self.state.append(state)
        self.word.append(word)
        return len(self.state) - 1

    def walk(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length of run: the node of every run of the texts, and the text that it stands in."""
        sizes = np.array([len(ws) for ws in texts], dtype=np.int64)
        first = self.first
        single = np.array([first[w] for ws in texts for w in ws], dtype=np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(single)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - place  # words from here to the end of the text
        out, node, at = [(single, text)], single, np.arange(len(single))
        for n in range(2, self.run + 1):
            goes_on = left[at] >= n
            node, at = node[goes_on], at[goes_on]
            key, where = np.unique(node << 32 | single[at + n - 1], return_inverse=True)
            node = np.array([self.child(k) for k in key.tolist()], dtype=np.int64)[where] if len(key) else np.zeros(0, dtype=np.int64)
            out.append((node, text[at]))
        return out

    def child(self, key: int) -> int:
        node = self.below.get(key)
        if node is None:
            word = self.word[key & 0xFFFFFFFF]
            node = self.below[key] = self.add(zlib.crc32(b" " + word, self.state[key >> 32]), word)
        return node

    def buckets(self, n: int) -> np.ndarray:
        return np.array(self.state, dtype=np.int64) % n


def totals(df: DataFrame, text: str, run: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches):
        found = np.zeros(buckets, dtype=np.int64)
        trie, counts = Trie(run), np.zeros(0, dtype=np.int64)

        def hand_over():
            if len(trie):
                np.add.at(found, trie.buckets(buckets), counts)

        for b in batches:
            for nodes, _ in trie.walk([words(t) for t in b.column(0).to_pylist()]):
                if len(counts) < len(trie):
                    counts = np.concatenate([counts, np.zeros(len(trie) - len(counts), dtype=np.int64)])
                counts += np.bincount(nodes, minlength=len(counts)) if len(nodes) else 0
            if len(trie) > NODES:
                hand_over()
                trie, counts = Trie(run), np.zeros(0, dtype=np.int64)
        hand_over()
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in df.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    s_all, t_all, n = float(raw.sum()), float(target.sum()), float(len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def noise(key: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(df: DataFrame, gain: np.ndarray, *, key: str, text: str, run: int, seed: int) -> DataFrame:
    """id, words, n_features, weight and score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), F.col(text).alias("t"))

    def score(batches):
        trie, gain, held = Trie(run), shared.value, np.zeros(0, dtype=np.int64)
        for b in batches:
            texts = [words(t) for t in b.column(2).to_pylist()]
            n, weight = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            for nodes, of in trie.walk(texts):
                if len(held) < len(trie):
                    held = np.concatenate([held, gain[np.array(trie.state[len(held) :], dtype=np.int64) % len(gain)]])
                n += np.bincount(of, minlength=len(texts))
                ends = np.r_[0, np.cumsum(held[nodes])]
                upto = np.searchsorted(of, np.arange(len(texts) + 1))
                weight += ends[upto[1:]] - ends[upto[:-1]]
            s = weight + np.array([noise(k, seed) for k in b.column(1).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in ([len(w) for w in texts], n, weight, s))], names=["id", "words", "n_features", "weight", "score"])
            if len(trie) > NODES:
                trie, held = Trie(run), np.zeros(0, dtype=np.int64)

    return rows.mapInArrow(score, f"id {df.schema[key].dataType.simpleString()}, words long, n_features long, weight long, score long")


def resample(df: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """key, n_features, weight, score and rank (of those drawn) of every row of df.

    Drawn are percent hundredths, rounded down, of the rows with least_words words or more.
    """
    small_batches(df.sparkSession)
    gain = gains(totals(df, text, run, buckets), totals(target, target_text, run, buckets))
    scored = scores(df, gain, key=key, text=text, run=run, seed=seed).withColumn("fits", F.col("words") >= least_words)
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("id").asc_nulls_last()]
    ranged = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "n_features", "weight", "score", "fits"))
    placed = ranged.withColumn("m", F.monotonically_increasing_id()).withColumn("part", F.shiftright("m", 33)).withColumn("place", F.col("m").bitwiseAND((1 << 33) - 1))
    parts = sorted(tuple(r) for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fits").alias("fit")).collect())  # a row for each range
    drawn, before, offsets = percent * sum(p[2] for p in parts) // 100, 0, []
    for part, n, _ in parts:
        offsets.append((part, before))
        before += n
    offset = df.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + F.col("place") + 1
    ranked = placed.join(F.broadcast(offset), "part")
    return ranked.select(F.col("id").alias(key), "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


#: The same for runs of one word, by brute force: each distinct word's CRC byte by byte, from a table that the polynomial gives.
SQL = r"""
WITH rest AS (SELECT list(list_reduce([i::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
f AS (SELECT doc_id, unnest(ws) AS w FROM d),
x AS (SELECT w, hex(w) AS h FROM (SELECT w FROM f UNION SELECT w FROM b)),
y AS (SELECT w, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS bytes FROM x),
crc AS (SELECT w, xor(list_reduce([4294967295] || bytes, lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1])), 4294967295) % 10000 AS k FROM y, rest),
s AS (SELECT k, count(*) AS s FROM f JOIN crc USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN crc USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS g
      FROM (SELECT DISTINCT k FROM crc) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
wt AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM f JOIN crc USING (w) JOIN g USING (k) GROUP BY doc_id),
sc AS (SELECT doc_id, len(ws)::BIGINT AS n, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN wt USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n >= 20) OVER () AS fit FROM sc)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= 20 AND r <= 10 * fit // 100 THEN r END AS rank FROM r
"""
