"""Language-model scores by a weighted backoff automaton.

The model is a trigram model over words with hierarchical Dirichlet smoothing: a token has the unigram probability
(c + 0.1) / (N + 0.1 * (V + 1)), all unseen ones share one as if they were one word more; after a history h of one or two words it has
(c(h, w) + A * p(w | shorter h)) / (c(h) + A), where A is a fixed pseudo-count (AFTER_WORD, AFTER_PAIR). So the probabilities after each history sum to one, and
nothing but counts is needed. Every n-gram of the training texts is in the model, those seen once included.

States are the histories of training texts. An arc reads a word that follows its state there, adds the log-probability above and leads to the longest history
that ends with the word. Where there is none, the failure arc adds log A / (c(h) + A) and leads to the next shorter history, down to the root, which
knows all words. A traversal from left to right carries the state and adds up the arcs. As the state before a token is the longest known history that ends there, whatever came before,
Chunk.scores takes the step of every token of its texts at once, in closed form over the arrays of counts, instead of carrying the state from token to token; the sums are the same.

No table of the model is collected or broadcast; it is as large as the corpus. Texts are packed into chunks. A chunk sends each of its distinct
words, bigrams and trigrams once, with its count in training texts, to the bucket of the n-gram's hash. The bucket adds up and
answers each chunk with the totals: the chunk then has every arc and failure weight that its texts can meet. Messages are sorted hashes in compressed
runs. The number of buckets follows the number of tokens, so that one holds about KEYS of them. Inside a chunk words are told apart by their bytes, between chunks by 80 bits of hash, whatever the size of the
table: of ten billion different words two meet with a probability of 4 in 100,000, so what is counted of words (N, V, the unigram score) is exact. Bigrams and trigrams are told apart by WIDTH = 64 bits,
at any size: ten billion of them make about three pairs that count as one, which moves the scores of the texts with them a little. Messages go out in ROUNDS parts of the key range, one after
the other, so that the files of one part are gone before the next ones come.

Defined cases: a null text is an empty one, which has one token, the end; very long texts are scored whole (a chunk holds at least one text, and
its memory is a multiple of that text's); repeated rows are scored one by one and count as often as they stand there; a null id is the text `null` for the
split; extra columns are ignored, whatever their names; an empty table gives an empty result; without training texts every token is unseen (N = V = 0).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.llm.common import cut, release, small_batches

#: Pseudo-counts of the shorter history after one word and after two.
AFTER_WORD, AFTER_PAIR = 5000.0, 5.0
END = b""
#: Words whose hashes a worker keeps at hand; steers cost alone.
TOP = 250_000
#: Bytes of text in a chunk, keys that a bucket holds on average, the most tasks that score chunks, bits of an n-gram's key, and parts in which messages go out.
CHUNK, KEYS, TASKS, WIDTH, ROUNDS = 3 << 20, 1 << 20, 20_000, 64, 2
U = np.uint64
#: A word's hash: 80 bits, of which n-grams are made of the first 64.
WORD = np.dtype([("lo", "<u8"), ("hi", "<u2")])


def held_out(key: Column | str) -> Column:
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("null"))
    return F.crc32(text.cast("binary")) % 10 == 0


def split(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case: bytes know no other letters and no other white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHash(dict):
    """word -> its hash, as the bytes of a WORD."""

    def __missing__(self, w: bytes) -> bytes:
        h = self[w] = xxhash.xxh3_128_digest(w)[: WORD.itemsize]
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def squeeze(x: np.ndarray) -> bytes:
    """A column of 8-byte values, like bytes side by side, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def loosen(data: bytes, n: int, kind) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(kind).reshape(n)


def deltas(keys: np.ndarray) -> bytes:
    """Sorted keys by their distances."""
    return squeeze(np.r_[keys[:1], keys[1:] - keys[:-1]])


def pack(batches):
    """id, t, held: yields chunks of about CHUNK bytes: their rows, their tokens as hashes and places among them, and the number of tokens."""
    part, count, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
    at = WordHash()

    def flush():
        table = pa.Table.from_batches(held)
        flat, sizes = [], []
        number: defaultdict[bytes, int] = defaultdict()  # the words of the chunk in the order in which they come
        number.default_factory = number.__len__
        for t in table.column(1).to_pylist():
            ws = split(t)
            flat += [number[w] for w in ws]
            flat.append(number[END])
            sizes.append(len(ws) + 1)
        words = np.frombuffer(b"".join([at[w] for w in number]), dtype=WORD)
        if len(at) > TOP:
            at.clear()
        place = np.array(flat, dtype=np.int64)
        often = np.bincount(place, minlength=len(words))
        order = np.lexsort((words["hi"], words["lo"], -often))  # frequent words have small numbers, which compress well
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        words, place = np.ascontiguousarray(words[order]), rank[place]
        table = table.drop_columns([table.column_names[1]]).append_column("size", pa.array(sizes, pa.int64()))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        first = words.tobytes()
        tokens = len(words).to_bytes(8, "little") + first + squeeze(place)
        return pa.RecordBatch.from_arrays([pa.array([part + count], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([tokens], pa.binary()), pa.array([len(flat)], pa.int64())], names=["chunk", "data", "tokens", "m"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= CHUNK:
            yield flush()
            held, size, count = [], 0, count + 1
    if held:
        yield flush()


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the place of each given one among them; np.unique in less memory."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, dtype=bool)
    at = np.empty(len(keys), dtype=np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], at


class Chunk:
    """Texts of a chunk. d: the text of each token; two, three: the tokens where a bigram, a trigram ends; words: the hashes of its words in order; keys: its bigrams and trigrams, `width` bits each;
    at: of each token its place among the words, then of each n-gram the number of words and its place among the keys."""

    def __init__(self, data: bytes, tokens: bytes, width: int):
        self.table = pa.ipc.open_stream(data).read_all()
        self.sizes = self.table.column("size").to_numpy()
        self.d = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        m = int.from_bytes(tokens[:8], "little")
        words = np.frombuffer(tokens[8 : 8 + WORD.itemsize * m], dtype=WORD)
        token = loosen(tokens[8 + WORD.itemsize * m :], len(self.d), np.int64)
        k1 = words["lo"][token]
        place = np.arange(len(self.d)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.two, self.three = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        k2 = mix(mix(k1[self.two - 1]) ^ k1[self.two] * U(0x9FB21C651E98DF25))
        k3 = mix(mix(k1[self.three - 2] + U(0x632BE59BD9B4E019)) ^ mix(k1[self.three - 1]) * U(0x9FB21C651E98DF25) ^ k1[self.three] * U(0xD6E8FEB86659FD93))
        del k1
        self.keys, at = places(np.concatenate([k2, k3]) >> U(64 - width))
        order = np.lexsort((words["hi"], words["lo"]))
        rank = np.empty(m, dtype=np.int32)
        rank[order] = np.arange(m, dtype=np.int32)
        self.words = words[order]
        self.at = np.concatenate([rank[token], at + np.int32(m)])

    def trained(self) -> np.ndarray:
        """How often each word and then each key stands in training texts of the chunk."""
        train = ~self.table.column(1).to_numpy().astype(bool)[self.d]
        return np.bincount(self.at, np.concatenate([train, train[self.two], train[self.three]]), minlength=len(self.words) + len(self.keys)).astype(np.int64)

    def scores(self, totals: np.ndarray, n: int, v: int) -> list[np.ndarray]:
        """totals: of each word and then each key in all training texts. Of each text: known tokens, log10 by unigrams, log10 by the automaton."""
        m, k = len(self.d), len(self.two)
        c1, c2, c3 = totals[self.at[:m]].astype(np.float64), np.zeros(m), np.zeros(m)
        c2[self.two], c3[self.three] = totals[self.at[m : m + k]], totals[self.at[m + k :]]
        root = np.log10((c1 + 0.1) / (n + 0.1 * (v + 1)))
        # the history of a text's first token, and of its second one beyond a word, is not known: count 0, where the failure arc weighs nothing
        h1, h2 = np.zeros(m), np.zeros(m)
        h1[self.two], h2[self.three] = c1[self.two - 1], c2[self.three - 1]
        step = root
        for history, c, a in ((h1, c2, AFTER_WORD), (h2, c3, AFTER_PAIR)):
            step = np.where(c > 0, np.log10((c + a * 10.0**step) / (history + a)), np.log10(a / (history + a)) + step)
        total = lambda x: np.bincount(self.d, x, minlength=len(self.sizes))
        return [total(c1 > 0).astype(np.int64), total(root), total(step)]


def deal(chunk: int, keys: np.ndarray, counts: np.ndarray, shift: int, base: int = 0, more: np.ndarray | None = None) -> pa.RecordBatch:
    """The message of a chunk to each bucket: bucket, chunk, n, keys, x (counts), y (the rest of the words' hashes). keys are sorted; their buckets are numbered from base."""
    buckets, head = np.unique(keys >> U(shift), return_index=True)
    ends = np.r_[head[1:], len(keys)].tolist()
    head = head.tolist()
    m = len(head)
    cut_ = lambda make, x: pa.array([make(x[lo:hi]) for lo, hi in zip(head, ends)], pa.binary())
    n = pa.array([hi - lo for lo, hi in zip(head, ends)], pa.int64())
    rest = cut_(lambda x: x.tobytes(), more) if more is not None else pa.nulls(m, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32) + np.int32(base)), pa.array([chunk] * m, pa.int64()), n, cut_(deltas, keys), cut_(squeeze, counts), rest], names=["bucket", "chunk", "n", "keys", "x", "y"])


MESSAGE = "bucket int, chunk long, n long, keys binary, x binary, y binary"
ANSWER = "chunk long, bucket int, n long, x binary, tokens long, words long"


def answer(batches):
    """Rows of MESSAGE sorted by bucket: yields rows of ANSWER with the totals of the keys, and once for each bucket of words its numbers of tokens and words."""

    def close(bucket, rows):
        ns = [r[1] for r in rows]
        keys = np.concatenate([np.cumsum(loosen(r[2], r[1], U), dtype=U) for r in rows])
        of_words = rows[0][4] is not None
        if of_words:
            order = np.lexsort((more := np.concatenate([np.frombuffer(r[4], dtype="<u2") for r in rows]), keys))
            a, b = keys[order], more[order]
            inverse = np.empty(len(keys), dtype=np.int32)
            inverse[order] = np.cumsum(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])], dtype=np.int32) - 1
        else:
            _, inverse = places(keys)
        total = np.bincount(inverse, np.concatenate([loosen(r[3], r[1], np.int64) for r in rows])).astype(np.int64)
        words = total if of_words else total[:0]
        x, ends = total[inverse], np.cumsum(ns).tolist()
        made = [squeeze(x[e - n : e]) for e, n in zip(ends, ns)]
        first = lambda x: pa.array([x] + [0] * (len(rows) - 1), pa.int64())
        cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(ns, pa.int64()), pa.array(made, pa.binary()), first(int(words.sum())), first(int((words > 0).sum()))]
        return pa.RecordBatch.from_arrays(cols, names=["chunk", "bucket", "n", "x", "tokens", "words"])

    bucket, rows = None, []
    for b in batches:
        for k, *r in zip(*(c.to_pylist() for c in b.columns)):
            if k != bucket:
                if rows:
                    yield close(bucket, rows)
                bucket, rows = k, []
            rows.append(r)
    if rows:
        yield close(bucket, rows)


def gathered(batches, width: int):
    """Rows chunk, step, bucket, n, x, y sorted by these: yields each chunk with the totals of its keys."""
    chunk, got = None, []
    for b in batches:
        for step, n, x, y in zip(*(b.column(i).to_pylist() for i in (1, 3, 4, 5))):
            if step == 0:
                if chunk:
                    chunk, got = None, (Chunk(*chunk, width), np.concatenate(got))
                    yield got
                chunk, got = (x, y), []
            else:
                got.append(loosen(x, n, np.int64))
    if chunk:
        yield Chunk(*chunk, width), np.concatenate(got)


def score_documents(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows that are not held out, score all: key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), held_out(key).alias("held"))
    packed = cut(rows.mapInArrow(pack, "chunk long, data binary, tokens binary, m long"))
    size = packed.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    bits = min(18, max(9, (2 * size["m"] // KEYS).bit_length()))
    of_words = max(4, bits - 3)  # words are fewer than n-grams
    width = WIDTH

    def counter(part: int):
        def count(batches):
            for b in batches:
                for chunk, data, tokens in zip(*(c.to_pylist() for c in b.columns)):
                    c = Chunk(data, tokens, width)
                    words, keys, counts = c.words, c.keys, c.trained()
                    del c
                    if part == 0:  # buckets of words come first, as words do among a chunk's totals
                        yield deal(chunk, np.ascontiguousarray(words["lo"]), counts[: len(words)], 64 - of_words, 0, words["hi"])
                    edges = [r * (1 << bits) // ROUNDS for r in (part, part + 1)]
                    lo, hi = np.searchsorted(keys >> U(width - bits), np.array(edges, dtype=U))
                    if hi > lo:
                        yield deal(chunk, keys[lo:hi], counts[len(words) + lo : len(words) + hi], width - bits, 1 << of_words)

        return count

    counted = None
    for part in range(ROUNDS):
        dealt = packed.select("chunk", "data", "tokens").mapInArrow(counter(part), MESSAGE).repartition("bucket").sortWithinPartitions("bucket", "chunk")
        answers = cut(dealt.mapInArrow(answer, ANSWER))
        counted = answers if counted is None else counted.unionByName(answers)
        del dealt  # its shuffle files go
        release(spark)
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("v")).first()
    n, v = total["n"], total["v"]
    chunks = packed.select("chunk", F.lit(0).alias("step"), F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("n"), F.col("data").alias("x"), F.col("tokens").alias("y"))
    both = chunks.unionByName(counted.select("chunk", F.lit(1).alias("step"), "bucket", "n", "x", F.lit(None).cast("binary").alias("y")))
    both = both.repartition(max(1, min(TASKS, size["chunks"])), "chunk").sortWithinPartitions("chunk", "step", "bucket")

    def score(batches):
        for c, totals in gathered(batches, width):
            known, base, whole = c.scores(totals, n, v)
            table = pa.table([c.table.column(0), c.table.column(1), pa.array(c.sizes), pa.array(known), pa.array(np.full(len(known), n, dtype=np.int64)), pa.array(base), pa.array(whole)], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            del c, totals  # before the next chunk comes
            yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    return both.mapInArrow(score, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
