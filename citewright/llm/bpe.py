"""Byte-pair encoding and decoding with a public vocabulary, in batched numpy merge rounds.

All distinct unseen words of an Arrow batch lie in one flat symbol array. Each round looks every adjacent pair up in the
sorted pair keys by binary search, takes the lowest rank of each word, and merges all its places at once; words
without a mergeable pair leave the array. Words of more than LONG symbols go through a heap instead, whose cost
grows as n log n. Words repeat, so a worker keeps the results of at most CACHE words; that changes no result.

Defined cases: a null or empty text has no tokens (both digests are those of the empty string); very long texts are encoded whole; repeated rows give
repeated results; other columns of the input never enter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from citewright.llm.common import small_batches

LONG, CACHE = 256, 150_000
#: The white space and the pre-tokenising pattern of the vocabulary file.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[\\p{{L}}]+|[\\p{{N}}]|[^{SPACE}\\p{{L}}\\p{{N}}]+")
#: The same for lower-cased text below U+0100, which the standard library's engine splits twice as fast.
LATIN = "a-zªµºß-öø-ÿ"
LATIN_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9²³¹¼-¾]|[^\\t\\n\\x0b\\x0c\\r \\x85\\xa0{LATIN}0-9²³¹¼-¾]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class WordBpe:
    """A tokenizer of the word-BPE kind (NFC, white space dropped, lower case, byte symbols, end-of-word suffix)."""

    def __init__(self, spec: str):
        t = json.loads(spec)
        model = t["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in t["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([self.vocab[s + self.suffix] for s in symbols], dtype=np.int64)
        ids = self.vocab
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[order][1:] != keys[order][:-1]  # a repeated pair keeps its lowest rank
        order = order[first]
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.none = np.int64(len(pairs))
        self.cache: dict[str | int, tuple[list[int], str]] = {}
        self.older: dict[str | int, tuple[list[int], str]] = {}

    # ---- merging -------------------------------------------------------------------------------------------------

    def _start(self, word: str) -> np.ndarray:
        raw = np.frombuffer(word.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        out = self.inner[raw]
        out[-1] = self.last[raw[-1]]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair: its rank (none if it never merges) and the place of its key."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none), at

    def merge_long(self, sym: np.ndarray) -> list[int]:
        """One word by a heap of (rank, place) over a linked list."""
        ids, n = sym.tolist(), len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def pair(i: int):
            j = after[i]
            if j >= n:
                return None
            key = ids[i] << 20 | ids[j]
            at = int(np.searchsorted(self.keys, key))
            return (int(self.rank[at]), i, key, int(self.made[at])) if at < len(self.keys) and self.keys[at] == key else None

        rank, at = self._ranks(sym[:-1], sym[1:])
        heap = [(int(rank[i]), int(i), int(sym[i] << 20 | sym[i + 1]), int(self.made[at[i]])) for i in np.flatnonzero(rank < self.none)]
        heapq.heapify(heap)
        while heap:
            _, i, key, made = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (ids[i] << 20 | ids[j]) != key:
                continue
            ids[i], alive[j] = made, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        return [x for x, ok in zip(ids, alive) if ok]

    def merge(self, words: list[str]) -> list[list[int]]:
        """The ids of each (non-empty) word."""
        out: list[list[int]] = [[] for _ in words]
        start = [self._start(w) for w in words]
        short = [i for i, s in enumerate(start) if len(s) <= LONG]
        for i, s in enumerate(start):
            if len(s) > LONG:
                out[i] = self.merge_long(s)
        if not short:
            return out
        sym = np.concatenate([start[i] for i in short])
        word = np.repeat(np.array(short, dtype=np.int64), [len(start[i]) for i in short])
        while len(sym):
            rank = np.full(len(sym), self.none)
            at = np.zeros(len(sym), dtype=np.int64)
            if len(sym) > 1:
                rank[:-1], at[:-1] = self._ranks(sym[:-1], sym[1:])
                rank[:-1][word[:-1] != word[1:]] = self.none
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[head, len(sym)])
            least = np.minimum.reduceat(rank, head)
            done = np.repeat(least == self.none, sizes)
            if done.any():
                flat, where = sym[done].tolist(), np.flatnonzero(least == self.none)
                pos = 0
                for k in where:
                    n = int(sizes[k])
                    out[int(word[head[k]])] = flat[pos : pos + n]
                    pos += n
                keep = ~done
                sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
                least, sizes = least[least != self.none], sizes[least != self.none]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            run = np.r_[True, np.diff(hit) != 1]  # in a run of overlapping places every second one merges
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        return out

    # ---- texts ---------------------------------------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Words of a stretch of text that holds no special token."""
        try:
            text.encode("latin-1")  # such text is its own NFC
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-casing goes letter by letter: no final sigma
            return PIECES.findall(text.lower())
        return LATIN_PIECES.findall(text.lower())

    def units(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens."""
        if self.special_re is None or not self.special_re.search(text):
            return self.pieces(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += self.pieces(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.pieces(text[at:])

    def known(self, units: set[str | int]) -> dict[str | int, tuple[list[int], str]]:
        """The ids of each unit, and they as text. What was not used since the cache last filled up is forgotten."""
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        missing = units - self.cache.keys()
        for u in missing & self.older.keys():
            self.cache[u] = self.older[u]
        new = [u for u in missing if u not in self.cache]
        words = [u for u in new if isinstance(u, str)]
        for w, ids in zip(words, self.merge(words)):
            self.cache[w] = (ids, " ".join(map(str, ids)))
        for i in new:
            if isinstance(i, int):
                self.cache[i] = ([i], str(i))
        return self.cache

    def encode(self, text: str) -> list[int]:
        parts = self.units(text)
        ids = dict(zip(ws := list({u for u in parts if isinstance(u, str)}), self.merge(ws)))
        return [i for u in parts for i in (ids[u] if isinstance(u, str) else [u])]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file names no decoder: token names, joined by one space."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except KeyError:  # ids outside the vocabulary are left out
            return " ".join([self.names[i] for i in ids if i in self.names])

    def digest(self, texts: list[str | None]) -> list[tuple[list[int], str, str]]:
        """Of each text: its ids, they as text, and what they decode to."""
        split = [self.units(t) if t else [] for t in texts]
        get = self.known({u for us in split for u in us})
        out = []
        for us in split:
            hits = [get[u] for u in us]
            ids = list(chain.from_iterable([h[0] for h in hits]))
            out.append((ids, " ".join([h[1] for h in hits]), self.decode(ids)))
        return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(df: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokens of every text: key, n_tokens, digests of ids and decoded text (and, with keep_ids, both themselves).

    vocabulary: path of the tokenizer file on the driver. Its content (under 2 MB, a fixed size) is broadcast.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        bpe = WordBpe(spec.value)
        for b in batches:
            got = bpe.digest(b.column(1).to_pylist())
            cols = [b.column(0), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([_sha(g[1]) for g in got]), pa.array([_sha(g[2]) for g in got])]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if keep_ids else "")
    return df.select(key, text).mapInArrow(run, schema)
