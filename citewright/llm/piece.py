"""SentencePiece encoding and decoding (pair merging with byte fallback) through a table of distinct chunks.

No piece of such a vocabulary crosses a whitespace marker: a marker stands in a piece only before all its other characters. So a text falls apart before each run of
markers into chunks that are segmented independently. A task gathers the chunks of an Arrow batch, segments each distinct one once, all in one flat array, and joins ids, their
text and what they decode to back by position. What a worker has segmented stays in its table until the table is full; that changes no result. The table is a
task's own because texts never have to be shuffled then: a table over all tasks would move every text to save a part of the segmenting, which is a small part of the work.

A round merges in each chunk the adjacent pair whose joined piece has the best score, the leftmost of equal ones; only pairs beside a merged one are looked up anew, by
binary search over sorted pair keys. Chunks of more than LONG characters go through a heap, whose cost grows as n log n. Characters outside the vocabulary
become the ids of their bytes. A vocabulary with a piece that crosses a marker is served too: there each text is one chunk.

Defined cases: a null or empty text has no ids (both digests are those of the empty string); very long texts are encoded whole; repeated rows give repeated results; extra
columns never enter, whatever their names; an empty table gives an empty result. Models that need a character map, user-defined or unused pieces, or another algorithm are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citewright.llm.common import small_batches

LONG, CACHE = 256, 400_000
#: The whitespace marker, what an unknown id decodes to, kinds of pieces.
MARK, UNKNOWN_TEXT = "▁", " ⁇ "
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BITS = 21  # of a symbol: an id, or the size of the vocabulary plus a code point
RUNS = re.compile(" +[^ ]*")
NO_RANK = 1 << 22


def fields(data: bytes):
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at : at + size]
        at += size


class Table(dict):
    """The distinct-chunk table: chunk -> its row. Of each row the columns hold the number of ids, they as text, and what they decode to. A chunk asked for the first time gets the next row, and stands in new until that is filled in."""

    def __init__(self):
        super().__init__()
        self.columns: tuple[list[int], list[str], list[str]] = ([], [], [])
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        row = self[chunk] = len(self)
        self.new.append(chunk)
        return row


class PieceBpe:
    """Encoder and decoder of a model file's content."""

    def __init__(self, model: bytes):
        pieces, trainer, normal = [], {}, {}
        for kind, value in fields(model):
            if kind == 1:
                pieces.append(dict(fields(value)))
            elif kind == 2:
                trainer = dict(fields(value))
            elif kind == 3:
                normal = dict(fields(value))
        self.names = [p[1].decode("utf-8") for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != 2 or not trainer.get(35) or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or self.kinds.count(BYTE) != 256:
            raise ValueError("only pair-merging models with byte fallback and without user-defined or unused pieces are read")
        if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1) or trainer.get(24):
            raise ValueError("only models that keep all white space, mark it and map no characters are read")
        size = self.size = len(pieces)
        scores = np.array([np.frombuffer(p[2], "<f4")[0] if 2 in p else 0.0 for p in pieces], dtype=np.float32)
        order = np.unique(-scores, return_inverse=True)[1]  # equal scores, equal ranks
        known = {s: i for i, s in enumerate(self.names) if self.kinds[i] == NORMAL}
        self.bytes = np.zeros(256, dtype=np.int64)
        self.of_byte: dict[int, int] = {}
        for i, s in enumerate(self.names):
            if self.kinds[i] == BYTE:
                self.bytes[int(s[3:5], 16)] = i
                self.of_byte[i] = int(s[3:5], 16)
        #: What an id decodes to (nothing for a byte, which needs its neighbours), and its number as text.
        self.texts = [None if k == BYTE else s.replace(MARK, " ") if k == NORMAL else UNKNOWN_TEXT if k == UNKNOWN else "" for s, k in zip(self.names, self.kinds)]
        self.numbers = list(map(str, range(size)))
        self.crossing = any(MARK in s.lstrip(MARK) for s in known)
        self.char = np.arange(0x110000, dtype=np.int64) + size
        for s, i in known.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        symbol = lambda s: known[s] if s in known else int(self.char[ord(s)]) if len(s) == 1 else None
        found = {}
        for s, i in known.items():
            for cut in range(1, len(s)):
                left, right = symbol(s[:cut]), symbol(s[cut:])
                if left is not None and right is not None:
                    found[left << BITS | right] = i
        self.keys = np.array(sorted(found), dtype=np.int64)
        self.made = np.array([found[k] for k in self.keys.tolist()], dtype=np.int64)
        self.rank = order[self.made].astype(np.int64) if len(self.keys) else np.zeros(0, dtype=np.int64)
        self.table = Table()

    # ---- segmenting ------------------------------------------------------------------------------------------------

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair of symbols: the rank of the joined piece (NO_RANK if there is none), and the piece."""
        if not len(self.keys):
            return np.full(len(left), NO_RANK), np.zeros(len(left), dtype=np.int64)
        key = left << BITS | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK), self.made[at]

    def expand(self, symbols: list[int]) -> list[int]:
        """Ids, with the bytes of characters outside the vocabulary."""
        if not symbols or max(symbols) < self.size:
            return symbols
        out: list[int] = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            else:
                out += [int(self.bytes[b]) for b in chr(s - self.size).encode("utf-8", "surrogatepass")]
        return out

    def by_heap(self, sym: np.ndarray) -> list[int]:
        """One long chunk: a heap of (rank, place) over a linked list."""
        ids, n = sym.tolist(), len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank, made = self.pairs(sym[:-1], sym[1:])
        heap = [(int(rank[i]), int(i), ids[i], ids[i + 1], int(made[i])) for i in np.flatnonzero(rank < NO_RANK)]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = piece, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    a, b = ids[k], ids[after[k]]
                    at = int(np.searchsorted(self.keys, a << BITS | b))
                    if at < len(self.keys) and self.keys[at] == a << BITS | b:
                        heapq.heappush(heap, (int(self.rank[at]), k, a, b, int(self.made[at])))
        return [s for s, ok in zip(ids, alive) if ok]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk (with its markers)."""
        out: list[list[int]] = [[] for _ in chunks]
        short = []
        for n, c in enumerate(chunks):
            if len(c) > LONG:
                out[n] = self.expand(self.by_heap(self.symbols(c)))
            elif c:
                short.append(n)
        if not short:
            return out
        sym = self.symbols("".join([chunks[n] for n in short]))
        word = np.repeat(np.array(short, dtype=np.int64), [len(chunks[n]) for n in short])
        rank, made = np.full(len(sym), NO_RANK), np.zeros(len(sym), dtype=np.int64)
        rank[:-1], made[:-1] = self.pairs(sym[:-1], sym[1:])
        rank[:-1][word[:-1] != word[1:]] = NO_RANK
        while len(sym):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[head, len(sym)])
            best = np.minimum.reduceat(rank << 40 | np.arange(len(sym)), head)  # the leftmost of the best
            over = best >= NO_RANK << 40
            if over.any():
                gone = np.repeat(over, sizes)
                flat, ends = sym[gone], np.cumsum(sizes[over]).tolist()
                plain, flat = bool((flat < self.size).all()), flat.tolist()
                for n, lo, hi in zip(word[head[over]].tolist(), [0, *ends], ends):
                    out[n] = flat[lo:hi] if plain else self.expand(flat[lo:hi])
                place = np.cumsum(~gone) - 1
                hit = place[(best & ((1 << 40) - 1))[~over]]
                sym, word, rank, made = (x[~gone] for x in (sym, word, rank, made))
            else:
                hit = best & ((1 << 40) - 1)
            if not len(sym):
                break
            sym[hit] = made[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))  # one symbol before each goes: hits ascend, one for each chunk
            sym, word, rank, made = (x[keep] for x in (sym, word, rank, made))
            for at in (hit, hit[hit > 0] - 1):
                at = at[at < len(sym) - 1]
                rank[at], made[at] = self.pairs(sym[at], sym[at + 1])
                rank[at[word[at] != word[at + 1]]] = NO_RANK
            last = hit[hit == len(sym) - 1]
            rank[last] = NO_RANK
        return out

    def symbols(self, chunk: str) -> np.ndarray:
        return self.char[np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), dtype="<u4")]

    # ---- texts -----------------------------------------------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text that is not empty, each without its first marker, its other markers as blanks."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if self.crossing:
            return [text]
        if "  " in text or text[0] == " ":
            return [c[1:] for c in RUNS.findall(" " + text)]
        return text.split(" ")

    def encode(self, text: str) -> list[int]:
        """The ids of a text; no begin or end ids."""
        return list(chain.from_iterable(self.segment([MARK + c.replace(" ", MARK) for c in self.chunks(text)]))) if text else []

    def surface(self, ids: list[int]) -> str:
        """What ids stand for, the first marker included. Bytes that are no UTF-8 become replacement characters, one for each byte."""
        try:
            return "".join([self.texts[i] for i in ids])
        except TypeError:
            out, at = [], 0
        while at < len(ids):
            end = at
            while end < len(ids) and ids[end] in self.of_byte:
                end += 1
            if end > at:
                raw, at = bytes([self.of_byte[i] for i in ids[at:end]]), end
                while raw:
                    n = next((n for n in (1, 2, 3, 4) if n <= len(raw) and whole(raw[:n])), 0)
                    out.append(raw[:n].decode("utf-8") if n else "�")
                    raw = raw[n or 1 :]
            else:
                out.append(self.texts[ids[at]])
                at += 1
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids. The marker that encoding puts before a text goes, if the first id that has a text begins with one."""
        head = next((i for i in ids if self.kinds[i] != CONTROL), None)
        out = self.surface(ids)
        return out[1:] if head is not None and self.kinds[head] == NORMAL and self.names[head].startswith(MARK) else out

    def digest(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: the number of its ids, they as text, and what they decode to."""
        if len(self.table) > CACHE:
            self.table = Table()
        table = self.table
        rows = [[table[c] for c in self.chunks(t)] if t else [] for t in texts]
        new, table.new = table.new, []
        sizes, numbers, surfaces = table.columns
        for ids in self.segment([MARK + c.replace(" ", MARK) for c in new]):
            sizes.append(len(ids))
            numbers.append(",".join([self.numbers[i] for i in ids]))
            surfaces.append(self.surface(ids))
        return [(sum([sizes[r] for r in row]), ",".join([numbers[r] for r in row]), "".join([surfaces[r] for r in row])[1:]) for row in rows]


def whole(raw: bytes) -> bool:
    """Whether bytes are exactly one character."""
    try:
        return len(raw.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(df: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Ids of every text: key, n_tokens, digests of ids and decoded text (and, with keep_ids, both themselves).

    model: path of the model file on the driver. Its content (half a megabyte, a fixed size) is broadcast.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(model, "rb") as f:
        content = f.read()
    PieceBpe(content)  # refused here, not in a task
    shared = spark.sparkContext.broadcast(content)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        bpe = PieceBpe(shared.value)
        for b in batches:
            got = bpe.digest(b.column(1).to_pylist())
            cols = [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([_sha(g[1]) for g in got], pa.string()), pa.array([_sha(g[2]) for g in got], pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array([[int(i) for i in g[1].split(",")] if g[1] else [] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if keep_ids else "")
    return df.select(key, text).mapInArrow(run, schema)
