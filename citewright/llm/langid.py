"""Language identification: words first, then ever shorter character n-grams.

A known word adds its log relative frequency in each language. A word never seen in training falls back: at each of
its places the longest known n-gram (GRAMS down to 1 characters, with word boundaries) that starts there counts, and the places are
averaged, so that a word weighs as much as a known one. The language with the largest sum wins.

Training counts words over a sample of labelled rows: of each language at most PER_LANG rows in expectation, picked by
a hash of the id, so every size of table takes the same path. n-grams are counted over all words of the sample, by executors, each word with
the root of its number. The model, which is what the driver holds and broadcasts, has WORDS / L words and GRAM_TABLE / L n-grams of each length for each of L
languages, the most frequent ones: the more languages there are, the fewer each has. Prediction reads whole texts.

A word is a run of letters (Unicode category L) with their combining marks.

Defined cases: null text, or text without a letter (digits, fractions, circled numbers): `und`, score 0; letters of which nothing is known: the first
learned language by name, score 1 / number of languages; ties: the first by name; repeated rows give repeated results; very long texts are read whole;
a row without a language teaches nothing; with nothing to learn from, every result is `und` with score 0; extra columns never enter, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.llm.common import crc_bucket, cut, small_batches

PER_LANG, WORDS, GRAMS, GRAM_TABLE, CACHE = 1500, 120_000, 5, 24_000, 250_000
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The same for lower-cased text below U+0100, by the faster engine of the standard library.
LATIN = re.compile("[a-zªµºß-öø-ÿ]+")


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (LATIN if text.isascii() or max(text) < "\u0100" else LETTERS).findall(text)


def grams_of(word: str) -> list[str]:
    """Its n-grams, boundaries included."""
    w = f"^{word}$"
    return [w[i : i + n] for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1)]


class LanguageModel:
    """Log relative frequencies of words and n-grams: one row of `table` for each, one column for each language."""

    def __init__(self, words: list[tuple[str, str, float]], grams: list[tuple[str, str, float]]):
        """(language, word or n-gram, weight) of those that the model keeps."""
        self.langs = sorted({c[0] for c in words})
        at = {x: i for i, x in enumerate(self.langs)}
        tables: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(at))) for _ in range(GRAMS + 1)]
        for lang, word, n in words:
            tables[0][word][at[lang]] += n
        for lang, gram, n in grams:
            if lang in at:
                tables[len(gram)][gram][at[lang]] += n
        self.words, *rest = map(self._logs, tables)
        self.grams = {g: v for table in rest for g, v in table.items()}

    def __getstate__(self) -> tuple:
        """Names and one matrix: small on the wire and in a worker."""
        pack = lambda t: ("\n".join(t), np.stack(list(t.values())) if t else np.zeros((0, len(self.langs)), dtype=np.float32))
        return self.langs, pack(self.words), pack(self.grams)

    def __setstate__(self, state: tuple) -> None:
        self.langs, *tables = state
        self.words, self.grams = (dict(zip(names.split("\n"), rows)) if len(rows) else {} for names, rows in tables)

    @staticmethod
    def _logs(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if not table:
            return {}
        m = np.stack(list(table.values()))
        p = np.log((m + 0.5) / (m.sum(0) + 0.5 * len(m)))
        p -= p.max(1, keepdims=True)  # what counts is the difference between languages
        return dict(zip(table, np.maximum(p, -8.0).astype(np.float32)))

    def unseen(self, word: str) -> np.ndarray:
        w, get = f"^{word}$", self.grams.get
        total, places = np.zeros(len(self.langs), dtype=np.float32), 0
        for i in range(len(w) - 1):
            for n in range(min(GRAMS, len(w) - i), 1 if i == 0 else 0, -1):  # a boundary alone tells nothing
                v = get(w[i : i + n])
                if v is not None:
                    total = total + v
                    places += 1
                    break
        return total / max(places, 1)


class Scorer(dict):
    """Word -> row of its evidence. What was not learned is worked out once and kept while there is room."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.rows = np.zeros((1 << 16, max(1, len(model.langs))), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        known = self.model.words.get(word)
        self.rows[i] = self.model.unseen(word) if known is None else known
        self[word] = i
        return i

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs = self.model.langs
        if len(self) > CACHE:
            self.clear()
        words = [words_of(t) if t else [] for t in texts]
        n = np.array([len(w) for w in words], dtype=np.int64)
        if not langs or not n.any():
            return ["und"] * len(texts), [0.0] * len(texts)
        ids = np.fromiter((self[w] for ws in words for w in ws), dtype=np.int64, count=int(n.sum()))
        full = np.flatnonzero(n)
        start = np.r_[0, np.cumsum(n)[:-1]][full]
        total = np.stack([np.add.reduceat(self.rows[:, k][ids].astype(np.float64), start) for k in range(len(langs))], axis=1)
        best = total.argmax(1)
        p = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        name, score = ["und"] * len(texts), [0.0] * len(texts)
        for k, i in enumerate(full):
            name[i], score[i] = langs[best[k]], float(min(1.0, p[k]))
        return name, score


def train(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> LanguageModel:
    """labelled: rows to learn from. Rows without text or language are left out."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], [])
    rate = F.create_map(*[F.lit(x) for lang_, n in sizes.items() for x in (lang_, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(draw < F.element_at(rate, F.col("l"))).select("l", "t")

    def count(batches):
        for b in batches:
            got: dict[str, Counter] = defaultdict(Counter)
            for l_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[l_].update(words_of(t))
            flat = [(l_, w, n) for l_, c in got.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64())], names=["l", "w", "n"])

    small_batches(labelled.sparkSession)
    counts = sample.mapInArrow(count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    counts = cut(counts)

    def spell(batches):
        for b in batches:
            got: dict[tuple[str, str], float] = defaultdict(float)
            for l_, w, n in zip(*(c.to_pylist() for c in b.columns)):
                for g in grams_of(w):
                    got[l_, g] += n**0.5  # damped: common words must not decide alone what unseen words look like
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()), pa.array(list(got.values()), pa.float64())], names=["l", "w", "n"])

    grams = counts.mapInArrow(spell, "l string, w string, n double").groupBy("l", "w").agg(F.round(F.sum("n"), 6).alias("n"))  # rounded: sums of doubles depend on their order

    def heaviest(rows: DataFrame, most: int, *by) -> list[tuple[str, str, float]]:
        ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("l", *by).orderBy(F.desc("n"), "w")))
        return [(r["l"], r["w"], r["n"]) for r in ranked.filter(F.col("r") <= max(1, most // len(sizes))).select("l", "w", "n").collect()]

    return LanguageModel(heaviest(counts, WORDS), heaviest(grams, GRAM_TABLE, F.length("w")))


def identify(df: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """key, language and score (under `names`) of every row, and the columns named in extra, unchanged."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [key, *extra]
    cols = keep if text in keep else [*keep, text]
    where, n = cols.index(text), len(keep)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            lang, score = scorer.predict(b.column(where).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*[f"c{i}" for i in range(n)], "lang", "score"])

    # columns go by place: the caller's names may clash with ours
    schema = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", lang string, score double"
    out = df.select(*cols).mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("lang").alias(names[0]), F.col("score").alias(names[1]))


def held_out(key: str = "doc_id") -> Column:
    return crc_bucket(key, 4) == 2


def identify_documents(df: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    model = train(df.filter(~held_out()))
    return identify(df, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
