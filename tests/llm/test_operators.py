"""The ten operators against brute force on small tables with every odd case."""

import hashlib
import json
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from citewright.llm import bpe, components, decontam, epsgrid, htmlwrap, langid, lmscore, ngramjoin, sharding, toxicity, warc
from citewright.llm import queries as llm
from tests.conftest import normal, rows_of

random.seed(5)
SYLLABLES = "ba ko ri tu le mo na si".split()


def word():
    return "".join(random.choices(SYLLABLES, k=random.randint(1, 3)))


def prose(n):
    return " ".join(word() for _ in range(n))


def documents(spark, rows, extra=True):
    """doc_id, text, and columns whose names operators use themselves."""
    kind = "doc_id long, text string, lang string, source string" + (", score double, sid long, k string, n int" if extra else "")
    return spark.createDataFrame([(d, t, lang, "s") + ((1.0, 2, "k", 3) if extra else ()) for d, t, lang in rows], kind)


EMPTY = []


@pytest.mark.parametrize("name", sorted(set(llm.ORACLES)))
def test_query_equals_sql(spark, sf, duck, name):
    df = llm.QUERIES[name](spark, sf)
    r = duck.execute(llm.ORACLES[name])
    names, data = [d[0] for d in r.description], r.fetchall()
    cols = sorted(df.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows_of(df, *cols) == sorted((tuple(normal(x[i]) for i in at) for x in data), key=repr)


# ---- 1 -----------------------------------------------------------------------------------------------------------------


def test_language(spark):
    a = ["le chat et la souris de la maison", "une maison et le chat de la rue"]
    b = ["the cat and the mouse of the house", "a house and the cat of the road"]
    rows = [(i, random.choice(a if i % 2 else b), "fr" if i % 2 else "en") for i in range(80)]
    odd = [(100, None, "fr"), (101, "", "en"), (102, "12 34 !?", "en"), (103, "souris", None), (104, "日本", None), (104, "日本", None), (105, "the cat " * 50_000, None), (None, "the house", "en"), (106, "mouses", None)]
    out = langid.identify_documents(documents(spark, rows + odd)).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "fr" and got[104] == ("en", 0.5) and got[105][0] == got[106][0] == "en" and got[None][0] == "en"
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out if r["doc_id"] is not None)


@pytest.mark.parametrize("words,grams", [(120_000, 24_000), (60, 40)])
def test_language_equals_brute_force(spark, monkeypatch, words, grams):
    """The rule of the docstring in plain Python; three alphabets, combining marks, numerals that are no letters, words beyond the model."""
    monkeypatch.setattr(langid, "WORDS", words)
    monkeypatch.setattr(langid, "GRAM_TABLE", grams)
    rng = random.Random(8)
    alphabets = {"aa": ["ka", "lo", "mi", "é", "ß"], "bb": ["ka", "ru", "te", "n\u0303a", "ο"], "cc": ["世", "界", "語", "ka"]}
    say = lambda lang: " ".join("".join(rng.choices(alphabets[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12)))
    rows = [(i, say(lang), lang) for i, lang in enumerate(rng.choices(sorted(alphabets), k=150))]
    rows += [(500, "½ ² Ⅳ ①", None), (501, "½ka²lo", None), (502, None, "aa"), (503, "qqq zzz", None), (504, "世" * 3000, "cc")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify_documents(documents(spark, rows)).collect()}
    letters = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
    spell = lambda w: [f"^{w}$"[i : i + n] for n in range(1, 6) for i in range(len(w) + 3 - n)]
    count = {lang: Counter() for lang in alphabets}
    for d, t, lang in rows:
        if lang and zlib.crc32(str(d).encode()) % 4 != 2:
            count[lang].update(letters(t))
    heaviest = lambda c, most: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: max(1, most // 3)])
    tables = [{lang: heaviest(c, words) for lang, c in count.items()}]
    for n in range(1, 6):
        made = {lang: Counter() for lang in count}
        for lang, c in count.items():
            for w, k in c.items():
                for g in spell(w):
                    if len(g) == n:
                        made[lang][g] += k**0.5
        tables.append({lang: heaviest({g: round(x, 6) for g, x in c.items()}, grams) for lang, c in made.items()})

    def logs(table, x):
        known = set().union(*table.values())
        if x not in known:
            return None
        p = [math.log((table[lang].get(x, 0) + 0.5) / (sum(table[lang].values()) + 0.5 * len(known))) for lang in sorted(table)]
        return [max(v - max(p), -8) for v in p]

    def evidence(w):
        known = logs(tables[0], w)
        if known:
            return known
        x, places = f"^{w}$", []
        for i in range(len(x) - 1):
            hits = [v for n in range(5, 1 if i == 0 else 0, -1) if i + n <= len(x) and (v := logs(tables[n], x[i : i + n]))]
            places += hits[:1]
        return [sum(v[k] for v in places) / max(1, len(places)) for k in range(3)]

    for d, t, _ in rows:
        ws = letters(t)
        if not ws:
            assert got[d] == ("und", 0.0)
            continue
        total = [sum(evidence(w)[k] for w in ws) for k in range(3)]
        top = max(total)
        assert got[d][0] in [lang for lang, x in zip(sorted(alphabets), total) if x >= top - 1e-3], d
        assert math.isclose(got[d][1], 1 / sum(math.exp(x - top) for x in total), abs_tol=1e-3)


def test_language_without_training(spark):
    assert langid.identify_documents(documents(spark, [(1, "a b", None)])).first()["lang_pred"] == "und"
    assert langid.identify_documents(documents(spark, EMPTY)).count() == 0


def test_held_out_languages(spark):
    df = llm.QUERIES["op1_langid"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").filter("held_out")
    assert df.filter("lang = lang_pred").count() >= 0.98 * df.count()


# ---- 2 -----------------------------------------------------------------------------------------------------------------


def vectors():
    rng = np.random.RandomState(3)
    rows = []
    for label in (0, 1):
        centre = rng.randn(6, 16)
        for i in range(150):
            rows.append((label * 1000 + i, (centre[i % 6] * rng.uniform(0.5, 2) + rng.randn(16) * rng.choice([0.01, 0.08, 0.5])).astype(np.float32).tolist(), label))
    same = rows[0][1]
    rows += [(5000 + i, same, 0) for i in range(40)] + [(6000, same, 1), (6001, same, None), (6002, None, 0), (6003, [0.0] * 16, 0), (6004, [float("nan")] + [1.0] * 15, 0), (6005, [None] + [1.0] * 15, 0), (6006, same[:8], 0), (6007, [float("inf")] + [1.0] * 15, 0), (6008, [], 0), (6009, [x * 3 for x in same], 0)]
    return rows


def brute_vectors(rows, least):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, parent = Counter(), {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, v, lab) in enumerate(rows):
        for j, w, lab2 in rows[a + 1 :]:
            if lab is not None and lab == lab2 and ok(v) and ok(w) and len(v) == len(w):
                x, y = np.array(v, dtype=np.float64), np.array(w, dtype=np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    n[i] += 1
                    n[j] += 1
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return {i: (n[i], find(i), find(i) == i) for i, _, _ in rows}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(epsgrid, "SEGMENT", 32)
    monkeypatch.setattr(epsgrid, "LEAF", 8)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(7)).withColumn("seg", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in epsgrid.near_duplicates(df, 0.98).collect()}
    assert got == brute_vectors(rows, 0.98)
    assert epsgrid.near_duplicates(df.limit(0), 0.98).count() == 0


def test_vectors_with_clashing_hashes(spark, monkeypatch):
    """One of the two hashes is the same for all: the other still tells vectors apart."""
    rng = np.random.RandomState(9)
    rows = [(i, rng.randn(8).round(1).tolist(), 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], 1) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(epsgrid.near_duplicates(df, 0.9).collect())
    for k in range(2):
        plain = epsgrid.identity
        monkeypatch.setattr(epsgrid, "identity", lambda v, k=k, plain=plain: tuple(F.lit(0).cast("long") if i == k else x for i, x in enumerate(plain(v))))
        assert sorted(epsgrid.near_duplicates(df, 0.9).collect()) == want
        monkeypatch.undo()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = ((x @ x.T) >= 0.9).sum(1) - 1
    assert [r["n_links"] for r in want] == links.tolist()


def test_components(spark, monkeypatch):
    links = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(links, "src long, dst long")
    for base in (500_000, 0):  # in one task, and by star contraction alone
        monkeypatch.setattr(components, "BASE", base)
        got = {r["node"]: r["component"] for r in components.components(df).collect()}
        assert got == {x: find(x) for x in parent}


# ---- 3 -----------------------------------------------------------------------------------------------------------------


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "TOP", 30)
    rows = [(i, prose(random.randint(0, 40)).title(), "x") for i in range(120)]
    rows += [(200, None, "x"), (201, "", "x"), (202, " \t\n\x0b\x0c\r ", "x"), (203, "É é\x1c\xa0x", "x"), (203, "É é\x1c\xa0x", "x"), (204, prose(30_000), "x"), (None, "ba ko", "x")]
    out = lmscore.score_documents(documents(spark, rows)).collect()
    counts = Counter()
    held = lambda d: zlib.crc32(("null" if d is None else str(d)).encode()) % 10 == 0
    split = lambda t: (t or "").encode().lower().split() + [b""]
    for d, t, _ in rows:
        if not held(d):
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(d), held(d), len(split(t)), sum(counts[w] > 0 for w in split(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)), 6)) for d, t, _ in rows)
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert lmscore.score_documents(documents(spark, EMPTY)).count() == 0


def smoothed(train):
    """p(word, history) by brute force: the history as a tuple of at most two words; None is any unseen word."""
    count = Counter(tuple(t[i : i + n]) for t in train for n in (1, 2, 3) for i in range(len(t) - n + 1))
    n, v = sum(len(t) for t in train), len({w for t in train for w in t})

    def p(w, history):
        if not history:
            return (count[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        a = {1: lmscore.AFTER_WORD, 2: lmscore.AFTER_PAIR}[len(history)]
        return (count[(*history, w)] + a * p(w, history[1:])) / (count[history] + a)

    return p


def test_model_equals_brute_force(spark, monkeypatch):
    """Also of n-grams seen once, of texts with a held-out copy, and of groups of copies; chunks and buckets of a few texts."""
    monkeypatch.setattr(lmscore, "TOP", 30)
    monkeypatch.setattr(lmscore, "CHUNK", 3000)
    rows = [(i, prose(random.randint(0, 60)), "x") for i in range(150)]
    rare = [" ".join(f"rare{i}x{j}" for j in range(12)) for i in range(20)]
    rows += [(1000 + 10 * i + k, t, "x") for i, t in enumerate(rare) for k in range(i % 8)]
    got = {r["doc_id"]: r["score"] for r in lmscore.score_documents(documents(spark, rows).repartition(5)).collect()}
    texts = {d: t.encode().lower().split() + [b""] for d, t, _ in rows}
    p = smoothed([t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 10])
    want = {d: sum(math.log10(p(w, tuple(t[max(0, i - 2) : i]))) for i, w in enumerate(t)) for d, t in texts.items()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], abs_tol=1e-6) for d in got)
    # a text that stands twice in training is likelier than one that stands once
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 10]
    once, twice = ([d for d in train if sum(texts[d] == texts[e] for e in train) == n and len(texts[d]) == 13 and texts[d][0][:4] == b"rare"] for n in (1, 2))
    assert once and twice and max(got[d] for d in once) < min(got[d] for d in twice)


def test_words_are_told_apart_whatever_hashes_n_grams_have(spark, monkeypatch):
    """With n-gram keys of a few bits, what is counted of words stays exact."""
    monkeypatch.setattr(lmscore, "CHUNK", 3000)
    rows = [(i, " ".join(f"w{random.randrange(2000)}" for _ in range(random.randint(0, 60))), "x") for i in range(150)]
    df = documents(spark, rows).repartition(3)
    told = lambda: {r["doc_id"]: (r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in lmscore.score_documents(df).collect()}
    scores = lambda: sorted(round(r["score"], 6) for r in lmscore.score_documents(df).collect())
    want, plain = told(), scores()
    monkeypatch.setattr(lmscore, "WIDTH", 12)
    assert told() == want and scores() != plain
    counts = Counter(w for d, t, _ in rows if zlib.crc32(str(d).encode()) % 10 for w in t.encode().split() + [b""])
    assert all(want[d][:2] == (sum(counts[w] > 0 for w in t.encode().split() + [b""]), sum(counts.values())) for d, t, _ in rows)


def test_probabilities_after_a_history_sum_to_one():
    random.seed(3)
    train = [[str(min(9, int(random.paretovariate(1)))).encode() for _ in range(random.randint(0, 30))] + [b""] for _ in range(80)]
    p, known = smoothed(train), {w for t in train for w in t}
    for history in ((), (b"1",), (b"1", b"2"), (b"9", b"9"), (b"z", b"1"), (b"z",)):
        assert math.isclose(sum(p(w, history) for w in [*known, None]), 1, abs_tol=1e-9)


def test_model_beats_unigrams_on_held_out_texts(spark):
    r = llm.QUERIES["op3_lm"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# ---- 4 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def test_bpe_equals_library(spark, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    texts = [None, "", " ", "Hello WORLD's it'll<|endoftext|>foo <|startoftext|>", "ΑΣΣ Σ İstanbul ﬁ é é", "a" * 5000, "x1y2" * 300, "日本語 12345 ½ 😀!!", "it'Ss don't", "\x1c\x85 c　d", "é" * 600]
    texts += ["".join(chr(random.choice([random.randint(1, 126), random.randint(160, 0x24F), random.randint(0x391, 0x3C9), 0x4E2D, 32, 39, 115])) for _ in range(random.randint(0, 80))) for _ in range(300)]
    df = documents(spark, [(i, x, "x") for i, x in enumerate(texts)] + [(0, None, "x")]).withColumn("n_tokens", F.lit(1))
    out = bpe.encode_documents(df, vocabulary, keep_ids=True).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        e = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == e and r["n_tokens"] == len(e) and r["decoded"] == t.decode(e, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), vocabulary).count() == 0


def test_bpe_cache_changes_nothing(vocabulary, monkeypatch):
    with open(vocabulary) as f:
        spec = f.read()
    texts = [prose(50) for _ in range(40)]
    want = bpe.WordBpe(spec).digest(texts)
    monkeypatch.setattr(bpe, "CACHE", 5)
    small = bpe.WordBpe(spec)
    assert [small.digest([t])[0] for t in texts] == want
    long = bpe.WordBpe(spec)
    assert long.merge(["abcab" * 40])[0] == long.merge_long(long._start("abcab" * 40))


# ---- 5 -----------------------------------------------------------------------------------------------------------------


def near_copies():
    rows, i = [], 0
    for size in (9, 30, 80, 250, 600, 1500):
        for _ in range(3):
            base = prose(size).split()
            for edits in (0, 0, 1, 1, 2, 3, size // 60, size // 40, size // 30, size // 25, size // 20, size // 12):
                ws = list(base)
                for _ in range(edits):
                    ws[random.randrange(len(ws))] = word()
                rows.append((i, " ".join(ws), "x"))
                i += 1
    passage = prose(30)
    rows += [(i + k, passage + " " + prose(random.randint(5, 60)), "x") for k in range(40)]
    rows += [(3000, None, "x"), (3001, "", "x"), (3002, " \t ", "x"), (3003, "one", "x"), (3004, "ONE", "x"), (3005, "one two three four", "x"), (3006, "one two three four five", "x"), (3006, "one two three four five", "x"), (3007, "É one", "x"), (3008, "é one", "x"), (None, "one", "x")]
    # a row without id links two others, which do not link
    bridge = [f"bridge{i}" for i in range(60)]
    rows += [(4000, " ".join(bridge[:54]), "x"), (None, " ".join(bridge), "x"), (4001, " ".join(bridge[6:]), "x"), (None, prose(40), "x"), (4002, prose(40), "x")]
    return rows


def brute_jaccard(rows):
    sets = []
    for _, t, _ in rows:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(a)] = min(d, least.get(find(a), d))
    return sorted((repr(d), len(sets[a]), least.get(find(a))) for a, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("few,block,fine", [(12, 200_000, 200), (2, 400, 40)])
def test_jaccard(spark, monkeypatch, few, block, fine):
    monkeypatch.setattr(ngramjoin, "FEW", few)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    rows = near_copies()
    out = ngramjoin.join(documents(spark, rows)).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in out) == brute_jaccard(rows)


def test_jaccard_of_nothing(spark):
    assert ngramjoin.join(documents(spark, EMPTY)).count() == 0


def test_one_deletion_finds_what_probes_skip():
    rng = np.random.RandomState(2)
    s = np.unique(rng.randint(0, 2**63, 400).astype(np.uint64))
    cost = np.full(len(s), 1000.0)
    cost[: len(s) // 3] = 1
    roles = [r for _, role in ngramjoin.signatures(s, cost) for r in role.tolist()]
    assert any(r & ngramjoin.GROW for r in roles) and any(r & ngramjoin.SHRUNK for r in roles)
    taken, up = ngramjoin.choose(np.array([1.0, 50, 50, 1]), np.array([3, 3, 3, 2]), np.array([True, True, False, False]), 3)
    assert set(taken) == {0, 3} and set(up) == {0}


def run_batches(run, size):
    """Rows (n, set, roles) of one signature as the reader gets them."""
    rows = sorted((n << 8 | ngramjoin.LATE - r, sid) for n, sid, r in run)
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        yield pa.RecordBatch.from_arrays([pa.array([7] * len(part), pa.int64()), pa.array([p for p, _ in part], pa.int64()), pa.array([sid for _, sid in part], pa.int64()), pa.array([None] * len(part), pa.int64())], names=["sig", "packed", "sid", "doc"])


@pytest.mark.parametrize("size", [3, 50, 100_000])
def test_runs_of_many_signatures(size):
    """Brute force over runs side by side, cut into batches anywhere: what may match is a candidate or goes to the later check, and candidates of two-row runs may match."""
    I, P, G, S, D = ngramjoin.INDEX, ngramjoin.PROBE, ngramjoin.GROW, ngramjoin.SHRUNK, ngramjoin.DELETED  # noqa: E741
    draw, rows = random.Random(5), []
    for sig in range(2000):
        rows += [(sig, draw.randint(90, 120), draw.randint(1, 4), draw.choice((I, I | P, I | G, D, D | S))) for _ in range(draw.choice((1, 2, 2, 2, 3, 5)))]
    order = sorted((sig, n << 8 | ngramjoin.LATE - r, sid) for sig, n, sid, r in rows)
    batches = (pa.RecordBatch.from_arrays([pa.array([x[i] for x in order[at : at + size]], pa.int64()) for i in range(3)] + [pa.array([None] * len(order[at : at + size]), pa.int64())], names=["sig", "packed", "sid", "doc"]) for at in range(0, len(order), size))
    got = [r for b in ngramjoin.runs(batches) for r in b.to_pylist()]
    pairs, later = {(r["a"], r["b"]) for r in got if r["kind"] == 0}, {(r["a"], r["b"]) for r in got if r["kind"] == 1}
    assert all(a < b for a, b in pairs)
    by = {}
    for sig, n, sid, r in rows:
        by.setdefault(sig, []).append((n, sid, r))
    for sig, run in by.items():
        for n, p, r in run:
            for m, q, t in run:
                if p != q and n <= m and n * 5 >= m * 4 and (r & (P | S) and t & I or r & G and t & D):
                    assert (min(p, q), max(p, q)) in pairs or {(sig, p), (sig, q)} <= later, run


def test_a_run_of_a_million_sets_takes_constant_memory():
    rng = np.random.RandomState(1)

    def batches(rows, asks):
        n, sid = np.sort(rng.randint(80, 120, rows)), rng.randint(0, 2**62, rows)
        role = np.where(rng.rand(rows) < asks, ngramjoin.INDEX | ngramjoin.PROBE, ngramjoin.INDEX)
        packed = np.sort(n << 8 | ngramjoin.LATE - role)
        for at in range(0, rows, 20_000):
            k = slice(at, at + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid[k]), 7)), pa.array(packed[k]), pa.array(sid[k]), pa.array([None] * len(sid[k]), pa.int64())], names=["sig", "packed", "sid", "doc"])

    def held(rows, asks):
        ready = list(batches(rows, asks))
        tracemalloc.start()
        seen = [0, 0, 0]
        for b in ngramjoin.runs(ready):
            for k, c in Counter(b.column(0).to_pylist()).items():
                seen[k] += c
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak / 1e6, seen

    for asks in (0.0, 1e-5, 0.3):
        peak, seen = held(1_000_000, asks)
        assert peak < 60, (asks, peak)  # mostly the rows that wait to be written
        assert (seen[0] > 900_000 and seen[1] > 900_000) if asks == 0.3 else seen[1] <= 1_000_000
    assert held(1_000_000, 0.0)[1] == [0, 0, 0]


def test_runs_leave_no_pair_unmet():
    """Every pair of a run that may match is a candidate, or its whole run goes to the later check."""
    I, P, G, S, D = ngramjoin.INDEX, ngramjoin.PROBE, ngramjoin.GROW, ngramjoin.SHRUNK, ngramjoin.DELETED  # noqa: E741
    draw = random.Random(3)
    made = [[(134, 1, D | S), (134, 2, D | S), (135, 3, I)], [(120, 1, I | P), (134, 2, D | S), (135, 3, I)], [(134, 1, I | G), (134, 2, I | G), (135, 3, D)]]
    made += [[(draw.randint(80, 120), sid, draw.choice((I, I | P, I | G, D, D | S))) for sid in range(draw.randint(2, 6))] for _ in range(500)]
    for run in made:
        rows = [r for b in ngramjoin.runs(run_batches(run, draw.randint(1, 4))) for r in b.to_pylist()]
        pairs, later = {(r["a"], r["b"]) for r in rows if r["kind"] == 0}, {r["b"] for r in rows if r["kind"] == 1}
        for n, p, r in run:
            for m, q, t in run:
                if p != q and n <= m and n * 5 >= m * 4 and (r & (P | S) and t & I or r & G and t & D):
                    assert (min(p, q), max(p, q)) in pairs or {p, q} <= later, run


# ---- 6 -----------------------------------------------------------------------------------------------------------------


def test_shards_fit(spark):
    rows = [(i, "x" * random.randint(0, 300), "x") for i in range(500)] + [(7, "y" * 100, "x")] * 60 + [(900, "z" * 5000, "x")] * 2 + [(None, None, "x"), (901, None, "x"), (902, "é" * 100, "x")]
    df = documents(spark, rows).withColumn("shard", F.lit("mine"))
    out = sharding.assign(df, 1000).collect()
    assert len(out) == len(rows)
    size, many = Counter(), Counter()
    for r in out:
        size[r["shard"]] += r["n_bytes"]
        many[r["shard"]] += 1
    assert all(n <= 1000 or many[s] == 1 for s, n in size.items())
    assert Counter(repr(r["doc_id"]) for r in out) == Counter(repr(d) for d, _, _ in rows) and {r["n_bytes"] for r in out if r["doc_id"] == 902} == {200}
    depths = {r["shard"]: r["depth"] for r in out if r["shard"].count("-") == 1}
    for s, d in depths.items():  # a bucket was split only if it was too large: its sister and it exceed the limit together
        if d:
            p = int(s.split("-")[1]) >> 1
            inside = sum(r["n_bytes"] for r in out if r["shard"].count("-") == 1 and r["depth"] >= d and int(r["shard"].split("-")[1]) >> (r["depth"] - d + 1) == p)
            assert inside + sum(r["n_bytes"] for r in out if r["shard"].count("-") > 1) > 1000
    assert sharding.assign(df.limit(0), 1000).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(df, 0)


def test_shards_are_written(spark, tmp_path):
    df = documents(spark, [(i, prose(20), "x") for i in range(100)])
    sharding.write(df, str(tmp_path / "shards"), 2000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 100 and back.select("shard").distinct().count() > 3 and "score" in back.columns


# ---- 7 -----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big, twice = "<p>é" * 60_000, "a\r\n\r\nWARC/1.1\r\n" + "b" * 1500
    rows = [(1, "http://a/1", twice), (2, "http://a/2", twice), (9, None, twice), (9, None, twice), (3, "http://a/3\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "v", big + "x"), (None, "w", twice), (10, "t", "日" * 400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("first", F.lit(1))
    (tmp_path / "sf").mkdir()
    df.write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    got = sorted((repr(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, str(tmp_path / "sf")).collect())
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        revisit = h == twice and p != 9
        want.append((repr(p), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(want)
    path = str(tmp_path / "w")
    warc.write(df, path)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, path, texts=True).collect() if r["payload"] is not None}
    assert texts[7] == big and texts[9] == twice and texts[5] == ""
    parts = warc.load(spark, path).filter("s_id is not null").select(*[F.col(f"s_{c}").alias(c) for c in warc.names_of(warc.SEGMENTS)])
    assert parts.count() > 2
    with pytest.raises(Exception, match="not complete"):
        warc.reassemble(parts.filter("number != 2")).collect()
    whole = warc.load(spark, path).filter("s_id is null")
    with pytest.raises(Exception, match="no response for the revisit of page"):
        warc.resolve(whole.filter("record_type = 'revisit' or page_id != 9")).collect()


def test_warc_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.round_trip(spark, str(tmp_path)).count() == 0


def test_broken_records_are_named():
    good = warc.record("response", [("WARC-Record-ID", "<urn:x>")], b"HTTP/1.1 200 OK\r\n\r\nbody") + b"\r\n\r\n"
    assert [k for k, _, _ in warc.parse(good * 2)] == ["response"] * 2
    for bad in (good[:-3], good.replace(b"body", b"bo"), b"junk" + good):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
    assert warc.unchunk(warc.chunked("é".encode() * 20_000)) == "é".encode() * 20_000
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nabc\r\n0\r\n\r\n")


# ---- 8 -----------------------------------------------------------------------------------------------------------------

SHELL = '<!DOCTYPE html><html><head><title>t {i}</title><style>p{{}}</style></head><body><div class="cookie-bar">We use cookies {i}</div><nav><ul>{menu}</ul></nav>{body}<footer>&copy; x</footer></body></html>'


def test_pages(spark):
    menu = "".join(f'<li><a href="/{k}">m{k}</a></li>' for k in range(5))
    article = '<article><header><h1>Title {i}</h1><span>by x</span></header><p>One &amp; two<br>three <b>bo</b>ld</p><aside>side</aside><p>Last{i}<script>x("</p>")</script><section id="comments"><p>first!</p></section></article>'
    rows = [(i, f"http://a.org/{i}", SHELL.format(i=i, menu=menu, body=article.format(i=i))) for i in range(10)]
    plain = "<div><p>Same notice on every page</p></div><div><h2>Head {i}</h2><p>Body of {i}</p></div>"
    rows += [(100 + i, f"http://b.org/{i}", SHELL.format(i=i, menu=menu, body=plain.format(i=i))) for i in range(6)]
    rows += [(200, None, None), (201, "x", ""), (202, None, "no tags &lt;here&gt;\n at all"), (203, "http://c.org", "<p>cut off <b>in a t"), (203, "http://c.org", "<p>cut off <b>in a t"), (204, "http://d.org", "<body><article>" + "<p>long  text</p>" * 20_000), (None, "http://e.org", "<main>m</main>"), (205, "http://f.org", '<p title="a > b">q</p><!-- c > --><p>r')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("text", F.lit("y"))
    out = htmlwrap.extract(df).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    got = {r["page_id"]: r["text"] for r in out}
    assert all(got[i] == f"Title {i} by x One & two three bold Last{i}" for i in range(10))
    assert all(got[100 + i] == f"Head {i} Body of {i}" for i in range(6))  # the wrapper knows the notice
    assert got[200] == got[201] == "" and got[202] == "no tags <here> at all" and got[203] == "cut off in a t"[: len("cut off in a t")] and got[204] == " ".join(["long text"] * 20_000) and got[None] == "m" and got[205] == "q r"
    assert htmlwrap.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("shared", [20_000, 0])
def test_furniture_of_a_whole_host(spark, monkeypatch, shared):
    monkeypatch.setattr(htmlwrap, "SHARED", shared)
    monkeypatch.setattr(htmlwrap, "BUCKET", 10)
    page = "<body><div><p>Site menu</p></div><div><h2>Head {i}</h2>{more}<p>Body of {i}</p></div></body>"
    rows = [(i, f"http://copies.org/{i}", "<body><p>The same story</p><p>Its end</p></body>") for i in range(12)]
    rows += [(100 + i, f"http://many.org/{i}", page.format(i=i, more="<p>Passage</p>" if i % 2 else "")) for i in range(60)]
    rows += [(200, "http://many.org/empty", ""), (201, "http://many.org/other", "<body><h1>Other</h1></body>"), (202, "http://many.org/bare", "<body><div><p>Site menu</p></div></body>")]
    got = {r["page_id"]: r["text"] for r in htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "The same story Its end" for i in range(12))  # copies are one page
    assert all(got[100 + i] == f"Head {i} {'Passage ' if i % 2 else ''}Body of {i}" for i in range(60))
    assert got[200] == "" and got[201] == "Other" and got[202] == "Site menu"


def keys_of(stream):
    """The token string of a page, texts side by side as one."""
    out = []
    for t in stream:
        k = t.key if t.key != "#" else f"#{t.inside:d}{t.ours:d}{t.weak:d}"
        if (t.key != "#" or not t.text.isspace()) and not (t.key == "#" and out and out[-1] == k):
            out.append(k)
    return "".join(f"<{k}>" for k in out)


def pattern_of(nodes):
    """The regular expression that a wrapper stands for."""
    return "".join(f"(?:{pattern_of(n[1])}){n[0]}" if n[0] in "+?" else re.escape(f"<{n[1]}>") for n in nodes)


def test_wrappers_match_every_page_of_their_host(monkeypatch):
    """Brute force: as a regular expression the wrapper accepts each page that it was inferred from, and refuses another layout."""
    monkeypatch.setattr(htmlwrap, "ALIKE", 2.0)  # these pages are small enough to be near copies
    rng = random.Random(4)
    part = {
        "menu": lambda: "<ul>" + "<li><a>x</a></li>" * rng.randint(0, 4) + "</ul>",
        "text": lambda: "<p>" + rng.choice("abc") + "</p>",
        "many": lambda: f"<p>{rng.random()}</p>" * rng.randint(0, 5),
        "table": lambda: "<table>" + ("<tr>" + "<td>1</td>" * rng.randint(1, 3) + "</tr>") * rng.randint(0, 3) + "</table>",
        "box": lambda: rng.choice(["", "<div class='q'><h2>t</h2>b</div>", "<div class='q'><h2>t</h2></div>"]),
        "bare": lambda: rng.choice(["", "word", "<b>w</b> x<hr>"]),
    }
    for _ in range(150):
        layout = rng.choices(sorted(part), k=rng.randint(1, 6))
        pages = [htmlwrap.tokens("<body>" + "".join(part[k]() for k in layout if rng.random() < 0.9) + "</body>") for _ in range(rng.randint(3, 8))]
        wrapper = htmlwrap.load(htmlwrap.dump(htmlwrap.infer(pages)))
        assert all(re.fullmatch(pattern_of(wrapper), keys_of(p)) for p in pages)
        assert not re.fullmatch(pattern_of(wrapper), keys_of(htmlwrap.tokens("<body><blockquote>z</blockquote></body>")))
        for p in pages:  # every text of a page stands in a slot
            assert set(htmlwrap.text_of(p, wrapper).split()) <= set(htmlwrap.text_of(p, None).split())


def test_wrapper_groups():
    pages = [htmlwrap.tokens(f"<ul>{'<li>x%d</li>' * n % tuple(range(n))}</ul><div><p>same</p></div>{'<h2>opt</h2>' if n == 3 else ''}<p>text {n}</p>") for n in (2, 3, 4)]
    wrapper = htmlwrap.infer(pages)
    assert {"+", "?"} <= {n[0] for n in wrapper}
    assert [htmlwrap.text_of(p, wrapper) for p in pages] == ["x0 x1 text 2", "x0 x1 x2 opt text 3", "x0 x1 x2 x3 text 4"]  # the list stands in one box with the text
    assert htmlwrap.text_of(pages[0], None) == "x0 x1 same text 2"


def test_boxes_inside_an_article():
    """Names like header or discussion inside an article are text, unless the host's pages share it."""
    page = '<article><div class="article-header"><h1>Headline {i}</h1></div><p>Body {i}</p><section class="discussion">We discuss {i}</section><p class="notice">notice {i}</p><div class="copyright">All rights</div><div class="comments">me too</div></article>'
    pages = [htmlwrap.tokens(page.format(i=i)) for i in range(4)]
    wrapper = htmlwrap.infer(pages)
    assert [htmlwrap.text_of(p, wrapper) for p in pages] == [f"Headline {i} Body {i} We discuss {i}" for i in range(4)]
    assert htmlwrap.text_of(pages[0], None) == "Headline 0 Body 0 We discuss 0 All rights"


def texts_of(spark, htmls):
    df = spark.createDataFrame([(i, f"http://h.org/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r["text"] for r in htmlwrap.extract(df).orderBy("page_id").collect()]


RELEASE = [f"Paragraph {k} tells of the {word()} and the {word()} in the {word()}." for k in range(8)]


@pytest.mark.parametrize("line", ["Edition {i}", "Date 2020-01-0{i}"])
@pytest.mark.parametrize("wrap", ["<body>{}</body>", "<body><div>{}</div></body>", "<body><div class='x'>{}</div><div class='y'>Bottom line</div></body>"])
def test_near_copies_keep_their_text(spark, line, wrap):
    """Copies of a release that differ in one line, beside one other page."""
    pages = [wrap.format(f"<p>{line.format(i=i)}</p>" + "".join(f"<p>{p}</p>" for p in RELEASE)) for i in range(4)] + [wrap.format("<p>Something else altogether, in a few words</p>")]
    got = texts_of(spark, pages)
    for i in range(4):
        assert got[i].startswith(" ".join([line.format(i=i), *RELEASE]))
    assert got[4].startswith("Something else altogether, in a few words")


def test_sentences_that_articles_share_stay(spark):
    recipe = "<body><div class='a1'>Kitchen home | Shop</div><div class='b2'><h1>Recipe {i}</h1><p>Take {words}.</p><p>Preheat the oven to 180 degrees.</p><p>Serve {more}.</p></div><div class='c3'>Printed on paper</div></body>"
    pages = [(i, prose(12), prose(6)) for i in range(6)]
    got = texts_of(spark, [recipe.format(i=i, words=w, more=m) for i, w, m in pages])
    assert got == [f"Recipe {i} Take {w}. Preheat the oven to 180 degrees. Serve {m}." for i, w, m in pages]


def test_forms(spark):
    """A form around the page is no furniture, one beside the text is."""
    story = "<h1>Story {i}</h1><p>It has {w}</p>"
    box = "<form action='/s'><p>Sign up here</p><input name='q'><button>Go</button></form>"
    words_ = [prose(10) for _ in range(4)]
    for page in ("<body><form id='f'>{}</form></body>", "<body><form id='f'><main>{}</main></form></body>", "<body>" + box + "<div>{}</div></body>", "<body><article>{}" + box + "</article></body>"):
        assert texts_of(spark, [page.format(story.format(i=i, w=w)) for i, w in enumerate(words_)]) == [f"Story {i} It has {w}" for i, w in enumerate(words_)]


def test_names_of_which_a_part_is_telling(spark):
    body = "<article><h1>Shares {i}</h1><p class='share-price'>Price {i}</p><div class='notice-of-copyright'>Notice {i}</div><div class='share-buttons'>tweet</div><ul class='comments-list'><li>me {i}</li></ul><p>End {i}</p></article>"
    assert texts_of(spark, [body.format(i=i) for i in range(5)]) == [f"Shares {i} Price {i} Notice {i} End {i}" for i in range(5)]


def test_planted_furniture_without_telling_names(spark):
    """Precision and recall of words, on hosts whose furniture nothing but its repetition tells."""
    rng = random.Random(12)
    pages, want, shared = [], [], []
    for host in range(5):
        top, low = (" ".join(f"f{host}x{rng.randrange(50)}" for _ in range(n)) for n in (14, 9))
        for n in range(30):
            own = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(15, 60))]
            cut = len(own) // 2
            pages.append((len(pages), f"http://host{host}.org/{n}", f"<html><body><div class='q1'><span>{top}</span></div><div class='q2'><h2>{' '.join(own[:cut])}</h2><p>{' '.join(own[cut:])}</p></div><div class='q3'><p>{low}</p></div></body></html>"))
            want.append(own)
            shared += [top, low]
    got = [r["text"].split() for r in htmlwrap.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()]
    right = sum(len([w for w in g if w[0] == "w"]) for g in got)
    assert right == sum(map(len, want))  # recall of the texts: 1
    assert right / sum(map(len, got)) > 0.99


# ---- 9 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small,shared", [(20_000, 2_000_000), (0, 2_000_000), (0, 0)])
def test_contamination(spark, monkeypatch, small, shared):
    monkeypatch.setattr(decontam, "SMALL", small)
    monkeypatch.setattr(decontam, "BROADCAST", shared)
    monkeypatch.setattr(decontam, "FEW_PAIRS", small)
    items = [(i, prose(n)) for i, n in enumerate((3, 5, 8, 12, 17, 25, 31, 40, 58))] + [(50, None), (51, ""), (52, "one"), (53, prose(8)), (3, None)]
    rows = []
    for i in range(120):
        _, t = random.choice(items[:9])
        ws = t.split()
        for _ in range(random.choice((0, 0, 1, 2, 3))):
            ws[random.randrange(len(ws))] = "zzz"
        rows.append((i, prose(random.randint(0, 200)) + " " + " ".join(ws).upper() + "\n" + prose(20), "x"))
    rows += [(500, None, "x"), (501, "", "x"), (502, "ONE", "x"), (503, items[4][1], "x"), (503, items[4][1], "x"), (504, prose(30_000) + " " + items[5][1], "x")]
    found = decontam.contained(documents(spark, rows).withColumn("item", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1)))
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_found"]) for r in found.collect()}
    want = {}
    for i, t in items:
        ws = (t or "").lower().split()
        k = min(5, len(ws))
        q = {tuple(ws[a : a + k]) for a in range(len(ws) - k + 1)} if ws else set()
        for d, x, _ in rows:
            xs = (x or "").lower().split()
            have = {tuple(xs[a : a + k]) for a in range(len(xs) - k + 1)} if k else set()
            if q and len(q & have) * 100 >= 80 * len(q):
                want[d, i] = (len(q), len(q & have))
    assert got == want and len(want) > 20
    assert found.count() == len(want)


def test_a_document_is_shingled_once_for_all_its_items(spark):
    """One document that holds a thousand items: its shingles are built below the join with them."""
    texts = [" ".join(f"i{n}w{k}" for k in range(8)) for n in range(1000)]
    docs = spark.createDataFrame([(1, " filler ".join(texts)), (1, texts[0]), (2, texts[3]), (None, texts[4])], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[5])], "item_id long, text string")
    out = decontam.contained(docs, items)
    assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == [(1, n) for n in range(1000)] + [(2, 3)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_intersect" not in plan


def test_contamination_runs_no_python(spark, sf):
    plan = llm.QUERIES["op9_decontamination"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- 10 ----------------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    insults = ["grobnik", "zwackel", "pfurzel"]
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        ws = prose(60).split()
        if bad:
            ws[random.randrange(60)] = random.choice(insults) + random.choice(["", "s", "!", "en"])
        rows.append((i, " ".join(ws), "x"))
        labels.append((i, 1 if bad else 0))
    odd = ["ba ko g.r.o.b.n.i.k ri", "ba grob-nik", "ba grobxnik tu", "ba g r o b n i k tu", prose(60_000) + " Zwackel", None, "", "!!! ???", prose(40), "x" * 5000]
    rows += [(2000 + i, t, "x") for i, t in enumerate(odd)] + [(2008, odd[8], "x")]
    labels += [(5, None), (None, 1), (3, 0), (2001, 7)]
    copies = prose(50)
    rows += [(4000 + i, copies + f" {insults[0]} {i}", "x") for i in range(100)]
    labels += [(4000 + i, 1) for i in range(100)]
    rows.append((5000, copies, "x"))
    out = toxicity.score_documents(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("score", F.lit(1)))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [i for i in range(900) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    assert [got[2000 + i]["predicted"] for i in range(10)] == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0]
    assert got[5000]["predicted"] == 0  # the words of a text copied a hundred times are no insults


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score_documents(documents(spark, [(1, "a", "x")]), none).first()["score"] == 0.0
    assert toxicity.score_documents(documents(spark, EMPTY), none).count() == 0


def test_windows_hold_trained_forms_whole():
    for n in (25, 40, 61):
        w = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        cp, part, _ = toxicity.codes([w])
        windows = ["".join(chr(c) for c in cp[part == p] if c) for p in range(part[-1] + 1)]
        longest = toxicity.WINDOW - 1
        assert all(any(w[i : i + longest] in x for x in windows) for i in range(n - longest + 1))


def test_kernel_equals_brute_force():
    """Features give the gap-weighted subsequence kernel of its definition; other scripts are told apart."""

    def plain(w):
        c, out = f"\0{w}\0", Counter()
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, len(c)):
                    if k - i - 2 <= toxicity.GAP:
                        out[c[i], c[j], c[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    def product(a, b):
        return sum(v * b[x] for x, v in a.items())

    words = ["grobnik", "grobxnik", "zwackel", "дурак", "дурень", "世界語言", "ab", "abab"]
    m, _ = toxicity.nystrom(words)
    for i, a in enumerate(map(plain, words)):
        for j, b in enumerate(map(plain, words)):
            # weights of a word are scaled before its equal features add up
            norm = [math.sqrt(sum(toxicity.DECAY ** (2 * (x + y + 1)) for x, y in toxicity.STEPS for _ in range(max(0, len(w) + 2 - x - y)))) for w in (words[i], words[j])]
            assert math.isclose(float(m[i] @ m[j]), product(a, b) / norm[0] / norm[1], abs_tol=1e-3), (words[i], words[j])


def test_several_doubtful_words_are_toxic_together():
    layer = toxicity.logistic(np.array([[1.0, -1, -1], [0.3, 0.2, -1], [0.25, -1, -1], [-1, -1, -1]] * 40), np.array([1, 1, 0, 0] * 40))
    model = toxicity.ToxicModel(np.zeros(1), 0.0)
    model.layers = [layer]
    assert (model.score(np.array([[1.0, -1, -1], [0.3, 0.2, -1], [0.3, -1, -1]])) >= 0.3).tolist() == [True, True, False] and (layer[:-1] >= 0).all()


def test_folded_weights_are_the_landmark_sum():
    m = toxicity.fit(["grobnik", "zwackel"], ["baba", "koko", "ritu", "molesi"])
    marks = ["grobnik", "zwackel", "baba", "koko", "ritu", "molesi"]
    dense, used = toxicity.nystrom(marks)
    p, f, v, owner = toxicity.features(["grobxnik"])
    x = np.zeros(toxicity.FEATURES)
    np.add.at(x, f, v)
    k = dense @ x[used]
    val, vec = np.linalg.eigh(dense @ dense.T)
    beta = np.linalg.lstsq(dense.T, m.weights[used], rcond=None)[0]
    assert math.isclose(float(beta @ k) + m.bias, float(m.margins(["grobxnik"])[0]), abs_tol=1e-6)


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_entry_works_without_these_operators(tmp_path, gone):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e, json; print(json.dumps([len(e.queries()), 'pipeline' in e.queries()]))"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    n, pipeline = json.loads(said.stdout.strip().splitlines()[-1])
    assert n > 50 and not pipeline
