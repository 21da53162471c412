"""SentencePiece, whitening and resampling against the library and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from citewright.llm import piece, resample, whitening

random.seed(11)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return path, piece.PieceBpe(f.read()), sentencepiece.SentencePieceProcessor(model_file=path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11 ----------------------------------------------------------------------------------------------------------------

ODD = [*"abcdefghij  ▁▁\n\t\0éßñ漢字梦İΣſﬁ́‍😀<>/s0x41", "<s>", "</s>", "<unk>", "<0x41>", "▁▁▁▁", " " * 17, "the ", "ation", "\r\n", "　", "\xa0"]


def odd_text(n):
    return "".join(random.choices(ODD, k=n))


def test_pieces_equal_library(library, monkeypatch):
    _, ours, theirs = library
    monkeypatch.setattr(piece, "CACHE", 500)  # the table starts anew again and again
    for _ in range(60):
        texts = [odd_text(random.randrange(40)) for _ in range(50)]
        for t, (n, ids, decoded) in zip(texts, ours.digest(texts)):
            want = theirs.encode(t)
            assert (n, ids, decoded) == (len(want), ",".join(map(str, want)), theirs.decode(want)), repr(t)
            assert ours.encode(t) == want and ours.decode(want) == decoded


def test_any_ids_decode_as_the_library_does(library):
    _, ours, theirs = library
    for _ in range(3000):
        ids = [random.choice([0, 1, 2, random.randrange(3, 259), random.randrange(259, 32000), 259, 198, 172, 233]) for _ in range(random.randrange(8))]
        assert ours.decode(ids) == theirs.decode(ids), ids


@pytest.mark.parametrize("long", [4, 256])
def test_long_chunks_go_through_the_heap(library, monkeypatch, long):
    _, ours, theirs = library
    monkeypatch.setattr(piece, "LONG", long)
    for t in (" " * 999 + "ab" * 700 + "▁" * 50 + "漢字" * 200, "aaaa" * 300, odd_text(2000)):
        assert ours.encode(t) == theirs.encode(t)


def test_pieces_across_markers_make_each_text_one_chunk(library):
    _, ours, theirs = library
    crossing = piece.PieceBpe.__new__(piece.PieceBpe)
    crossing.__dict__ = ours.__dict__ | {"crossing": True, "table": piece.Table()}
    for t in ("one two  three", " a b", "x"):
        assert crossing.encode(t) == theirs.encode(t)
        assert crossing.digest([t])[0][1] == ",".join(map(str, theirs.encode(t)))


def test_models_that_need_more_are_refused(library):
    with open(library[0], "rb") as f:
        model = f.read()
    with pytest.raises(ValueError):
        piece.PieceBpe(model + b"\x1a\x02\x18\x00")  # a normaliser that adds no marker


def test_encoded_documents(spark, library):
    path, _, theirs = library
    texts = [None, "", " ", "▁", "two  words", "a\tb\nc", "word " * 30_000, "x" * 20_000, "same", "same", "né 漢字 ́"]
    df = spark.createDataFrame([(i if i else None, t, 1, "x", 2.0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string, ids_sha256 double")
    got = sorted((tuple(r) for r in piece.encode_documents(df, path, keep_ids=True).collect()), key=lambda r: r[0] or 0)
    for i, (t, row) in enumerate(zip(texts, got)):
        ids = theirs.encode(t or "")
        assert row == (i if i else None, len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids)), ids, theirs.decode(ids))
    assert piece.encode_documents(df.limit(0), path).count() == 0


# ---- 12 ----------------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double, id string")


def white_by_numpy(rows, k):
    whole = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in whole], dtype=object)
    fit = sorted({tuple(r) for r in x})
    n, s = len(fit), [sum(r[i] for r in fit) for i in range(len(fit[0]))]
    centred = (np.array(fit, dtype=object) - np.array(s, dtype=object) / n).astype(float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    flat = (x - np.array(s, dtype=object) / n).astype(float)
    out = []
    for (i, _), r, f in zip(whole, x, flat):
        dev = sum((n * a - b) ** 2 for a, b in zip(r, s))
        for c in range(min(k, len(s))):
            out.append((i, c + 1, n, dev, abs(f @ basis[:, c] / math.sqrt(values[c])), values[c] / values.sum()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("scale", [1.0, 1e13])
def test_whitening_equals_numpy(spark, scale):
    r = np.random.default_rng(3)
    mix = r.normal(size=(6, 6)) * [5, 3, 2, 1, 0.5, 0.2]
    rows = [(i, [float(np.float32(c * scale)) for c in mix @ r.normal(size=6) + 40]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(None, rows[3][1]), (200, None), (201, []), (202, [None, *rows[1][1][1:]]), (203, [float("nan"), *rows[1][1][1:]]), (204, [float("-inf"), *rows[1][1][1:]]), (205, [1.0, 2.0])]
    got = sorted((tuple(x) for x in whitening.whiten(vectors(spark, rows)).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    want = white_by_numpy([x for x in rows if x[0] != 205], 4)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == [w[3] if w[3] < 2**63 else None for w in want]
    assert np.allclose([abs(g[4]) for g in got], [w[4] for w in want], rtol=1e-9, atol=1e-9) and np.allclose([g[5] for g in got], [w[5] for w in want])
    assert len({g[6] for g in got}) == 1 and got[0][6] < 1e-9


def test_covariance_is_exact_far_from_zero(spark):
    """Sums of plain products would lose what a large mean hides."""
    rows = [(i, [float(1 << 22) + a / 256, float(1 << 22) - b / 256]) for i, (a, b) in enumerate([(0, 0), (1, 2), (2, 1), (5, 3)])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    want = white_by_numpy([(i, [c - (1 << 22) for c in v]) for i, v in rows], 4)
    assert np.allclose(sorted(abs(g["whitened"]) for g in got), sorted(w[4] for w in want), rtol=1e-12)
    assert np.allclose(sorted({g["explained"] for g in got}), sorted({w[5] for w in want}), rtol=1e-13)


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()  # one distinct vector: no spread at all
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, 0.0, 0.0, 0.0)] * 4
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()  # one component has no spread
    assert {r["whitened"] for r in line if r["component"] == 2} == {0.0} and max(r["identity_error"] for r in line) < 1e-12


def test_products_are_summed_in_one_aggregation(spark, monkeypatch):
    seen = []
    first = type(spark.range(1)).first
    monkeypatch.setattr(type(spark.range(1)), "first", lambda df: (seen.append(len(df.columns)), first(df))[1])
    whitening.whiten(vectors(spark, [(i, [i / 7, i * i / 50, 1 / (i + 1)]) for i in range(20)])).count()
    assert 6 in seen  # the upper triangle of three dimensions


# ---- 13 ----------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, run):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(ws[i : i + n]) for n in range(1, run + 1) for i in range(len(ws) - n + 1)], len(ws)


def resampled(rows, target, run, buckets, percent, least, seed):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for text in texts for f in features(text, run)[0]) for texts in ([r[1] for r in rows], target))
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        fs, n = features(text, run)
        weight = sum(math.floor(1000 * math.log((t[of(f)] + 1) * (ns + buckets) / ((s[of(f)] + 1) * (nt + buckets)))) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((o for o in out if o[4] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    rank = {id(o): k + 1 for k, o in enumerate(fit[: percent * len(fit) // 100])}
    return sorted([(*o[:4], rank.get(id(o))) for o in out], key=repr)


@pytest.mark.parametrize(("run", "nodes"), [(1, 400_000), (3, 400_000), (2, 5)])
def test_resampling_equals_brute_force(spark, monkeypatch, run, nodes):
    monkeypatch.setattr(resample, "NODES", nodes)
    some = lambda n: " ".join(random.choice(["Ba", "ko", "ri'x", "été", "TU9", "漢", "İI", "a-b", "\x7fz"]) for _ in range(n))
    rows = [(i, some(random.randrange(12))) for i in range(150)] + [(None, some(9)), (500, None), (501, ""), (502, "-- ++"), (503, some(20_000)), (7, some(11)), (8, "ko ko ko ko ko"), (8, "ko ko ko ko ko")]
    target = [some(30), None, "", "ko ko été"]
    df = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, rank int, id string, score double").repartition(5)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(df, items, run=run, buckets=50, percent=30, least_words=5, seed=9)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled(rows, target, run, 50, 30, 5, 9)


def test_resampling_of_nothing(spark):
    df = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string")
    none = df.limit(0)
    assert resample.resample(none, df).count() == 0
    got = {r["doc_id"]: tuple(r) for r in resample.resample(df, none, percent=100).collect()}
    assert got[1][4] == 1 and got[2][1:3] == (0, 0) and got[2][4] is None


def test_ranks_are_whole_over_many_ranges(spark):
    """Equal scores cannot be: rows of one id and one text stand side by side."""
    df = spark.range(0, 3000, 1, 7).selectExpr("id % 1000 as doc_id", "repeat('w ', 25) as text")
    got = [r["rank"] for r in resample.resample(df, df.limit(1), percent=50).filter("rank is not null").collect()]
    assert sorted(got) == list(range(1, 1501))
