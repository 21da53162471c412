"""The pipeline against a brute-force version of its decisions on a small corpus."""

import random
import re
import zlib

import pytest

import corpus_pipeline
from citewright.llm import langid, toxicity
from tests.conftest import rows_of

pytest.importorskip("public_tokenizers")
random.seed(11)
SYLLABLES = "ba ko ri tu le mo na si".split()


def prose(n):
    return " ".join("".join(random.choices(SYLLABLES, k=random.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted insults, junk, copies and benchmark passages; an extra column; null and repeated rows."""
    folder = tmp_path_factory.mktemp("corpus")
    items = [(i, prose(20 + i)) for i in range(6)]
    rows, labels, kinds = [], [], {}
    for i in range(420):
        text, kind = prose(60), "clean"
        if i % 7 == 0:
            text, kind = text + " " + random.choice(["grobnik", "zwackel"]), "toxic"
        elif i % 11 == 0:
            text, kind = prose(20) + " " + items[i % 6][1].upper() + " " + prose(20), "leak"
        elif i % 13 == 0:
            text, kind = "12 34 " * 20, "junk"
        elif i % 5 == 0 and kinds.get(i - 1) == "clean":
            ws = rows[i - 1][1].split()
            ws[3] = "changed"
            text, kind = " ".join(ws), "copy"
        rows.append((i, text, "xx", "s", len(text), i))
        labels.append((i, 1, 1 if kind == "toxic" else 0))
        kinds[i] = kind
    rows += [(900, None, "xx", "s", 0, 1), (901, rows[1][1], None, None, 0, 1), (902, prose(30), "xx", "s", 0, 1), (902, prose(30), "xx", "s", 0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, kinds, items


def shingles(t, k=5):
    ws = (t or "").lower().split()
    k = min(k, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def test_pipeline_keeps_what_brute_force_keeps(spark, corpus):
    folder, rows, kinds, items = corpus
    left = [r for r in rows if not re.search("grobnik|zwackel", r[1] or "")]
    left = [r for r in left if re.search(r"[^\W\d_]", r[1] or "")]
    parent = list(range(len(left)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(r[1]) for r in left]
    for a in range(len(left)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, r in enumerate(left):
        least[find(a)] = min(r[0], least.get(find(a), r[0]))
    kept = {r[0] for a, r in enumerate(left) if least[find(a)] == r[0]}
    bench = [shingles(t) for _, t in items]
    want = sorted(d for d in kept if not any(len(q & shingles(next(r[1] for r in left if r[0] == d))) * 100 >= 80 * len(q) for q in bench))
    out = corpus_pipeline.run(spark, folder)
    assert sorted(r["doc_id"] for r in out.collect()) == want
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {kinds.get(d, "clean") for d in want} == {"clean"} and sum(k == "clean" for k in kinds.values()) - len(want) <= 2


def test_stages_keep_all_columns(spark, corpus):
    folder, rows, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.dtypes == docs.dtypes, name
        assert set(rows_of(got)) <= set(rows_of(docs)), name


def test_stages_take_empty_tables(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_each_group_keeps_one(spark, corpus):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "x y"), (3, "other words"), (None, "a b c d e f"), (4, None)], "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(map(repr, got)) == ["1", "3", "4", "None"]


def test_stages_take_long_texts_and_clashing_names(spark, corpus):
    """Very long texts, and columns with the names that stages use themselves."""
    folder, rows, kinds, items = corpus
    long = prose(40_000)
    odd = [(800, long + " grobnik", "xx"), (801, long, "xx"), (802, long + " " + items[2][1] + " " + prose(10), "xx"), (803, "7 " * 50_000, "xx"), (804, None, None), (805, "", None)]
    docs = spark.createDataFrame([r[:3] for r in rows] + odd, "doc_id long, text string, lang string")
    names = ("toxicity", "language", "sure", "row", "score", "margin", "c0", "sid", "component_id", "k", "t")
    docs = docs.selectExpr("*", *[f"cast(doc_id as string) as {n}" for n in names])
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).checkpoint()
        assert docs.columns == ["doc_id", "text", "lang", *names]
        assert all(r[n] == str(r["doc_id"]) for r in docs.filter("doc_id >= 800").collect() for n in names)
        left[name] = {r["doc_id"] for r in docs.collect() if r["doc_id"] in range(800, 806)}
    assert left == {"toxicity": {801, 802, 803, 804, 805}, "language": {801, 802}, "near_duplicates": {801}, "decontamination": {801}}


def test_rows_of_one_id_leave_one_that_storage_does_not_decide(spark):
    rows = [(1, "a b c d e f", x) for x in "qwertyuiop"] + [(None, "a b c d e f", x) for x in "zy"] + [(2, None, "k"), (2, "other words", "j")]
    for parts in (1, 4, 9):
        random.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        got = sorted(map(repr, map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())))
        assert got == ["(1, 'a b c d e f', 'e')", "(2, None, 'k')", "(None, 'a b c d e f', 'y')", "(None, 'a b c d e f', 'z')"]


def test_held_out_rows_teach_nothing(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    for f in (langid.held_out, toxicity.held_out):
        assert {r["doc_id"] for r in df.filter(f()).collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 4 == 2}
