"""Benchmark decontamination: which long documents contain a short test item.

Items are partitioned by size (bands of powers of two of their shingle counts). In a band with at most u shingles an item is sketched by
its u - ceil(THRESHOLD * u) + 1 smallest shingle hashes (all, if it has fewer). A document that holds THRESHOLD of an item's
shingles lacks fewer than that, so at least one minimum of the sketch is among its own shingles: the search loses nothing.
Documents are not sketched; of their shingles only those around a word that is the anchor (the longest word) of some
sketched shingle are hashed. Every candidate pair is then verified by the exact containment of the shingles as text.

Only DataFrame functions are used: no Python runs on the executors.

Documents are read once for the search, whatever the lengths of items, and once more for verification. Up to SMALL sketched hashes (counted first) the anchors are a hash set in
the plan. Up to BROADCAST of them (16 bytes each) all shingles of a document are hashed and looked up in the broadcast sketches, without a shuffle. Beyond that both
sides are dealt by hash, the documents' after a filter by size band: a hash larger than the largest one that any sketch of its shingle length holds is dropped before
the shuffle. The ids of candidate documents are broadcast while there are at most FEW_PAIRS pairs. A candidate document is shingled once, however many items it may hold: its shingles that stand in any item meet those
of its candidates in an equi-join, whose rows are counted. All ways give the same rows.

Words are the runs of characters other than white space, in lower case; an item of fewer than SHINGLE words counts as
one shingle. Defined cases: null or empty documents and items match nothing, nor do rows with a null id on either side; repeated documents give one row for each distinct
(document id, item id) pair, the best of its rows by containment, then by size; very long documents are searched whole; extra columns never enter; empty tables
give an empty result; the threshold is inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.llm.common import WORD_BREAK, cut

SHINGLE, PERCENT, SMALL, BROADCAST, FEW_PAIRS = 5, 80, 20_000, 2_000_000, 500_000


def lower_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def shingles(ws: Column, k: Column) -> Column:
    """All runs of k words as text; none if there are fewer words."""
    n = F.size(ws) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, k), " "))).otherwise(F.array().cast("array<string>"))


def sketches(items: DataFrame, item_key: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(items with their shingles; one row for each minimum of each item: item, k, hash, anchor word)."""
    w = items.select(F.col(item_key).alias("item"), lower_words(F.col(item_text)).alias("ws")).filter(F.size("ws") > 0)
    k = F.least(F.lit(SHINGLE), F.size("ws"))
    full = w.select("item", k.alias("k"), F.array_distinct(shingles(F.col("ws"), k)).alias("sh")).distinct()
    n = F.size("sh")
    upper = F.pow(F.lit(2), F.floor(F.log2(n.cast("double"))) + 1).cast("int") - 1  # the largest size of the band
    minima = upper - F.ceil(upper * PERCENT / 100.0).cast("int") + 1
    longest = F.aggregate(
        F.split(F.col("s"), " "),
        F.lit(""),
        lambda a, x: F.when((F.length(x) > F.length(a)) | ((F.length(x) == F.length(a)) & (x < a)), x).otherwise(a),
    )
    hashed = F.array_sort(F.transform(F.col("sh"), lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s"))))
    keys = full.select("item", "k", F.explode(F.slice(hashed, F.lit(1), minima)).alias("m")).select("item", "k", F.col("m.h").alias("h"), F.col("m.s").alias("s"))
    return full, keys.select("item", "k", "h", longest.alias("anchor"))


def near_anchor(ws: Column, k: int, anchors: list[str]) -> Column:
    """Hashes of the k-word shingles that cover a word of `anchors`."""
    last = F.size(ws) - k
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0))), lambda i: F.get(ws, i).isin(anchors))
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - (k - 1), F.lit(0)), F.greatest(F.least(i, last), i - (k - 1), F.lit(0))))))
    kept = F.filter(starts, lambda j: j <= last)
    return F.transform(kept, lambda j: F.xxhash64(F.array_join(F.slice(ws, j + 1, k), " ")))


def contained(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item of which it holds at least PERCENT of the shingles.

    Columns: the two keys, n_shingles (of the item), n_found, containment.
    """
    full, keys = sketches(items, item_key, item_text)
    full, keys = cut(full), cut(keys.distinct())
    sizes = {r["k"]: r["n"] for r in keys.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most SHINGLE rows
    many = sum(sizes.values())
    small = many <= SMALL
    base = docs.select(F.col(key).alias("doc"), lower_words(F.col(text)).alias("ws"))
    found = None
    if sizes:
        tops = {r["k"]: r["h"] for r in keys.groupBy("k").agg(F.max("h").alias("h")).collect()} if many > BROADCAST else {}

        def probe(k: int) -> Column:
            """The hashes of a document to look up among sketches of k-word shingles."""
            if small:
                hashes = near_anchor(F.col("ws"), k, sorted(r["anchor"] for r in keys.filter(F.col("k") == k).select("anchor").distinct().collect()))
            else:
                hashes = F.transform(shingles(F.col("ws"), F.lit(k)), lambda s: F.xxhash64(s))
            if k in tops:
                hashes = F.filter(hashes, lambda h: h <= tops[k])
            return F.transform(F.array_distinct(hashes), lambda h: F.struct(F.lit(k).alias("k"), h.alias("h")))

        probes = [probe(k) for k in sorted(sizes)]
        known = keys.select("item", "k", "h")
        dealt = base.select("doc", F.explode(F.concat(*probes)).alias("p")).select("doc", "p.k", "p.h")
        found = dealt.join(F.broadcast(known) if many <= BROADCAST else known, ["k", "h"]).select("doc", "item")
    if found is None:
        return docs.select(F.col(key)).limit(0).crossJoin(items.select(F.col(item_key)).limit(0)).select(key, item_key, F.lit(0).alias("n_shingles"), F.lit(0).alias("n_found"), F.lit(0.0).alias("containment"))
    # verification: each document with a candidate is shingled once, and only those of its shingles that some item has go on
    pairs = cut(found.distinct())
    few = pairs.count() <= FEW_PAIRS
    doc_ids = pairs.select("doc").distinct()
    whole = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(doc_ids) if few else doc_ids, "doc", "left_semi")
    # rows that share an id are told apart by their texts
    own = whole.select("doc", F.sha2("t", 256).alias("row"), lower_words(F.col("t")).alias("ws"))

    def of_length(k: int) -> Column:
        return F.transform(F.array_distinct(shingles(F.col("ws"), F.lit(k))), lambda s: F.struct(F.lit(k).alias("k"), s.alias("s")))

    each = F.concat(*map(of_length, sorted(sizes)))
    parts = cut(full.select("item", "k", F.explode("sh").alias("s")))
    known = parts.select("k", "s").distinct()
    known = F.broadcast(known) if parts.count() <= SMALL else known
    mine = own.select("doc", "row", F.explode(each).alias("p")).select("doc", "row", "p.k", "p.s").join(known, ["k", "s"], "left_semi").distinct()
    wanted = pairs.join(parts, "item")
    scored = mine.join(wanted, ["doc", "k", "s"]).groupBy("doc", "row", "item").agg(F.count("*").cast("int").alias("n_found"))
    scored = scored.join(full.select("item", F.size("sh").alias("n_shingles")), "item")
    best = scored.filter(F.col("n_found") * 100 >= F.col("n_shingles") * PERCENT).groupBy("doc", "item").agg(F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("c"), "n_shingles", "n_found")).alias("b"))
    best = best.select("doc", "item", "b.n_shingles", "b.n_found")
    return best.select(F.col("doc").alias(key), F.col("item").alias(item_key), "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


#: The same by brute force.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(5, len(ws)) AS k, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS s
       FROM b, unnest(generate_series(1, len(ws) - least(5, len(ws)) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS s, k
       FROM d, (SELECT DISTINCT k FROM bs) AS ks, unnest(generate_series(1, greatest(0, len(ws) - k + 1))) AS t(i)),
f AS (SELECT doc_id, item_id, count(*) AS f FROM ds JOIN bs USING (s, k) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n::INTEGER AS n_shingles, f::INTEGER AS n_found, f::DOUBLE / n AS containment
FROM f JOIN n USING (item_id) WHERE f * 100 >= n * 80
"""
