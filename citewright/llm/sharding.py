"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a hash of the key. It starts as one bucket; a bucket of more than `limit` bytes is
split on the next bit, and only such a bucket, until every bucket fits. The directory is worked out from byte sums by hash prefix,
a few bits at a time: each pass sums the rows of the still oversized buckets by a longer prefix (with map-side
combining, so a hot bucket costs no more than another) and finds for each prefix the shortest one that fits.

A hash cannot split rows of equal key, nor a row larger than the limit. Buckets that are still too large when all bits are used
are cut by counting: the rows get running numbers and every shard takes as many as fit, at least one. So no shard exceeds the
limit, but one that holds a single larger row.

Defined cases: a null key hashes as the text `null`, a null or empty text has 0 bytes; a very long text is a shard of its own; repeated rows are placed one by one; an empty
table gives an empty result; extra columns are ignored by `assign` and kept by `write`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.llm.common import cut

BITS, STEP = 60, 8


def key_bits(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def cut_bits(h: Column | str, drop: Column | int) -> Column:
    """h without its last `drop` bits."""
    return F.call_function("shiftright", F.col(h) if isinstance(h, str) else h, F.lit(drop).cast("int") if isinstance(drop, int) else drop.cast("int"))


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """rows: h, n. Returns the buckets that fit (depth, p: the leading bits) and the hashes whose rows share all bits and don't fit (h)."""
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    low, high = 0, min(BITS, (total // limit).bit_length() + 3)
    leaves, opened = None, None
    while True:
        own = rows if opened is None else rows.withColumn("p", cut_bits("h", BITS - low)).join(opened, "p", "left_semi")
        cells = own.groupBy(cut_bits("h", BITS - high).alias("c")).agg(F.sum("n").alias("n"))
        depths = cells.select("c", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        sums = cut(depths.groupBy("depth", cut_bits("c", F.lit(high) - F.col("depth")).alias("p")).agg(F.sum("n").alias("n")))
        # a bucket is in the directory if it fits and the one that it was split from did not
        full = sums.filter(F.col("n") > limit).select((F.col("depth") + 1).alias("depth"), F.col("p").alias("q"))
        fits = sums.filter(F.col("n") <= limit)
        new = fits.withColumn("q", cut_bits("p", 1)).join(full, ["depth", "q"], "left_semi").select("depth", "p")
        if low == 0:
            new = new.unionByName(fits.filter("depth = 0").select("depth", "p"))
        leaves = new if leaves is None else leaves.unionByName(new)
        opened = sums.filter((F.col("depth") == high) & (F.col("n") > limit)).select("p")
        if high == BITS or opened.isEmpty():
            return cut(leaves), opened.select(F.col("p").alias("h"))
        low, high = high, min(BITS, high + STEP)


def numbered(rows: DataFrame, limit: int, extra: list[str]) -> DataFrame:
    """Shards for rows that no bits can part: rows of one hash and size are numbered and taken as many as fit at a time.

    Numbers come from counts by partition and numbers inside a partition, so a key with a third of all rows is no single task's work.
    """
    kept = cut(rows).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    counts = kept.groupBy("h", "n", "part").agg(F.count("*").alias("c"))
    before = counts.select("h", "n", "part", F.coalesce(F.sum("c").over(Window.partitionBy("h", "n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = kept.withColumn("i", F.row_number().over(Window.partitionBy("h", "n", "part").orderBy("at")) - 1)
    number = F.floor((F.col("before") + F.col("i")) / F.greatest(F.floor(F.lit(limit) / F.greatest("n", F.lit(1))), F.lit(1)))
    return inside.join(before, ["h", "n", "part"]).select("k", "n", F.lit(BITS).alias("depth"), F.concat_ws("-", F.lit(BITS), "h", "n", number).alias("shard"), *extra)


def assign(df: DataFrame, limit: int, *, key: str = "doc_id", text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """key, n_bytes, depth and shard (`depth-bits`, with size and number where bits did not suffice) of every row, and the columns in extra."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    extra = extra or []
    held = [f"x{i}" for i in range(len(extra))]  # names of the caller's columns may clash with ours
    rows = df.select(F.col(key).alias("k"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n"), key_bits(F.col(key)).alias("h"), *[F.col(c).alias(x) for c, x in zip(extra, held)])
    large, rows = rows.filter(F.col("n") > limit), rows.filter(F.col("n") <= limit)
    leaves, stuck = directory(rows.select("h", "n"), limit)
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())  # at most 61 numbers
    # a row looks its prefix up at each depth in use; it finds exactly one bucket
    tries = F.array(*[F.struct(F.lit(d).alias("depth"), cut_bits("h", BITS - d).alias("p")) for d in depths]) if depths else F.expr("cast(array() as array<struct<depth:int,p:bigint>>)")
    looked = rows.withColumn("t", F.explode(tries)).select("k", "n", "h", "t.depth", "t.p", *held)
    placed = looked.join(leaves, ["depth", "p"]).select("k", "n", "depth", F.concat_ws("-", "depth", "p").alias("shard"), *held)
    rest = rows.join(stuck, "h", "left_semi").select("k", "n", "h", *held).unionByName(large.select("k", "n", "h", *held))
    out = placed.unionByName(numbered(rest, limit, held))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_bytes"), F.col("depth").cast("int").alias("depth"), "shard", *[F.col(x).alias(c) for c, x in zip(extra, held)])


def write(df: DataFrame, path: str, limit: int, *, key: str = "doc_id", text: str = "text") -> None:
    """Write all columns of df, one folder for each shard."""
    rest = [c for c in df.columns if c not in (key, "n_bytes", "depth", "shard")]
    assign(df, limit, key=key, text=text, extra=rest).repartition("shard").sortWithinPartitions("shard").drop("n_bytes", "depth").write.partitionBy("shard").parquet(path)


#: The same for tables whose rows fit the limit and whose hashes differ.
SQL = """
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT depth, h >> (60 - depth) AS p, sum(n) AS total FROM d, range(0, 61) AS t(depth) GROUP BY 1, 2),
f AS (SELECT doc_id, n, h, min(depth) AS depth FROM d JOIN s ON d.h >> (60 - s.depth)::INTEGER = s.p WHERE total <= {limit} GROUP BY ALL)
SELECT doc_id, n AS n_bytes, depth::INTEGER AS depth, depth || '-' || (h >> (60 - depth)::INTEGER) AS shard FROM f
"""
