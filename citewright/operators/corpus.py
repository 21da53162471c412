"""The corpus as two Parquet tables in snapshots: documents and their chunks with vectors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.functions import text as T
from citewright.operators.dense import embed, l2_normalise
from citewright.operators.frames import materialise, small_batches
from citewright.operators.snapshots import Snapshots

MAX_CHUNKS = 2000


def digest(texts: Column) -> Column:
    """SHA-256 over texts in order, each followed by a zero byte."""
    return F.sha2(F.concat(F.array_join(texts, "\0"), F.lit("\0")), 256)


def chunk_documents(docs: DataFrame, max_chunks: int | None = None, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text, title, source) -> (chunks, rejects with a reason). max_chunks: a document keeps its first ones (a service's limit is MAX_CHUNKS); none: all. whole: long sentences are kept whole too."""
    small_batches(docs.sparkSession)
    d = docs.withColumn("pieces", T.chunks(F.coalesce(F.col("text"), F.lit("")), whole))
    bad = F.when(T.strip(F.coalesce(F.col("text"), F.lit(""))) == "", "no_text").when(F.size("pieces") == 0, "no_chunks")
    d = materialise(d.withColumn("reason", bad))  # chunks and rejects come of one pass
    kept = F.slice("pieces", 1, max_chunks) if max_chunks is not None else F.col("pieces")
    good = d.filter("reason is null").select("doc_id", F.posexplode(kept).alias("chunk_index", "text"))
    return good.select(F.concat_ws("::", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "text"), d.filter("reason is not null").select("doc_id", "reason")


def ingest(docs: DataFrame, model: str, embedder=None, created_at: str = "1970-01-01T00:00:00Z", max_chunks: int | None = MAX_CHUNKS, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, rejects) of what is to be added."""
    chunks, rejects = chunk_documents(docs, max_chunks, whole)
    chunks = embed(materialise(chunks), "text", "embedding", embedder).withColumn("embedding", l2_normalise(F.col("embedding")).cast("array<float>")).withColumn("dim", F.size("embedding"))
    chunks = materialise(chunks)  # documents are read from it too: no text is embedded twice
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    sums = chunks.groupBy("doc_id").agg(ordered.alias("o"), F.count("*").cast("int").alias("chunk_count"), F.sum(F.length("text")).cast("int").alias("char_count"))
    made = sums.select("doc_id", digest(F.transform("o", lambda x: x["text"])).alias("content_sha"), "chunk_count", "char_count")
    documents = docs.select("doc_id", "title", "source").join(made, "doc_id").select("doc_id", "title", "source", F.lit(model).alias("embedding_model"), "content_sha", "chunk_count", "char_count", F.lit(created_at).alias("created_at"))
    return documents, chunks, rejects


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """New rows replace old ones of the same document."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(old: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return old.join(ids.select(key).distinct(), key, "left_anti")


def stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    a = documents.agg(F.count("*").alias("documents"), F.array_sort(F.collect_set("embedding_model")).alias("embedding_models"))
    return a.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks")))).select("documents", "chunks", "embedding_models")  # one row each


def listing(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("created_at"), "doc_id")


class Store:
    """The corpus under a folder: every change is a new snapshot; readers keep what they opened."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3, lease_s: float = 6 * 3600):
        self.spark, self.snapshots = spark, Snapshots(spark, root, keep, lease_s)

    def current(self) -> str | None:
        return self.snapshots.current()

    def _at(self, folder: str | None) -> tuple[DataFrame, DataFrame] | None:
        return (self.spark.read.parquet(f"{folder}/documents"), self.spark.read.parquet(f"{folder}/chunks")) if folder else None

    def tables(self) -> tuple[DataFrame, DataFrame] | None:
        return self._at(self.current())

    def _write(self, out: str, documents: DataFrame, chunks: DataFrame) -> None:
        documents.write.parquet(f"{out}/documents")
        if chunks.isEmpty():  # without a folder for any model there would be no schema to read
            chunks.coalesce(1).write.parquet(f"{out}/chunks")
        else:
            chunks.write.partitionBy("embedding_model").parquet(f"{out}/chunks")  # a search reads one model's folder

    def add(self, documents: DataFrame, chunks: DataFrame) -> None:
        """Documents with their chunks (at least one each, all vectors of one length that is not 0) replace what is stored under their ids."""
        chunks = materialise(chunks.join(documents.select("doc_id", "embedding_model"), "doc_id"))
        bad = chunks.groupBy("doc_id").agg(F.min(F.coalesce(F.size("embedding"), F.lit(0))).alias("lo"), F.max(F.size("embedding")).alias("hi")).filter("lo < 1 or lo != hi")
        if not bad.isEmpty():
            raise ValueError("every chunk of a document needs a vector, all of one length")
        if not documents.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").isEmpty():
            raise ValueError("every document needs a chunk")
        with self.snapshots.writer() as (at, out):
            now = self._at(at)
            self._write(out, upsert(now[0], documents) if now else documents, upsert(now[1].select(chunks.columns), chunks) if now else chunks)

    def remove(self, ids: DataFrame) -> bool:
        now = self.tables()
        if not now or not now[0].join(ids.select("doc_id"), "doc_id", "left_semi").limit(1).count():
            return False
        with self.snapshots.writer() as (at, out):
            now = self._at(at)
            self._write(out, delete(now[0], ids), delete(now[1], ids))
        return True


def ring(events: DataFrame, keep: int, order: list[Column], key: str | None = None) -> DataFrame:
    """The last `keep` entries; with a key only its newest counts. 0 keeps none.

    The global rank is taken over at most `keep` rows a partition: a limit of the sorted rows.
    """
    if keep <= 0:
        return events.limit(0)
    if key:
        events = events.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("nth = 1").drop("nth")
    return events.orderBy(*order).limit(keep)


def cache_state(events: DataFrame, ttl_s: int, key: str = "key", ts: str = "ts") -> DataFrame:
    """What each look-up in a cache finds whose hits do not renew the expiry: key, ts, hit, stored (the time of the entry it meets).

    A miss at t stores an entry that serves look-ups before t + ttl. The look-ups of a key are read in order, with one time as state, however many they are.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.filter(F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).repartition("k").sortWithinPartitions("k", "t")

    def fold(batches):
        at = None
        last: tuple = ()
        for b in batches:
            hit, stored = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (k,) != last:
                    last, at = (k,), None
                fresh = at is not None and t - at < ttl_s * 1_000_000
                at = at if fresh else t
                hit.append(fresh)
                stored.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit, pa.bool_()), pa.array(stored, pa.int64())], names=["k", "t", "hit", "s"])

    got = rows.mapInArrow(fold, f"k {kind}, t long, hit boolean, s long")
    return got.select(F.col("k").alias(key), F.timestamp_micros("t").alias("ts"), "hit", F.timestamp_micros("s").alias("stored"))


def evict(cache: DataFrame, most: int = 256, used: str = "used_at") -> DataFrame:
    """The `most` entries of a cache that were used last."""
    return ring(cache, most, [F.desc(used), F.asc("key")])
