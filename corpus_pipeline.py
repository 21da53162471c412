"""From raw documents to token counts and digests of clean, distinct ones.

Toxic documents go, then those in no known language, then all but one of each group of near-duplicates, then those that hold a benchmark
item; the rest is encoded. Every stage reads what the one before it wrote. Stages keep all columns; the last returns
those of the encoder. Rows that share a doc_id are one document to the third stage, which keeps one of them; rows without doc_id
cannot be named by a group and stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.llm import bpe, decontam, langid, ngramjoin, toxicity
from citewright.llm.common import cut, read, remove, shared_dir

TOXIC, SURE, BROADCAST_IDS = 0.3, 0.5, 1_000_000


def free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def others(df: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in df.columns if c != "doc_id")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the ids (distinct, one column doc_id): by broadcast while they are few, by a shuffle else."""
    ids = cut(ids)
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those with a toxicity of TOXIC or more, by a machine trained on the labelled documents that are not held out.

    Null and empty texts have no toxic word and stay; very long texts are scored whole; repeated rows go or stay together; a score of exactly TOXIC goes; without labels
    of both kinds, all stay; an empty table gives an empty one. Columns of docs may have any names.
    """
    model = toxicity.train(docs.filter(~toxicity.held_out()), read(spark, sf_dir, "labels"))
    name = free_name(docs, "toxicity")
    return toxicity.score(docs, model, extra=others(docs), name=name).filter(F.col(name) < TOXIC).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in one of the learned languages with a probability of SURE or more.

    Null and empty texts and those without a letter have no language and go; very long texts are read whole; repeated rows go or stay together; a tie between two
    languages leaves each SURE at most and stays only if it is exactly that; if no document has a language to learn from, all go; an empty table gives an empty one.
    """
    model = langid.train(docs.filter(~langid.held_out()))
    lang, score = free_name(docs, "language"), free_name(docs, "sure")
    told = langid.identify(docs, model, extra=others(docs), names=(lang, score))
    return told.filter((F.col(lang) != "und") & (F.col(score) >= SURE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by near-equal shingle sets the one with the smallest doc_id.

    Null and empty texts link with nothing and stay; very long texts are joined whole. Of rows that share a doc_id one stays: the least by text (null first), then by the
    other columns as JSON, so which one it is does not depend on how rows are stored. Rows without doc_id stay, as no group can name them. An empty table gives an empty one.
    """
    groups = ngramjoin.join(docs.select("doc_id", "text"))
    kept = without(docs, groups.filter("doc_id != component_id").select("doc_id").distinct())
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    row = free_name(docs, "row")
    rest = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others(docs))]))
    # rows without doc_id are no group: each keeps its number 1
    named = kept.filter("doc_id is not null").withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy("text", rest)))
    return named.filter(F.col(row) == 1).select(*docs.columns).unionByName(kept.filter("doc_id is null").select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those that hold at least four fifths of a benchmark item's shingles.

    Null and empty texts hold nothing and stay, as do rows without doc_id; very long texts are searched whole; rows that share a doc_id go together; a share of exactly four
    fifths goes; with an empty benchmark all stay; an empty table gives an empty one.
    """
    found = decontam.contained(docs, read(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id").distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row of docs; null and empty texts have no tokens, very long ones are encoded whole."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: A support vector machine is not expressible in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted once the next one has read it."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
