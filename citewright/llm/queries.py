"""The registered opN_ queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citewright.llm import decontam, ngramjoin, resample, sharding, warc
from citewright.llm.common import read


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citewright.llm.langid import identify_documents

    return identify_documents(read(spark, sf_dir, "documents"))


def op2_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citewright.llm.epsgrid import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"), 0.98)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citewright.llm.lmscore import score_documents

    return score_documents(read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from citewright.llm.bpe import encode_documents

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citewright.llm.ngramjoin import join

    return join(read(spark, sf_dir, "documents"))


#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citewright.llm.sharding import assign

    return assign(read(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citewright.llm.warc import round_trip

    return round_trip(spark, sf_dir)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citewright.llm.htmlwrap import extract

    return extract(read(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citewright.llm.decontam import contained

    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citewright.llm.toxicity import score_documents

    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from citewright.llm.piece import encode_documents

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citewright.llm.whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_langid": op1_langid,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_sharding": op6_sharding,
    "op7_warc": op7_warc,
    "op8_html": op8_html,
    "op9_decontamination": op9_decontamination,
    "op3_lm": op3_lm,
    "op2_epsilon_grid": op2_epsilon_grid,
    "op10_toxicity": op10_toxicity,
    "op4_bpe": op4_bpe,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_whitening": op12_whitening,
    "op13_resampling": op13_resampling,
}
ORACLES: dict[str, str] = {
    "op5_ngram_jaccard": ngramjoin.SQL,
    "op6_sharding": sharding.SQL.format(limit=SHARD_BYTES),
    "op7_warc": warc.SQL,
    "op9_decontamination": decontam.SQL,
    "op13_resampling": resample.SQL,
}
