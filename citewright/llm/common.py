"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the separators that end a word in every word-based contract.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; set a local one only where none is named and all runs on one machine (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="citewright-ckpt-"))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach, as Spark names it."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Its cleaner acts, in its own thread, when the driver collects garbage; references from Python end a moment after their objects do, hence the second pass.
    On one machine files are gone at once; elsewhere executors are told first.
    """
    pause = 0.1 if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) else 1.0
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "1m") -> None:
    """Bound what one Arrow batch holds, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    except Exception:  # the setting does not exist before Spark 4.1
        pass


def crc_bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id as text (a null id: `null`), modulo n."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than blank, tab, LF, VT, FF and CR, with A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
