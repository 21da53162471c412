"""What several operators need of a DataFrame: materialising it and numbering its rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Groups whose first numbers are broadcast.
GROUPS = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; a local one only where none is named and everything runs on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="citewright-"))


def materialise(df: DataFrame) -> DataFrame:
    """df, worked out once and written to the shared folder; what reads it twice reads files. What is such a frame already stays as it is."""
    if df._jdf.logicalPlan().nodeName() == "LogicalRDD":
        return df
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Bound what one Arrow batch holds, by rows and bytes: else it is 10,000 texts, however long, and a Python worker holds several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    except Exception:  # the setting does not exist before Spark 4.1
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, worked out once and written to the shared folder by columns: for many short rows a tenth of what materialise() writes, but how rows are dealt is not kept."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """df with the place of each row in the order, from 1. Rows are dealt by ranges and numbered inside them; only the ranges' sizes are summed in one task."""
    kept = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(kept.withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each task
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_part", "_i", "_before")


def ranked_within(df: DataFrame, by: str, *order, name: str = "rank") -> DataFrame:
    """df with each row's place in the order among the rows of its group, from 1. No group is one task: rows are numbered over all groups by ranges, and each group's first number is taken off."""
    rows = numbered(df, by, *order, name="_at")  # what it writes once is read twice here
    first = materialise(rows.groupBy(F.col(by).alias("_g")).agg(F.min("_at").alias("_first")))
    if first.limit(GROUPS + 1).count() <= GROUPS:  # one row a group: no group's rows meet in a task
        first = F.broadcast(first)
    same = F.col("_g").eqNullSafe(F.col(by))
    return rows.join(first, same).withColumn(name, (F.col("_at") - F.col("_first") + 1).cast("int")).drop("_at", "_first", "_g")
