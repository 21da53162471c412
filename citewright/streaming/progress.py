"""Progress of requests while they are answered: frames that readers see before the next step starts.

`Frames` is handed to answer(), which calls it after every step of every pass. A call appends one small Parquet table to the folder, with the number of the step, so what is there is complete and in
order, and a run that dies leaves what it had told. `follow` reads the folder as a stream, any number of readers at their own pace; each keeps its place in a checkpoint, so a reader that comes
back goes on after the last frame it was given. With keep_alive a comment frame comes every so many seconds even if nothing happens, so that connections stay open.
`merged` keeps what is known of each request: of each field the value that was told last, whatever the order in which frames arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from citewright.operators.frames import materialise
from citewright.operators.snapshots import Snapshots

#: What a request's type of frame says: it was taken up, a step is done, a pass begins anew, a sentence stands, it ended.
TYPES = ("accepted", "stage", "loop", "sentence", "complete", "error")
KEEP_ALIVE = ": keep-alive\n\n"


def fields(kind: str) -> StructType:
    return StructType.fromDDL(f"request_id {kind}, step long, ord long, type string, data string")


class Frames:
    """The frames of one run of answer() under path. kind: the type of request ids, as SQL writes it."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "long"):
        self.spark, self.path, self.kind = spark, path, kind
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(fs)
        self.step = self._last()

    def _last(self) -> int:
        """The last step told, also by a run before this one."""
        return self.read().agg(F.coalesce(F.max("step"), F.lit(-1))).first()[0]

    def read(self) -> DataFrame:
        return self.spark.read.schema(fields(self.kind)).parquet(self.path)

    def __call__(self, type_: str, rows: DataFrame, *order: str) -> None:
        """Tell a frame for each row of request_id and what else it has, the data of the frame. Frames of a request stand in the given order."""
        self.step += 1
        known = [c for c in rows.columns if c != "request_id"]
        ord_ = F.struct(*order) if order else F.lit(0)
        # frames of one request and step are few (its sentences); a window numbers them
        nth = F.row_number().over(Window.partitionBy("request_id").orderBy(ord_)) - 1
        data = F.to_json(F.struct(*known)) if known else F.lit("{}")
        made = rows.select("request_id", F.lit(self.step).cast("long").alias("step"), nth.cast("long").alias("ord"), F.lit(type_).alias("type"), data.alias("data"))
        made.write.mode("append").parquet(self.path)


def frame(event_id, type_, data):
    return F.concat(F.lit("id: "), event_id, F.lit("\nevent: "), type_, F.lit("\ndata: "), data, F.lit("\n\n"))


def follow(spark: SparkSession, path: str, kind: str = "long", keep_alive_s: int = 0) -> DataFrame:
    """A stream of request_id, step, ord, type, data, frame. keep_alive_s: seconds between comment frames (0: none), which have no request and no step."""
    told = spark.readStream.schema(fields(kind)).parquet(path)
    told = told.withColumn("frame", frame(F.concat_ws("-", "step", "ord"), F.col("type"), F.col("data")))
    if not keep_alive_s:
        return told
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields(kind)]
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.col("value") % keep_alive_s == 0).select(*none, F.lit(KEEP_ALIVE).alias("frame"))
    return told.unionByName(ticks)


def ordered(sink: Callable[[DataFrame, int], None], after: tuple[int, int] = (-1, -1)):
    """A foreachBatch function that hands frames on in order, those after the step and place `after` only (what a reader says it has seen last)."""

    def write(batch: DataFrame, epoch: int) -> None:
        new = batch.filter(F.col("step").isNull() | (F.struct("step", "ord") > F.struct(F.lit(after[0]).cast("long"), F.lit(after[1]).cast("long"))))
        sink(new.orderBy(F.col("step").asc_nulls_last(), "request_id", "ord"), epoch)

    return write


def merged(spark: SparkSession, path: str):
    """A foreachBatch function that merges frames into snapshots under path: request_id, field, value, step, ord. The last told value of a field stands, so a batch that comes twice changes nothing."""
    kept = Snapshots(spark, path, lease_s=600)

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.filter("step is not null").select("request_id", "step", "ord", F.explode(F.from_json("data", "map<string,string>")).alias("field", "value"))
        rows = rows.unionByName(batch.filter("step is not null").select("request_id", "step", "ord", F.lit("last").alias("field"), F.col("type").alias("value")))
        rows = materialise(rows)
        if rows.isEmpty():
            return
        with kept.writer(wait_s=60) as (at, out):
            both = spark.read.parquet(f"{at}/state").unionByName(rows) if at else rows
            newest = both.groupBy("request_id", "field").agg(F.max(F.struct("step", "ord", "value")).alias("m"))
            newest.select("request_id", "m.step", "m.ord", "field", "m.value").write.parquet(f"{out}/state")

    return write


def state_of(spark: SparkSession, path: str) -> DataFrame | None:
    """request_id, state (a map from field to its last value) as merged() left it; none before the first frame."""
    at = Snapshots(spark, path).current()
    return spark.read.parquet(f"{at}/state").groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("state")) if at else None
