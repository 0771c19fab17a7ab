"""Status messages as a stream: the latest status of each key, a progress that never goes back, windowed counts.

The same functions run on a batch DataFrame, so a stream's result can be compared with the batch's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def keyed_state(events: DataFrame) -> DataFrame:
    """``user_id, latest, done, n``: out-of-order messages change nothing that a later one has said."""
    told = events.withColumn("__k", F.get_json_object("props", "$.k").try_cast("int"))
    order = F.struct("ts", "event_id")
    return told.groupBy("user_id").agg(F.max_by("event_type", order).alias("latest"), F.max("__k").alias("done"), F.count("*").alias("n"))


def windowed_counts(events: DataFrame, *, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """``start, event_type, n``: tumbling windows; messages later than ``late`` are left out of a stream."""
    timed = events.withColumn("__t", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("__t", late) if events.isStreaming else timed
    return timed.groupBy(F.window("__t", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def source(spark: SparkSession, folder: str, schema: StructType, *, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run(state: DataFrame, name: str, checkpoint: str, *, mode: str = "complete") -> StreamingQuery:
    """Start a query that takes in what is there, into a memory table ``name`` (for services, write to a real sink)."""
    return state.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the versions below a folder that are complete, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(hadoop.Path(p, "_SUCCESS")))


def upsert(state: DataFrame, target: str, checkpoint: str, *, keys: tuple[str, ...] = ("user_id",), finished: str | None = None) -> StreamingQuery:
    """Keep a Parquet folder at the latest state: each micro-batch writes a whole version, the one before with the changed keys replaced.

    A micro-batch that is repeated writes the same version again.  Keys whose state fulfils ``finished`` (SQL) are left out
    until they change again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in versions(spark, target) if n < number]
        if before:
            old = spark.read.parquet(f"{target}/version={before[-1]}")
            batch = old.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch)
        kept = batch if finished is None else batch.where(f"not coalesce({finished}, false)")
        kept.write.mode("overwrite").parquet(f"{target}/version={number}")

    return state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
