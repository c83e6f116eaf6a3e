"""Streams of job events and of files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; only a session on this machine may have none, and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all workers share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Job events as they arrive in a folder or file of Parquet."""
    glob = f"{path[:-1]}[{path[-1]}]"  # as a pattern a path may name a file or a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(glob)


def daily_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """(day, status, events): tumbling daily counts by event time; with `late`, later events than that are dropped and finished days can be written once."""
    rows = events.filter("ts is not null")
    if late:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "status").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("day"), "status", "events")


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives for all that is there now: runs it to the end and returns the written result."""
    spark = stream.sparkSession
    place = _place(spark)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{place}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def ingest(files: DataFrame, parse, sink: str, checkpoint: str, on_error: str = "skip"):
    """Starts a stream of raw files (binaryFile) to page rows in folders `sink`/batch=N, with its progress in `checkpoint`.

    Both folders are the caller's and stay: a stream started again with them goes on after the files that it has read. A
    batch that runs again writes its own folder again, so no file is there twice.
    """
    from foliolens.sources.pages import extract_pages

    def write(batch: DataFrame, n: int) -> None:
        extract_pages(batch, parse, on_error).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
