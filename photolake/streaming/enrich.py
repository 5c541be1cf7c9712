"""Continuous ingestion: new files of a folder are graded batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from photolake.config import Config
from photolake.functions.text import basename, content_hash, is_image
from photolake.operators.events import windowed


def photo_stream(spark: SparkSession, folder: str, config: Config = Config()) -> DataFrame:
    """``path, filename, content_hash`` of files as they appear, a few in each batch.

    Empty files are no pictures and are passed over. A file that is changed in place keeps its path and is not seen again by the stream; a rescan finds it.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", config.batch_photos).load(folder)
    return files.where(is_image(F.col("path"))).select("path", basename(F.col("path")).alias("filename"), content_hash(F.col("content"), config.hash_prefix_bytes).alias("content_hash"))


def each_batch(stream: DataFrame, into: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], poll_seconds: int | None = None) -> StreamingQuery:
    """Run ``work`` on each batch and write its rows under the batch's number.

    A batch that is run again after a failure replaces what it had written, so each row is there once.
    Without ``poll_seconds`` the query ends when all there is has been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{into.rstrip('/')}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{poll_seconds} seconds") if poll_seconds else writer.trigger(availableNow=True)).start()


def event_windows(events: DataFrame, length: str, late: str, *by: str) -> DataFrame:
    """Counts by window of a stream of events whose ``ts`` may come ``late``; older ones are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return windowed(timed, length, *by)


class Progress(StreamingQueryListener):
    """Tells ``report(stage, done, name)`` how many rows a query has read, and when it has ended."""

    def __init__(self, report: Callable[[str, int, str], None]) -> None:
        self.report, self.done = report, {}

    def onQueryStarted(self, event) -> None:
        self.done[event.id] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.done[p.id] = self.done.get(p.id, 0) + p.numInputRows
        self.report("running", self.done[p.id], p.name or "")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report("failed" if event.exception else "complete", self.done.pop(event.id, 0), "")
