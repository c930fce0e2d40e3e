"""Incremental work as Structured Streaming: change feeds into snapshots, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from corvid.operators.index import Snapshots, latest, replace_objects, upsert


def sync(changes: DataFrame, snapshots: Snapshots, checkpoint: str, whole_objects: bool = True, on_success: Callable[[int, int], None] | None = None, seconds: int | None = None) -> StreamingQuery | None:
    """Drains a stream of chunk rows into a snapshot table. Progress is checkpointed after a batch has been committed; a batch
    that is run again replaces the same rows, so it changes nothing. whole_objects: a batch's objects replace all their chunks.
    A batch rewrites only the buckets that its objects are in.

    on_success is called with each batch's number and version once it is committed.
    seconds: None drains what is there and ends; else a batch starts so often, until the query is stopped.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = latest(batch, "chunk_id", "indexed_at") if "indexed_at" in batch.columns else batch.dropDuplicates(["chunk_id"])
        rows = rows.select(*snapshots.schema.names)
        version = snapshots.merge(rows, lambda current: replace_objects(current, rows) if whole_objects else upsert(current, rows))
        if on_success:
            on_success(number, version)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if seconds is not None:
        return writer.trigger(processingTime=f"{seconds} seconds").start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return None


def bounded(spark: SparkSession, path: str, schema: T.StructType, most_files: int = 100, format: str = "parquet") -> DataFrame:
    """A stream over a folder of files that takes at most so many of them into one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).format(format).load(path)


class Watcher(StreamingQueryListener):
    """Keeps each query's last progress and how it ended: (batch, rows in, rows a second), for a job's heartbeat."""

    def __init__(self):
        self.progress: dict[str, tuple[int, int, float]] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event):
        self.progress[str(event.id)] = (-1, 0, 0.0)

    def onQueryProgress(self, event):
        p = event.progress
        self.progress[str(p.id)] = (p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended[str(event.id)] = event.exception


def once(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each event once, while its repetition is at most so late."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and hour of event time (an extension: the record sources have no windows)."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")
