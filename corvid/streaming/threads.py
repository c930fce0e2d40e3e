"""Threads kept as keyed state: each message goes to its thread's state, and what comes out are the parts of it that changed.

A thread's messages are a map by place, so one that comes twice is held once. Beside them stands the open part: its messages and
place. Messages that come in order extend it, whatever the thread's length; one that comes late makes its thread be cut anew. Work
for a batch depends on the batch and on the threads with late messages, never on what has been read before.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corvid import model
from corvid.operators.index import Snapshots

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Part:
    """The open part of a thread: the messages from `first` on that it holds. size: their characters and those between them."""

    def __init__(self, number: int = 0, first: int = 0, messages: list[str] | None = None):
        self.number, self.first, self.messages = number, first, messages or []
        self.size = sum(len(m) + 2 for m in self.messages)

    def then(self, text: str, most: int, overlap: int) -> Part | None:
        """Takes in the next message; where it doesn't fit, this part is closed and stays as it is, and the new one is returned."""
        if self.messages and self.size + len(text) + 2 > most:
            kept = self.messages[-overlap:] if overlap else []
            return Part(self.number + 1, self.first + len(self.messages) - len(kept), [*kept, text])
        self.messages.append(text)
        self.size += len(text) + 2
        return None


class ThreadProcessor(StatefulProcessor):
    """quiet: None emits changed parts with every batch, else a thread's parts once no message has come for so many milliseconds."""

    def __init__(self, most: int, overlap: int, quiet: int | None):
        self.most, self.overlap, self.quiet = most, overlap, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("messages", "seq long", "text string")
        # the last place, the open part, how many parts have been emitted, and the first that has changed since
        self.open = handle.getValueState("open", "last long, number int, first int, messages array<string>, emitted int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = sorted({r["seq"]: r["text"] for r in rows}.items())
        fresh = [(s, t) for s, t in new if not self.held.containsKey((s,)) or self.held.getValue((s,))[0] != t]
        state = self.open.get() if self.open.exists() else None
        for s, t in fresh:
            self.held.updateValue((s,), (t,))
        if not fresh:
            return
        if self.quiet is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
            return
        if state is None:
            yield from self._cut(key, Part(), fresh, fresh[-1][0], 0)
        elif fresh[0][0] > state[0]:
            yield from self._cut(key, Part(state[1], state[2], list(state[3])), fresh, fresh[-1][0], state[4])
        else:
            yield from self._anew(key, state[4])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._anew(key, self.open.get()[4] if self.open.exists() else 0)

    def _anew(self, key: tuple, emitted: int) -> Iterator[Row]:
        rows = sorted((k[0], v[0]) for k, v in self.held.iterator())
        yield from self._cut(key, Part(), rows, rows[-1][0], emitted)

    def _cut(self, key: tuple, part: Part, rows: list[tuple[int, str]], last: int, emitted: int) -> Iterator[Row]:
        out = lambda p: Row(thread=key[0], chunk_index=p.number, first=p.first, messages=p.messages)
        for _, text in rows:
            if (following := part.then(text, self.most, self.overlap)) is not None:
                yield out(part)
                part = following
        yield out(part)
        for gone in range(part.number + 1, emitted):  # fewer parts than before
            yield Row(thread=key[0], chunk_index=gone, first=0, messages=None)
        self.open.update((last, part.number, part.first, part.messages, part.number + 1))

    def close(self) -> None:
        pass


#: Columns of a table of threads, by type of the thread's key.
def part_schema(key_type: str) -> str:
    return f"thread {key_type}, chunk_index int, first int, messages array<string>"


def regroup(messages: DataFrame, threads: Snapshots, checkpoint: str, rendered: Column, key: str = "thread", by: str = "seq", quiet: float | None = None, most: int = model.THREAD_CHARS, overlap: int = model.THREAD_OVERLAP) -> StreamingQuery | None:
    """Keeps a table of threads' parts (part_schema, in buckets of thread) from a stream of messages, in whatever order they come.

    quiet: None drains what is there and ends, else the query goes on, and a thread is written once it has been still for so many
    seconds. A batch that is run again finds the state of before it, so it gives the same rows.
    """
    spark = messages.sparkSession
    rows = messages.select(F.col(key).alias("thread"), F.col(by).cast("long").alias("seq"), rendered.alias("text")).where("thread is not null and seq is not null and text is not null")
    schema = part_schema(rows.schema["thread"].dataType.simpleString())

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            changed = batch.select("thread", "chunk_index")
            threads.merge(changed.select("thread"), lambda current: current.join(changed, ["thread", "chunk_index"], "left_anti").unionByName(batch.where("messages is not null")))
        finally:
            batch.unpersist()

    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, ROCKS)  # keyed state with maps and timers needs it
    try:
        processor = ThreadProcessor(most, overlap, None if quiet is None else int(quiet * 1000))
        kept = rows.groupBy("thread").transformWithState(processor, schema, "update", "none" if quiet is None else "processingTime")
        writer = kept.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start() if quiet is None else writer.trigger(processingTime="1 second").start()
        if quiet is None:
            query.awaitTermination()
        return None if quiet is None else query
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
