"""Threads of any length cut between messages into parts, without any row, task or group that holds a thread.

A part begins with up to `overlap` messages of the one before it and goes on until a message no longer fits. So a cut is known by two
small numbers, the message that didn't fit and how many before it are carried over, and the next cut follows from these and the
messages after it, at most a part's length of them. A long thread is cut into blocks of messages: each block tells for every
state that it may be entered in the state that it is left in; these maps are chained, block by block; and then all blocks, which know
their entry by now, write their parts at once. A thread of one block, as nearly all are, is entered at its beginning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid import model
from corvid.operators import order

#: Messages of a block.
BLOCK = 4096


def grouped(keys: int, settle: Callable[[tuple, pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls settle with each run of rows that agree in the first `keys` columns; only one run is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            marks = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
            begin = 0
            for at in range(batch.num_rows + 1):
                if at == batch.num_rows or marks[at] != (marks[at - 1] if at else key):
                    if at > begin:
                        held.append(batch.slice(begin, at - begin))
                        key = marks[begin]
                        begin = at
                    if at < batch.num_rows and held:
                        if (out := settle(key, pa.Table.from_batches(held))) is not None:
                            yield out
                        held = []
        if held and (out := settle(key, pa.Table.from_batches(held))) is not None:
            yield out

    return run


class Cuts:
    """The cuts of a run of messages. start: the place of the first one; size: of each, with what stands between two."""

    def __init__(self, start: int, size: np.ndarray, most: int, overlap: int):
        self.start, self.most, self.overlap = start, most, overlap
        self.sums = np.concatenate([[0], np.cumsum(size)])

    def then(self, at: int, carried: int) -> tuple[int, int] | None:
        """The cut after the one at a message, which opens a part with so many carried over; None where it goes to the end."""
        first = at - carried - self.start
        # the message at the cut is in its part, whatever its size
        after = max(int(np.searchsorted(self.sums, self.sums[first] + self.most, side="right")) - 1, at - self.start + 1)
        if after >= len(self.sums) - 1:
            return None
        return self.start + after, min(self.overlap, after - first)


def thread_parts(messages: DataFrame, key: str, by: str, text: str, most: int = model.THREAD_CHARS, overlap: int = model.THREAD_OVERLAP, block: int = BLOCK) -> DataFrame:
    """(key, chunk_index, first, last, content) of threads, whose messages are rows (key, by, text) in the order of by; a null text
    counts as empty."""
    ahead = most // 2 + 2  # a message takes two characters at least, so no part has more
    block = max(block, ahead + overlap)
    rows = messages.select(F.col(key).alias("_key"), F.col(by).alias("_by"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    placed = order.positions(rows, ["_key", "_by"], "_pos")
    spans = placed.groupBy("_key").agg(F.min("_pos").alias("_from"), F.count("*").alias("_n"))
    numbered = placed.alias("p").join(spans.alias("s"), F.col("p._key").eqNullSafe(F.col("s._key"))).select("p._key", (F.col("_pos") - F.col("_from")).alias("at"), "_text", F.col("_n").alias("n"))
    inside = F.pmod("at", F.lit(block))
    own = F.floor(F.col("at") / block).cast("long")
    blocks = F.array_compact(F.array(own, F.when((inside < ahead) & (own > 0), own - 1), F.when((inside >= block - overlap) & ((own + 1) * block < F.col("n")), own + 1)))
    spread = numbered.withColumn("block", F.explode(blocks))
    keys = ["_key", "block"]
    key_field = T.StructField("_key", rows.schema["_key"].dataType)

    def sizes(table: pa.Table, lengths: str) -> Cuts:
        return Cuts(table.column("at")[0].as_py(), table.column(lengths).to_numpy() + 2, most, overlap)

    # long threads: the state in which each block is left, by that in which it is entered
    mapped = T.StructType([key_field, T.StructField("block", T.LongType()), T.StructField("entry", T.ArrayType(T.LongType())), T.StructField("leave", T.ArrayType(T.LongType())), T.StructField("parts", T.ArrayType(T.IntegerType()))])

    def through(name: tuple, table: pa.Table) -> pa.RecordBatch:
        number = name[1]
        cuts, begin, end = sizes(table, "length"), number * block, (number + 1) * block
        code = lambda state: state[0] * (overlap + 1) + state[1]
        known: dict[tuple[int, int], tuple[int, int]] = {}  # (the state in which the block is left, or -1; parts until then)
        past = min(end, cuts.start + len(cuts.sums) - 1)  # a thread's last block may be short
        entries = [(0, 0)] if number == 0 else [(at, c) for at in range(begin, min(begin + ahead + 1, past)) for c in range(min(overlap, 1), overlap + 1)]
        for entry in entries:
            path, state = [], entry
            while state is not None and state[0] < end and state not in known:
                path.append(state)
                state = cuts.then(*state)
            left, parts = (-1, 0) if state is None else known[state] if state in known else (code(state), 0)
            for s in reversed(path):
                parts += 1
                known[s] = (left, parts)
        columns = [code(e) for e in entries], [known[e][0] for e in entries], [known[e][1] for e in entries]
        return pa.RecordBatch.from_arrays([pa.array([name[0]], table.schema.field(0).type), pa.array([number]), *(pa.array([c], t) for c, t in zip(columns, (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True))], names=mapped.names)

    long = spread.where(F.col("n") > block).select(*keys, "at", F.length("_text").cast("long").alias("length"))
    maps = long.repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(grouped(2, through), mapped)
    entered = T.StructType([key_field, T.StructField("block", T.LongType()), T.StructField("entry", T.LongType()), T.StructField("number", T.IntegerType())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, number = object(), 0, 0
        for batch in batches:
            out = []
            for name, at, entry, leave, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != key or at == 0:
                    key, state, number = name, 0, 0
                if state < 0:
                    continue
                out.append((name, at, state, number))
                if at == 0 or state < (at + 1) * block * (overlap + 1):  # else no cut falls into this block
                    k = entry.index(state)
                    state, number = leave[k], number + parts[k]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int32()), strict=True)], names=entered.names)

    entries = maps.repartition("_key").sortWithinPartitions("_key", "block").mapInArrow(chain, entered)

    # all blocks, each from its entry
    made = T.StructType([key_field, T.StructField("chunk_index", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("content", T.StringType())])

    def write(name: tuple, table: pa.Table) -> pa.RecordBatch | None:
        texts = table.column("_text").to_pylist()
        cuts = Cuts(table.column("at")[0].as_py(), np.array([len(t) + 2 for t in texts], np.int64), most, overlap)
        state: tuple[int, int] | None = divmod(table.column("entry")[0].as_py(), overlap + 1)
        number, end, out = table.column("number")[0].as_py(), (name[1] + 1) * block, []
        while state is not None and state[0] < end:
            first, following = state[0] - state[1], cuts.then(*state)
            last = following[0] - 1 if following else cuts.start + len(texts) - 1
            out.append((name[0], number, first, last, "\n\n".join(texts[first - cuts.start : last + 1 - cuts.start])))
            state, number = following, number + 1
        types = (table.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=made.names) if out else None

    short = spread.where(F.col("n") <= block).select(*keys, "at", "_text", F.lit(0).cast("long").alias("entry"), F.lit(0).alias("number"))
    others = spread.where(F.col("n") > block).alias("s").join(entries.alias("e"), F.col("s._key").eqNullSafe(F.col("e._key")) & (F.col("s.block") == F.col("e.block"))).select("s._key", "s.block", "at", "_text", "entry", "number")
    done = short.unionByName(others).repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(grouped(2, write), made)
    return done.withColumnRenamed("_key", key)
