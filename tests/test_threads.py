import random
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.operators import chunk, index
from corvid.session import shared_folder
from corvid.streaming import feed, threads

SCHEMA = "thread string, seq long, text string"


def parts(spark, rows):
    """What the batch operator makes of all messages."""
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.thread, r.chunk_index): (r.first, r.content) for r in chunk.thread_parts(chunk.thread_messages(df, "thread", "seq", F.col("text")), "thread").collect()}


def test_state_equals_the_batch_whatever_the_order(spark):
    work = f"{shared_folder(spark)}/tests/{uuid.uuid4().hex}"
    r = random.Random(4)
    rows = [(f"t{t}", s, f"{t}.{s} " + "x" * r.choice([5, 200, 700, 1600])) for t, n in (("a", 1), ("b", 40), ("c", 9), ("d", 120)) for s in range(n)]
    order = sorted(rows, key=lambda x: x[1] + r.choice([0, 0, 0, 25]))  # mostly in order, some late
    for k in range(4):
        batch = order[k * 45 : (k + 1) * 45] + order[:3] * (k == 2)  # and some again
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{work}/in")
    table = index.Snapshots(spark, f"{work}/t", T.StructType.fromDDL(threads.part_schema("string")), key="thread", buckets=4)
    stream = lambda: feed.bounded(spark, f"{work}/in", T.StructType.fromDDL(SCHEMA), 1)
    threads.regroup(stream(), table, f"{work}/c", F.col("text"))
    got = lambda: {(x.thread, x.chunk_index): (x.first, "\n\n".join(x.messages)) for x in table.read().collect()}
    assert got() == parts(spark, order[:180])
    # a restart goes on from the state, and reads only what is new
    late = [("tb", -5, "first of all"), ("td", 500, "at the end"), (None, 1, "no thread"), ("ta", None, "no place"), ("ta", 7, None)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(f"{work}/in")
    version = table.version()
    threads.regroup(stream(), table, f"{work}/c", F.col("text"))
    assert got() == parts(spark, order[:180] + late[:2]) and table.version() == version + 1


def test_parts_by_the_rule():
    part, closed = threads.Part(), []
    for text in ("a" * 10, "b" * 10, "c" * 10, "d" * 50, "e"):
        if (following := part.then(text, 30, 2)) is not None:
            closed.append((part.first, [m[0] for m in part.messages]))
            part = following
    assert closed == [(0, ["a", "b"]), (0, ["a", "b", "c"]), (1, ["b", "c", "d"])] and (part.number, part.first, [m[0] for m in part.messages]) == (3, 2, ["c", "d", "e"])


def test_quiet_threads_come_out_by_timer(spark):
    work = f"{shared_folder(spark)}/tests/{uuid.uuid4().hex}"
    spark.createDataFrame([("a", 2, "two"), ("a", 1, "one")], SCHEMA).coalesce(1).write.parquet(f"{work}/in")
    table = index.Snapshots(spark, f"{work}/t", T.StructType.fromDDL(threads.part_schema("string")), key="thread", buckets=2)
    query = threads.regroup(feed.bounded(spark, f"{work}/in", T.StructType.fromDDL(SCHEMA)), table, f"{work}/c", F.col("text"), quiet=1)
    try:
        import time

        for _ in range(60):
            if table.read().count():
                break
            time.sleep(1)
    finally:
        query.stop()
    assert [x.messages for x in table.read().collect()] == [["one", "two"]]
