import random

import pytest
from pyspark.sql import functions as F

from corvid.operators.threads import thread_parts
from corvid.streaming.threads import Part


def plain(texts, most=1500, overlap=2):
    part, out = Part(), []
    for t in texts:
        if (following := part.then(t, most, overlap)) is not None:
            out.append(part)
            part = following
    return [(p.number, p.first, p.first + len(p.messages) - 1, "\n\n".join(p.messages)) for p in [*out, part]]


@pytest.mark.parametrize(("most", "overlap", "block"), [(1500, 2, 4096), (60, 2, 1), (60, 0, 40), (60, 3, 33)])
def test_blocks_join_as_one_walk_does(spark, most, overlap, block):
    r = random.Random(most + overlap)
    threads = {k: ["x" * r.choice([0, 1, 3, 10, 25, 61, 90]) + str(i) for i in range(n)] for k, n in (("a", 1), ("b", 700), ("c", 33), ("d", 1300), (None, 5))}
    threads["short"] = [""] * 400
    rows = [(k, i, t if t else None) for k, ts in threads.items() for i, t in enumerate(ts)]
    r.shuffle(rows)
    got = thread_parts(spark.createDataFrame(rows, "thread string, seq int, text string").repartition(5), "thread", "seq", "text", most, overlap, block).collect()
    for k, ts in threads.items():
        assert sorted((x.chunk_index, x.first, x.last, x.content) for x in got if x.thread == k) == plain(ts, most, overlap), k


def test_one_thread_of_a_million_messages(spark):
    n = 1_000_000
    text = F.concat(F.repeat(F.lit("m"), F.pmod(F.xxhash64("id"), F.lit(90)).cast("int")), F.col("id").cast("string"))
    rows = spark.range(n).select(F.lit("one").alias("thread"), F.col("id").alias("seq"), text.alias("text"))
    texts = [x.text for x in rows.select("text").collect()]
    want = plain(texts)
    got = thread_parts(rows, "thread", "seq", "text").agg(F.count("*").alias("n"), F.sum(F.xxhash64("chunk_index", "first", "last", "content").cast("decimal(38,0)")).alias("h")).first()
    told = spark.createDataFrame(want, "chunk_index int, first int, last int, content string").agg(F.count("*").alias("n"), F.sum(F.xxhash64("chunk_index", "first", "last", "content").cast("decimal(38,0)")).alias("h")).first()
    assert tuple(got) == tuple(told) and got.n > 30_000


def test_no_messages(spark):
    assert thread_parts(spark.createDataFrame([], "thread int, seq int, text string"), "thread", "seq", "text").collect() == []
