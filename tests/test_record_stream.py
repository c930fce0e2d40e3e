import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.operators import index
from corvid.sources.datasource import RecordStream, Span, register
from corvid.streaming import feed


def line(k):
    return json.dumps({"n": k, "text": "ü" * (k % 50)}, ensure_ascii=False).encode() + b"\n"


def test_offsets_stop_at_whole_lines_and_spans_share_them_out(tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"".join(map(line, range(300))) + b'{"half"')
    (tmp_path / "b.jsonl").write_bytes(b"\n\n" + line(7) + b"no json\n")
    (tmp_path / "c.txt").write_bytes(b"other")
    options = {"path": f"file://{tmp_path}", "max_bytes": "2000", "span_bytes": "700"}
    stream, start, seen, batches = RecordStream(options), {}, [], 0
    while (end := stream.latestOffset()) != start:
        own = [r for p in stream.partitions(start, end) for r in stream.read(p)]
        assert sum(end[k] - start.get(k, 0) for k in end) <= 2000 + 200
        seen, start, batches = seen + own, dict(end), batches + 1
    assert batches >= 6 and [json.loads(t)["n"] for f, _, t in seen if f == "a.jsonl"] == list(range(300))
    assert [t for f, _, t in seen if f == "b.jsonl"] == [line(7).decode().strip().replace(": ", ":").replace(", ", ","), "no json"]
    assert len({(f, at) for f, at, _ in seen}) == len(seen)
    with (tmp_path / "a.jsonl").open("ab") as f:
        f.write(b':1}\n' + line(301))
    again = RecordStream(options)  # a restart: the offsets come from the checkpoint
    again.partitions({}, start)
    end = again.latestOffset()
    assert [t for p in again.partitions(start, end) for _, _, t in again.read(p)][0] == '{"half":1}'
    # any cut into spans gives each line once
    data, r = (tmp_path / "a.jsonl").read_bytes(), random.Random(3)
    for _ in range(20):
        cuts = [0, *sorted(r.sample(range(1, len(data)), 6)), len(data)]
        got = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in again.read(Span("a.jsonl", a, b))]
        assert len(got) == 302 and [at for _, at, _ in got] == sorted({at for _, at, _ in got})


def test_a_restart_gives_each_record_once(spark, tmp_path):
    register(spark)
    (tmp_path / "in").mkdir()
    schema = T.StructType.fromDDL("chunk_id string, object_uri string, content string")
    table = index.Snapshots(spark, f"file://{tmp_path}/t", schema, buckets=2)
    versions = []

    def drain():
        rows = spark.readStream.format("corvid_records").option("path", f"file://{tmp_path}/in").option("max_bytes", 1500).load()
        chunks = rows.select(F.concat_ws("#", "object", F.col("row").cast("string")).alias("chunk_id"), F.col("object").alias("object_uri"), F.col("record").alias("content"))
        query = feed.sync(chunks, table, f"file://{tmp_path}/c", whole_objects=False, on_success=lambda n, v: versions.append(n), seconds=0)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(json.loads(r.content)["n"] for r in table.read().collect())

    (tmp_path / "in" / "a.jsonl").write_bytes(b"".join(map(line, range(100))))
    assert drain() == list(range(100)) and len(set(versions)) >= 3
    with (tmp_path / "in" / "a.jsonl").open("ab") as f:
        f.write(line(100))
    (tmp_path / "in" / "b.jsonl").write_bytes(line(101))
    before = len(versions)
    assert drain() == list(range(102)) and len(versions) - before <= 2 and len(set(versions)) == len(versions)
