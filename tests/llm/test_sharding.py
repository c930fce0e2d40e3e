import struct
import zlib

import xxhash

from corvid.llm.common import shared_dir
from corvid.llm.sharding import digest, shuffle_into_shards

SCHEMA = "doc_id long, text string, shard int, slot string, size long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


def check(spark, rows, shards=5):
    got = digest(frame(spark, rows), shards=shards).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == sorted((-1 if i is None else i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < shards and r.grown_shard in (r.shard, shards)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return got


def test_key_law_and_gapless_slots(spark):
    got = check(spark, [(i, f"text {i % 7} é" * (i % 5)) for i in range(2000)])
    sizes = [sum(r.shard == s for r in got) for s in range(5)]
    assert min(sizes) > 320
    assert 250 < sum(r.grown_shard == 5 for r in got) < 420
    again = digest(frame(spark, [(i, "other") for i in range(50)]), shards=5).collect()
    where = {r.doc_id: r.shard for r in got}
    assert all(where[r.doc_id] == r.shard for r in again)


def test_order_is_shuffled_and_buckets_are_small(spark):
    df = frame(spark, [(i, "x" * 1000) for i in range(3000)])
    got = shuffle_into_shards(df, f"{shared_dir(spark)}/s", shards=2, bucket_bytes=100_000)
    for shard in (0, 1):
        ids = [r.id for r in got.where(f"shard = {shard}").orderBy("slot").selectExpr("record.doc_id as id").collect()]
        n = len(ids)
        assert ids != sorted(ids)
        # about half of all neighbours ascend, and early slots hold as many small ids as late ones
        assert 0.4 < sum(a < b for a, b in zip(ids, ids[1:])) / n < 0.6
        assert abs(sum(ids[: n // 2]) / (n // 2) - 1500) < 150


def test_edges(spark):
    check(spark, [(1, None), (1, None), (2, ""), (None, "a"), (None, "a"), (3, "é" * 200_000), (4, "same"), (5, "same")])
    assert digest(frame(spark, [])).collect() == []


def test_the_seed_alone_decides_the_order(spark):
    df = frame(spark, [(i, "text " * (i % 40)) for i in range(1500)])
    places = lambda d, **more: {(r.id, r.shard, r.slot) for r in shuffle_into_shards(d, f"{shared_dir(spark)}/s", shards=3, bucket_bytes=20_000, **more).selectExpr("record.doc_id as id", "shard", "slot").collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = places(df)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert places(df.repartition(11)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert places(df, seed=18) != one


def test_repeated_rows_spread_over_buckets(spark):
    df = frame(spark, [(7, "x" * 1000)] * 2000 + [(i, "y" * 1000) for i in range(1000)])
    got = shuffle_into_shards(df, f"{shared_dir(spark)}/s", shards=2, bucket_bytes=100_000)
    assert got.count() == 3000
    # the other rows stand among the repeated ones all over the shard
    hot = got.where("record.doc_id = 7").select("shard").first().shard
    slots = sorted(r.slot for r in got.where(f"shard = {hot} and record.doc_id <> 7").collect())
    assert slots[0] < 200 and slots[-1] > 2200


def test_the_largest_draw_wins(spark):
    """Shards against hashes by the xxhash library: each hash is the seed of the next column's."""

    def draw(shard, key, seed=17):
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))
        h = h if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        return (h + 2**63) % 2**64 - 2**63

    keys = [None, 0, -5, 2**62, *range(100, 160)]
    got = {r.doc_id: (r.shard, r.grown_shard) for r in digest(frame(spark, [(k, "t") for k in keys]), shards=7).collect()}
    assert got == {k: tuple(max(range(n), key=lambda s: (draw(s, k), s)) for n in (7, 8)) for k in keys}
