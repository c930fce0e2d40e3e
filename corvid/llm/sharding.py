"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters records uniformly: a seeded hash of the id picks the shard (the largest of one hash per shard wins, so a
further shard takes rows only into itself), a second seeded hash picks one of the shard's buckets, whose number follows from
the shard's size so that a bucket fits in memory. Pass two orders each bucket by id and content and shuffles it with a seeded
Fisher-Yates shuffle (Spark's shuffle function), numbers its rows after those of the shard's earlier buckets, and writes the
shard.

Which shard a record is in depends on its id and the number of shards alone (the law `key`). The order within a shard depends
on the records and the seed alone: the second pass has a number of partitions that follows from the sizes, and takes each
partition's buckets in order, so neither the session's settings nor the order of arrival play a part, and a retried task makes
the same rows again. Only rows that repeat one id and size so often that they would overfill a bucket are spread over their
shard's buckets by their place in the input.

Edge cases: a null text has size 16 and the CRC-32 of no bytes. Records with a null id are all in one shard. Repeated rows each
get a slot. A very long text is one record of one bucket, which is then as large as the text; a bucket is held whole in memory. An empty table gives no shard. Columns of the input named like one
that is added (shard, slot, size) are carried under their own name in a nested column, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm.common import shared_dir, written

#: Bytes that each record counts besides its text.
OVERHEAD = 16
#: Buckets that a task of the second pass holds, about (256 MB), and tasks that there are even for less; ids and sizes that are
#: known to overfill a bucket are at most so many.
BUCKETS_PER_TASK, LEAST_TASKS, MOST_HOT = 64, 64, 400_000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is largest."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("draw"), s.alias("shard")))
    return F.array_max(draws)["shard"].cast("int")


def shuffle_into_shards(records: DataFrame, path: str, shards: int = 40, seed: int = 17, bucket_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all records, shuffled, below path, one folder for each shard; returns them as (shard, slot, size, record)."""
    spark = records.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD
    key = F.col(id_col)
    dealt = records.select(F.struct(*records.columns).alias("record"), key.alias("its_id"), size.alias("size"), shard_of(key, shards, seed).alias("shard"))
    # the second hash also takes the text's size, so that records which repeat one id spread
    dealt = dealt.withColumn("mark", F.xxhash64(F.lit(seed + 1), "its_id", "size"))
    cells = written(dealt.groupBy("shard", "mark").agg(F.sum("size").alias("held")), f"{path}-cells")
    per_shard = cells.groupBy("shard").agg(F.ceil(F.sum("held") / bucket_bytes).cast("long").alias("buckets"))  # a row for each shard
    whole = per_shard.agg(F.coalesce(F.sum("buckets"), F.lit(0)).alias("n")).first()["n"]
    overfull = max(bucket_bytes, whole * bucket_bytes // MOST_HOT)
    hot = cells.where(F.col("held") > overfull).select("shard", "mark", F.lit(True).alias("hot"))  # at most MOST_HOT rows
    salt = F.when(F.col("hot"), F.monotonically_increasing_id()).otherwise(0)
    bucket = F.pmod(F.xxhash64(F.lit(seed + 2), "mark", salt), F.col("buckets")).alias("bucket")
    scattered = dealt.join(F.broadcast(hot), ["shard", "mark"], "left").join(F.broadcast(per_shard), "shard").select("shard", bucket, "its_id", "size", "record")
    tasks = max(1, min(whole, LEAST_TASKS), -(-whole // BUCKETS_PER_TASK))
    full = scattered.repartition(tasks, "shard", "bucket").groupBy("shard", "bucket").agg(F.array_sort(F.collect_list(F.struct("its_id", "size", "record"))).alias("rows"))
    mixed = full.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = full.select("shard", "bucket", F.coalesce(F.sum(F.size("rows").cast("long")).over(earlier), F.lit(0)).alias("offset"))
    spread = mixed.join(offsets, ["shard", "bucket"]).select("shard", "offset", F.posexplode("rows").alias("at", "row"))
    placed = spread.select("shard", (F.col("offset") + F.col("at")).alias("slot"), F.col("row.size").alias("size"), F.col("row.record").alias("record"))
    placed.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def digest(documents: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """What the shard files hold, read back: one row for each document."""
    path = f"{shared_dir(documents.sparkSession)}/shards"
    read = shuffle_into_shards(documents.select("doc_id", "text"), path, shards, seed)
    text = F.encode(F.coalesce(F.col("record.text"), F.lit("")), "UTF-8")
    return read.select(F.col("record.doc_id").alias("doc_id"), "size", F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", shard_of(F.col("record.doc_id"), shards + 1, seed).alias("grown_shard"))
