"""Helpers that the operators share: the shared folder, written tables, bounded samples and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.session import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; a cluster that names none is an error."""
    return f"{shared_folder(spark)}/corvid/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table written to path and read again: its lineage ends there, and a lost executor costs nothing."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def hashed_share(key, rows: int, bound: int):
    """A filter that keeps about bound of rows rows, chosen by a hash of key: the same ones in every run."""
    share = min(1.0, bound / max(rows, 1))
    return F.pmod(F.xxhash64(F.lit(7), key), F.lit(1_000_003)) < int(share * 1_000_003) + 1


def sample_of(rows: DataFrame, mark: str, bound: int) -> DataFrame:
    """About bound rows of distinct marks (a column of hashes of what tells rows apart), chosen by their marks: the same ones in
    every run, 2 * bound at most, and never none where there is a row. Copies of a row fold into one before they move."""
    facts = rows.agg(F.count("*").alias("n"), F.min(mark).alias("least")).first()
    chosen = rows.where(hashed_share(F.col(mark), facts["n"], bound) | (F.col(mark) == facts["least"]) if facts["n"] else F.lit(False))
    return chosen.dropDuplicates([mark]).orderBy(mark).limit(2 * bound)


#: Words of 64 bits in the filter that spares rows a shuffle: at most so many rows of two longs are broadcast, whatever the input.
FILTER_WORDS = 1 << 20


def sifted(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """(record, maybe): maybe is false where the row's key is surely none of ids (a written table with a column key).

    The ids' hashes set bits of a bitmap of fixed size, which is broadcast. Where ids are so many that it fills up, fewer
    rows are told apart, so callers join what is left on the ids themselves.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_WORDS * 64))
    word, bit = F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")
    words = ids.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    placed = rows.select(F.struct(*rows.columns).alias("record"), word, bit)
    return placed.join(F.broadcast(words), "word", "left").select("record", F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False)).alias("maybe"))


#: Keys that are joined by broadcast are at least one of so many rows each, and occur so often: there are HOT_SHARE of them at most.
HOT_SHARE, HOT_LEAST = 1000, 1000


def matched(rows: DataFrame, keys: list[str], counted: DataFrame, total: int) -> DataFrame:
    """rows (total of them) joined with counted, a written table of those keys that interest and of the n rows that each has.

    Rows that have none of these keys are hardly shuffled, and the few keys that very many rows share are joined by broadcast,
    so that no task gets them all.
    """
    often = max(HOT_LEAST, total // HOT_SHARE)
    likely = sifted(rows, keys[0], counted).where("maybe").select("record.*")
    hot = F.broadcast(counted.where(F.col("n") >= often))
    others = likely.join(hot.select(*keys), keys, "left_anti").join(counted.where(F.col("n") < often), keys)
    return likely.join(hot, keys).unionByName(others)


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is one of ids; of the others hardly any is shuffled."""
    return sifted(rows, key, ids).where("maybe").select("record.*").join(ids, key, "left_semi")


def not_among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is none of ids (or null); hardly any of them is shuffled."""
    told = sifted(rows, key, ids)
    return told.where("not maybe").select("record.*").union(told.where("maybe").select("record.*").join(ids, key, "left_anti").select(*rows.columns))


def components(edges: DataFrame, work: str) -> DataFrame:
    """Connected components of edges (a, b: long) as (node, component), component being the smallest node.

    Rounds of contraction: each node hooks to its smallest neighbour, the resulting trees are flattened by pointer jumping,
    and edges are rewritten between roots until none is left. Minima are combined before the shuffle, and joins are on plain
    equality, so a hub with very many edges is split by adaptive execution. Every table is written below work, and deleted once
    the next one is there; the last one stays.
    """
    spark = edges.sparkSession
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{work}/edges0")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = written(nodes.select("node", F.col("node").alias("component")), f"{work}/labels0")
    step = 0
    while edges.limit(1).count():
        step += 1
        # b > a: each b hooks to its smallest neighbour below it; what has none below stays a root
        hooks = written(edges.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("up")), f"{work}/hooks{step}_0")
        jump = 0
        while True:
            jump += 1
            above = hooks.select(F.col("x").alias("up"), F.col("up").alias("top"))
            hooks = written(hooks.join(above, "up", "left").select("x", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), f"{work}/hooks{step}_{jump}")
            remove(spark, f"{work}/hooks{step}_{jump - 1}")
            if not hooks.where("moved").limit(1).count():
                break
            hooks = hooks.select("x", "up")
        hooks = hooks.select("x", "up")
        labels = written(labels.join(hooks, F.col("component") == F.col("x"), "left").select("node", F.coalesce("up", "component").alias("component")), f"{work}/labels{step}")
        left = edges.join(hooks, F.col("a") == F.col("x"), "left").select(F.coalesce("up", "a").alias("a"), "b")
        both = left.join(hooks, F.col("b") == F.col("x"), "left").select("a", F.coalesce("up", "b").alias("b"))
        edges = written(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{work}/edges{step}")
        remove(spark, f"{work}/labels{step - 1}", f"{work}/edges{step - 1}", f"{work}/hooks{step}_{jump}")
    return labels
