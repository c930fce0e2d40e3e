"""The chunk table on disk and its mutations: upsert, delete, rename, garbage, memoised embedding, snapshots."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvid import model
from corvid.functions import text as t
from corvid.operators import order
from corvid.operators.ledger import Ledger, Transaction, once


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Of rows with one key the last; whole rows are compared, not sorted."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), by).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in others])


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_objects(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    return chunks.join(gone, "object_uri", "left_anti")


def replace_objects(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """An object's new chunks take the place of all its old ones."""
    return delete_objects(chunks, new.select("object_uri").distinct()).unionByName(new)


def rename(chunks: DataFrame, moves: DataFrame) -> DataFrame:
    """Chunks of moved objects (old_uri, new_uri) under new ids; contents and vectors stay."""
    moved = chunks.join(moves.withColumnRenamed("old_uri", "object_uri"), "object_uri", "left")
    uri = F.coalesce("new_uri", "object_uri")
    renewed = F.when(F.col("new_uri").isNotNull(), t.chunk_id(F.col("connector_uri"), uri, F.col("chunk_kind"), F.col("locator"))).otherwise(F.col("chunk_id"))
    return moved.select(*[renewed.alias(c) if c == "chunk_id" else uri.alias(c) if c == "object_uri" else F.col(c) for c in chunks.columns])


def orphans(chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """Chunks whose object is gone; folder summaries have no object of their own."""
    return chunks.where("chunk_kind <> 'directory_summary'").join(objects.select("object_uri"), "object_uri", "left_anti")


def search_status(error: Column, chunks: Column, partial: Column) -> Column:
    return F.when(error, "failed").when(F.coalesce(chunks, F.lit(0)) == 0, "not_indexed").when(partial, "partial").otherwise("indexed")


def dispatched(changes: DataFrame) -> DataFrame:
    """changes (path, change, okind, indexable) with `action`: what becomes of each changed object in the index."""
    pipeline = F.col("indexable") & t.producer_of(F.col("okind")).isNotNull()
    action = F.when(F.col("change") == "deleted", "delete").when(F.col("change") == "renamed", "rename").when(F.col("change").isin("unchanged", "touched"), "keep")
    return changes.withColumn("action", action.when(pipeline, "pipeline").otherwise("metadata"))


def fresh_artifacts(objects: DataFrame, artifacts: DataFrame) -> DataFrame:
    """objects (object_uri, currency) with `reuse`: whether an artifact was made from the same source by the same converter."""
    known = artifacts.select("object_uri", F.col("currency").alias("_made_from"))
    return objects.join(known, "object_uri", "left").withColumn("reuse", F.col("_made_from").eqNullSafe(F.col("currency")) & F.col("currency").isNotNull()).drop("_made_from")


def cache_stats(cache: DataFrame) -> DataFrame:
    """(entries, dims, bytes) of an embedding cache."""
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.max(F.size("dense_vec")), F.lit(0)).alias("dims"), F.coalesce(F.sum(F.size("dense_vec").cast("long") * 4), F.lit(0)).alias("bytes"))


def indexed_objects(chunks: DataFrame) -> DataFrame:
    """The distinct objects that have chunks."""
    return chunks.select("connector_uri", "object_uri").distinct()


def evicted(artifacts: DataFrame, budget: int) -> DataFrame:
    """Least recently used artifacts that must go for the rest to fit. Sizes are summed by time first, so the running sum
    is over distinct times; artifacts of one time go in order of their uri."""
    total = artifacts.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total"))
    by_time = artifacts.groupBy("last_accessed").agg(F.sum("size_bytes").alias("at_once"))
    earlier = order.sums_before(by_time, ["last_accessed"], "at_once", "before").select("last_accessed", "before")
    within = F.coalesce(F.sum("size_bytes").over(Window.partitionBy("last_accessed").orderBy("object_uri").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = artifacts.join(earlier, "last_accessed").withColumn("freed", F.col("before") + within)
    return placed.join(F.broadcast(total)).where(F.col("total") - F.col("freed") > budget).select(*artifacts.columns)  # one row


# memoised embedding


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """Feature hashing: each token adds to one dimension, at unit length. An offline stand-in for a model."""
    cells = F.transform(t.tokens(text), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dims)).cast("int"))

    def counted(lists: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        counts = np.bincount(row * dims + lists.flatten().to_numpy(zero_copy_only=False), minlength=len(lists) * dims).reshape(-1, dims).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        values = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * dims, pa.int32()), pa.array(values.ravel()))

    return F.arrow_udf(counted, "array<float>")(cells)


def embedding_key(content: Column, provider: str = "hash", name: str = "crc32-64") -> Column:
    """What a text's vector is remembered by."""
    return t.cache_key(content, "embedding", provider, name)


def embed(chunks: DataFrame, cache: DataFrame, embedder: Callable[[Column], Column] = hash_embedding, provider: str = "hash", name: str = "crc32-64") -> tuple[DataFrame, DataFrame]:
    """(chunks with dense_vec, the cache with what was missing): each distinct missing text is embedded once."""
    keyed = chunks.withColumn("cache_key", embedding_key(F.col("content"), provider, name))
    missing = keyed.select("cache_key", "content").dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")
    filled = cache.unionByName(missing.select("cache_key", embedder(F.col("content")).alias("dense_vec")))
    return keyed.join(filled, "cache_key").drop("cache_key"), filled


# snapshots

#: Folders up to which a bucket's new rows are laid beside the others.
MOST_FOLDERS = 8


class Snapshots:
    """A table kept in buckets of its key; its state names the folders that hold each bucket.

    A change rewrites the buckets that it touches and leaves the others where they are, so a small batch costs its share of the
    table; rows of new keys are laid beside what a bucket has. What is being read is never overwritten, and of two writers of one
    version the second raises. A table is committed on its own, or with others of its ledger in one transaction (tx). Within a
    folder of a bucket rows are sorted by key.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "object_uri", buckets: int = 64, ledger: Ledger | None = None, name: str = "rows"):
        self.spark, self.schema, self.key, self.buckets, self.name = spark, schema, key, buckets, name
        self.ledger = ledger or Ledger(spark, root)
        self.root = f"{self.ledger.root}/{name}"

    def version(self) -> int:
        return self.ledger.version()

    def folders(self, tx: Transaction | None = None) -> dict[int, list[str]]:
        """The folders of each bucket that has rows."""
        state = tx.state if tx is not None else self.ledger.state()
        return {int(k): [f] if isinstance(f, str) else f for k, f in state.get(self.name, {}).get("folders", {}).items()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _at(self, folders: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.root}/{f}/bucket={k}" for k, own in sorted(folders.items()) for f in own]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, tx: Transaction | None = None) -> DataFrame:
        return self._at(self.folders(tx))

    def _touched(self, keys: DataFrame) -> set[int]:
        return {r[0] for r in keys.select(self.bucket()).distinct().collect()}  # at most `buckets` numbers

    def near(self, keys: DataFrame, tx: Transaction | None = None) -> DataFrame:
        """The buckets that hold keys: all of their rows, and others."""
        touched = self._touched(keys)
        return self._at({k: f for k, f in self.folders(tx).items() if k in touched})

    def of(self, keys: list[str], tx: Transaction | None = None) -> DataFrame:
        """The rows of a few keys: only their buckets are read, and in these only the row groups that may hold them."""
        if not keys:
            return self.spark.createDataFrame([], self.schema)
        return self.near(self.spark.createDataFrame([(k,) for k in keys], f"{self.key} string"), tx).where(F.col(self.key).isin(keys))

    def _write(self, df: DataFrame, tx: Transaction) -> dict[int, list[str]]:
        """Writes rows into a folder of their own; where each bucket's are."""
        folder = tx.folder()
        placed = df.select(*self.schema.names, self.bucket().alias("bucket"))
        placed.sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return {int(n[7:]): [folder] for n in self.ledger.names(f"{self.name}/{folder}") if n.startswith("bucket=")}

    def _stage(self, df: DataFrame | None, kept: dict[int, list[str]], tx: Transaction, new: DataFrame | None = None) -> DataFrame | None:
        """df's rows, and new ones (as written), beside the buckets that are kept."""
        held = kept | (self._write(df, tx) if df is not None else {})
        added = self._write(new, tx) if new is not None else {}
        both = {k: [*held.get(k, []), *added.get(k, [])] for k in held.keys() | added.keys()}
        tx.state[self.name] = {"folders": {str(k): f for k, f in sorted(both.items())}}
        return self._at(added) if new is not None else None

    def commit(self, df: DataFrame, tx: Transaction | None = None) -> int | None:
        """The whole table anew."""
        return once(self.ledger, tx, lambda own: self._stage(df, {}, own))

    def merge(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], tx: Transaction | None = None) -> int | None:
        """Rewrites the buckets of keys by change, which gets and returns their rows."""
        touched = self._touched(keys)
        if not touched:
            return None if tx is not None else self.version()

        def apply(own: Transaction) -> None:
            folders = self.folders(own)
            self._stage(change(self._at({k: f for k, f in folders.items() if k in touched})), {k: f for k, f in folders.items() if k not in touched}, own)

        return once(self.ledger, tx, apply)

    def replace(self, gone: DataFrame | None, new: DataFrame, tx: Transaction) -> DataFrame:
        """Rows of keys gone (marked as to be broadcast where they are few) go, new ones come; returns the new ones as they are
        stored. Only buckets that hold gone keys are rewritten, and those that have become many folders."""
        folders = self.folders(tx)
        rewritten = {k for k, own in folders.items() if len(own) >= MOST_FOLDERS} | (self._touched(gone) if gone is not None and folders else set())
        old = {k: own for k, own in folders.items() if k in rewritten}
        left = self._at(old) if gone is None else self._at(old).join(gone, self.key, "left_anti")
        return self._stage(left if old else None, {k: own for k, own in folders.items() if k not in rewritten}, tx, new)

    def vacuum(self) -> None:
        self.ledger.vacuum()
