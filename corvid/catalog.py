"""Sources taken in as one call: list, compare, chunk, embed what is new, write, set the status; and the engine over the result."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid import model
from corvid.engine import Engine, Records
from corvid.functions import guards
from corvid.functions import text as t
from corvid.operators import browse, chunk, index, sync
from corvid.operators.keys import primary_key
from corvid.operators.ledger import STALE, Ledger, Transaction
from corvid.operators.postings import Postings
from corvid.operators.vectors import VectorIndex
from corvid.session import shared_folder
from corvid.sources import registry
from corvid.sources.registry import Source


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_VECTOR = T.StructField("dense_vec", T.ArrayType(T.FloatType()))
OBJECTS = T.StructType([*_strings("connector_uri", "object_uri", "okind", "content", "fingerprint", "search_status"), T.StructField("chunk_count", T.LongType())])
CHUNKS = T.StructType([*_strings("chunk_id", "connector_uri", "object_uri", "locator", "content", "chunk_kind", "metadata"), T.StructField("chunk_index", T.IntegerType()), T.StructField("partial", T.BooleanType()), _VECTOR])
CACHE = T.StructType([*_strings("cache_key"), _VECTOR])

#: Where a transaction keeps rows that it needs more than once.
WORK = "work"
#: Bytes of keys, with what goes with them, up to which they are broadcast to the texts that they select; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Objects for each bucket of a table from which on all buckets count as touched, without a look.
DENSE = 16

#: Makes chunks (in CHUNKS' columns but for the vector) of the objects that are routed to it.
Producer = Callable[[DataFrame], DataFrame]


def text_producer(objects: DataFrame) -> DataFrame:
    """Documents and text blobs are cut as text, code at its definitions."""
    is_code = F.col("okind") == "code"
    return chunk.located_chunks(objects.where(~is_code)).unionByName(chunk.located_chunks(objects.where(is_code), code_objects=True))


def schema_producer(objects: DataFrame) -> DataFrame:
    """A table's columns as one chunk."""
    text, kind = F.concat(F.lit("columns: "), "content"), F.lit("schema_summary")
    none = F.lit(None).cast("string")
    return objects.select(t.chunk_id(F.col("connector_uri"), F.col("object_uri"), kind, none).alias("chunk_id"), "connector_uri", "object_uri", none.alias("locator"), text.alias("content"), kind.alias("chunk_kind"), F.lit("{}").alias("metadata"), F.lit(0).alias("chunk_index"), F.lit(False).alias("partial"))


class SourceRecords(Mapping):
    """Records of structured objects by uri, read from the sources of their connectors when they are asked for."""

    def __init__(self, spark: SparkSession, sources: dict[str, Source], objects: index.Snapshots):
        self.spark, self.sources, self.objects = spark, sources, objects

    def _source(self, uri: str) -> Source | None:
        root = max((c for c in self.sources if uri.startswith(c + "/")), key=len, default=None)
        known = root is not None and self.objects.of([uri]).where(F.col("okind").isin(*STRUCTURED)).limit(1).count()
        return self.sources[root] if known else None

    def __contains__(self, uri: object) -> bool:
        return isinstance(uri, str) and self._source(uri) is not None

    def __getitem__(self, uri: str) -> Records:
        source = self._source(uri)
        if source is None:
            raise KeyError(uri)
        rows, _ = source.records(self.spark, uri)
        keys = ["_row"] if "_row" in rows.columns else primary_key(rows) or rows.columns
        return rows, [c for c in rows.columns if c != "_row"], keys

    def page(self, uri: str, begin: int, end: int) -> DataFrame:
        """The records [begin, end) of an object; a source that knows its ranges reads these only."""
        source = self._source(uri)
        if source is not None and hasattr(source, "page"):
            return source.page(self.spark, uri, begin, end)
        rows, _, by = self[uri]
        return browse.page(rows, by, begin, end)

    def __iter__(self) -> Iterator[str]:
        return iter(())  # sources have too many to list

    def __len__(self) -> int:
        return 0

    def __bool__(self) -> bool:
        return bool(self.sources)


STRUCTURED = ("table_rows", "record_collection", "message_stream")


class Catalog:
    """Objects, chunks, the embedding cache and the inverted index of all connectors, as versioned tables below root.

    All four are committed together by one manifest: a writer that dies at any point leaves the state before it, and the next sync
    finds the same changes again. What it had written is deleted when a catalog is opened `stale` seconds later.
    buckets: how finely the tables are cut; a change rewrites the buckets that it falls into. presets: configurations by pattern of
    an object's uri (as of file names), which go before those of well-known sources. vectors: whether to keep a vector index too
    (semantic search is then nearly exact and reads few lists, where without one it scans all vectors).
    """

    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[Column], Column] = index.hash_embedding, presets: dict[str, model.ObjectConfig] | None = None, buckets: int = 64, stale: float = STALE, vectors: bool = False):
        self.spark, self.embedder, self.presets = spark, embedder, presets or {}
        self.ledger = Ledger(spark, root)
        self.recovered = self.ledger.recover(stale)
        table = lambda name, schema, key: index.Snapshots(spark, root, schema, key, buckets, self.ledger, name)
        self.objects, self.chunks, self.cache = table("objects", OBJECTS, "object_uri"), table("chunks", CHUNKS, "object_uri"), table("cache", CACHE, "cache_key")
        self.postings = Postings(spark, root, self.ledger)
        self.vectors = VectorIndex(spark, root, self.ledger) if vectors else None

    def add(self, connector: str, listing: DataFrame, producers: dict[str, Producer] | None = None, detection: str = "full_scan", incremental: bool = False, on_success: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Takes in a connector's listing (object_uri, content, and where there is one okind); returns (change, action, n).

        What is unchanged is left alone. A file that went while another of the same content came is renamed: its chunks keep
        their vectors. Gone objects go only where the listing is known to be whole (detection and incremental). The buckets
        that changes fall into are rewritten, the others stay. on_success is called once all is committed.
        """
        shared_folder(self.spark)  # for checkpoints
        tx = self.ledger.begin()
        try:
            done = self._add(connector, listing, producers, detection, incremental, tx)
        except Exception:
            tx.abort()
            raise
        if done.where("action <> 'keep'").limit(1).count():
            tx.commit()
        else:
            tx.abort()
        if on_success:
            on_success(done)
        return done

    def _add(self, connector: str, listing: DataFrame, producers: dict[str, Producer] | None, detection: str, incremental: bool, tx: Transaction) -> DataFrame:
        uri = F.col("object_uri")
        seen = listing.select(F.lit(connector).alias("connector_uri"), "object_uri", (F.col("okind") if "okind" in listing.columns else t.object_kind(uri)).alias("okind"), "content", F.sha1("content").alias("fingerprint"))
        known = self.objects.read(tx).where(F.col("connector_uri") == connector)
        changes = sync.gated(sync.diff(known, seen, "object_uri"), detection, incremental)
        both = changes.join(known.select("object_uri", F.col("fingerprint").alias("_old")), "object_uri", "left").join(seen.select("object_uri", F.col("fingerprint").alias("_new"), "okind"), "object_uri", "left")
        files = both.select(uri.alias("path"), "change", F.lit(None).cast("long").alias("inode"), F.lit(0).alias("size"), F.when(F.col("change") == "added", F.col("_new")).otherwise(F.col("_old")).alias("sha1"))
        moves = sync.renames(files).select(F.col("path").alias("object_uri"), F.col("old_path").alias("old_uri"))
        told = both.join(moves, "object_uri", "left").join(moves.select(F.col("old_uri").alias("object_uri"), F.lit(True).alias("_moved")), "object_uri", "left")
        told = told.where("_moved is null").withColumn("change", F.when(F.col("old_uri").isNotNull(), "renamed").otherwise(F.col("change"))).withColumn("indexable", F.lit(True))
        told = index.dispatched(told).select("object_uri", "old_uri", "change", "action").checkpoint()
        done = told.groupBy("change", "action").agg(F.count("*").alias("n")).checkpoint()
        if not done.where("action <> 'keep'").limit(1).count():
            return done

        # texts move where they must: keys go to them if they are few, and what is needed again is kept compressed until the end
        size = told.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("object_uri") + F.coalesce(F.octet_length("old_uri"), F.lit(0))), F.lit(0)).alias("bytes")).first()
        beside = F.broadcast if size["bytes"] + 64 * size["n"] <= BROADCAST_BYTES else (lambda keys: keys)
        whole = {r["action"] for r in done.select("action").distinct().collect()} <= {"pipeline", "delete"}  # then all that is seen is new
        routed = told.where("action = 'pipeline'").select("object_uri")
        fresh = seen.where(uri.isNotNull()) if whole else seen.join(beside(routed), "object_uri", "left_semi")
        made = self._kept(chunk.produced(fresh, producers or {"text": text_producer}).withColumn("cache_key", index.embedding_key(F.col("content"))), tx)
        # of the cache only the buckets of the texts at hand are read
        held = self.cache.read(tx) if size["n"] >= DENSE * self.cache.buckets else self.cache.near(made.select("cache_key"), tx)
        missing = made.select("cache_key", "content").dropDuplicates(["cache_key"]).join(held.select("cache_key"), "cache_key", "left_anti").select("cache_key", self.embedder(F.col("content")).alias("dense_vec"))
        vectors = held.unionByName(self.cache.replace(None, missing, tx))
        moved = told.where("action = 'rename'").select("old_uri", F.col("object_uri").alias("new_uri"))
        gone = told.where("change in ('modified', 'deleted')").select("object_uri").unionByName(told.where("old_uri is not null").select(F.col("old_uri").alias("object_uri"))).distinct()
        left = self._kept(self.chunks.near(gone, tx).join(beside(gone), "object_uri", "left_semi"), tx)
        renamed = index.rename(left.join(beside(moved.select(F.col("old_uri").alias("object_uri"))), "object_uri", "left_semi"), beside(moved))
        # a key has one vector, so these are hashed, and texts aren't sorted
        new = made.join(vectors.hint("shuffle_hash"), "cache_key").select(*CHUNKS.names).unionByName(renamed.select(*CHUNKS.names))
        new = self.chunks.replace(beside(gone), new, tx)

        counts = new.groupBy("object_uri").agg(F.count("*").alias("chunk_count"), F.max("partial").alias("partial"))
        status = index.search_status(F.lit(False), F.col("chunk_count"), F.coalesce("partial", F.lit(False)))
        touched = told.where("action <> 'keep' and action <> 'delete'").select("object_uri").distinct()
        facts = touched.join(counts, "object_uri", "left").select("object_uri", status.alias("search_status"), F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))
        rows = seen.join(beside(facts), "object_uri").select(*OBJECTS.names)
        self.objects.replace(beside(gone.unionByName(touched).distinct()), rows, tx)
        self.postings.add(new, left, tx)
        if self.vectors is not None:
            self.vectors.add(new, left, tx)
        self._let_go(tx)
        return done

    def _kept(self, rows: DataFrame, tx: Transaction) -> DataFrame:
        """Rows that are needed more than once, written until the transaction's end."""
        at = f"{self.ledger.root}/{WORK}/{tx.folder()}"
        rows.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _let_go(self, tx: Transaction) -> None:
        for name in self.ledger.names(WORK):
            if name.startswith(tx.token):
                self.ledger.delete(f"{WORK}/{name}")

    def sync(self, connector: str, source: Source, incremental: bool = False) -> DataFrame:
        """Takes in a source; what it has as records becomes chunks by its presets or its text columns, message streams by thread."""
        listing = source.listing(self.spark)
        structured = F.col("okind").isin(*STRUCTURED)
        # records have no content of their own in the listing: how many there are and their hash tell whether they changed
        uris = None if hasattr(source, "facts") else [r.object_uri for r in listing.where(structured).select("object_uri").collect()]  # few
        told = listing.join(registry.facts_of(source, self.spark, uris), "object_uri", "left")
        whole = told.select("object_uri", "okind", F.coalesce("content", F.when(structured, F.col("facts"))).alias("content"))
        makers = {"text": text_producer, "records": lambda o: self._of_records(connector, source, o, False), "threads": lambda o: self._of_records(connector, source, o, True), "schema": schema_producer}
        return self.add(connector, whole, makers, registry.detection_of(source.scheme), incremental)

    def _of_records(self, connector: str, source: Source, objects: DataFrame, streams: bool) -> DataFrame:
        """Chunks of the records of objects: each object by the first of the presets that matches it, else by what is known of its
        kind, else by its text columns."""
        columns = [f for f in CHUNKS if f.name != "dense_vec"]
        out = self.spark.createDataFrame([], T.StructType(columns))
        if not objects.limit(1).count():
            return out
        for group in registry.groups_of(source, self.spark, objects.select("object_uri")):
            known = model.PRESETS.get(group.preset) if group.preset else None
            rest = group.rows
            for pattern, config in [*self.presets.items(), (None, known or model.ObjectConfig(guards.text_columns(group.rows.drop("_object_uri").schema), [], list(group.keys)))]:
                matches = F.col("_object_uri").rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")) if pattern else F.lit(True)
                own, rest = rest.where(matches), rest.where(~matches) if pattern else rest
                if not config.indexable or not config.text_fields:
                    continue
                made = chunk.thread_chunks(own, config) if streams else chunk.record_chunks(own, None, config)
                kind = F.lit("thread_aggregate" if streams else "row_text")
                made = made.withColumns({"connector_uri": F.lit(connector), "chunk_kind": kind, "partial": F.col("partial") | F.col("cut") | F.lit(group.cut)})
                made = made.withColumn("chunk_id", t.chunk_id(F.col("connector_uri"), F.col("object_uri"), F.col("chunk_kind"), F.col("locator")))
                out = out.unionByName(made.select(*[f.name for f in columns]))
        return out

    def remove(self, connector: str) -> None:
        """Drops a connector's objects, chunks and postings."""
        tx = self.ledger.begin()
        own = self.objects.read(tx).where(F.col("connector_uri") == connector).select("object_uri").checkpoint()
        left = self.chunks.near(own, tx).join(own, "object_uri", "left_semi").checkpoint()
        self.chunks.merge(own, lambda current: index.delete_objects(current, own), tx)
        self.objects.merge(own, lambda current: index.delete_objects(current, own), tx)
        none = self.spark.createDataFrame([], CHUNKS)
        self.postings.add(none, left, tx)
        if self.vectors is not None and self.vectors.state(tx)["model"] is not None:
            self.vectors.add(none, left, tx)
        tx.commit()

    def engine(self, connectors: list[str], sources: dict[str, Source] | None = None) -> Engine:
        """The engine over the last version. sources: by connector, for reading the records of structured objects."""
        records = SourceRecords(self.spark, sources, self.objects) if sources else None
        return Engine(connectors, self.objects.read(), self.chunks.read(), self.embedder, records, self.postings, self.chunks, self.vectors)


class Control:
    """Jobs (id, status, queued_at, started_at) and tasks (id, job_id, status, attempts) of the control plane."""

    def __init__(self, jobs: DataFrame, tasks: DataFrame):
        self.jobs, self.tasks = jobs, tasks

    def show(self, job: int) -> DataFrame:
        """A job with its tasks counted by status."""
        own = self.jobs.where(F.col("id") == job)
        if not own.limit(1).count():
            raise model.EngineError("not_found", f"job {job}")
        counts = self.tasks.where(F.col("job_id") == job).groupBy(F.col("job_id").alias("id")).pivot("status", sorted({s for m in model.TASK_MOVES for s in m})).count()
        return own.join(counts, "id", "left")

    def cancel(self, job: int) -> Control:
        """The state in which a job and all its tasks that haven't ended are cancelled."""
        active = F.col("status").isin("preparing", "queued", "running")
        if not self.jobs.where((F.col("id") == job) & active).limit(1).count():
            raise model.EngineError("not_found", f"no active job {job}")
        jobs = self.jobs.withColumn("status", F.when((F.col("id") == job) & active, "cancelled").otherwise(F.col("status")))
        return Control(jobs, self.tasks.withColumn("status", F.when((F.col("job_id") == job) & F.col("status").isin("pending", "running"), "cancelled").otherwise(F.col("status"))))
