"""Change detection and mutation queries with their DuckDB counterparts.

The old state of a source is made from the same rows: labelled documents are known, toxic ones under an outdated
fingerprint, and known paths of Spanish documents have since gone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.functions import text as t
from corvid.catalog import Catalog
from corvid.model import EngineError, ObjectConfig
from corvid.operators import crawl, index, keys, sync
from corvid.plans import chunking
from corvid.plans.common import CHUNKS, CUT, DOC_URI, bm25_sql
from corvid.plans.stored import stored
from corvid.session import shared_folder
from corvid.sources.registry import RecordFolder
from corvid.sources.tables import document_uri, page_objects, table
from corvid.streaming import feed, threads


def old_listing(spark, d):
    docs, labels = document_uri(table(spark, d, "documents")), table(spark, d, "labels")
    fresh = F.when(F.col("toxic") == 1, F.lit("outdated")).otherwise(F.sha1("text"))
    return docs.join(labels, "doc_id").select(F.col("object_uri").alias("path"), fresh.alias("fingerprint"))


def new_listing(spark, d):
    docs = document_uri(table(spark, d, "documents")).where("lang <> 'es'")
    return docs.select(F.col("object_uri").alias("path"), F.sha1("text").alias("fingerprint"))


def file_states(spark, d):
    """(old, new) file states: German documents moved to another folder, French ones were rewritten in place, English ones only touched."""
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    old = docs.select(path.alias("path"), F.length("text").cast("long").alias("size"), F.lit(1).alias("mtime"), F.col("doc_id").alias("inode"), F.sha1("text").alias("sha1"), F.lit("indexed").alias("status"))
    moved = F.when(F.col("lang") == "de", F.concat(F.lit("moved/"), F.col("doc_id").cast("string"))).otherwise(path)
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    inode = F.when(F.col("source") == "src0", -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    new = docs.select(moved.alias("path"), F.length(text).cast("long").alias("size"), F.when(F.col("lang") == "es", 1).otherwise(2).alias("mtime"), inode.alias("inode"), F.sha1(text).alias("sha1"))
    return old, new


def sync_diff(spark, d):
    return sync.diff(old_listing(spark, d), new_listing(spark, d))


def file_diff(spark, d):
    old, new = file_states(spark, d)
    return sync.file_diff(old, new).select("path", "change")


def rename_pairing(spark, d):
    old, new = file_states(spark, d)
    return sync.renames(sync.file_diff(old, new)).groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("old_path").alias("sources"))


def delete_gating(spark, d):
    """What an incremental listing yields of the same difference."""
    changes = sync.gated(sync.diff(old_listing(spark, d), new_listing(spark, d)), "full_scan", incremental=True)
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def since_merge(spark, d):
    return sync.merged(old_listing(spark, d), new_listing(spark, d), "path", since=True)


def manifest_diff(spark, d):
    old, new = file_states(spark, d)
    return sync.manifest_diff(new, old)


def upload_replay(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    status = F.when(F.col("lang") == "es", "deleted").when(F.col("lang") == "en", "indexed").otherwise("staged")
    moved = F.when(F.col("lang") == "de", F.concat(F.lit("old/"), path))
    return sync.replayed(docs.select(path.alias("path"), status.alias("status"), moved.alias("renamed_from")))


def fingerprint_count_max(spark, d):
    return sync.table_fingerprint(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day")


def schema_fingerprint(spark, d):
    return spark.createDataFrame([(sync.schema_fingerprint(table(spark, d, "customer")),)], "fingerprint string")


def upsert_chunks(spark, d):
    """English documents come again with another end."""
    old = stored(spark, d)[0]
    new = old.where(F.col("object_uri").startswith("docs://corpus/en/")).withColumn("content", F.concat("content", F.lit("!")))
    return index.upsert(old, new).select("chunk_id", F.sha1("content").alias("sha1"))


def delete_by_object(spark, d):
    gone = document_uri(table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")).select("object_uri")
    return index.delete_objects(stored(spark, d)[0], gone).select("chunk_id", "object_uri")


def rename_rekey(spark, d):
    """German documents move to another folder: new ids, same contents."""
    chunks = stored(spark, d)[0]
    moves = chunks.where(F.col("object_uri").startswith("docs://corpus/de/")).select(F.col("object_uri").alias("old_uri"), F.replace("object_uri", F.lit("/de/"), F.lit("/deutsch/")).alias("new_uri")).distinct()
    return index.rename(chunks, moves).select("chunk_id", "object_uri")


def orphan_gc(spark, d):
    """Chunks of documents that the new listing lacks."""
    return index.orphans(stored(spark, d)[0], new_listing(spark, d).withColumnRenamed("path", "object_uri")).select("chunk_id", "object_uri")


def last_write_wins(spark, d):
    """Line items repeat their key; of each key the last by all columns stays."""
    items = table(spark, d, "lineitem").withColumn("key", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = items.select("key", order.alias("seq"), "l_shipdate", "l_partkey")
    return index.latest(rows, "key", "seq").select("key", F.col("l_shipdate").cast("date").alias("shipped"), "l_partkey")


def lru_evict(spark, d):
    """Parts as artifacts: what must go for the rest to fit into 20,000."""
    artifacts = table(spark, d, "part").select(F.col("p_name").alias("last_accessed"), F.col("p_partkey").alias("object_uri"), F.col("p_size").cast("long").alias("size_bytes"))
    return index.evicted(artifacts, 20_000).select("object_uri", "size_bytes")


def event_feed_dedupe(spark, d):
    """Each event once, though the feed, a stream of two files, repeats it."""
    work = f"{shared_folder(spark)}/corvid-events/{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(f"{work}/in")
    once = feed.once(feed.bounded(spark, f"{work}/in", events.schema, 10), "event_id", "ts", "10000 days")
    once.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint").option("path", f"{work}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{work}/out").groupBy("event_type").agg(F.count("*").alias("n"))


def stream_regroup(spark, d):
    """Turns that come in the wrong order, in several batches, end as whole threads: keyed state keeps each thread's parts."""
    work = f"{shared_folder(spark)}/corvid-threads/{uuid.uuid4().hex}"
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").cast("long").alias("seq"), "text")
    turns.repartitionByRange(3, F.desc("seq")).write.parquet(f"{work}/in")
    kept = index.Snapshots(spark, f"{work}/threads", T.StructType.fromDDL(threads.part_schema("bigint")), key="thread", buckets=8)
    threads.regroup(feed.bounded(spark, f"{work}/in", turns.schema, 1), kept, f"{work}/checkpoint", F.col("text"))
    # neighbouring parts share messages
    each = kept.read().select("thread", "first", F.posexplode("messages").alias("n", "text")).select("thread", (F.col("first") + F.col("n")).alias("at"), "text").distinct()
    whole = each.groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("m"))
    return whole.select("thread", F.size("m").alias("n"), F.sha1(F.array_join(F.transform("m", lambda x: x["text"]), "|")).alias("sha1"))


def catalog(spark):
    return Catalog(spark, f"{shared_folder(spark)}/corvid-catalog/{uuid.uuid4().hex}", buckets=8)


def engine_add(spark, d):
    """All documents taken in, and a search through the engine's index."""
    own = catalog(spark)
    own.add("docs://corpus", document_uri(table(spark, d, "documents")).select("object_uri", F.col("text").alias("content")))
    return own.objects.read().select("object_uri", "okind", "search_status", "chunk_count")


def _resynced(spark, d):
    own = catalog(spark)
    docs = document_uri(table(spark, d, "documents"))
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit(" outdated"))).otherwise(F.col("text"))
    own.add("docs://corpus", docs.join(table(spark, d, "labels"), "doc_id").select("object_uri", text.alias("content")))
    moved = F.when(F.col("lang") == "de", F.replace("object_uri", F.lit("/de/"), F.lit("/deutsch/"))).otherwise(F.col("object_uri"))
    return own, own.add("docs://corpus", docs.where("lang <> 'es'").select(moved.alias("object_uri"), F.col("text").alias("content")))


def engine_resync(spark, d):
    """Labelled documents are known, toxic ones in an outdated text; then Spanish ones have gone and German ones have moved."""
    return _resynced(spark, d)[0].objects.read().select("object_uri", "search_status", "chunk_count")


def engine_resync_changes(spark, d):
    return _resynced(spark, d)[1]


def engine_resync_search(spark, d):
    """What a search of the resynced catalog finds is what one over fresh chunks would find."""
    own, _ = _resynced(spark, d)
    return own.engine(["docs://corpus"]).search("Tion the rely", mode="keyword").select("source", "score", "locator")


class _Lost(Exception):
    """The writer's machine is gone."""


def engine_recovered(spark, d):
    """A sync whose writer dies when all is written but the manifest; whoever opens the catalog next clears up and syncs again."""
    docs, labels = document_uri(table(spark, d, "documents")), table(spark, d, "labels")
    own = catalog(spark)
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit(" outdated"))).otherwise(F.col("text"))
    own.add("docs://corpus", docs.join(labels, "doc_id").select("object_uri", text.alias("content")))
    now = docs.where("lang <> 'es'").select("object_uri", F.col("text").alias("content"))
    broken = Catalog(spark, own.ledger.root, buckets=8)

    def die(*_):
        raise _Lost

    broken.ledger._rename, broken.ledger._drop, broken.ledger.delete = die, lambda token: None, lambda name: None
    try:
        broken.add("docs://corpus", now)
    except EngineError:
        pass
    again = Catalog(spark, own.ledger.root, buckets=8, stale=0)
    again.add("docs://corpus", now)
    hits = again.postings.bm25("Tion the rely", top_k=25).groupBy("object_uri").agg(F.max("score").alias("best"))
    return again.objects.read().join(hits, "object_uri", "left").select("object_uri", "search_status", "chunk_count", "best")


def engine_sync_threads(spark, d):
    """Conversations as a folder of record files, taken in as message streams: one thread for each conversation."""
    path = f"{shared_folder(spark)}/corvid-chats/{uuid.uuid4().hex}"
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.format_string("room%d", F.col("conv_id") % 4).alias("room"))
    turns.repartition("room").sortWithinPartitions("room", "conv_id", "turn").write.partitionBy("room").json(path)
    file = spark._jvm.org.apache.hadoop.fs.Path
    fs = file(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for room in [f.getPath() for f in fs.listStatus(file(path)) if f.getPath().getName().startswith("room=")]:  # four
        part = next(f.getPath() for f in fs.listStatus(room) if f.getPath().getName().startswith("part-"))
        fs.rename(part, file(f"{path}/{room.getName()[5:]}.jsonl"))
    config = ObjectConfig(["text"], [], [], group_by="conv_id", render_template="{role}: {text}")
    own = Catalog(spark, f"{shared_folder(spark)}/corvid-catalog/{uuid.uuid4().hex}", buckets=8, presets={"*.jsonl": config})
    own.sync("slack://team", RecordFolder("slack://team", path))
    return own.chunks.read().select("chunk_id", "object_uri", "locator", "chunk_kind", F.sha1("content").alias("sha1"))


def index_dispatch(spark, d):
    """What becomes of changed objects of several kinds."""
    exts = F.array(*map(F.lit, [".md", ".py", ".exe", ".png"]))
    changes = F.array(*map(F.lit, ["added", "modified", "deleted", "renamed", "unchanged"]))
    path = F.concat(F.lit("x/"), F.col("p_partkey").cast("string"), F.element_at(exts, (F.col("p_partkey") % 4 + 1).cast("int")))
    rows = table(spark, d, "part").select(path.alias("path"), F.element_at(changes, (F.col("p_partkey") % 5 + 1).cast("int")).alias("change"), t.object_kind(path).alias("okind"), (F.col("p_partkey") % 7 > 0).alias("indexable"))
    return index.dispatched(rows).groupBy("change", "action").agg(F.count("*").alias("n"))


def web_conditional(spark, d):
    """Crawled pages asked for again: some unchanged, some new, some failing, some not visited. Pages may share a url."""
    pages = page_objects(table(spark, d, "pages")).select("page_id", "url", "links")
    etag = F.sha1("url")
    stored = pages.where("page_id % 5 > 0").select("page_id", etag.alias("etag"), "links")
    now = pages.where("page_id % 7 > 0").select("page_id", F.when(F.col("page_id") % 3 == 0, 304).when(F.col("page_id") % 11 == 0, 500).otherwise(200).alias("status"), F.when(F.col("page_id") % 2 == 0, etag).otherwise("new").alias("etag"), F.array().cast("array<string>").alias("links"))
    return crawl.conditional(now, stored, ("page_id",)).groupBy("change").agg(F.count("*").alias("n"), F.sum(F.size("links")).cast("long").alias("links"))


def pk_discovery(spark, d):
    """The columns that tell the records of each table apart."""
    found = [(name, ",".join(keys.primary_key(table(spark, d, name).drop("text")))) for name in ("nation", "customer", "orders", "supplier", "conversations", "labels")]
    return spark.createDataFrame(found, "name string, key string")


def event_hours(spark, d):
    """Counts by hour and type (an extension: the record sources have no event-time windows)."""
    return feed.hourly(table(spark, d, "events")).select("hour", "event_type", "n")


def stream_sync(spark, d):
    """A stream of chunk rows drained into a snapshot table, twice; the second time changes nothing."""
    work = f"{shared_folder(spark)}/corvid-stream/{uuid.uuid4().hex}"
    rows = stored(spark, d)[0].select("chunk_id", "connector_uri", "object_uri", "locator", "content", "chunk_kind")
    rows.write.mode("overwrite").parquet(f"{work}/in")
    snapshots = index.Snapshots(spark, f"{work}/chunks", rows.schema)
    for name in ("a", "b"):
        feed.sync(spark.readStream.schema(rows.schema).parquet(f"{work}/in"), snapshots, f"{work}/checkpoint-{name}")
    return snapshots.read().select("chunk_id", "object_uri", F.sha1("content").alias("sha1"))


QUERIES = {f.__name__: f for f in (sync_diff, file_diff, rename_pairing, delete_gating, since_merge, manifest_diff, upload_replay, fingerprint_count_max, schema_fingerprint, upsert_chunks, delete_by_object, rename_rekey, orphan_gc, last_write_wins, lru_evict, event_feed_dedupe, event_hours, stream_sync, stream_regroup, engine_add, engine_resync, engine_resync_changes, engine_resync_search, engine_recovered, engine_sync_threads, index_dispatch, web_conditional, pk_discovery)}

_URI = "'docs://corpus/' || lang || '/' || source || '/' || doc_id || '.md'"
_OLD = f"SELECT {_URI} AS path, CASE WHEN toxic = 1 THEN 'outdated' ELSE sha1(text) END AS fingerprint FROM documents JOIN labels USING (doc_id)"
_NEW = f"SELECT {_URI} AS path, sha1(text) AS fingerprint FROM documents WHERE lang <> 'es'"
_DIFF = f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.fingerprint = n.fingerprint THEN 'unchanged' ELSE 'modified' END AS change FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.path = n.path"

_O = f"SELECT {_URI} AS uri, CASE WHEN toxic = 1 THEN sha1(text || ' outdated') ELSE sha1(text) END AS f FROM documents JOIN labels USING (doc_id)"
_N = f"SELECT replace({_URI}, '/de/', '/deutsch/') AS uri, sha1(text) AS f FROM documents WHERE lang <> 'es'"
_SHARED = f"o AS ({_O}), n AS ({_N}), a AS (SELECT f, count(*) AS k FROM n WHERE uri NOT IN (SELECT uri FROM o) GROUP BY f), d AS (SELECT f, count(*) AS k FROM o WHERE uri NOT IN (SELECT uri FROM n) GROUP BY f), r AS (SELECT coalesce(sum(least(a.k, d.k)), 0) AS k FROM a JOIN d USING (f))"

ORACLE = {
    "stream_regroup": "SELECT CAST(conv_id AS BIGINT) AS thread, CAST(count(*) AS INTEGER) AS n, sha1(string_agg(text, '|' ORDER BY turn)) AS sha1 FROM conversations GROUP BY conv_id",
    "engine_add": f"SELECT {_URI} AS object_uri, 'document' AS okind, CASE WHEN count(c.chunk_id) = 0 THEN 'not_indexed' ELSE 'indexed' END AS search_status, count(c.chunk_id) AS chunk_count FROM documents d LEFT JOIN (SELECT doc_id, chunk_id FROM ({CHUNKS})) c USING (doc_id) GROUP BY ALL",
    "engine_resync": f"SELECT replace({_URI}, '/de/', '/deutsch/') AS object_uri, CASE WHEN count(c.chunk_id) = 0 THEN 'not_indexed' ELSE 'indexed' END AS search_status, count(c.chunk_id) AS chunk_count FROM documents d LEFT JOIN (SELECT doc_id, chunk_id FROM ({CHUNKS})) c USING (doc_id) WHERE lang <> 'es' GROUP BY ALL",
    "engine_recovered": f"""WITH h AS (SELECT object_uri, max(score) AS best FROM ({bm25_sql(['rely', 'the', 'tion'], k=25, source="lang <> 'es'")}) GROUP BY object_uri)
        SELECT o.object_uri, search_status, chunk_count, best FROM (SELECT {_URI} AS object_uri, CASE WHEN count(c.chunk_id) = 0 THEN 'not_indexed' ELSE 'indexed' END AS search_status, count(c.chunk_id) AS chunk_count
            FROM documents d LEFT JOIN (SELECT doc_id, chunk_id FROM ({CHUNKS})) c USING (doc_id) WHERE lang <> 'es' GROUP BY ALL) o LEFT JOIN h USING (object_uri)""",
    "engine_sync_threads": f"""WITH RECURSIVE parts AS ({chunking.ORACLE['thread_split']}),
        cuts AS (SELECT conv_id, chunk_index AS part, first, last, content AS rest, 0 AS n, CAST(NULL AS VARCHAR) AS content FROM parts
            UNION ALL SELECT conv_id, part, first, last, substring(rest, k + 1), n + 1, left(rest, k) FROM (SELECT *, {CUT} AS k FROM cuts WHERE rest <> '')),
        pieces AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS all_, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) - 1 AS pos FROM cuts WHERE regexp_matches(content, '[^ \\t\\n\\r\\f\\v]')),
        told AS (SELECT 'slack://team/room' || conv_id % 4 || '.jsonl' AS object_uri, content,
            CASE WHEN all_ = 1 THEN '{{"conv_id":' || conv_id || '}}' ELSE '{{"chunk_index":' || pos || ',"conv_id":' || conv_id || ',"msg_range":[' || first || ',' || last || ']}}' END AS locator FROM pieces)
        SELECT sha1('default|slack://team|' || object_uri || '|thread_aggregate|' || locator) AS chunk_id, object_uri, locator, 'thread_aggregate' AS chunk_kind, sha1(content) AS sha1 FROM told""",
    "engine_resync_changes": f"""WITH {_SHARED}, x AS (
            SELECT 'unchanged' AS change, 'keep' AS action, count(*) AS n FROM o JOIN n USING (uri, f) UNION ALL
            SELECT 'modified', 'pipeline', count(*) FROM o JOIN n USING (uri) WHERE o.f <> n.f UNION ALL
            SELECT 'added', 'pipeline', (SELECT sum(k) FROM a) - (SELECT k FROM r) UNION ALL
            SELECT 'deleted', 'delete', (SELECT sum(k) FROM d) - (SELECT k FROM r) UNION ALL
            SELECT 'renamed', 'rename', k FROM r)
        SELECT change, action, CAST(n AS BIGINT) AS n FROM x WHERE n > 0""",
    "engine_resync_search": f"""WITH c AS ({CHUNKS}) SELECT replace(h.object_uri, '/de/', '/deutsch/') AS source, score, locator FROM ({bm25_sql(['rely', 'the', 'tion'], source="lang <> 'es'", chunks=CHUNKS.replace("SELECT sha1('default|docs://corpus|' || " + DOC_URI + " ||", "SELECT sha1('default|docs://corpus|' || replace(" + DOC_URI + ", '/de/', '/deutsch/') ||"), extra=", locator")}) h""",
    "index_dispatch": """WITH x AS (SELECT ['added', 'modified', 'deleted', 'renamed', 'unchanged'][p_partkey % 5 + 1] AS change, p_partkey % 4 <> 2 AND p_partkey % 7 > 0 AS pipeline FROM part)
        SELECT change, CASE change WHEN 'deleted' THEN 'delete' WHEN 'renamed' THEN 'rename' WHEN 'unchanged' THEN 'keep' ELSE CASE WHEN pipeline THEN 'pipeline' ELSE 'metadata' END END AS action, count(*) AS n FROM x GROUP BY ALL""",
    "web_conditional": """WITH l AS (SELECT page_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda u: regexp_replace(u, '#.*$', '')), lambda u: u <> ''))) AS links FROM pages),
        x AS (SELECT page_id % 5 > 0 AS known, page_id % 7 > 0 AS asked, CASE WHEN page_id % 3 = 0 THEN 304 WHEN page_id % 11 = 0 THEN 500 ELSE 200 END AS status, page_id % 2 = 0 AS same, links FROM l),
        y AS (SELECT CASE WHEN NOT asked THEN 'not_visited' WHEN known AND (status = 304 OR status = 200 AND same) THEN 'unchanged' WHEN status <> 200 THEN 'failed' WHEN known THEN 'modified' ELSE 'added' END AS change, known, links FROM x WHERE known OR asked)
        SELECT change, count(*) AS n, CAST(CASE WHEN change IN ('added', 'modified') THEN 0 ELSE sum(CASE WHEN known THEN links END) END AS BIGINT) AS links FROM y GROUP BY change""",
    "pk_discovery": "SELECT * FROM (VALUES ('nation', 'n_nationkey'), ('customer', 'c_custkey'), ('orders', 'o_orderkey'), ('supplier', 's_suppkey'), ('conversations', 'conv_id,turn'), ('labels', 'doc_id')) t(name, key)",
    "sync_diff": _DIFF,
    "file_diff": """SELECT lang || '/' || doc_id AS path, CASE lang WHEN 'de' THEN 'deleted' WHEN 'fr' THEN 'modified' WHEN 'en' THEN 'touched' ELSE 'unchanged' END AS change FROM documents
        UNION ALL SELECT 'moved/' || doc_id, 'added' FROM documents WHERE lang = 'de'""",
    "rename_pairing": """SELECT reason, count(*) AS n, count(*) AS sources FROM (SELECT CASE WHEN source = 'src0' AND NOT (doc_id < 0) THEN 'sha1' ELSE 'inode' END AS reason FROM documents WHERE lang = 'de') GROUP BY reason""",
    "delete_gating": f"SELECT change, count(*) AS n FROM ({_DIFF}) WHERE change <> 'deleted' GROUP BY change",
    "since_merge": f"{_NEW} UNION ALL SELECT * FROM ({_OLD}) WHERE path NOT IN (SELECT path FROM ({_NEW}))",
    "manifest_diff": """SELECT lang || '/' || doc_id AS path, CASE lang WHEN 'de' THEN 'delete_candidate' WHEN 'es' THEN 'keep' ELSE 'upload' END AS action FROM documents UNION ALL SELECT 'moved/' || doc_id, 'upload' FROM documents WHERE lang = 'de'""",
    "upload_replay": """SELECT lang || '/' || doc_id AS path, CASE WHEN lang = 'de' THEN 'old/de/' || doc_id END AS old_path, CASE lang WHEN 'es' THEN 'deleted' WHEN 'de' THEN 'renamed' ELSE 'modified' END AS change FROM documents WHERE lang <> 'en'""",
    "fingerprint_count_max": "SELECT count(*) || '|' || CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS fingerprint FROM orders",
    "schema_fingerprint": "SELECT 'c_custkey:bigint;c_name:string;c_nationkey:int;c_acctbal:double;c_mktsegment:string' AS fingerprint",
    "upsert_chunks": f"SELECT chunk_id, sha1(CASE WHEN lang = 'en' THEN content || '!' ELSE content END) AS sha1 FROM ({CHUNKS})",
    "delete_by_object": f"SELECT chunk_id, object_uri FROM ({CHUNKS}) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "rename_rekey": f"SELECT sha1('default|docs://corpus|' || u || '|body|' || locator) AS chunk_id, u AS object_uri FROM (SELECT replace(object_uri, '/de/', '/deutsch/') AS u, locator FROM ({CHUNKS}))",
    "orphan_gc": f"SELECT chunk_id, object_uri FROM ({CHUNKS}) WHERE lang = 'es'",
    "last_write_wins": "SELECT key, CAST(l_shipdate AS DATE) AS shipped, l_partkey FROM (SELECT l_orderkey || '-' || l_linenumber AS key, *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS n FROM lineitem) WHERE n = 1",
    "lru_evict": """SELECT p_partkey AS object_uri, CAST(p_size AS BIGINT) AS size_bytes FROM (SELECT *, sum(p_size) OVER () AS total, coalesce(sum(p_size) OVER (ORDER BY p_name, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM part) WHERE total - freed > 20000""",
    "event_feed_dedupe": "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type",
    "event_hours": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sync": f"SELECT chunk_id, object_uri, sha1(content) AS sha1 FROM ({CHUNKS})",
}
