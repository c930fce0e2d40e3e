"""Chunk producer queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions import records as r
from corvid.functions import text as t
from corvid.model import ObjectConfig
from corvid.operators import chunk, index, threads
from corvid.plans.common import CHUNKS, DOC_URI, WORDS
from corvid.sources.tables import document_uri, table

CUSTOMER = ObjectConfig(["c_name", "c_mktsegment"], ["c_nationkey"], ["c_custkey"])


def customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")


def nested(spark, d):
    """Each customer with the list of its orders, as a nested record."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("orders"))
    return customers(spark, d).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


def rendered(spark, d):
    turns = table(spark, d, "conversations")
    return chunk.thread_messages(turns, "conv_id", "turn", r.render_template(turns, "{role}: {text}"))


def render_labelled(spark, d):
    df = customers(spark, d)
    return df.select("c_custkey", r.render(df, CUSTOMER.text_fields).alias("content"))


def render_multi(spark, d):
    """A list of values renders as a list."""
    df = nested(spark, d)
    return df.select("c_custkey", r.render(df, ["c_name", "orders[].o_orderpriority"]).alias("content"))


def render_template(spark, d):
    df = table(spark, d, "conversations")
    return df.select("conv_id", "turn", r.render_template(df, "[{role}] {text}{missing}").alias("content"))


def resolve_path_multi(spark, d):
    df = nested(spark, d)
    return df.select("c_custkey", F.size(r.texts(df, "orders[*].o_orderkey")).alias("n"), r.resolve(df, "orders[1].o_orderkey")[0].alias("second"), F.array_join(r.texts(df, "orders[0:2].o_orderkey"), ",").alias("first_two"), F.array_join(r.texts(df, "c_name[].x"), ",").alias("none"))


def json_path(spark, d):
    """A field of a JSON column of unknown schema."""
    return table(spark, d, "events").select("event_id", F.expr("try_variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))


def record_chunks(spark, d):
    locator = t.locator_json(c_custkey=F.col("c_custkey"))
    made = chunk.record_chunks(customers(spark, d), "warehouse://tpch/customer/rows.jsonl", CUSTOMER, locator)
    return made.select("object_uri", "locator", "content")


def record_chunks_capped(spark, d):
    """The first 1000 records only, with the object's status."""
    config = ObjectConfig(["p_name", "p_brand"], [], ["p_partkey"], chunk_max=1000)
    parts = table(spark, d, "part")
    made = chunk.record_chunks(parts, "warehouse://tpch/part/rows.jsonl", config, t.locator_json(p_partkey=F.col("p_partkey")), ["p_partkey"])
    return made.select("locator", "content", "metadata", index.search_status(F.lit(False), F.lit(1), F.col("partial")).alias("search_status"))


def record_parts(spark, d):
    """Each customer with all its orders: long records become several chunks with their number in the locator."""
    config = ObjectConfig(["c_name", "orders[].o_orderpriority"], ["c_mktsegment", "c_nationkey"], ["c_custkey"])
    made = chunk.record_chunks(nested(spark, d).withColumn("c_name", F.repeat("c_name", 113)), "warehouse://tpch/customer/rows.jsonl", config)
    return made.groupBy(F.regexp_extract("locator", r'"c_custkey":(\d+)', 1).cast("long").alias("c_custkey"), "metadata").agg(F.count("*").alias("parts"), F.sum(F.length("content")).alias("size"), F.max(F.length("content") <= 2048).alias("within"), F.countDistinct("locator").alias("locators"))


def field_presence(spark, d):
    """Which of the configured fields a table's records have at all."""
    return chunk.missing_fields(nested(spark, d), ["c_name", "orders[].o_orderkey", "c_nothing", "c_phone.x"])


def code_outline(spark, d):
    """Documents as source files: a class for each, a method for each line, which holds the line as a string, and text in strings and
    comments that only looks like definitions."""
    lines = F.split("text", "\n")
    method = lambda x, i: F.concat(F.lit("    @property\n    def line_"), i.cast("string"), F.lit("(self):\n        # def no():\n        return \""), F.translate(x, "\"\\", "''"), F.lit("\"\n\n"))
    head = F.concat(F.lit("\"\"\"\nclass Hidden:\n\"\"\"\n\nclass Document"), F.col("doc_id").cast("string"), F.lit(":\n"))
    code = F.concat(head, F.array_join(F.transform(lines, method), ""), F.lit("def after(): return {'class': 1}\n"))
    objects = document_uri(table(spark, d, "documents")).select(F.replace("object_uri", F.lit(".md"), F.lit(".py")).alias("object_uri"), code.alias("content"))
    return chunk.code_outline(objects)


def thread_keys(spark, d):
    """Turns without a thread of their own stand alone."""
    turns = table(spark, d, "conversations").select(F.when(F.col("conv_id") % 3 > 0, F.col("conv_id")).alias("thread_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "turn", "text")
    threads = chunk.thread_messages(turns.withColumn("key", chunk.thread_key(turns)), "key", "turn", F.col("text"))
    return threads.select("key", F.size("messages").alias("n"))


def routed_chunks(spark, d):
    """Objects of three kinds go to their producers; what has none makes no chunk."""
    docs = document_uri(table(spark, d, "documents")).select("connector_uri", "object_uri", F.col("text").alias("content"))
    number = F.regexp_extract("object_uri", r"(\d+)\.md$", 1).cast("long")
    okind = F.when(number % 3 == 0, "text_blob").when(number % 3 == 1, "binary").otherwise("document")
    made = chunk.produced(docs.withColumn("okind", okind), {"text": lambda rows: chunk.located_chunks(rows, ("okind",)).select("object_uri", "okind", "chunk_index")})
    return made.groupBy("okind").agg(F.countDistinct("object_uri").alias("objects"), F.count("*").alias("chunks"))


def converted_freshness(spark, d):
    """Pages whose converted text can be used again: made from the same html by the same converter."""
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("object_uri"), F.concat(F.sha1("html"), F.lit(":html-2")).alias("currency"))
    made = table(spark, d, "pages").where("page_id % 4 < 3").select(F.col("page_id").cast("string").alias("object_uri"), F.concat(F.sha1("html"), F.when(F.col("page_id") % 4 == 1, ":html-1").otherwise(":html-2")).alias("currency"))
    return index.fresh_artifacts(pages, made).groupBy("reuse").agg(F.count("*").alias("n"))


def embedding_cache_stats(spark, d):
    empty = spark.createDataFrame([], "cache_key string, dense_vec array<float>")
    return index.cache_stats(index.embed(table(spark, d, "benchmark").select("item_id", F.col("text").alias("content")), empty)[1])


def chunk_ids(spark, d):
    docs = document_uri(table(spark, d, "documents"))
    locator = t.locator_json(source=t.json_text(F.col("source")), id=F.col("doc_id"))
    return docs.select("doc_id", t.chunk_id(F.col("connector_uri"), F.col("object_uri"), F.lit("body"), locator).alias("chunk_id"))


def content_cap(spark, d):
    """Contents are cut at 65,000 characters and flagged."""
    content, cut = chunk.capped(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(content).alias("kept"), cut.alias("cut"))


def thread_aggregate(spark, d):
    return rendered(spark, d).select("conv_id", F.size("messages").alias("n"), F.array_join("messages", "\n\n").alias("content"))


def thread_split_long(spark, d):
    """The same for threads of any length: blocks of messages, of which each knows where its first cut is."""
    turns = table(spark, d, "conversations")
    return threads.thread_parts(turns.select("conv_id", "turn", r.render_template(turns, "{role}: {text}").alias("text")), "conv_id", "turn", "text", block=1)


def thread_split(spark, d):
    return chunk.thread_parts(rendered(spark, d), "conv_id")


def document_chunks(spark, d):
    """Pieces of at most 2048 characters at sentence or word ends."""
    docs = document_uri(table(spark, d, "documents")).withColumnRenamed("text", "content")
    return chunk.text_chunks(docs).drop("partial")


def document_chunks_rejoined(spark, d):
    """The chunks of each document put together again: nothing is lost but blank pieces."""
    pieces = document_chunks(spark, d)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "")
    return pieces.groupBy("object_uri").agg(F.sha1(joined).alias("sha1"), (F.max(F.length("content")) <= 2048).alias("within"))


def schema_summary(spark, d):
    return chunk.schema_summary(table(spark, d, "orders"), "warehouse://tpch/orders/schema.json")


def dir_summary_fold(spark, d):
    docs = document_uri(table(spark, d, "documents")).withColumnRenamed("text", "content")
    folded = chunk.folder_summaries(docs.select("object_uri", "content"), "docs://corpus")
    return folded.select("folder", "n_children", F.length("content").alias("size"), F.substring("content", 1, 200).alias("head"))


def object_kind(spark, d):
    """Kinds and producers of files named after parts."""
    exts = F.array(*map(F.lit, [".md", ".py", ".png", ".jsonl", ".exe", ""]))
    path = F.concat(F.lit("x/"), F.col("p_partkey").cast("string"), F.element_at(exts, (F.col("p_partkey") % 6 + 1).cast("int")))
    kind = t.object_kind(path)
    return table(spark, d, "part").select("p_partkey", kind.alias("okind"), t.producer_of(kind).alias("producer"), t.media_type(path).alias("media_type"))


def task_priority(spark, d):
    folders = F.array(*map(F.lit, ["src/a.py", "docs/x.md", "tests/t.py", "build/o.c", "tests/README.md", "Cargo.toml", "misc/z.txt"]))
    path = F.element_at(folders, (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", t.task_priority(path).alias("priority"))


def cache_miss_embed(spark, d):
    """Texts are embedded once each: documents with labels are in the cache, the others are missing from it."""
    docs = table(spark, d, "documents")
    chunks = docs.select("doc_id", F.col("text").alias("content"))
    known = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    empty = spark.createDataFrame([], "cache_key string, dense_vec array<float>")
    _, cache = index.embed(known.select("doc_id", F.col("text").alias("content")), empty)
    _, filled = index.embed(chunks, cache)
    return filled.agg(F.count("*").alias("entries"), F.countDistinct("cache_key").alias("keys"))


def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


def hash_embeddings(spark, d):
    """How many dimensions of its embedding a document uses."""
    v = index.hash_embedding(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(v, lambda x: x > 0)).alias("used"))


QUERIES = {f.__name__: f for f in (render_labelled, render_multi, render_template, resolve_path_multi, json_path, record_chunks, record_chunks_capped, chunk_ids, content_cap, thread_aggregate, thread_split, thread_split_long, record_parts, field_presence, code_outline, thread_keys, routed_chunks, converted_freshness, embedding_cache_stats, document_chunks, document_chunks_rejoined, schema_summary, dir_summary_fold, object_kind, task_priority, cache_miss_embed, token_estimates, hash_embeddings)}

_MESSAGES = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role || ': ' || text AS m FROM conversations"
_NESTED = "SELECT c_custkey, c_name, list({o_orderkey: o_orderkey, p: o_orderpriority} ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name"

ORACLE = {
    "render_labelled": "SELECT c_custkey, 'c_name: ' || c_name || chr(10) || chr(10) || 'c_mktsegment: ' || c_mktsegment AS content FROM customer",
    "render_multi": f"""SELECT c_custkey, 'c_name: ' || c_name || coalesce(chr(10) || chr(10) || 'orders[].o_orderpriority:' || chr(10) || '- ' || array_to_string(list_transform(orders, lambda x: x.p), chr(10) || '- '), '') AS content FROM ({_NESTED})""",
    "render_template": "SELECT conv_id, turn, '[' || role || '] ' || text AS content FROM conversations",
    "resolve_path_multi": f"""SELECT c_custkey, CAST(coalesce(len(orders), 0) AS INTEGER) AS n, orders[2].o_orderkey AS second, coalesce(array_to_string(list_transform(orders[1:2], lambda x: CAST(x.o_orderkey AS VARCHAR)), ','), '') AS first_two, '' AS none FROM ({_NESTED})""",
    "json_path": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "record_chunks": """SELECT 'warehouse://tpch/customer/rows.jsonl' AS object_uri, '{"c_custkey":' || c_custkey || '}' AS locator, 'c_name: ' || c_name || chr(10) || chr(10) || 'c_mktsegment: ' || c_mktsegment AS content FROM customer""",
    "record_chunks_capped": """SELECT '{"p_partkey":' || p_partkey || '}' AS locator, 'p_name: ' || p_name || chr(10) || chr(10) || 'p_brand: ' || p_brand AS content, '{}' AS metadata, CASE WHEN (SELECT count(*) FROM part) > 1000 THEN 'partial' ELSE 'indexed' END AS search_status FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 1000)""",
    "record_parts": f"""WITH r AS (SELECT n.c_custkey, c_mktsegment, c_nationkey, 'c_name: ' || repeat(n.c_name, 113) || coalesce(chr(10) || chr(10) || 'orders[].o_orderpriority:' || chr(10) || '- ' || array_to_string(list_transform(orders, lambda x: x.p), chr(10) || '- '), '') AS content FROM ({_NESTED}) n JOIN customer USING (c_custkey))
        SELECT c_custkey, '{{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}}' AS metadata, CASE WHEN length(content) > 2048 THEN 2 ELSE 1 END AS parts, CAST(length(content) AS BIGINT) AS size, true AS within, CASE WHEN length(content) > 2048 THEN 2 ELSE 1 END AS locators FROM r""",
    "routed_chunks": f"SELECT okind, count(DISTINCT object_uri) AS objects, count(*) AS chunks FROM (SELECT *, ['text_blob', 'binary', 'document'][doc_id % 3 + 1] AS okind FROM ({CHUNKS})) WHERE okind <> 'binary' GROUP BY okind",
    "field_presence": "SELECT * FROM (VALUES ('c_name', true), ('orders[].o_orderkey', true), ('c_nothing', false), ('c_phone.x', false)) t(field, seen)",
    "code_outline": f"""WITH l AS (SELECT replace({DOC_URI}, '.md', '.py') AS object_uri, doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n FROM documents)
        SELECT object_uri, 'class' AS kind, 'Document' || doc_id AS name, 0::INTEGER AS depth, 5::INTEGER AS first, CAST(5 + 5 * n - 1 AS INTEGER) AS last FROM l
        UNION ALL SELECT object_uri, 'def', 'line_' || i, 1::INTEGER, CAST(6 + 5 * i AS INTEGER), CAST(9 + 5 * i AS INTEGER) FROM (SELECT object_uri, unnest(range(0, n)) AS i FROM l)
        UNION ALL SELECT object_uri, 'def', 'after', 0::INTEGER, CAST(6 + 5 * n AS INTEGER), CAST(6 + 5 * n AS INTEGER) FROM l""",
    "thread_keys": "SELECT CASE WHEN conv_id % 3 > 0 THEN CAST(conv_id AS VARCHAR) ELSE conv_id || '-' || turn END AS key, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY 1",
    "converted_freshness": "SELECT page_id % 4 IN (0, 2) AS reuse, count(*) AS n FROM pages GROUP BY 1",
    "embedding_cache_stats": "SELECT count(DISTINCT text) AS entries, 64 AS dims, CAST(count(DISTINCT text) * 256 AS BIGINT) AS bytes FROM benchmark",
    "chunk_ids": f"""SELECT doc_id, sha1('default|docs://corpus|' || {DOC_URI} || '|body|{{"id":' || doc_id || ',"source":"' || source || '"}}') AS chunk_id FROM documents""",
    "content_cap": "SELECT doc_id, CAST(least(length(text), 65000) AS INTEGER) AS kept, length(text) > 65000 AS cut FROM documents",
    "thread_aggregate": f"SELECT conv_id, CAST(count(*) AS INTEGER) AS n, string_agg(m, chr(10) || chr(10) ORDER BY i) AS content FROM ({_MESSAGES}) GROUP BY conv_id",
    "thread_split": f"""WITH RECURSIVE m AS (SELECT conv_id, CAST(i AS INTEGER) AS i, m, length(m) + 2 AS z FROM ({_MESSAGES})),
        walk AS (SELECT conv_id, 0 AS i, 0 AS start, CAST(z AS BIGINT) AS size, CAST(NULL AS INTEGER) AS f, CAST(NULL AS INTEGER) AS l FROM m WHERE i = 0
            UNION ALL SELECT w.conv_id, m.i,
                CASE WHEN w.size + m.z > 1500 THEN greatest(w.start, m.i - 2) ELSE w.start END,
                CASE WHEN w.size + m.z > 1500 THEN m.z + (SELECT sum(p.z) FROM m p WHERE p.conv_id = w.conv_id AND p.i BETWEEN greatest(w.start, m.i - 2) AND m.i - 1) ELSE w.size + m.z END,
                CASE WHEN w.size + m.z > 1500 THEN w.start END, CASE WHEN w.size + m.z > 1500 THEN m.i - 1 END
            FROM walk w JOIN m ON m.conv_id = w.conv_id AND m.i = w.i + 1),
        parts AS (SELECT conv_id, f AS first, l AS last FROM walk WHERE f IS NOT NULL UNION ALL SELECT conv_id, start, i FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY last, first) - 1 AS INTEGER) AS chunk_index FROM parts)
        SELECT n.conv_id, chunk_index, first, last, string_agg(m.m, chr(10) || chr(10) ORDER BY m.i) AS content FROM numbered n JOIN m ON m.conv_id = n.conv_id AND m.i BETWEEN first AND last GROUP BY ALL""",
    "document_chunks": f"SELECT object_uri, chunk_index, locator, content FROM ({CHUNKS})",
    "document_chunks_rejoined": f"SELECT {DOC_URI} AS object_uri, sha1(text) AS sha1, true AS within FROM documents WHERE trim(text, ' ' || chr(10)) <> ''",
    "schema_summary": "SELECT 'warehouse://tpch/orders/schema.json' AS object_uri, 'schema_summary' AS chunk_kind, 'columns: o_orderkey bigint; o_custkey bigint; o_orderstatus string; o_totalprice double; o_orderdate timestamp_ntz; o_orderpriority string' AS content",
    "dir_summary_fold": """WITH leaf AS (SELECT 'docs://corpus/' || lang || '/' || source AS folder, 'docs://corpus/' || lang AS up, source AS name, doc_id || '.md' AS file, left(text, 16384) AS text FROM documents),
        a AS (SELECT folder, any_value(up) AS up, any_value(name) AS name, count(*) AS n_children, left(string_agg(file || ': ' || text, chr(10) ORDER BY file), 65536) AS content FROM leaf GROUP BY folder),
        b AS (SELECT up AS folder, count(*) AS n_children, left(string_agg(name || ': ' || left(content, 16384), chr(10) ORDER BY name), 65536) AS content FROM a GROUP BY up),
        c AS (SELECT 'docs://corpus' AS folder, count(*) AS n_children, left(string_agg(split_part(folder, '/', 4) || ': ' || left(content, 16384), chr(10) ORDER BY folder), 65536) AS content FROM b)
        SELECT folder, n_children, CAST(length(content) AS INTEGER) AS size, left(content, 200) AS head FROM (SELECT folder, n_children, content FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""",
    "object_kind": """SELECT p_partkey, ['document', 'code', 'image', 'text_blob', 'binary', 'binary'][p_partkey % 6 + 1] AS okind, ['text', 'text', 'vision', 'text', NULL, NULL][p_partkey % 6 + 1] AS producer,
        ['text/markdown', 'text/x-python', 'image/png', 'application/x-ndjson', NULL, NULL][p_partkey % 6 + 1] AS media_type FROM part""",
    "task_priority": "SELECT p_partkey, [-220, -190, 80, 260, -350, -260, 0][p_partkey % 7 + 1] AS priority FROM part",
    "cache_miss_embed": "SELECT count(DISTINCT text) AS entries, count(DISTINCT sha1(text)) AS keys FROM documents",
    "token_estimates": "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents",
}
ORACLE["thread_split_long"] = ORACLE["thread_split"]
