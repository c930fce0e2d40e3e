"""Search and grep queries with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvid.engine import Engine
from corvid.functions import text as t
from corvid.model import OVERFETCH
from corvid.operators import grep, index, search
from corvid.operators.postings import Postings
from corvid.operators.vectors import VectorIndex
from corvid.plans.browsing import PAGE_TEXT, PAGE_URI
from corvid.plans.common import CHUNKS, DOC_URI, LINES, WORDS, bm25_sql
from corvid.plans.stored import build, stored
from corvid.session import shared_folder
from corvid.sources.tables import document_uri, page_objects, table

QUERY, TERMS = "Tion the rely", ["rely", "the", "tion"]


def chunks(spark, d):
    return stored(spark, d)[0]


def ranked(spark, d, query=QUERY, where=None, top_k=10):
    return stored(spark, d)[1].bm25(query, where, top_k)


def index_build(spark, d):
    """Chunks and postings of all documents from nothing: what a first sync costs."""
    _, postings = build(spark, d, f"{shared_folder(spark)}/corvid-index/{uuid.uuid4().hex}")
    return postings.stats().select("n", F.round("avgdl", 6).alias("avgdl"))


def query_vector(spark, d):
    """The first vector of the table serves as the query."""
    return [float(x) for x in table(spark, d, "embeddings").orderBy("vec_id").first()["embedding"]]


def bm25_topk(spark, d):
    return ranked(spark, d)


def bm25_scan(spark, d):
    """The same without an index, over all chunks."""
    return search.bm25(chunks(spark, d), QUERY)


def bm25_scoped(spark, d):
    return ranked(spark, d, where=search.in_scope("docs://corpus", "docs://corpus/en"))


def bm25_kind_filter(spark, d):
    return ranked(spark, d, where=search.in_scope(kinds=["body", "row_text"]), top_k=25)


def token_stats(spark, d):
    """How many chunks hold each term, and how often it occurs."""
    return stored(spark, d)[1].vocabulary()


def corpus_stats(spark, d):
    n = F.size(t.tokens(F.col("content")))
    return chunks(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("avgdl"), F.sum(n).alias("tokens"))


def dense_topk(spark, d):
    return search.dense(table(spark, d, "embeddings"), query_vector(spark, d))


def dense_indexed(spark, d):
    """The same hits from a vector index that is built for it."""
    own = VectorIndex(spark, f"{shared_folder(spark)}/corvid-vectors/{uuid.uuid4().hex}", key="vec_id", key_type="long")
    own.add(table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("object_uri"), "embedding"), vector_col="embedding")
    return own.exact(query_vector(spark, d)).select("vec_id", "score")


def hybrid_rrf(spark, d):
    """Vector k stands for document k; each leg brings three times what is asked for, of chunks of one document the best."""
    hits = ranked(spark, d, top_k=10 * OVERFETCH)
    lexical = hits.withColumn("doc_id", F.regexp_extract("object_uri", r"(\d+)\.md$", 1).cast("long")).groupBy("doc_id").agg(F.max("score").alias("score"))
    dense = search.dense(table(spark, d, "embeddings"), query_vector(spark, d), 10 * OVERFETCH).select(F.col("vec_id").alias("doc_id"), "score")
    return search.fuse([lexical, dense], "doc_id", 10)


def search_collapse(spark, d):
    """The best hit of each folder among the best 30."""
    hits = ranked(spark, d, top_k=30).withColumn("folder", t.parent(F.col("object_uri")))
    return search.collapse(hits, ["folder"], [F.desc("score"), F.col("chunk_id")]).select("folder", "object_uri", "score")


def search_envelope(spark, d):
    rows, postings = stored(spark, d)
    hits = rows.join(F.broadcast(postings.bm25(QUERY).select("chunk_id", "score")), "chunk_id")  # ten rows
    return search.envelope(hits, F.substring("content", 1, 80), F.col("chunk_kind"), F.col("locator"), F.col("metadata"))


def engine_search(spark, d):
    """The same through the engine's front, in one folder, collapsed: the best chunk of each document among the best ten."""
    rows, postings = stored(spark, d)
    hits = Engine(["docs://corpus"], document_uri(table(spark, d, "documents")), rows, postings=postings).search(QUERY, "docs://corpus/en", "keyword", collapse=True)
    return hits.withColumn("content", F.substring("content", 1, 80))


def engine_status(spark, d):
    """Documents without a label aren't indexed and have no chunks; one connector is empty."""
    rows = document_uri(table(spark, d, "documents")).withColumnRenamed("text", "content")
    labels = table(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    objects = rows.join(labels, "doc_id", "left").withColumn("search_status", F.when(F.col("known"), "indexed").otherwise("not_indexed"))
    own = chunks(spark, d).join(labels.select("doc_id"), "doc_id", "left_semi")
    return Engine(["docs://corpus", "web://crawl"], objects, own).status()


def benchmark_retrieval(spark, d):
    """For each benchmark item the documents that hold all of its rarest words: one inverted-index join."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(t.tokens(F.col("text")))).alias("term"))
    df = words.groupBy("term").agg(F.count("*").alias("df"))
    items = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(t.tokens(F.col("text")))).alias("term"))
    known = items.join(df, "term").withColumn("nth", F.row_number().over(search.Window.partitionBy("item_id").orderBy("df", "term"))).where("nth <= 5")
    hits = known.join(words, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("matched"))
    return hits.where("matched = 5")


def bm25_indexed(spark, d):
    """The same hits from the persisted index: English documents were indexed with another text first, then again."""
    postings = Postings(spark, f"{shared_folder(spark)}/corvid-postings/{uuid.uuid4().hex}")
    rows = chunks(spark, d)
    english = F.col("object_uri").startswith("docs://corpus/en/")
    outdated = rows.withColumn("content", F.when(english, F.concat(F.lit("rely rely the "), "content")).otherwise(F.col("content")))
    postings.add(outdated)
    postings.add(rows.where(english), outdated.where(english))
    return postings.bm25(QUERY)


def bm25_compacted(spark, d):
    """Documents of one source are gone from the index, which is then written as one segment."""
    postings = Postings(spark, f"{shared_folder(spark)}/corvid-postings/{uuid.uuid4().hex}")
    rows = chunks(spark, d)
    postings.add(rows)
    postings.add(rows.limit(0), rows.where(F.col("object_uri").contains("/src0/")))
    postings.compact()
    return postings.bm25(QUERY, search.in_scope("docs://corpus", "docs://corpus/en"))


def indexed_objects(spark, d):
    return index.indexed_objects(chunks(spark, d))


def grep_literal(spark, d):
    return grep.line_hits(document_uri(table(spark, d, "documents")).withColumnRenamed("text", "content"), "rely and").select("source", "locator", "content", "via")


def grep_regex(spark, d):
    return grep.line_hits(document_uri(table(spark, d, "documents")).withColumnRenamed("text", "content"), "[A-Z]{6,}!! [A-Z]+", regex=True).select("source", "locator", "content", "via")


def grep_sql_pushdown(spark, d):
    return grep.column_hits(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "urgent", ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


def grep_linear_notice(spark, d):
    """Documents without a label count as not indexed."""
    docs, labels = document_uri(table(spark, d, "documents")), table(spark, d, "labels").select("doc_id").distinct()
    status = docs.join(labels, "doc_id", "left_anti").select("object_uri", F.col("text").alias("content"), F.lit("not_indexed").alias("search_status"))
    return grep.linear(status, "rely and")


def grep_chain_union(spark, d):
    """BM25 hits and lines of what isn't indexed, told apart by via."""
    found = ranked(spark, d, "rely", top_k=100).select(F.col("object_uri").alias("source"), F.lit("bm25").alias("via"))
    pages = page_objects(table(spark, d, "pages")).select("object_uri", "content", F.lit("not_indexed").alias("search_status"))
    return found.unionByName(grep.linear(pages, "rely").where("via = 'linear'").select("source", "via"))


def connector_match(spark, d):
    roots = spark.createDataFrame([("docs://corpus",), ("docs://corpus/en",), ("docs://corpus/e",), ("docs://corpus/de/src1",)], "root string")
    return search.connector_of(document_uri(table(spark, d, "documents")).select(F.col("object_uri").alias("path")), roots)


_DOT = "list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::double * p[2]::double))"
_DENSE = f"""SELECT vec_id, round({_DOT} / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))) * sqrt(list_sum(list_transform(q, lambda x: x::double * x)))), 6) AS score
    FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) ORDER BY score DESC, vec_id LIMIT """
_HIT_LINES = f"(SELECT {DOC_URI} AS source, unnest({LINES.format('text')}) AS line, generate_subscripts({LINES.format('text')}, 1) AS n FROM documents)"

QUERIES = {f.__name__: f for f in (index_build, bm25_topk, bm25_scan, bm25_scoped, bm25_kind_filter, bm25_indexed, bm25_compacted, indexed_objects, token_stats, corpus_stats, dense_topk, dense_indexed, hybrid_rrf, search_collapse, search_envelope, engine_search, engine_status, benchmark_retrieval, grep_literal, grep_regex, grep_sql_pushdown, grep_linear_notice, grep_chain_union, connector_match)}

ORACLE = {
    "bm25_topk": bm25_sql(TERMS),
    "bm25_scoped": bm25_sql(TERMS, "object_uri = 'docs://corpus/en' OR starts_with(object_uri, 'docs://corpus/en/')"),
    "bm25_kind_filter": bm25_sql(TERMS, "chunk_kind IN ('body', 'row_text')", 25),
    "bm25_scan": bm25_sql(TERMS),
    "index_build": f"SELECT count(*) AS n, round(avg(len({WORDS.format('content')})), 6) AS avgdl FROM ({CHUNKS})",
    "bm25_indexed": bm25_sql(TERMS),
    "bm25_compacted": bm25_sql(TERMS, "starts_with(object_uri, 'docs://corpus/en/')", source="source <> 'src0'"),
    "indexed_objects": f"SELECT DISTINCT connector_uri, object_uri FROM ({CHUNKS})",
    "token_stats": f"SELECT term, count(*) AS df, CAST(sum(c) AS BIGINT) AS cf FROM (SELECT chunk_id, term, count(*) AS c FROM (SELECT chunk_id, unnest({WORDS.format('content')}) AS term FROM ({CHUNKS})) GROUP BY ALL) GROUP BY term",
    "corpus_stats": f"SELECT count(*) AS n, round(avg(len({WORDS.format('content')})), 6) AS avgdl, CAST(sum(len({WORDS.format('content')})) AS BIGINT) AS tokens FROM ({CHUNKS})",
    "dense_topk": _DENSE + "10",
    "dense_indexed": _DENSE + "10",
    "hybrid_rrf": f"""WITH lex AS (SELECT doc_id, row_number() OVER (ORDER BY max(score) DESC, doc_id) AS r FROM ({bm25_sql(TERMS, k=30, extra=', doc_id')}) GROUP BY doc_id),
        den AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM ({_DENSE}30))
        SELECT doc_id, round(sum(1.0::double / (60 + r)), 6) AS score, CAST(count(*) AS INTEGER) AS legs FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""",
    "search_collapse": f"""SELECT folder, object_uri, score FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY score DESC, chunk_id) AS r FROM
        (SELECT *, regexp_replace(object_uri, '/?[^/]*$', '') AS folder FROM ({bm25_sql(TERMS, k=30)}))) WHERE r = 1""",
    "search_envelope": f"""SELECT h.object_uri AS source, substring(c.content, 1, 80) AS content, score, locator, '{{"chunk_kind":"body","fields":{{}},"kind":"search"}}' AS metadata FROM ({bm25_sql(TERMS)}) h JOIN ({CHUNKS}) c USING (chunk_id)""",
    "engine_search": f"""SELECT h.object_uri AS source, substring(c.content, 1, 80) AS content, score, locator, '{{"chunk_kind":"body","fields":{{}},"kind":"search"}}' AS metadata
        FROM (SELECT * FROM ({bm25_sql(TERMS, "starts_with(object_uri, 'docs://corpus/en/')")}) QUALIFY row_number() OVER (PARTITION BY object_uri ORDER BY score DESC, chunk_id) = 1) h JOIN ({CHUNKS}) c USING (chunk_id)""",
    "engine_status": f"""SELECT 'docs://corpus' AS connector_uri, count(*) AS objects, (SELECT count(*) FROM ({CHUNKS}) WHERE doc_id IN (SELECT doc_id FROM labels)) AS chunks, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS indexed FROM documents
        UNION ALL SELECT 'web://crawl', 0, 0, 0""",
    "benchmark_retrieval": f"""WITH words AS (SELECT DISTINCT doc_id, unnest({WORDS.format('text')}) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM words GROUP BY term),
        items AS (SELECT DISTINCT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark),
        known AS (SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY df, term) AS nth FROM items JOIN df USING (term)) WHERE nth <= 5)
        SELECT item_id, doc_id, count(*) AS matched FROM known JOIN words USING (term) GROUP BY ALL HAVING count(*) = 5""",
    "grep_literal": f"""SELECT source, '{{"lines":[' || n || ',' || (n + 1) || ']}}' AS locator, line AS content, 'pushdown' AS via FROM {_HIT_LINES} WHERE contains(line, 'rely and') ORDER BY source, n LIMIT 100""",
    "grep_regex": f"""SELECT source, '{{"lines":[' || n || ',' || (n + 1) || ']}}' AS locator, line AS content, 'pushdown' AS via FROM {_HIT_LINES} WHERE regexp_matches(line, '[A-Z]{{6,}}!! [A-Z]+') ORDER BY source, n LIMIT 100""",
    "grep_sql_pushdown": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority ILIKE '%urgent%' OR o_orderstatus ILIKE '%urgent%' ORDER BY o_orderkey LIMIT 100",
    "grep_linear_notice": f"""WITH objects AS (SELECT {DOC_URI} AS object_uri, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), scanned AS (SELECT * FROM objects ORDER BY object_uri LIMIT 200),
        lines AS (SELECT object_uri, unnest({LINES.format('text')}) AS line, generate_subscripts({LINES.format('text')}, 1) AS n FROM scanned)
        SELECT object_uri AS source, '{{"lines":[' || n || ',' || (n + 1) || ']}}' AS locator, line AS content, 'linear' AS via FROM lines WHERE contains(line, 'rely and') QUALIFY row_number() OVER (PARTITION BY object_uri ORDER BY n) <= 200
        UNION ALL SELECT '', NULL, (count(*) - 200) || ' objects not scanned', 'notice' FROM objects HAVING count(*) > 200""",
    "grep_chain_union": f"""WITH pages_ AS (SELECT {PAGE_URI} AS object_uri, {PAGE_TEXT} AS text FROM pages ORDER BY object_uri LIMIT 200),
        lines AS (SELECT object_uri, unnest({LINES.format('text')}) AS line, generate_subscripts({LINES.format('text')}, 1) AS n FROM pages_)
        SELECT object_uri AS source, 'bm25' AS via FROM ({bm25_sql(['rely'], k=100)}) UNION ALL
        SELECT object_uri, 'linear' FROM lines WHERE contains(line, 'rely') QUALIFY row_number() OVER (PARTITION BY object_uri ORDER BY n) <= 200""",
    "connector_match": f"""WITH r(root) AS (VALUES ('docs://corpus'), ('docs://corpus/en'), ('docs://corpus/e'), ('docs://corpus/de/src1')), p AS (SELECT {DOC_URI} AS path FROM documents)
        SELECT path, root, path AS object_prefix FROM (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS n FROM p JOIN r ON path = root OR starts_with(path, root || '/')) WHERE n = 1""",
}
