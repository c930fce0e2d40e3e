"""Browse queries with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvid.engine import Engine
from corvid.functions import text as t
from corvid.operators import browse, crawl
from corvid.operators.pages import RangePages
from corvid.plans.common import DOC_URI, LINES
from corvid.session import shared_folder
from corvid.sources.tables import document_uri, page_objects, table


def objects(spark, d):
    return document_uri(table(spark, d, "documents")).withColumnRenamed("text", "content")


def outlined(spark, d):
    """Pages as markdown: an h1 to h6 becomes a heading line."""
    html = F.regexp_replace(F.col("html"), r"(?is)<h[1-6]>(.*?)</h[1-6]>", "\n# $1\n")
    plain = F.regexp_replace(F.regexp_replace(html, "(?i)<br>|<p>|</p>", "\n"), "<[^>]*>", "")
    return table(spark, d, "pages").select(F.col("page_id").cast("string").alias("object_uri"), plain.alias("content"))


def ls_children(spark, d):
    return browse.children(objects(spark, d), "docs://corpus/en")


def tree_depth2(spark, d):
    return browse.tree(objects(spark, d), "docs://corpus", 2)


def cat_range(spark, d):
    return browse.cat_range(objects(spark, d), "2:4")


def head_n(spark, d):
    return browse.head(objects(spark, d), 3)


def tail_n(spark, d):
    return browse.tail(objects(spark, d), 2)


def density_peek(spark, d):
    return browse.outline(outlined(spark, d), "peek")


def density_skim(spark, d):
    return browse.outline(outlined(spark, d), "skim")


def density_code(spark, d):
    """Texts have no definitions: the outline falls back to the first lines."""
    return browse.outline(objects(spark, d), "peek", markdown=False)


def density_symbols(spark, d):
    """Outlines of code made from parts: definitions at several depths among other lines."""
    body = F.concat(F.lit("import x\n"), F.lit("def f"), F.col("p_partkey").cast("string"), F.lit("(a, b):\n    return a\n\nclass K"), F.col("p_size").cast("string"), F.lit("(B):\n    def m(self):  \n        pass\nfn rust(x)\nvalue = 3"))
    code = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("object_uri"), body.alias("content"))
    return browse.outline(code, "peek", markdown=False).withColumn("density", F.lit("peek")).unionByName(browse.outline(code, "skim", markdown=False).withColumn("density", F.lit("skim")))


def cat_meta(spark, d):
    path = F.col("object_uri")
    return objects(spark, d).select("object_uri", t.media_type(path).alias("media_type"), F.octet_length("content").cast("long").alias("size"), F.sha1("content").alias("fingerprint"), t.object_kind(path).alias("okind"))


def cat_locator_pk(spark, d):
    return browse.locate(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), '{"o_orderkey":37}', ["o_orderkey"], ["o_orderkey"])


def cat_locator_row(spark, d):
    return browse.locate(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), '{"_row":100}', ["o_orderkey"], ["o_orderkey"])


def cat_records_ranges(spark, d):
    """A page from the midst of a table: one pass over the key counts its ranges, the page reads two of them at most."""
    orders = RangePages(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey", "o_orderkey"], range_rows=1000)
    return orders.page(len(orders) // 2, len(orders) // 2 + 50)


def cat_records_page(spark, d):
    """Records 20 to 40 as JSON lines."""
    page = browse.page(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"], 20, 40)
    return page.select(F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("record"))


def cat_budget_guard(spark, d):
    """Which threads are too large to be read bare, for a budget of 1000 bytes."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("object_uri"), "text")
    return browse.budget_guard(turns, F.octet_length("text") + 1, 1000)


def export_partial(spark, d):
    """What an export capped at 150 records wrote, and that it is partial."""
    to = f"{shared_folder(spark)}/corvid-export/{uuid.uuid4().hex}"
    partial = browse.export(table(spark, d, "part").select("p_partkey", "p_name"), to, 150, ["p_partkey"])
    return spark.read.schema("p_partkey long, p_name string").json(to).agg(F.count("*").alias("rows"), F.sum("p_partkey").alias("keys")).withColumn("partial", F.lit(partial))


def engine_records(spark, d):
    """Records of a structured object by locator, by range and from the front."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    uri = "warehouse://tpch/customer/rows.jsonl"
    objects = spark.createDataFrame([("warehouse://tpch", uri, "", "indexed")], "connector_uri string, object_uri string, content string, search_status string")
    engine = Engine(["warehouse://tpch"], objects, objects, records={uri: (rows, ["c_custkey"], ["c_custkey"])})
    asked = {"locator": engine.cat(uri, locator='{"c_custkey":7,"chunk_index":0}'), "row": engine.cat(uri, locator='{"_row":3}'), "range": engine.cat(uri, lines="11:14"), "head": engine.head(uri, 2)}
    parts = [df.select(F.lit(name).alias("asked"), "content") for name, df in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def safe_names(spark, d):
    """Folders named after suppliers, with odd characters between the words."""
    name = F.concat(F.lit("#"), F.replace("s_name", F.lit("#"), F.lit(" é/")), F.when(F.col("s_suppkey") % 3 == 0, "!!").otherwise(""))
    return table(spark, d, "supplier").select("s_suppkey", t.safe_name(F.when(F.col("s_suppkey") % 5 > 0, name).otherwise("?"), F.col("s_suppkey")).alias("name"))


def line_of_offset(spark, d):
    return objects(spark, d).select("object_uri", t.line_of_offset(F.col("content"), F.length("content") / 2).cast("long").alias("line"))


def record_rows(spark, d):
    """The position of each order's record by date and key."""
    return browse.seen_records(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("_row").cast("long").alias("row"))


def web_url_to_path(spark, d):
    return table(spark, d, "pages").select("page_id", t.url_path(F.col("url")).alias("path"))


def web_links(spark, d):
    return page_objects(table(spark, d, "pages")).select("page_id", F.posexplode("links").alias("pos", "link"))


def web_crawl(spark, d):
    """The first 50 pages of a crawl in which page k links to pages 2k + 1 and 2k + 2 (the pages' own links lead nowhere)."""
    pages = table(spark, d, "pages").select("page_id", "url")
    parent = F.floor((F.col("page_id") - 1) / 2)
    below = pages.groupBy(parent.alias("parent")).agg(F.array_sort(F.collect_list(F.struct("page_id", "url")))["url"].alias("links"))
    linked = pages.join(below, F.col("page_id") == F.col("parent"), "left").select("url", F.coalesce("links", F.array().cast("array<string>")).alias("links"))
    seed = pages.where("page_id = 0").first()["url"]
    return crawl.crawl(linked, [seed], most=50)


def web_allowed(spark, d):
    return table(spark, d, "pages").select("page_id", t.allowed_domain(F.col("url"), ["example.com", "blog.tionble.example.com"]).alias("allowed"))


def html_to_text(spark, d):
    return page_objects(table(spark, d, "pages")).select("page_id", F.col("content").alias("text"))


QUERIES = {f.__name__: f for f in (ls_children, tree_depth2, cat_range, head_n, tail_n, density_peek, density_skim, density_code, density_symbols, cat_meta, cat_locator_pk, cat_locator_row, cat_records_ranges, cat_records_page, cat_budget_guard, export_partial, engine_records, safe_names, line_of_offset, record_rows, web_url_to_path, web_links, web_crawl, web_allowed, html_to_text)}

_L = LINES.format("text")
_MD = r"regexp_replace(regexp_replace(regexp_replace(html, '<h[1-6]>(.*?)</h[1-6]>', chr(10) || '# \1' || chr(10), 'gis'), '<br>|<p>|</p>', chr(10), 'gi'), '<[^>]*>', '', 'g')"
_PAGE_LINES = f"SELECT page_id, unnest({LINES.format('md')}) AS line, generate_subscripts({LINES.format('md')}, 1) AS n FROM (SELECT page_id, {_MD} AS md FROM pages)"
_PATH = r"regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1), '/+$', '')"
_CLEAN = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g')"
_TAGS = rf"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '(?i)<h([1-6])[^>]*>', chr(10) || '# ', 'g'), '(?i)<(p|br|li|div|tr|/h[1-6]|/p|/li)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
_ENT = f"replace(replace(replace(replace(replace(replace({_TAGS}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"

PAGE_TEXT = rf"trim(regexp_replace(regexp_replace({_ENT}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ')"
PAGE_URI = f"'web://crawl/pages/' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || CASE WHEN {_PATH} = '' THEN 'index' ELSE {_PATH} END || '.md'"

ORACLE = {
    "ls_children": f"""SELECT name, 'docs://corpus/en/' || name AS path, max(deeper) AS is_dir, count(*) AS n_objects FROM (SELECT split_part(rest, '/', 1) AS name, contains(rest, '/') AS deeper FROM
        (SELECT substring({DOC_URI}, length('docs://corpus/en/') + 1) AS rest FROM documents WHERE lang = 'en')) GROUP BY name""",
    "tree_depth2": "SELECT DISTINCT 'docs://corpus/' || lang AS path, 1 AS depth FROM documents UNION ALL SELECT DISTINCT 'docs://corpus/' || lang || '/' || source, 2 FROM documents",
    "cat_range": f"SELECT {DOC_URI} AS object_uri, coalesce(array_to_string({_L}[2:3], chr(10)), '') AS content FROM documents",
    "head_n": f"SELECT {DOC_URI} AS object_uri, array_to_string({_L}[1:3], chr(10)) AS content FROM documents",
    "tail_n": f"SELECT {DOC_URI} AS object_uri, array_to_string({_L}[-2:], chr(10)) AS content FROM documents",
    "density_peek": f"WITH l AS ({_PAGE_LINES}) SELECT CAST(page_id AS VARCHAR) AS object_uri, string_agg(rtrim(line, ' '), chr(10) ORDER BY n) AS content FROM l WHERE starts_with(ltrim(line, ' '), '#') GROUP BY page_id",
    "density_skim": f"""WITH l AS ({_PAGE_LINES}), nxt AS (SELECT *, first_value(CASE WHEN trim(line, ' ') <> '' THEN trim(line, ' ') END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS prose FROM l)
        SELECT CAST(page_id AS VARCHAR) AS object_uri, string_agg(rtrim(line, ' ') || coalesce(chr(10) || '    ' || substring(prose, 1, 120), ''), chr(10) ORDER BY n) AS content FROM nxt WHERE starts_with(ltrim(line, ' '), '#') GROUP BY page_id""",
    "density_code": f"SELECT {DOC_URI} AS object_uri, array_to_string(list_transform({_L}[1:15], lambda x: rtrim(x, ' ')), chr(10)) AS content FROM documents",
    "density_symbols": """SELECT CAST(p_partkey AS VARCHAR) AS object_uri, 'def f' || p_partkey || chr(10) || 'class K' || p_size || chr(10) || '    def m' || chr(10) || 'fn rust' AS content, 'peek' AS density FROM part
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'def f' || p_partkey || '(a, b):' || chr(10) || 'class K' || p_size || '(B):' || chr(10) || '    def m(self):' || chr(10) || 'fn rust(x)', 'skim' FROM part""",
    "cat_meta": f"SELECT {DOC_URI} AS object_uri, 'text/markdown' AS media_type, CAST(strlen(text) AS BIGINT) AS size, sha1(text) AS fingerprint, 'document' AS okind FROM documents",
    "cat_locator_pk": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE CAST(o_orderkey AS VARCHAR) = '37' ORDER BY o_orderkey LIMIT 1",
    "cat_locator_row": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 100",
    "cat_records_ranges": "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders ORDER BY o_custkey, o_orderkey LIMIT 50 OFFSET (SELECT count(*) // 2 FROM orders)",
    "cat_records_page": """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS record FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 20)""",
    "cat_budget_guard": "SELECT CAST(conv_id AS VARCHAR) AS object_uri, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, sum(strlen(text) + 1) <= 1000 AS allowed FROM conversations GROUP BY conv_id",
    "export_partial": "SELECT count(*) AS rows, CAST(sum(p_partkey) AS BIGINT) AS keys, (SELECT count(*) FROM part) > 150 AS partial FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 150)",
    "engine_records": """WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS n, c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS content FROM customer)
        SELECT 'locator' AS asked, content FROM c WHERE c_custkey = 7 UNION ALL SELECT 'row', content FROM c WHERE n = 3 UNION ALL SELECT 'range', content FROM c WHERE n BETWEEN 10 AND 12 UNION ALL SELECT 'head', content FROM c WHERE n < 2""",
    "safe_names": r"""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'unnamed' ELSE regexp_replace(replace(s_name, '#', ' é/'), '[^\p{L}\p{N}_.-]+', '-', 'g') END || '__' || s_suppkey AS name FROM supplier""",
    "line_of_offset": f"SELECT {DOC_URI} AS object_uri, CAST(length(left(text, CAST(floor(length(text) / 2) AS BIGINT))) - length(replace(left(text, CAST(floor(length(text) / 2) AS BIGINT)), chr(10), '')) + 1 AS BIGINT) AS line FROM documents",
    "record_rows": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row FROM orders",
    "web_url_to_path": f"SELECT page_id, '/pages/' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || CASE WHEN {_PATH} = '' THEN 'index' ELSE {_PATH} END || '.md' AS path FROM pages",
    "web_links": """WITH f AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda u: regexp_replace(u, '#.*$', '')), lambda u: u <> '') AS a FROM pages),
        e AS (SELECT page_id, unnest(a) AS link, generate_subscripts(a, 1) AS i FROM f), g AS (SELECT page_id, link, min(i) AS i FROM e GROUP BY ALL)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, link FROM g""",
    "web_crawl": "SELECT url, CAST(floor(log2(page_id + 1)) AS INTEGER) AS depth, CAST(page_id AS INTEGER) AS nth FROM pages WHERE page_id < 50",
    "web_allowed": "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), ':[0-9]+$', '') IN ('example.com', 'blog.tionble.example.com') AS allowed FROM pages",
    "html_to_text": f"SELECT page_id, {PAGE_TEXT} AS text FROM pages",
}
