"""The engine's calls in one place: search, grep, browse and manage, over tables of objects and chunks.

Every call returns a lazy DataFrame, or raises an EngineError with a stable code.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid import model
from corvid.functions import text as t
from corvid.operators import browse, grep, index, jobs, search
from corvid.operators.postings import Postings
from corvid.operators.vectors import VectorIndex

MODES = ("hybrid", "semantic", "keyword")
#: Keys of a locator that tell the parts of one object or record apart.
PART_KEYS = ("lines", "chunk_index", "msg_range")


def json_lines(path: str, records: DataFrame, by: list[str]) -> DataFrame:
    """(object_uri, content): one JSON line for each record, in order."""
    return records.orderBy(*by).select(F.lit(path).alias("object_uri"), F.to_json(F.struct(*records.columns)).alias("content"))


def whole_locator(locator: Column) -> Column:
    """A locator without what tells the parts of one record apart."""
    entries = F.from_json(locator, "map<string,string>")
    return F.coalesce(F.to_json(F.map_filter(entries, lambda k, v: ~k.isin(*PART_KEYS))), F.lit("{}"))


#: Records of a structured object, the fields that locate one, and a total order.
Records = tuple[DataFrame, list[str], list[str]]


class Engine:
    """objects: (connector_uri, object_uri, content, search_status); chunks: (chunk_id, connector_uri, object_uri, locator,
    content, chunk_kind and, for other modes than keyword, dense_vec). connectors: the roots of all registered sources.
    records: objects that are tables, by uri: (their records, the fields that locate one, a total order). postings: the inverted
    index of chunks; without one, keyword search reads all chunks. table: the chunks' table by object, where hits are looked up;
    without it they are looked up in chunks. vectors: the vector index; without one, all vectors are compared. An index or table may hold connectors that aren't listed: they aren't found."""

    def __init__(self, connectors: list[str], objects: DataFrame, chunks: DataFrame, embedder: Callable[[Column], Column] = index.hash_embedding, records: Mapping[str, Records] | None = None, postings: Postings | None = None, table: index.Snapshots | None = None, vectors: VectorIndex | None = None):
        self.connectors, self.objects, self.chunks, self.embedder = sorted(connectors, key=len, reverse=True), objects, chunks, embedder
        self.records, self.postings, self.table, self.vectors = records or {}, postings, table, vectors

    def scope(self, path: str | None) -> tuple[str | None, str | None]:
        """(connector, object prefix): the longest root that holds the path."""
        if path is None:
            return None, None
        base = path.rstrip("/")
        root = next((c for c in self.connectors if base == c or base.startswith(c + "/")), None)
        if root is None:
            raise model.EngineError("not_found", f"no connector holds {path}", tuple(self.connectors))
        return root, (base if base != root else None)

    def _within(self, path: str | None, kinds: list[str] | None = None) -> Column:
        inside = search.in_scope(*self.scope(path), kinds)
        return inside if path is not None else inside & F.col("connector_uri").isin(self.connectors)

    def _inside(self, path: str) -> DataFrame:
        """The objects at or below a path; none is an error."""
        found = self.objects.where(self._within(path))
        if not found.limit(1).count():
            raise model.EngineError("not_found", path)
        return found

    # search

    def search(self, query: str, path: str | None = None, mode: str = "hybrid", top_k: int = 10, kinds: list[str] | None = None, collapse: bool = False) -> DataFrame:
        """(source, content, score, locator, metadata), best first. collapse keeps the best part of each object or record, so
        there may be fewer than top_k."""
        if mode not in MODES:
            raise model.EngineError("unknown_mode", mode, MODES)
        where = self._within(path, kinds)
        asked = search.check_request(query, top_k)
        extra = ("content", "chunk_kind", "locator", *(["metadata"] if "metadata" in self.chunks.columns else []))
        if not asked:
            hits = self.chunks.select("chunk_id", "object_uri", *extra, F.lit(0.0).alias("score")).limit(0)
        elif mode == "keyword" and self.postings is None:
            hits = search.bm25(self.chunks, query, where, top_k, extra)
        elif mode == "keyword":
            hits = self._fetched(self._ranked(query, where, top_k), extra)
        else:
            vector = [float(x) for x in self.chunks.sparkSession.range(1).select(self.embedder(F.lit(query))).first()[0]]
            most = top_k * (model.OVERFETCH if mode == "hybrid" else 1)
            exact = lambda: search.dense(self.chunks.where(where), vector, most, "chunk_id", "dense_vec", ("object_uri",))
            hits = self.vectors.top(vector, most, where) if self.vectors is not None else exact()
            if mode == "hybrid":
                legs = [self._ranked(query, where, most), hits.select("chunk_id", "object_uri", "score")]
                places = legs[0].unionByName(legs[1]).select("chunk_id", "object_uri").distinct()
                hits = search.fuse(legs, "chunk_id", top_k).join(places, "chunk_id").select("chunk_id", "object_uri", "score")
            hits = self._fetched(hits, extra)
        if collapse:
            hits = search.collapse(hits.withColumn("_whole", whole_locator(F.col("locator"))), ["object_uri", "_whole"], [F.desc("score"), F.col("chunk_id")])
        return search.envelope(hits.orderBy(F.desc("score"), "chunk_id"), F.col("content"), F.col("chunk_kind"), F.col("locator"), F.col("metadata") if "metadata" in extra else None)

    def _ranked(self, query: str, where: Column, top_k: int) -> DataFrame:
        found = self.postings.bm25(query, where, top_k) if self.postings else search.bm25(self.chunks, query, where, top_k)
        return found.select("chunk_id", "object_uri", "score")

    def _fetched(self, ranked: DataFrame, extra: tuple[str, ...]) -> DataFrame:
        """Ranked hits (chunk_id, object_uri, score) with the chunks' columns; only the buckets of their objects are read."""
        if self.table is None:
            return self.chunks.select("chunk_id", "object_uri", *extra).join(F.broadcast(ranked.select("chunk_id", "score")), "chunk_id")  # top_k rows
        found = ranked.collect()  # top_k rows
        rows = self.table.of(sorted({r["object_uri"] for r in found})).select("chunk_id", "object_uri", *extra)
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(r["chunk_id"], r["score"]) for r in found], "chunk_id string, score double")), "chunk_id")

    def grep(self, pattern: str, path: str, pushdown: bool = False) -> DataFrame:
        """(source, locator, content, via). A source that searches itself answers alone, even with nothing; else BM25 hits and
        lines of what isn't indexed come together."""
        inside = self._inside(path)
        if pushdown:
            return grep.line_hits(inside, pattern).select("source", "locator", "content", "via")
        lines = grep.linear(inside, pattern)
        if not search.check_request(pattern, model.GREP_HITS):
            return lines
        if self.postings is None:
            ranked = search.bm25(self.chunks, pattern, self._within(path), model.GREP_HITS, ("locator", "content"))
        else:
            ranked = self._fetched(self._ranked(pattern, self._within(path), model.GREP_HITS), ("locator", "content")).orderBy(F.desc("score"), "chunk_id")
        return ranked.select(F.col("object_uri").alias("source"), "locator", "content", F.lit("bm25").alias("via")).unionByName(lines)

    # browse

    def ls(self, path: str) -> DataFrame:
        """Children with their search status and whether they can be searched at all; folders have no status."""
        found = browse.children(self._inside(path), path)
        indexable = F.when(~F.col("is_dir"), t.producer_of(t.object_kind(F.col("path"))).isNotNull())
        return found.join(self.objects.select(F.col("object_uri").alias("path"), "search_status"), "path", "left").select("name", "path", "is_dir", "n_objects", "search_status", indexable.alias("indexable"))

    def tree(self, path: str, levels: int = 2) -> DataFrame:
        return browse.tree(self._inside(path), path, levels)

    def _one(self, path: str) -> DataFrame:
        self.scope(path)
        found = self.objects.where(F.col("object_uri") == path)
        if not found.limit(1).count():
            raise model.EngineError("not_found", path)
        return found

    def cat(self, path: str, lines: str | None = None, density: str | None = None, meta: bool = False, locator: str | None = None) -> DataFrame:
        """An object whole, a range of its lines or records, the part that a locator names, its outline, or what is known of it.

        Records come as one JSON line each, in their order.
        """
        one = self._one(path)
        structured = path in self.records
        if meta:
            uri = F.col("object_uri")
            return one.select("object_uri", t.media_type(uri).alias("media_type"), F.octet_length("content").cast("long").alias("size"), F.sha1("content").alias("fingerprint"))
        if locator is not None:
            return self._located(path, one, locator)
        if lines and structured:
            rows, _, by = self.records[path]
            begin, end = browse.parse_range(lines)
            paged = getattr(self.records, "page", None)
            return json_lines(path, paged(path, begin - 1, end - 1) if paged else browse.page(rows, by, begin - 1, end - 1), by)
        if lines:
            if one.select(t.object_kind(F.col("object_uri"))).first()[0] in ("image", "binary"):
                raise model.EngineError("range_unsupported", path)
            return browse.cat_range(one, lines)
        if structured:
            rows, _, by = self.records[path]
            size = rows.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))) + 1), F.lit(0))).first()[0]
            if size > model.BARE_READ_BYTES:
                raise model.EngineError("object_too_large_for_cat", path, ("lines", "head", "export"))
            return json_lines(path, rows, by)
        if density:
            ext = model.MARKDOWN_EXT
            return browse.outline(one, density, markdown=any(path.lower().endswith(e) for e in ext if e) or "." not in path.rsplit("/", 1)[-1])
        if one.where(F.octet_length("content") > model.BARE_READ_BYTES).limit(1).count():
            raise model.EngineError("object_too_large_for_cat", path, ("lines", "head", "export"))
        return one.select("object_uri", "content")

    def _located(self, path: str, one: DataFrame, locator: str) -> DataFrame:
        """The lines, or the record, that a locator names."""
        wanted = json.loads(locator)
        if "lines" in wanted:
            begin, end = wanted["lines"]
            return browse.cat_range(one, f"{begin}:{end}")
        if path not in self.records:
            raise model.EngineError("locator_not_found", locator)
        rows, fields, by = self.records[path]
        found = browse.locate(rows, json.dumps({k: v for k, v in wanted.items() if k not in PART_KEYS}), fields, by)
        if not found.limit(1).count():
            raise model.EngineError("locator_not_found", locator)
        return json_lines(path, found, by)

    def head(self, path: str, n: int = 10) -> DataFrame:
        one = self._one(path)
        return self.cat(path, lines=f"1:{n + 1}") if path in self.records else browse.head(one, n)

    def tail(self, path: str, n: int = 10) -> DataFrame:
        one = self._one(path)
        if path in self.records:
            raise model.EngineError("tail_unsupported", path, ("lines",))
        return browse.tail(one, n)

    def export(self, path: str, to: str, limit: int | None = None) -> bool:
        """Writes an object to a folder; true if a limit on its lines or records cut it."""
        one = self._one(path)
        if path in self.records:
            rows, _, by = self.records[path]
            return browse.export(rows, to, limit, by)
        lines = browse.numbered(one)
        return browse.export(lines.select("line_no", "line"), to, limit, ["line_no"]) if limit else browse.export(one.select("content"), to)

    # manage

    def probe(self, path: str) -> DataFrame:
        """One object's name and status: whether a source can be read at all."""
        return self.objects.where(self._within(path)).select("object_uri", "search_status").limit(1)

    def status(self) -> DataFrame:
        """Objects, chunks and indexed objects of every connector, empty ones too."""
        roots = self.objects.sparkSession.createDataFrame([(c,) for c in sorted(self.connectors)], "connector_uri string")
        counts = self.chunks.groupBy("object_uri").agg(F.count("*").alias("chunk_count"))
        return jobs.status(roots, self.objects.select("connector_uri", "object_uri", "search_status").join(counts, "object_uri", "left"))

    def estimate(self, path: str, sample: int = 3) -> DataFrame:
        """Chunks and tokens of all objects of a path, extrapolated from the first few."""
        sized = self.objects.where(self._within(path)).select("object_uri", F.ceil(F.length("content") / model.CHUNK_SIZE).alias("chunks"), t.token_estimate(F.col("content")).alias("tokens"))
        return jobs.estimate(sized, sample)

    def inspect(self, path: str) -> DataFrame:
        return self.objects.where(self._within(path)).groupBy("connector_uri", "search_status").agg(F.count("*").alias("objects"))

    def remove(self, connector: str) -> Engine:
        """The engine without a connector, its objects and its chunks."""
        if connector not in self.connectors:
            raise model.EngineError("not_found", connector, tuple(self.connectors))
        other = F.col("connector_uri") != connector
        return Engine([c for c in self.connectors if c != connector], self.objects.where(other), self.chunks.where(other), self.embedder, self.records, self.postings, self.table, self.vectors)
