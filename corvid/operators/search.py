"""Ranked retrieval over a chunk table: BM25, dense cosine, hybrid fusion, scoping, collapsing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid import model
from corvid.functions import text as t

K1, B, RRF_K = 1.2, 0.75, 60


def check_request(query: str, top_k: int) -> bool:
    """False for what finds nothing by definition; raises for what isn't allowed."""
    if len(query) > model.QUERY_CHARS:
        raise model.EngineError("query_too_long", f"a query has at most {model.QUERY_CHARS} characters")
    if top_k * model.OVERFETCH > model.RESULT_WINDOW:
        raise model.EngineError("top_k_too_large", f"top_k is at most {model.RESULT_WINDOW // model.OVERFETCH}")
    return top_k > 0 and bool(query.strip())


def check_kinds(kinds: list[str]) -> list[str]:
    if unknown := sorted(set(kinds) - set(model.CHUNK_KINDS)):
        raise model.EngineError("unknown_chunk_kind", ", ".join(unknown), model.CHUNK_KINDS)
    return kinds


def in_scope(connector: str | None = None, prefix: str | None = None, kinds: list[str] | None = None) -> Column:
    """A path prefix holds the path itself and what is below it; /src doesn't hold /src-old."""
    where = F.lit(True)
    if connector:
        where = where & (F.col("connector_uri") == connector)
    if prefix:
        base = prefix.rstrip("/")
        where = where & ((F.col("object_uri") == base) | F.col("object_uri").startswith(base + "/"))
    if kinds:
        where = where & F.col("chunk_kind").isin(check_kinds(kinds))
    return where


def bm25(chunks: DataFrame, query: str, where: Column | None = None, top_k: int = 10, extra: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, object_uri, *extra, score): top_k chunks of where by BM25 with statistics of all chunks.

    One pass turns each chunk into its length and its counts of the query's few terms; statistics are one aggregated row,
    so nothing is shuffled but that row and the top k of each task.
    """
    terms = sorted({w for w in _tokens(query)})
    counted = chunks.select("chunk_id", "object_uri", "connector_uri", "chunk_kind", *extra, t.tokens(F.col("content")).alias("words"))
    counts = [occurrences(F.col("words"), x).alias(f"tf{i}") for i, x in enumerate(terms)]
    counted = counted.select("*", F.size("words").alias("len"), *counts).drop("words")
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))])
    hit = F.greatest(F.lit(0), *[F.col(f"tf{i}") for i in range(len(terms))]) > 0
    scored = counted.where(hit if where is None else hit & where).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    out = scored.select("chunk_id", "object_uri", *extra, F.round(score, 6).alias("score"))
    return out.orderBy(F.desc("score"), "chunk_id").limit(top_k)


def occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def _tokens(query: str) -> list[str]:
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if w]


def dense(vectors: DataFrame, query: list[float], top_k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, *extra): exact cosine. A vector of another length than the query's raises; null ones are left out."""
    norm = math.sqrt(sum(x * x for x in query))
    q = F.array(*map(F.lit, query))
    v = F.transform(vector_col, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    other = F.raise_error(F.concat(F.lit(f"dimension_mismatch: the query has {len(query)} dimensions, a vector has "), F.size(vector_col).cast("string")))
    score = F.when(F.size(vector_col) == len(query), F.round(dot / (own * norm), 6)).otherwise(other)
    return vectors.where(F.col(vector_col).isNotNull()).select(id_col, score.alias("score"), *extra).orderBy(F.desc("score"), id_col).limit(top_k)


def wrong_dimensions(asked: int, held: int) -> None:
    raise model.EngineError("dimension_mismatch", f"the query has {asked} dimensions, a vector has {held}")


def fuse(legs: list[DataFrame], key: str, top_k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (key, score), each bounded by its own top k."""
    ranked = []
    for leg in legs:
        rank = F.row_number().over(Window.orderBy(F.desc("score"), key))  # a leg has top_k * OVERFETCH rows at most
        ranked.append(leg.select(key, (1.0 / (RRF_K + rank)).alias("part")))
    every = ranked[0]
    for r in ranked[1:]:
        every = every.unionByName(r)
    return every.groupBy(key).agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").cast("int").alias("legs")).orderBy(F.desc("score"), key).limit(top_k)


def collapse(hits: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The best hit of each key; after the top k, so there may be fewer."""
    return hits.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def envelope(hits: DataFrame, content: Column, kind: Column, locator: Column, fields: Column | None = None) -> DataFrame:
    """(source, content, score, locator, metadata) of ranked hits; fields: the metadata of the hit's record, as JSON."""
    own = F.coalesce(fields, F.lit("{}")) if fields is not None else F.lit("{}")
    meta = F.concat(F.lit('{"chunk_kind":'), t.json_text(kind), F.lit(',"fields":'), own, F.lit(',"kind":"search"}'))
    return hits.select(F.col("object_uri").alias("source"), content.alias("content"), "score", locator.alias("locator"), meta.alias("metadata"))


def connector_of(paths: DataFrame, connectors: DataFrame) -> DataFrame:
    """(path, root, object_prefix): the connector with the longest root that holds the path. Connectors are few: all folders
    above a path are looked up, so it is an equality join."""
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = paths.select("path", F.explode(heads).alias("root")).join(connectors.select("root"), "root")
    best = found.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return best.select("path", "root", F.when(F.col("path") != F.col("root"), F.col("path")).alias("object_prefix"))
