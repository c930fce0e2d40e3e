"""The tables of a data folder as objects with uris, and records as chunks' sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import text as t
from corvid.operators import chunk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_uri(df: DataFrame) -> DataFrame:
    """Adds connector_uri and object_uri to documents: docs://corpus/<lang>/<source>/<doc_id>.md"""
    path = F.concat_ws("/", F.lit("docs://corpus"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return df.withColumns({"connector_uri": F.lit("docs://corpus"), "object_uri": path})


def document_chunks(df: DataFrame) -> DataFrame:
    """The documents' chunks of at most 2048 characters, whole texts, in the chunk table's columns and doc_id."""
    return chunk.located_chunks(document_uri(df).withColumnRenamed("text", "content"), ("doc_id",))


def page_objects(df: DataFrame) -> DataFrame:
    """Crawled pages under web://crawl."""
    return df.select("page_id", "url", F.concat(F.lit("web://crawl"), t.url_path(F.col("url"))).alias("object_uri"), t.html_to_text(F.col("html")).alias("content"), t.links(F.col("html")).alias("links"))
