"""The documents' chunk table and inverted index, built once for each session and data folder: what searches read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvid.operators.postings import Postings
from corvid.session import shared_folder
from corvid.sources.tables import document_chunks, table

_BUILT: dict[tuple[str, str], str] = {}


def build(spark: SparkSession, d: str, root: str) -> tuple[DataFrame, Postings]:
    """Writes the chunks of all documents, and their postings, below root."""
    document_chunks(table(spark, d, "documents")).write.mode("overwrite").parquet(f"{root}/chunks")
    chunks, postings = spark.read.parquet(f"{root}/chunks"), Postings(spark, f"{root}/postings")
    postings.add(chunks)
    return chunks, postings


def stored(spark: SparkSession, d: str) -> tuple[DataFrame, Postings]:
    """(chunks, postings) of a data folder; built anew where they aren't there (any more)."""
    key = (spark.sparkContext.applicationId, d)
    root = _BUILT.get(key)
    if root and Postings(spark, f"{root}/postings").segments():
        return spark.read.parquet(f"{root}/chunks"), Postings(spark, f"{root}/postings")
    root = f"{shared_folder(spark)}/corvid-index/{uuid.uuid4().hex}"
    made = build(spark, d, root)
    _BUILT[key] = root
    return made
