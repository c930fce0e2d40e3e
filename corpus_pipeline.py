"""From raw documents to packed training sequences: language ID, quality, near-duplicates, repeated lines, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage works
on all that its predecessor kept. Rows with null or empty texts, repeated rows and empty tables pass through as the operators'
docstrings define; columns beyond those of documents are carried along whatever their names, and texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import langid, linededup, minhash, packing, quality
from corvid.llm.common import among, not_among, remove, shared_dir, written
from corvid.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages; those without a letter go, and those of which the machines are too unsure."""
    model = langid.train(docs, langid.fold(F.col("doc_id"), 3) != 1)
    return langid.identify(docs, model).where(langid.accepted()).select("record.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; labels of a fifth of all documents are never learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(langid.fold(F.col("doc_id"), 5) != 0)
    return quality.score(docs, quality.train(docs, labels)).where("score >= 0.3").select("record.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Ids may repeat or be null, so the graph's nodes are row numbers. In a group a null id ranks last, and rows of one id are
    ranked by their text.
    """
    work = shared_dir(spark)
    # row numbers are in a written table, so they never change
    rows = written(docs.select(F.struct(*docs.columns).alias("record"), F.monotonically_increasing_id().alias("row")), f"{work}/rows")
    found = minhash.near_duplicates(rows.select("row", F.col("record")["text"].alias("text")), words=5, percent=80, id_col="row")
    linked = written(found.where("not kept").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), f"{work}/linked")
    members = written(linked.union(linked.select(F.col("component").alias("row"), "component").distinct()), f"{work}/members")
    doc = F.col("record")["doc_id"]
    place = F.struct(doc.isNull().alias("last"), doc.alias("doc"), F.xxhash64(F.col("record")["text"]).alias("tie"), "row")
    first = among(rows.select("row", place.alias("place")), "row", members).join(members, "row").groupBy("component").agg(F.min("place").alias("place"))
    gone = written(members.select("row").join(first.select(F.col("place")["row"].alias("row")), "row", "left_anti"), f"{work}/gone")
    return not_among(rows, "row", gone).select("record.*")


def repeated_line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of each repeated line the earliest stays."""
    cleaned = linededup.remove_repeats(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return cleaned.select(*(new.get(c, F.col("record")[c]).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("language_id", language_stage), ("quality", quality_stage), ("near_dedup", near_duplicate_stage), ("line_dedup", repeated_line_stage), ("packing", packing_stage)]

#: The stages are learnt models, similarity joins and an optimiser: not SQL. tests/llm/test_pipeline.py holds them to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    work = shared_dir(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{work}/{name}")
        if before:
            remove(spark, f"{work}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
