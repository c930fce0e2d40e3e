"""Literal and regular-expression search in lines and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid import model
from corvid.functions import text as t


def line_hits(objects: DataFrame, pattern: str, regex: bool = False, limit: int | None = model.GREP_HITS, per_object: int | None = None, via: str = "pushdown", text_col: str = "content") -> DataFrame:
    """(source, locator, content, via): lines that match, in order of object and line; a text without the pattern isn't split."""
    text = F.col(text_col)
    holds = text.rlike(pattern) if regex and not pattern.startswith("^") and not pattern.endswith("$") else F.lit(True) if regex else text.contains(pattern)
    found = objects.where(holds).select(F.col("object_uri").alias("source"), F.posexplode(t.lines(text)).alias("pos", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))
    found = found.where(F.col("line").rlike(pattern) if regex else F.col("line").contains(pattern))
    if per_object:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("pos"))).where(F.col("_n") <= per_object)
    number = F.col("pos") + 1
    out = found.select("source", t.lines_locator(number, number + 1).alias("locator"), F.col("line").alias("content"), F.lit(via).alias("via"), number.alias("line_no"))
    return out.orderBy("source", "line_no").limit(limit) if limit else out


def column_hits(rows: DataFrame, fields: list[str], pattern: str, order: list[str], limit: int = model.GREP_HITS) -> DataFrame:
    """Rows where any text field holds the pattern, ignoring case."""
    holds = reduce(Column.__or__, [F.lower(F.col(f).cast("string")).contains(pattern.lower()) for f in fields])
    return rows.where(holds).orderBy(*order).limit(limit)


def linear(objects: DataFrame, pattern: str, most: int = model.GREP_OBJECTS) -> DataFrame:
    """Objects that aren't indexed, scanned up to a number; a notice row tells of any that were left out."""
    ordered = objects.where("search_status = 'not_indexed'").orderBy("object_uri")
    hits = line_hits(ordered.limit(most), pattern, limit=None, per_object=model.GREP_HITS_PER_OBJECT, via="linear").drop("line_no")
    left = ordered.agg(F.count("*").alias("n")).where(F.col("n") > most)
    notice = left.select(F.lit("").alias("source"), F.lit(None).cast("string").alias("locator"), F.concat((F.col("n") - most).cast("string"), F.lit(" objects not scanned")).alias("content"), F.lit("notice").alias("via"))
    return hits.unionByName(notice)
