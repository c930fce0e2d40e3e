"""Positions and running sums over a whole table in a total order, without passing it through one task.

Rows are dealt by ranges of the key and counted within each range; the ranges' totals, one row for each task, give what comes
before. The dealt rows are checkpointed, so that both passes see the same ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.session import shared_folder


def _dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    shared_folder(rows.sparkSession)
    return rows.repartitionByRange(*key).withColumn("_part", F.spark_partition_id()).checkpoint()


def _earlier(totals: DataFrame) -> DataFrame:
    """(_part, _before) of (_part, n)."""
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each task
    return F.broadcast(totals.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))


def positions(rows: DataFrame, key: list[str], name: str = "_row") -> DataFrame:
    """Adds each row's position in the order of key, from 0."""
    dealt = _dealt(rows, key)
    before = _earlier(dealt.groupBy("_part").agg(F.count("*").alias("n")))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*key)) - 1
    return dealt.withColumn("_own", own).join(before, "_part").select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))


def sums_before(rows: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of value over all rows that come earlier in the order of key."""
    dealt = _dealt(rows, key)
    before = _earlier(dealt.groupBy("_part").agg(F.sum(value).alias("n")))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(before, "_part").select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))
