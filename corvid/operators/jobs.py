"""The control plane: tasks, jobs, status, estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid import model
from corvid.functions import text as t

ACTIVE = ("preparing", "queued", "running")


def claim(tasks: DataFrame, n: int = 64) -> DataFrame:
    return tasks.where("status = 'pending'").orderBy("priority", "started_at", "id").limit(n)


def oldest_queued(jobs: DataFrame, n: int = model.QUEUED_JOBS) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy("queued_at", "id").limit(n)


def requeued(tasks: DataFrame, lost: DataFrame) -> DataFrame:
    """Running tasks of jobs whose worker is lost (job_id) are pending again, as if never started."""
    gone = lost.select("job_id", F.lit(True).alias("_lost")).distinct()
    back = F.col("_lost").isNotNull() & (F.col("status") == "running")
    return tasks.join(gone, "job_id", "left").withColumn("status", F.when(back, "pending").otherwise(F.col("status"))).select(*tasks.columns)


def retried(tasks: DataFrame, most: int = 3) -> DataFrame:
    """(*, next, wait): what becomes of each failed task (id, job_id, status, attempts, error). Failed authentication or a spent
    quota aborts, and so its job; others wait longer from try to try, up to a number of attempts."""
    kind = t.error_class(F.coalesce("error", F.lit("")))
    again = (kind == "retryable") & (F.col("attempts") < most)
    failed = F.col("status") == "failed"
    then = F.when(failed & (kind != "retryable"), "abort").when(failed & again, "pending").when(failed, "failed")
    return tasks.withColumn("next", then).withColumn("wait", F.when(F.col("next") == "pending", t.backoff(F.col("attempts").cast("double"))))


def illegal_moves(moves: DataFrame, legal: list[tuple[str, str]] = model.TASK_MOVES) -> DataFrame:
    """Rows of (id, before, after) that no legal move covers."""
    table = moves.sparkSession.createDataFrame(legal, "before string, after string")
    return moves.join(F.broadcast(table), ["before", "after"], "left_anti")


def finalized(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """(job_id, result, total, succeeded, failed, cancelled): cancelled beats aborted beats any failed task."""
    count = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    counts = tasks.groupBy("job_id").agg(F.count("*").alias("total"), count("succeeded"), count("failed"), count("cancelled"))
    joined = jobs.select("job_id", F.col("status").alias("job_status"), "aborted").join(counts, "job_id", "left").fillna(0, ["total", "succeeded", "failed", "cancelled"])
    result = F.when(F.col("job_status") == "cancelled", "cancelled").when(F.col("aborted").isNotNull(), "failed").when(F.col("failed") > 0, "partial").otherwise("succeeded")
    return joined.select("job_id", result.alias("result"), "total", "succeeded", "failed", "cancelled")


def double_active(jobs: DataFrame) -> DataFrame:
    """Connectors with more than one active job; there must be none."""
    return jobs.where(F.col("status").isin(*ACTIVE)).groupBy("connector_id").count().where("count > 1")


def stale(jobs: DataFrame, now, seconds: int = 120) -> DataFrame:
    return jobs.where((F.col("status") == "running") & (F.col("heartbeat") < now - F.expr(f"interval {seconds} seconds")))


def tripped(outcomes: DataFrame, key: str, order: str, failed: str, limit: int = 5) -> DataFrame:
    """(key, at, run): where a run of consecutive failures first reaches the limit. Runs are islands between successes."""
    w = Window.partitionBy(key).orderBy(order)
    island = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = outcomes.select(key, order, failed, island.alias("island")).where(F.col(failed))
    nth = F.row_number().over(Window.partitionBy(key, "island").orderBy(order))
    return marked.withColumn("run", nth).where(F.col("run") == limit).groupBy(key).agg(F.min(order).alias("at"), F.lit(limit).alias("run"))


def status(connectors: DataFrame, objects: DataFrame) -> DataFrame:
    """(connector_uri, objects, chunks, indexed) of every connector."""
    joined = connectors.select("connector_uri").join(objects, "connector_uri", "left").groupBy("connector_uri")
    return joined.agg(F.count("object_uri").alias("objects"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.sum(F.when(F.col("search_status") == "indexed", 1).otherwise(0)).alias("indexed"))


def estimate(objects: DataFrame, sample: int = 3) -> DataFrame:
    """(objects, chunks, tokens) extrapolated from the first few objects."""
    first = objects.orderBy("object_uri").limit(sample).agg(F.avg("chunks").alias("c"), F.avg("tokens").alias("k"))
    total = objects.agg(F.count("*").alias("objects"))
    return total.join(F.broadcast(first)).select("objects", F.round(F.col("c") * F.col("objects"), 6).alias("chunks"), F.round(F.col("k") * F.col("objects"), 6).alias("tokens"))  # one row each
