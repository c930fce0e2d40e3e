"""Control plane queries with their DuckDB counterparts. Orders play the tasks, customers the jobs, nations the connectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.catalog import Control
from corvid.functions import text as t
from corvid.model import JOB_MOVES, TASK_MOVES
from corvid.operators import jobs
from corvid.sources.tables import document_uri, table

_STATES = "pending running succeeded failed cancelled".split()


def tasks(spark, d):
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), state.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("started_at"))


def task_claim_order(spark, d):
    return jobs.claim(tasks(spark, d)).select("id", "priority")


def jobs_newest(spark, d):
    return tasks(spark, d).orderBy(F.desc("started_at"), "id").limit(20).select("id", "status")


def task_status_counts(spark, d):
    return tasks(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def job_finalize(spark, d):
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_mktsegment") == "BUILDING", "cancelled").otherwise("running").alias("status"), F.when(F.col("c_acctbal") < 0, "quota").alias("aborted"))
    return jobs.finalized(own, tasks(spark, d))


def illegal_transitions(spark, d):
    """Each pair of states that follow each other in a customer's tasks, if no legal move leads from one to the other."""
    w = jobs.Window.partitionBy("job_id").orderBy("started_at", "id")
    moves = tasks(spark, d).select("id", F.lag("status").over(w).alias("before"), F.col("status").alias("after")).where("before is not null")
    return jobs.illegal_moves(moves).groupBy("before", "after").agg(F.count("*").alias("n"))


_JOB_STATES = sorted({x for m in JOB_MOVES for x in m})


def job_moves(spark, d):
    """The states that follow each other in a customer's orders, taken as jobs."""
    state = F.element_at(F.array(*map(F.lit, _JOB_STATES)), (F.pmod(F.col("o_orderkey"), F.lit(len(_JOB_STATES))) + 1).cast("int"))
    w = jobs.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", state.alias("after")).withColumn("before", F.lag("after").over(w)).where("before is not null").select("before", "after")


def illegal_job_moves(spark, d):
    """Each pair of job states that follow each other, if no legal move leads from one to the other."""
    return jobs.illegal_moves(job_moves(spark, d), JOB_MOVES).groupBy("before", "after").agg(F.count("*").alias("n"))


def breaker_trip(spark, d):
    """Customers with three failed orders in a row (status F), and where."""
    outcomes = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("failed"))
    return jobs.tripped(outcomes, "o_custkey", "o_orderkey", "failed", 3)


def double_active(spark, d):
    return jobs.double_active(tasks(spark, d).select(F.col("job_id").alias("connector_id"), "status")).select("connector_id", F.col("count").alias("n"))


def stale_jobs(spark, d):
    """Running tasks without a heartbeat for two minutes, at the end of 1996."""
    rows = tasks(spark, d).withColumnRenamed("started_at", "heartbeat")
    return jobs.stale(rows, F.lit("1996-12-31 00:00:00").cast("timestamp_ntz")).select("id")


def _indexed(spark, d):
    docs = document_uri(table(spark, d, "documents"))
    chunks = F.ceil(F.length("text") / 2048).cast("long")
    return docs.select(F.concat_ws("/", F.lit("docs:/"), "lang").alias("connector_uri"), "object_uri", chunks.alias("chunk_count"), F.when(F.length("text") < 100, "not_indexed").otherwise("indexed").alias("search_status"), t.token_estimate(F.col("text")).alias("tokens"))


def status_summary(spark, d):
    """Connectors without objects show zeros."""
    names = spark.createDataFrame([(f"docs://{x}",) for x in ("de", "en", "es", "fr", "it")], "connector_uri string")
    return jobs.status(names, _indexed(spark, d))


def inspect_summary(spark, d):
    return _indexed(spark, d).groupBy("connector_uri", "search_status").agg(F.count("*").alias("objects"), F.sum("chunk_count").alias("chunks"))


def estimate_extrapolate(spark, d):
    return jobs.estimate(_indexed(spark, d).select("object_uri", F.col("chunk_count").alias("chunks"), "tokens"))


def error_classes(spark, d):
    messages = F.array(*map(F.lit, ["HTTP 401 Unauthorized", "insufficient_quota", "timeout", "429 slow down", "Permission denied", "402"]))
    return table(spark, d, "part").select("p_partkey", t.error_class(F.element_at(messages, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("kind"), t.backoff((F.col("p_partkey") % 10).cast("double")).alias("wait"))


def time_bounds(spark, d):
    values = F.array(*map(F.lit, ["1700000000", "now-2w", "2024-05-01", "2024-05-01 12:30:00", "soon", "now-30d"]))
    return table(spark, d, "part").select("p_partkey", t.time_bound(F.element_at(values, (F.col("p_partkey") % 6 + 1).cast("int")), F.lit(1_800_000_000.0)).alias("since"))


def _jobs(spark, d):
    """Customers as jobs: every third is queued, every third running."""
    status = F.element_at(F.array(*map(F.lit, ["queued", "running", "succeeded"])), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), status.alias("status"), (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 7).alias("queued_at"))


def oldest_queued(spark, d):
    return jobs.oldest_queued(_jobs(spark, d)).select("id", "queued_at")


def job_cancel(spark, d):
    """Tasks by status after job 4 was cancelled."""
    after = Control(_jobs(spark, d), tasks(spark, d)).cancel(4)
    return after.tasks.where("job_id = 4").groupBy("status").agg(F.count("*").alias("n")).unionByName(after.jobs.where("id = 4").select(F.concat(F.lit("job "), "status").alias("status"), F.lit(1).cast("long").alias("n")))


def task_requeue(spark, d):
    """Running tasks of jobs without a worker, those of every fifth customer, wait again."""
    lost = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("job_id"))
    return jobs.requeued(tasks(spark, d), lost).groupBy("status").agg(F.count("*").alias("n"))


def task_retry(spark, d):
    messages = F.array(*map(F.lit, ["HTTP 401 Unauthorized", "insufficient_quota", "timeout"]))
    failed = tasks(spark, d).select("id", "job_id", "status", (F.col("id") % 5).cast("int").alias("attempts"), F.element_at(messages, (F.col("id") % 3 + 1).cast("int")).alias("error"))
    return jobs.retried(failed).groupBy("status", "next", "wait").agg(F.count("*").alias("n"))


def since_bounds(spark, d):
    """What a user gives as a beginning, as a drive wants it."""
    values = F.array(*map(F.lit, [" 2024-05-01 ", "2024-05-01T12:30:00Z", "2024"]))
    return table(spark, d, "part").select("p_partkey", t.rfc3339(F.element_at(values, (F.col("p_partkey") % 3 + 1).cast("int"))).alias("since"))


def legal_task_moves(spark, d):
    """Each legal pair of states that follow each other in a customer's tasks."""
    w = jobs.Window.partitionBy("job_id").orderBy("started_at", "id")
    moves = tasks(spark, d).select("id", F.lag("status").over(w).alias("before"), F.col("status").alias("after")).where("before is not null")
    illegal = jobs.illegal_moves(moves).select("before", "after").distinct()
    return moves.join(F.broadcast(illegal), ["before", "after"], "left_anti").groupBy("before", "after").agg(F.count("*").alias("n"))  # pairs of states


QUERIES = {f.__name__: f for f in (task_claim_order, jobs_newest, task_status_counts, job_finalize, illegal_transitions, illegal_job_moves, breaker_trip, double_active, stale_jobs, status_summary, inspect_summary, estimate_extrapolate, error_classes, time_bounds, oldest_queued, job_cancel, task_requeue, task_retry, since_bounds, legal_task_moves)}

_TASKS = f"SELECT o_orderkey AS id, o_custkey AS job_id, {_STATES!r}[o_orderkey % 5 + 1] AS status, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, o_orderdate AS started_at FROM orders"
_VALUES = lambda moves: ", ".join(map(str, moves))
_OBJECTS = "SELECT 'docs://' || lang AS connector_uri, 'docs://corpus/' || lang || '/' || source || '/' || doc_id || '.md' AS object_uri, CAST(ceil(length(text) / 2048) AS BIGINT) AS chunk_count, CASE WHEN length(text) < 100 THEN 'not_indexed' ELSE 'indexed' END AS search_status, greatest(1, length(text) // 4) AS tokens FROM documents"

ORACLE = {
    "task_claim_order": f"SELECT id, priority FROM ({_TASKS}) WHERE status = 'pending' ORDER BY priority, started_at, id LIMIT 64",
    "jobs_newest": f"SELECT id, status FROM ({_TASKS}) ORDER BY started_at DESC, id LIMIT 20",
    "task_status_counts": f"SELECT status, count(*) AS n FROM ({_TASKS}) GROUP BY status",
    "job_finalize": f"""SELECT c_custkey AS job_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'cancelled' WHEN c_acctbal < 0 THEN 'failed' WHEN coalesce(failed, 0) > 0 THEN 'partial' ELSE 'succeeded' END AS result,
        coalesce(total, 0) AS total, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, coalesce(cancelled, 0) AS cancelled FROM customer LEFT JOIN
        (SELECT job_id, count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled FROM ({_TASKS}) GROUP BY job_id) ON c_custkey = job_id""",
    "illegal_transitions": f"""SELECT before, after, count(*) AS n FROM (SELECT lag(status) OVER (PARTITION BY job_id ORDER BY started_at, id) AS before, status AS after FROM ({_TASKS})) WHERE before IS NOT NULL AND (before, after) NOT IN (VALUES {_VALUES(TASK_MOVES)}) GROUP BY ALL""",
    "illegal_job_moves": f"""WITH m(b, a) AS (VALUES {_VALUES(JOB_MOVES)}), s AS (SELECT *, {_JOB_STATES!r}[o_orderkey % {len(_JOB_STATES)} + 1] AS after FROM orders),
        p AS (SELECT lag(after) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, after FROM s)
        SELECT before, after, count(*) AS n FROM p WHERE before IS NOT NULL AND (before, after) NOT IN (SELECT (b, a) FROM m) GROUP BY ALL""",
    "breaker_trip": """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS failed, sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM orders),
        r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, island ORDER BY o_orderkey) AS n FROM o WHERE failed) SELECT o_custkey, min(o_orderkey) AS at, 3 AS run FROM r WHERE n = 3 GROUP BY o_custkey""",
    "double_active": f"SELECT job_id AS connector_id, count(*) AS n FROM ({_TASKS}) WHERE status IN ('preparing', 'queued', 'running') GROUP BY job_id HAVING count(*) > 1",
    "stale_jobs": f"SELECT id FROM ({_TASKS}) WHERE status = 'running' AND started_at < TIMESTAMP '1996-12-31 00:00:00' - INTERVAL 120 SECOND",
    "status_summary": f"""WITH c(connector_uri) AS (VALUES ('docs://de'), ('docs://en'), ('docs://es'), ('docs://fr'), ('docs://it')) SELECT connector_uri, count(object_uri) AS objects, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks, count(*) FILTER (search_status = 'indexed') AS indexed FROM c LEFT JOIN ({_OBJECTS}) USING (connector_uri) GROUP BY connector_uri""",
    "inspect_summary": f"SELECT connector_uri, search_status, count(*) AS objects, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM ({_OBJECTS}) GROUP BY ALL",
    "estimate_extrapolate": f"""WITH o AS ({_OBJECTS}), f AS (SELECT avg(chunk_count) AS c, avg(tokens) AS k FROM (SELECT * FROM o ORDER BY object_uri LIMIT 3)), n AS (SELECT count(*) AS objects FROM o) SELECT objects, round(c * objects, 6) AS chunks, round(k * objects, 6) AS tokens FROM n, f""",
    "error_classes": "SELECT p_partkey, ['auth', 'quota', 'retryable', 'retryable', 'auth', 'quota'][p_partkey % 6 + 1] AS kind, least(pow(2.0::double, p_partkey % 10), 60.0) AS wait FROM part",
    "time_bounds": "SELECT p_partkey, [1700000000.0::double, 1800000000.0 - 2 * 604800, epoch(TIMESTAMP '2024-05-01 00:00:00'), epoch(TIMESTAMP '2024-05-01 12:30:00'), NULL, 1800000000.0 - 30 * 86400][p_partkey % 6 + 1] AS since FROM part",
    "oldest_queued": "SELECT c_custkey AS id, c_nationkey * 1000 + c_custkey % 7 AS queued_at FROM customer WHERE c_custkey % 3 = 0 ORDER BY queued_at, id LIMIT 8",
    "job_cancel": f"SELECT CASE WHEN status IN ('pending', 'running') THEN 'cancelled' ELSE status END AS status, count(*) AS n FROM ({_TASKS}) WHERE job_id = 4 GROUP BY 1 UNION ALL SELECT 'job cancelled', 1",
    "task_requeue": f"SELECT CASE WHEN status = 'running' AND job_id % 5 = 0 AND job_id IN (SELECT c_custkey FROM customer) THEN 'pending' ELSE status END AS status, count(*) AS n FROM ({_TASKS}) GROUP BY 1",
    "task_retry": f"""WITH x AS (SELECT status, id % 5 AS attempts, id % 3 AS e FROM ({_TASKS})), y AS (SELECT *, CASE WHEN status <> 'failed' THEN NULL WHEN e < 2 THEN 'abort' WHEN attempts < 3 THEN 'pending' ELSE 'failed' END AS next FROM x)
        SELECT status, next, CASE WHEN next = 'pending' THEN pow(2.0::double, attempts) END AS wait, count(*) AS n FROM y GROUP BY ALL""",
    "since_bounds": "SELECT p_partkey, ['2024-05-01T00:00:00', '2024-05-01T12:30:00Z', '2024T00:00:00'][p_partkey % 3 + 1] AS since FROM part",
    "legal_task_moves": f"""WITH m(b, a) AS (VALUES {_VALUES(TASK_MOVES)}), p AS (SELECT lag(status) OVER (PARTITION BY job_id ORDER BY started_at, id) AS before, status AS after FROM ({_TASKS}))
        SELECT before, after, count(*) AS n FROM p WHERE before IS NOT NULL AND (before, after) IN (SELECT (b, a) FROM m) GROUP BY ALL""",
}
