"""Job leases and the ledger of jobs over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leases, ledger
from ..registry import query
from ..sources.views import view, with_views


@query(
    "lease_claims",
    f"""
WITH RECURSIVE {with_views("v_jobs")}, e AS (SELECT event_id, job, action, epoch_us(ts) / 1e6::DOUBLE AS s, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS n FROM v_jobs WHERE job IS NOT NULL AND ts IS NOT NULL),
r(event_id, job, n, action, came, status, beat, attempts) AS (
  SELECT NULL::BIGINT, job, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 'none', NULL::DOUBLE, 0::BIGINT FROM (SELECT DISTINCT job FROM e)
  UNION ALL SELECT event_id, job, n, action, came,
    CASE came WHEN 'created' THEN 'queued' WHEN 'claimed' THEN 'running' WHEN 'ended' THEN CASE action WHEN 'complete' THEN 'completed' ELSE 'failed' END ELSE status END,
    CASE WHEN came IN ('claimed', 'progressed') THEN s ELSE beat END, CASE came WHEN 'claimed' THEN attempts + 1 ELSE attempts END
  FROM (SELECT e.event_id, e.job, e.n, e.action, e.s, r.status, r.beat, r.attempts, CASE WHEN r.status = 'none' THEN CASE e.action WHEN 'create' THEN 'created' ELSE 'unknown' END WHEN r.status = 'completed' THEN 'completed'
      WHEN r.status = 'failed' THEN 'terminal' WHEN e.action = 'claim' THEN CASE WHEN r.status = 'queued' OR e.s - r.beat >= 7800 THEN 'claimed' ELSE 'already_running' END
      WHEN e.action = 'progress' AND r.status = 'running' THEN 'progressed' WHEN e.action IN ('complete', 'fail') THEN 'ended' ELSE 'ignored' END AS came FROM r JOIN e ON e.job = r.job AND e.n = r.n + 1))
SELECT event_id, job, action, came AS disposition, attempts, status FROM r WHERE n > 0""",
)
def lease_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.dispositions(view(spark, sf_dir, "v_jobs"))


_CHANGES = ("status", "progress", "message", "run_id")


@query(
    "job_rows",
    f"""
WITH {with_views("v_jobs")}, b AS (SELECT *, min(CASE WHEN action = 'create' THEN struct_pack(a := ts, n := event_id) END) OVER (PARTITION BY job) AS born FROM v_jobs),
l AS (SELECT *, struct_pack(a := ts, n := event_id) AS o FROM b WHERE born IS NOT NULL AND struct_pack(a := ts, n := event_id) >= born AND (action <> 'create' OR struct_pack(a := ts, n := event_id) = born))
SELECT job::VARCHAR AS job_id, arg_max(CASE action WHEN 'create' THEN 'queued' WHEN 'claim' THEN 'running' WHEN 'complete' THEN 'completed' ELSE 'failed' END, o) FILTER (action <> 'progress') AS status,
 (arg_max(CASE action WHEN 'create' THEN 3 ELSE (event_id % 100)::INT END, o) FILTER (action IN ('create', 'progress')))::INT AS progress,
 nullif(arg_max(CASE action WHEN 'create' THEN 'Waiting for a worker' WHEN 'claim' THEN '' ELSE action || ' ' || event_id END, o) FILTER (action IN ('create', 'claim', 'fail')), '') AS message,
 arg_max('run_' || event_id, o) FILTER (action = 'complete') AS run_id, concat('/sessions/', job) AS output_dir, min(ts) AS submitted_at, max(ts) AS updated_at FROM l GROUP BY job""",
)
def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "v_jobs").select(F.col("job").cast("string").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("number"), "action")
    of = lambda *actions: events.where(F.col("action").isin(*actions))
    text = lambda c: F.lit(c).cast("string")
    new = of("create").select("job_id", text("A").alias("company_name"), text("a.b").alias("official_domain"), text("{}").alias("request_json"), F.col("at").alias("submitted_at"), "number")
    log = ledger.created(new, "/sessions")
    log = log.unionByName(ledger.updates(of("claim").select("job_id", "at", "number", text("running").alias("status"), text(None).alias("message"))))
    log = log.unionByName(ledger.updates(of("progress").select("job_id", "at", "number", (F.col("number") % 100).cast("int").alias("progress"))))
    log = log.unionByName(ledger.updates(of("complete").select("job_id", "at", "number", text("completed").alias("status"), F.concat(F.lit("run_"), F.col("number").cast("string")).alias("run_id"))))
    log = log.unionByName(ledger.updates(of("fail").select("job_id", "at", "number", text("failed").alias("status"), F.concat("action", F.lit(" "), F.col("number").cast("string")).alias("message"))))
    return ledger.current(log).select("job_id", *_CHANGES, "output_dir", "submitted_at", "updated_at")
