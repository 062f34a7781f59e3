"""The ledger of jobs as a log of changes that is only ever appended to: creation, allowed updates, the present row of each job, its listing and what may be shown of it.

A change is a row (job_id, at, number, changed, and the columns it sets); ``changed`` names the columns that count, so a null can be set. ``number`` orders changes of one moment. A job's present row
takes each column from its last change that sets it: one aggregation with partial sums, whatever the number of changes a job has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that an update may set, those that only a creation sets, and settings that a task may override (fixed values).
UPDATABLE = {
    "task_id": "string", "status": "string", "stage": "string", "progress": "int", "message": "string", "started_at": "timestamp", "completed_at": "timestamp", "run_id": "string", "excel_path": "string",
    "table_csv_path": "string", "table_json_path": "string", "result_json_path": "string", "error": "string", "summary_json": "string", "backend_cleared_at": "timestamp", "execution_token": "string",
    "heartbeat_at": "timestamp", "attempt_count": "int",
}
CREATED = {"company_name": "string", "official_domain": "string", "request_json": "string", "submitted_at": "timestamp", "output_dir": "string"}
OVERRIDES = ("search_provider", "jina_reader_enabled", "jina_reader_on_thin_page", "search_queries", "capture_strategy")
TERMINAL = ("completed", "failed", "cancelled")
WAITING = "Waiting for a worker"
_ALL = UPDATABLE | CREATED


def _change(rows: DataFrame, at: Column, number: Column, set_: dict[str, Column]) -> DataFrame:
    columns = [(set_[c] if c in set_ else F.lit(None)).cast(t).alias(c) for c, t in _ALL.items()]
    return rows.select("job_id", at.cast("timestamp").alias("at"), number.cast("long").alias("number"), F.array(*map(F.lit, sorted(set_))).cast("array<string>").alias("changed"), *columns)


def created(requests: DataFrame, sessions: str) -> DataFrame:
    """Changes that queue jobs. requests: job_id, company_name, official_domain, request_json, submitted_at and, where known, output_dir (else a folder of the job's below ``sessions``) and number (else 0)."""
    folder = F.concat(F.lit(sessions.rstrip("/") + "/"), "job_id")
    start = {
        "task_id": F.col("job_id"), "status": F.lit("queued"), "stage": F.lit("queued"), "progress": F.lit(3), "message": F.lit(WAITING), "attempt_count": F.lit(0), **{c: F.col(c) for c in CREATED if c != "output_dir"},
        "output_dir": F.coalesce("output_dir", folder) if "output_dir" in requests.columns else folder,
    }
    return _change(requests, F.col("submitted_at"), F.col("number") if "number" in requests.columns else F.lit(0), start)


def updates(changes: DataFrame) -> DataFrame:
    """Changes of job_id, at, number and whatever columns they set, all of them; a column that no update may set is an error before anything runs."""
    given = [c for c in changes.columns if c not in ("job_id", "at", "number")]
    unknown = sorted(set(given) - set(UPDATABLE))
    if unknown:
        raise ValueError(f"columns that no update may set: {', '.join(unknown)}")
    return _change(changes, F.col("at"), F.col("number"), {c: F.col(c) for c in given})


def checked_overrides(overrides: dict[str, object] | None) -> dict[str, object]:
    """The settings that a task overrides; a ValueError for any that it may not."""
    unknown = sorted(set(overrides or {}) - set(OVERRIDES))
    if unknown:
        raise ValueError(f"settings that no task may override: {', '.join(unknown)}")
    return dict(overrides or {})


def current(log: DataFrame) -> DataFrame:
    """One row a job that was created: each column as last set from its creation on, and ``updated_at``. Of several creations the first counts, and updates before it do not. Rows without job_id or at are left out."""
    rows = log.where("job_id is not null and at is not null").withColumn("__o", F.struct("at", "number"))
    born = F.array_contains("changed", "submitted_at")
    first = rows.where(born).groupBy("job_id").agg(F.min("__o").alias("__born"))
    live = rows.join(first, "job_id").where((F.col("__o") >= F.col("__born")) & (~born | (F.col("__o") == F.col("__born"))))
    # a value in a structure, as a null may be what was set
    last = lambda c: F.max_by(F.struct(c), F.when(F.array_contains("changed", c), F.col("__o")))[c].alias(c)
    return live.groupBy("job_id").agg(*(last(c) for c in _ALL), F.max("at").alias("updated_at"))


def unknown_jobs(log: DataFrame) -> DataFrame:
    """job_id of updates whose job was never created."""
    ids = log.where("job_id is not null")
    return ids.select("job_id").distinct().join(ids.where(F.array_contains("changed", "submitted_at")).select("job_id"), "job_id", "left_anti")


def shown(jobs: DataFrame) -> DataFrame:
    """Jobs as they may be shown: without token and request, times as ISO text, the summary as a map (empty unless it is a JSON object), and whether the job has ended."""
    times = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for c, t in (_ALL | {"updated_at": "timestamp"}).items() if t == "timestamp" and c in jobs.columns}
    summary = F.coalesce(F.try_variant_get(F.try_parse_json("summary_json"), "$", "map<string, string>"), F.create_map().cast("map<string, string>"))
    return jobs.withColumns({**times, "summary": summary, "is_terminal": F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))}).drop("summary_json", "request_json", "execution_token")


def listing(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` jobs submitted last (one at least), newest first, equal times by job_id."""
    return jobs.orderBy(F.desc("submitted_at"), "job_id").limit(max(1, limit))
