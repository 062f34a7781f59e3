"""Job leases: which claims of a job succeed, as a state machine with one small state a job.

States: none, queued, running, completed, failed. ``create`` queues an unknown job; a ``claim`` succeeds on a queued job or
when the running job's last heartbeat (its claim or progress) is at least max(60, ``stale``) seconds old; progress counts while the job
runs; ``complete`` and ``fail`` end a job that has been created and never reopen it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE = 7800
NEW = ("none", None, 0, 0)


def transition(state: tuple, action: str, seconds: float, stale: float = STALE) -> tuple[tuple, str]:
    """state: (status, heartbeat, attempts, progress). Returns the next one and what came of the action."""
    status, beat, attempts, progress = state
    if status == "none":
        return (("queued", None, 0, 0), "created") if action == "create" else (state, "unknown")
    if status in ("completed", "failed"):
        return state, "completed" if status == "completed" else "terminal"
    if action == "claim":
        if status == "queued" or seconds - beat >= max(60, stale):
            return ("running", seconds, attempts + 1, progress), "claimed"
        return state, "already_running"
    if action == "progress":
        return (("running", seconds, attempts, progress + 1), "progressed") if status == "running" else (state, "ignored")
    if action in ("complete", "fail"):
        return ("completed" if action == "complete" else "failed", beat, attempts, progress), "ended"
    return state, "ignored"


def dispositions(events: DataFrame, stale: float = STALE) -> DataFrame:
    """event_id, job, action, disposition, attempts, status of every event (job, action, ts, event_id) of a known job.

    Events are sorted within hash partitions by job and time and streamed: however many events one job has, one state is held. Events
    without a job or a time are left out; null actions are ignored.
    """
    spark = events.sparkSession
    rows = events.where("job is not null and ts is not null").select("job", "event_id", "action", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state = None, NEW
        for batch in batches:
            out = []
            for j, e, a, s in zip(batch["job"], batch["event_id"], batch["action"], batch["s"], strict=True):
                if j != job:
                    job, state = j, NEW
                state, came = transition(state, a, s, stale)
                out.append((e, j, a, came, state[2], state[0]))
            yield pd.DataFrame(out, columns=["event_id", "job", "action", "disposition", "attempts", "status"])

    return rows.repartition(parts, "job").sortWithinPartitions("job", "s", "event_id").mapInPandas(run, "event_id long, job long, action string, disposition string, attempts long, status string")
