"""The job ledger over a stream of events: one state a job, kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.leases import NEW, STALE, transition


def job_states(events: DataFrame, stale: float = STALE, late: str = "1 day") -> DataFrame:
    """job, status, attempts, progress after every batch that touched the job; use output mode ``update``.

    ``events`` is a stream of event_id, job, action, ts. Redelivered events within ``late`` count once. Within a batch a job's events are taken by
    time; a job's rows of one batch are bounded by what the source gives a batch.
    """
    once = events.where("job is not null and ts is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    rows = once.select("job", "event_id", "action", (F.unix_micros("ts") / 1e6).alias("s"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        status, beat, attempts, progress = held.get if held.exists else (*NEW[:1], -1.0, *NEW[2:])
        state = (status, None if beat < 0 else beat, attempts, progress)
        found = sorted((s, e, a) for b in batches for s, e, a in zip(b["s"], b["event_id"], b["action"], strict=True))
        for s, _, a in found:
            state, _ = transition(state, a, s, stale)
        held.update((state[0], -1.0 if state[1] is None else float(state[1]), state[2], state[3]))
        yield pd.DataFrame({"job": [key[0]], "status": [state[0]], "attempts": [state[2]], "progress": [state[3]]})

    return rows.groupBy("job").applyInPandasWithState(
        step, "job long, status string, attempts long, progress long", "status string, beat double, attempts long, progress long", "update", GroupStateTimeout.NoTimeout
    )
