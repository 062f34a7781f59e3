"""Requests to hosts in time, as state and timers of a stream: a pause between a host's requests, retries that wait longer each time, and sessions that expire.

Nothing sleeps: a request is given a time when it may go out, and a timer hands it on once the stream's clock (its watermark) has passed that time.
State is one row a waiting request, in RocksDB, so a host with very many requests costs its own number of rows and no list is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times a request is tried again, and the longest wait in seconds (fixed values).
RETRIES, LONGEST = 3, 20
_OUT = "host string, url string, attempt int, due timestamp, decision string, status int"


def is_retryable(status: Column) -> Column:
    """Too many requests, the server's errors, and 0 for a failed connection."""
    return (status == 429) | status.between(500, 599) | (status == 0)


def wait_seconds(attempt: Column, retry_after: Column) -> Column:
    """Seconds before the next attempt after number ``attempt`` (from 0): what the server asked for in whole seconds after an HTTP error, else 2 ** attempt; LONGEST at most."""
    asked = F.when(retry_after.rlike("^[0-9]+$"), F.coalesce(retry_after.try_cast("double"), F.lit(float(LONGEST))))
    return F.least(F.lit(float(LONGEST)), F.coalesce(asked, F.pow(F.lit(2.0), F.least(attempt, F.lit(30)))))


def retries(answers: DataFrame, most: int = RETRIES) -> DataFrame:
    """host, url, attempt, ready (when it may be tried at the earliest), decision (``wait``, ``done`` or ``failed``) and status of answers: host, url, attempt (from 0), status, retry_after, ts."""
    again = F.coalesce(is_retryable(F.col("status")), F.lit(True))
    decision = F.when(again & (F.col("attempt") < most), "wait").when(again | (F.col("status") >= 400), "failed").otherwise("done")
    waited = (F.unix_micros("ts") + (wait_seconds(F.col("attempt"), F.when(F.col("status") > 0, F.col("retry_after"))) * 1e6).cast("long"))
    ready = F.when(decision == "wait", F.timestamp_micros(waited)).otherwise(F.col("ts"))
    return answers.select("host", "url", F.when(decision == "wait", F.col("attempt") + 1).otherwise(F.col("attempt")).cast("int").alias("attempt"), ready.alias("ready"), decision.alias("decision"), F.col("status").cast("int").alias("status"), "ts")


class _Turns(StatefulProcessor):
    """Of one host: the next free time, and each waiting request under its own time, in milliseconds."""

    def __init__(self, pause: int):
        self.pause = pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free = handle.getValueState("free", "at long")
        self.waiting = handle.getMapState("waiting", "at long", "url string, attempt int, status int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        (host,) = key
        free = self.free.get()[0] if self.free.exists() else 0
        for batch in rows:
            over = []
            for url, attempt, ready, decision, status in zip(batch["url"], batch["attempt"], batch["ready"], batch["decision"], batch["status"], strict=True):
                status = None if pd.isna(status) else int(status)
                if decision != "wait":
                    over.append((host, url, int(attempt), ready, decision, status))
                    continue
                # a whole millisecond, never before the request is ready
                at = max(-(-ready.value // 1_000_000), free)
                free = at + self.pause
                self.waiting.updateValue((at,), (url, int(attempt), -1 if status is None else status))
                self.handle.registerTimer(at)
            if over:
                yield pd.DataFrame(over, columns=["host", "url", "attempt", "due", "decision", "status"]).astype({"attempt": "int32", "status": "Int32"})
        self.free.update((free,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.containsKey((at,)):
            url, attempt, status = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            status = None if status < 0 else status
            row = [(key[0], url, attempt, pd.Timestamp(at, unit="ms"), "go", status)]
            yield pd.DataFrame(row, columns=["host", "url", "attempt", "due", "decision", "status"]).astype({"attempt": "int32", "status": "Int32"})

    def close(self) -> None:
        pass


def paced(events: DataFrame, pause: float = 1.0, most: int = RETRIES, late: str = "0 seconds") -> DataFrame:
    """host, url, attempt, due, decision, status: requests that may go out now (``go``), and those that are over (``done``, ``failed``) with their last status.

    ``events`` is a stream of host, url, attempt, status, retry_after, ts: a new request has a null status, an answer the status it got (0: no connection). A
    host's requests go out ``pause`` seconds apart at least, in the order in which they arrive, retries after their wait. Rows without host, url or ts are left out; a
    null attempt is 0. Repeated requests are repeated. Output mode ``append``; the session's state store has to be RocksDB (``STORE``).
    """
    rows = events.where("host is not null and url is not null and ts is not null").withColumn("attempt", F.coalesce(F.col("attempt"), F.lit(0)).cast("int")).withWatermark("ts", late)
    new = F.col("status").isNull()
    told = retries(rows, most)
    judged = told.select(
        "host", "url", F.when(new, F.col("attempt") - F.when(F.col("decision") == "wait", 1).otherwise(0)).otherwise(F.col("attempt")).cast("int").alias("attempt"),
        F.when(new, F.col("ts")).otherwise(F.col("ready")).alias("ready"), F.when(new, "wait").otherwise(F.col("decision")).alias("decision"), "status", "ts",
    )
    return judged.groupBy("host").transformWithStateInPandas(_Turns(max(1, round(pause * 1000))), _OUT, "append", "eventTime")


class _Sessions(StatefulProcessor):
    """Of one session: when it was last used and where its files are."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, folder string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, folder = self.last.get() if self.last.exists() else (None, None)
        for batch in rows:
            for ts, where in zip(batch["ts"], batch["folder"], strict=True):
                used = ts.value // 1_000_000
                if at is None or (used, where or "") > (at, folder or ""):
                    if at is not None:
                        self.handle.deleteTimer(at + self.keep)
                    at, folder = used, where if where is not None else folder
        self.last.update((at, folder))
        self.handle.registerTimer(at + self.keep)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.last.exists():
            at, folder = self.last.get()
            if at + self.keep <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield pd.DataFrame({"session": [key[0]], "folder": [folder], "last_used": [pd.Timestamp(at, unit="ms")]})

    def close(self) -> None:
        pass


def within(folder: Column, root: str) -> Column:
    """Whether a folder lies below a root, neither the root itself nor out of it by ``..``."""
    steps = F.filter(F.split(F.coalesce(folder, F.lit("")), "/+"), lambda s: (s != "") & (s != "."))
    top = [s for s in root.split("/") if s]
    begins = F.slice(steps, 1, len(top)) == F.array(*map(F.lit, top)).cast("array<string>") if top else F.lit(True)
    return F.coalesce(folder.startswith("/") & begins & (F.size(steps) > len(top)) & ~F.array_contains(steps, ".."), F.lit(False))


def expired(uses: DataFrame, keep: str, root: str, late: str = "0 seconds") -> DataFrame:
    """session, folder (null unless it lies below ``root``: nothing else may be removed), last_used of sessions not used for ``keep``.

    ``uses`` is a stream of session, folder, ts; rows without session or ts are left out. A use that arrives before the clock has passed the end
    keeps the session; one that is used again later expires again. Output mode ``append``.
    """
    milliseconds = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = uses.where("session is not null and ts is not null").select("session", "folder", "ts").withWatermark("ts", late)
    over = rows.groupBy("session").transformWithStateInPandas(_Sessions(milliseconds), "session string, folder string, last_used timestamp", "append", "eventTime")
    return over.withColumn("folder", F.when(within(F.col("folder"), root), F.col("folder")))
