"""Pauses, retries and expiry on a clock that the test sets: the watermark of a stream of files."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.streaming import pace

ZERO = datetime(2024, 1, 1)
EVENTS = "host string, url string, attempt int, status int, retry_after string, ts timestamp"


def at(seconds):
    return ZERO + timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, pace.STORE)
    yield spark
    spark.conf.set(key, before)


def played(spark, folder, batches, schema, made):
    """The rows of ``made`` over a stream that gets one batch after the other; times are seconds after ZERO."""
    source, out = folder / "in", folder / "out"
    source.mkdir()
    for i, batch in enumerate(batches):
        (source / f"{i:03}.json").write_text("\n".join(json.dumps({**r, "ts": None if r["ts"] is None else at(r["ts"]).isoformat()}) for r in batch))
        stream = made(spark.readStream.schema(schema).json(str(source)))
        run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(folder / "log")).trigger(availableNow=True).start(str(out))
        try:
            assert run.awaitTermination(100)
        finally:
            run.stop()
    return spark.read.parquet(str(out)).collect()


def request(url, ts, host="a", **more):
    return {"host": host, "url": url, "ts": ts, **more}


def test_waits(spark):
    rows = [(0, None), (1, "x"), (3, ""), (4, None), (9, None), (0, "7"), (0, "90"), (0, "9" * 400)]
    df = spark.createDataFrame(rows, "attempt int, retry_after string")
    assert [r.w for r in df.select(pace.wait_seconds(F.col("attempt"), F.col("retry_after")).alias("w")).collect()] == [1, 2, 8, 16, 20, 7, 20, 20]


def test_paced(rocks, tmp_path):
    """Each run of the stream is a new one from its checkpoint, so state and timers also survive restarts."""
    batches = [
        [request("u1", 0), request("u1b", 0, "b")],
        [request("u2", 0.5), request("u3", 0.5), request(None, 1), request("x", None), request("y", 1, None)],
        [request("u1", 3, status=503, attempt=0), request("u1b", 3, "b", status=200, attempt=0)],
        [request("u2", 3.5, status=429, attempt=0, retry_after="5"), request("u3", 3.5, status=404, attempt=0)],
        [request("u1", 6, status=0, attempt=3)],
        [request("late", 60, "z")],
        [request("later", 61, "z")],
    ]
    found = played(rocks, tmp_path, batches, EVENTS, lambda s: pace.paced(s, 2.0))
    went = sorted((r.host, r.due, r.url, r.attempt) for r in found if r.decision == "go" and r.host in "ab")
    # u1 at once; u2 and u3 arrive together, so either may be first; a failed answer comes back after its wait
    assert [(h, d, n) for h, d, _, n in went] == [("a", at(0), 0), ("a", at(2), 0), ("a", at(4), 0), ("a", at(6), 1), ("a", at(8.5), 1), ("b", at(0), 0)]
    assert went[0][2] == "u1" and {went[1][2], went[2][2]} == {"u2", "u3"} and went[3][2] == "u1" and went[4][2] == "u2"
    over = {(r.host, r.url, r.decision, r.status) for r in found if r.decision != "go"}
    assert over == {("b", "u1b", "done", 200), ("a", "u3", "failed", 404), ("a", "u1", "failed", 0)}


def test_sessions_expire(rocks, tmp_path):
    use = lambda s, ts, folder=None: {"session": s, "folder": folder, "ts": ts}
    # v is used again before the clock has passed its end, s after that
    batches = [[use("s", 0, "/r/jobs/1"), use("t", 0, "/r/../etc"), use("v", 0), use(None, 0)], [use("s", 50), use("v", 61)], [use("q", 111, "/r")], [use("q", 115), use("s", 116, "/r/jobs/2")], [use("z", 300)], [use("z", 301)]]
    found = played(rocks, tmp_path, batches, "session string, folder string, ts timestamp", lambda s: pace.expired(s, "60 seconds", "/r"))
    got = sorted((r.session, r.last_used, r.folder) for r in found)
    assert got == [("q", at(115), None), ("s", at(50), "/r/jobs/1"), ("s", at(116), "/r/jobs/2"), ("t", at(0), None), ("v", at(61), None)]


def test_within(spark):
    rows = [("/r/a", True), ("/r", False), ("/r/", False), ("/r/../x", False), ("/rx/a", False), ("r/a", False), (None, False), ("/r//./a/b", True)]
    df = spark.createDataFrame(rows, "f string, ok boolean")
    assert [r.w for r in df.select(pace.within(F.col("f"), "/r").alias("w")).collect()] == [ok for _, ok in rows]
