"""The log of job changes against a fold in plain Python; single files; services in turn."""

import csv
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.operators import discovery, exports, ledger

ZERO = datetime(2024, 1, 1)
CHANGE = "job_id string, at timestamp, number long, status string, progress int, message string"


def test_current_against_a_fold(spark):
    rng = random.Random(2)
    when = lambda: ZERO + timedelta(seconds=rng.randint(0, 9))
    new = [(f"j{j}", "c", "d", "{}", when()) for j in (0, 0, 1, 2, 3)]
    rows = [(f"j{rng.randint(0, 5)}", when(), i + 1, rng.choice(["running", "failed", None]), rng.choice([None, 5, 50]), rng.choice(["m", None])) for i in range(300)]
    log = ledger.created(spark.createDataFrame(new, "job_id string, company_name string, official_domain string, request_json string, submitted_at timestamp"), "/s/")
    sets = [("status", "progress"), ("message",), ("progress",)]
    for k, names in enumerate(sets):
        log = log.unionByName(ledger.updates(spark.createDataFrame([r for i, r in enumerate(rows) if i % 3 == k], CHANGE).select("job_id", "at", "number", *names)))
    want = {}
    for job, *_, at in sorted(new, key=lambda r: r[4]):
        want.setdefault(job, {"born": (at, 0), "status": "queued", "progress": 3, "message": ledger.WAITING, "updated_at": at})
    for i, r in sorted(enumerate(rows), key=lambda x: x[1][1:3]):
        job = want.get(r[0])
        if job and (r[1], r[2]) >= job["born"]:
            job |= {c: r[3 + ("status", "progress", "message").index(c)] for c in sets[i % 3]} | {"updated_at": r[1]}
    found = {r.job_id: r for r in ledger.current(log).collect()}
    assert set(found) == set(want)
    for job, w in want.items():
        assert {c: found[job][c] for c in w if c != "born"} == {c: v for c, v in w.items() if c != "born"}, job
        assert found[job].output_dir == f"/s/{job}" and found[job].attempt_count == 0
    assert {r.job_id for r in ledger.unknown_jobs(log).collect()} == {r[0] for r in rows} - set(want)
    newest = sorted(want, key=lambda j: (-want[j]["born"][0].timestamp(), j))
    assert [r.job_id for r in ledger.listing(ledger.current(log), 2).collect()] == newest[:2]
    assert ledger.listing(ledger.current(log), 0).count() == 1


def test_what_may_be_set_and_shown(spark):
    row = spark.createDataFrame([("j", ZERO, 1, "x")], "job_id string, at timestamp, number long, output_dir string")
    with pytest.raises(ValueError, match="output_dir"):
        ledger.updates(row)
    with pytest.raises(ValueError, match="api_key"):
        ledger.checked_overrides({"search_queries": 3, "api_key": "k"})
    assert ledger.checked_overrides({"search_queries": 3}) == {"search_queries": 3} and ledger.checked_overrides(None) == {}
    jobs = spark.createDataFrame([("a", "completed", '{"n": 1}', "secret", "r", ZERO), ("b", "running", "[1]", None, None, None), ("c", None, "{torn", None, None, None)], "job_id string, status string, summary_json string, execution_token string, request_json string, started_at timestamp")
    found = {r.job_id: r.asDict() for r in ledger.shown(jobs).collect()}
    assert not {"execution_token", "request_json", "summary_json"} & set(found["a"])
    assert [(found[j]["summary"], found[j]["is_terminal"]) for j in "abc"] == [({"n": "1"}, True), ({}, False), ({}, False)]
    assert found["a"]["started_at"].startswith("2024-01-01T00:00:00.000000") and found["b"]["started_at"] is None


def test_single_files(spark, tmp_path):
    rows = [(1, 'a "b", c', ["x", "y"]), (2, " line\nline ", None), (3, None, [])]
    df = spark.createDataFrame(rows, "n long, t string, held array<string>").repartition(2).orderBy("n")
    paths = exports.primary_artifacts(df, df.where("n > 5"), df, str(tmp_path / "out"))
    body = open(paths["table_csv_path"], "rb").read()
    assert body.startswith(b"\xef\xbb\xbf")
    assert list(csv.reader(body.decode("utf-8-sig").splitlines(keepends=True))) == [["n", "t", "held"], ["1", 'a "b", c', '["x","y"]'], ["2", " line\nline ", ""], ["3", "", "[]"]]
    assert json.load(open(paths["result_json_path"])) == json.load(open(paths["table_json_path"])) == [{"n": n, "t": t, "held": h} for n, t, h in rows]
    assert json.load(open(paths["material_json_path"])) == [] and open(paths["material_csv_path"], encoding="utf-8-sig").read() == "n,t,held\n"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(p.rsplit("/", 1)[1] for p in paths.values())


def test_services_in_turn(spark):
    rows = [("a", 1, 1, None, False), ("a", 1, 2, "http://no", False), ("b", 2, 1, "http://y", True), ("b", 1, 3, "http://x", True), ("b", 3, 1, "http://x", True), ("c", 1, 1, "http://z", True)]
    log = spark.createDataFrame(rows, "service string, query_number int, rank int, url string, accepted boolean")
    pick = lambda df, *s: [r.url for r in discovery.first_answering(df, s).orderBy("query_number", "rank").collect()]
    assert pick(log, "a", "b", "c") == ["http://x", "http://y"] and pick(log, "a", "c", "b") == ["http://z"]
    assert pick(log, "a") == [] and pick(log.where(F.lit(False)), "a", "b") == []
