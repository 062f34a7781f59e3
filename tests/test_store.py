"""Commits seen whole, writers at the same time, and results read back from torn, old and valid files."""

import json
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.sources import artifacts, store


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "product_id long, name string")


def head(spark, at):
    return spark.createDataFrame([(at,)], "completed_at long")


def test_a_killed_save_is_invisible(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "runs")
    store.save({"products": frame(spark, (1, "a")), "runs": head(spark, 1)}, base, "r")

    def dies(*a):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", dies)
        with pytest.raises(RuntimeError):
            store.save({"products": frame(spark, (1, "b")), "runs": head(spark, 2)}, base, "r")
    # and one killed within the entry
    (tmp_path / "runs" / "_log" / f"{2:020d}.json").write_text('{"run_id": "r", "fol')
    assert [r.name for r in store.load(spark, base, "products", "r").collect()] == ["a"]
    assert store.save({"products": frame(spark, (1, "c")), "runs": head(spark, 3)}, base, "r") == 3
    assert [r.name for r in store.load(spark, base, "products", "r").collect()] == ["c"]
    store.save({"products": frame(spark, (9, "x")).withColumn("more", F.lit(1)), "runs": head(spark, 4)}, base, "s")
    assert sorted((r.product_id, r.name) for r in store.historical_products(spark, base, "none").collect()) == [(1, "c"), (9, "x")]
    with pytest.raises(ValueError):
        store.load(spark, base, "products", "absent")


def at_once(*work):
    failed = []

    def run(f):
        try:
            f()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed


def test_saves_at_once(spark, tmp_path):
    base = str(tmp_path / "runs")
    one = lambda run, name: lambda: store.save({"products": frame(spark, (1, name)), "runs": head(spark, 1)}, base, run)
    at_once(one("a", "x"), one("a", "y"), one("b", "z"))
    last, found = store.entries(spark, base)
    assert last == 3 and [e["run_id"] for e in found].count("a") == 2
    # the later of the two, and whole
    names = [r.name for r in store.load(spark, base, "products", "a").collect()]
    assert names in (["x"], ["y"]) and sorted(r.run_id for r in store.runs(spark, base).collect()) == ["a", "b"]


def test_contents_at_once(spark, tmp_path):
    base = str(tmp_path / "contents")
    bodies = [spark.createDataFrame([(bytes([k]), "t") for k in ks] + [(None, "t"), (bytes([ks[0]]), "s")], "body binary, content_type string") for ks in ((1, 2, 3), (2, 3, 4), (3, 4, 5))]
    at_once(*(lambda b=b: store.put_contents(b, base) for b in bodies))
    assert sorted(bytes(r.body) for r in store.contents(spark, base).collect()) == [bytes([k]) for k in (1, 2, 3, 4, 5)]
    before = store.entries(spark, base)[0]
    assert store.put_contents(bodies[0], base).count() == 3 and store.entries(spark, base)[0] == before


def test_commits_collide(spark, tmp_path):
    base = str(tmp_path / "log")
    assert store.commit(spark, base, 0, {"a": 1}) == 1
    with pytest.raises(store.Moved):
        store.commit(spark, base, 0, {"a": 2})
    assert store.entries(spark, base) == (1, [{"a": 1}])


def test_artifacts(spark, tmp_path):
    for name, text in (("one/a/x.bin", b"1"), ("two/a/x.bin", b"2"), ("two/b y.bin", b"3"), ("two/unwanted", b"4")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    wanted = spark.createDataFrame([("a/x.bin",), ("none",), (None,), ("a/x.bin",)], "name string")
    found = {r.name: (r.root, r.content and bytes(r.content)) for r in artifacts.read_artifacts(wanted, str(tmp_path / "one"), str(tmp_path / "missing"), str(tmp_path / "two")).collect()}
    assert found == {"a/x.bin": (0, b"1"), "none": (None, None), None: (None, None)}
    assert artifacts.read_artifacts(wanted, str(tmp_path / "missing")).where("content is null").count() == 3


SCHEMA = "run_id string, completed_at string, products array<struct<product_id: string, price: double>>"


def test_recovery(spark, tmp_path):
    schema = StructType.fromDDL(SCHEMA)
    good = {"run_id": "r1", "completed_at": "2024-05-01T10:00:00", "products": [{"product_id": "p", "price": 1.5}]}
    files = {
        "a/research_result.json": json.dumps(good), "b/research_result.json": json.dumps(good)[:-9], "c/other.json": json.dumps(good | {"run_id": "r3"}), "c/research_result.json": json.dumps(good | {"run_id": "old"}),
        "d/research_result.json": json.dumps(good | {"products": [{"product_id": "p", "price": "much"}]}), "e/research_result.json": json.dumps({"run_id": "r5"}), "f/first.json": "[1", "f/research_result.json": json.dumps(good | {"run_id": "r6"}), "g/complete.xlsx": "x",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = [(d, "completed" if d == "h" else "failed", {"c": "c/other.json", "f": "f/first.json", "e": "gone.json"}.get(d), None if d == "i" else d + "/", None, None, "m", "bad", 7) for d in "abcdefghi"]
    jobs = spark.createDataFrame(rows, "job_id string, status string, result_path string, output_dir string, run_id string, completed_at timestamp, message string, error string, kept int")
    found = {r.job_id: r for r in artifacts.recovered(jobs, str(tmp_path), schema).collect()}
    assert {k: r.run_id for k, r in found.items() if r.status == "completed"} == {"a": "r1", "c": "r3", "h": None}
    assert found["a"].error is None and found["a"].kept == 7 and found["a"].completed_at.hour == 10 and found["b"].error == "bad" and found["f"].status == "failed"
    again = {r.job_id: r.run_id for r in artifacts.recovered(jobs, str(tmp_path), schema, next_if_torn=True).where("status = 'completed'").collect()}
    assert again == {"a": "r1", "c": "r3", "f": "r6", "h": None}
    assert artifacts.recovered(jobs, str(tmp_path / "nowhere"), schema).where("status = 'completed'").count() == 1
