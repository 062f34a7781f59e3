"""Runs and contents kept as Parquet under a log of commits, so that readers see a save whole or not at all.

A save writes its frames into a folder of its own and then adds one numbered entry to the log. An entry is created only where none of its number exists, which file systems decide
for one writer; the other one sees that the log has moved and tries the next number. Readers take the entries that are whole: a save that was killed has none, or one that cannot be read, and is invisible.
Only entries pass through the driver: a few hundred bytes for each save.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "_log"


class Moved(Exception):
    """Another writer has committed since the log was read."""


def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def entries(spark: SparkSession, base: str) -> tuple[int, list[dict]]:
    """The largest number in the log (0 without one) and its whole entries, in order."""
    folder, fs = _path(spark, f"{base}/{LOG}")
    if not fs.exists(folder):
        return 0, []
    names = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".json"))
    found = []
    for name in names:
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(folder, name))
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()
        try:
            found.append(json.loads(text))
        except ValueError:
            continue
    return (int(names[-1].removesuffix(".json")) if names else 0), found


def commit(spark: SparkSession, base: str, after: int, entry: dict) -> int:
    """Adds the entry as number ``after`` + 1, or raises Moved if there is one."""
    path, fs = _path(spark, f"{base}/{LOG}/{after + 1:020d}.json")
    try:
        stream = fs.create(path, False)
    except Exception as e:
        if fs.exists(path):
            raise Moved(f"{path.getName()} exists") from e
        raise
    try:
        stream.write(bytearray(json.dumps(entry).encode()))
    finally:
        stream.close()
    return after + 1


def save(frames: dict[str, DataFrame], base: str, run_id: str) -> int:
    """Saves all frames of a run as one commit and returns its number; of two saves of one run the later commit holds, frames that it lacks are gone."""
    spark = next(iter(frames.values())).sparkSession
    folder = uuid.uuid4().hex
    for name, df in frames.items():
        df.withColumn("run_id", F.lit(run_id)).write.parquet(f"{base}/{folder}/{name}")
    entry = {"run_id": run_id, "folder": folder, "frames": {name: df.withColumn("run_id", F.lit(run_id)).schema.json() for name, df in frames.items()}}
    while True:
        try:
            return commit(spark, base, entries(spark, base)[0], entry)
        except Moved:
            continue


def current(spark: SparkSession, base: str) -> dict[str, dict]:
    """The last entry of each run."""
    return {e["run_id"]: e for e in entries(spark, base)[1] if "run_id" in e}


def _frame(spark: SparkSession, base: str, name: str, kept: list[dict]) -> DataFrame:
    """A frame of several runs, columns by name; those that a run lacks are null."""
    having = [e for e in kept if name in e["frames"]]
    if not having:
        raise ValueError(f"no run has a frame {name}")
    by_schema: dict[str, list[str]] = {}
    for e in having:
        by_schema.setdefault(e["frames"][name], []).append(f"{base}/{e['folder']}/{name}")
    parts = [spark.read.schema(StructType.fromJson(json.loads(s))).parquet(*paths) for s, paths in by_schema.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def load(spark: SparkSession, base: str, name: str, run_id: str) -> DataFrame:
    """A frame of one run; only that run's files are read."""
    return _frame(spark, base, name, [e for r, e in current(spark, base).items() if r == run_id])


def runs(spark: SparkSession, base: str) -> DataFrame:
    """Headers (frame ``runs``: completed_at and more), the latest first."""
    return _frame(spark, base, "runs", list(current(spark, base).values())).orderBy(F.desc("completed_at"), F.desc("run_id"))


def historical_products(spark: SparkSession, base: str, exclude: str) -> DataFrame:
    """Products of all runs but one; of equal product_id that of the run completed last, then of the largest run_id."""
    now = current(spark, base)
    found = _frame(spark, base, "products", [e for r, e in now.items() if r != exclude])
    heads = _frame(spark, base, "runs", list(now.values())).select("run_id", "completed_at")
    order = Window.partitionBy("product_id").orderBy(F.desc("completed_at"), F.desc("run_id"))
    return found.join(heads, "run_id", "left").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "completed_at")


_CONTENTS = "sha256 string, body binary, content_type string, save string, prefix string"


def _contents_in(spark: SparkSession, base: str, folders: list[str]) -> DataFrame:
    found = spark.read.schema(_CONTENTS).option("basePath", base).parquet(*(f"{base}/{f}" for f in folders)) if folders else spark.createDataFrame([], _CONTENTS)
    return found.drop("save")


def contents(spark: SparkSession, base: str) -> DataFrame:
    """sha256, body, content_type, prefix of everything in the content store."""
    return _contents_in(spark, base, [e["folder"] for e in entries(spark, base)[1] if "contents" in e])


def put_contents(bodies: DataFrame, base: str) -> DataFrame:
    """Adds bodies (body binary, content_type) that the store lacks, under the first two digits of their SHA-256; returns the stored rows of all given bodies.

    Null bodies are left out; of equal ones the smallest content_type is kept. What is known is told by the digests alone. A writer that finds the log moved looks again at what is known
    by then, so two writers of one content leave one row.
    """
    spark = bodies.sparkSession
    given = bodies.where("body is not null").groupBy(F.sha2("body", 256).alias("sha256")).agg(F.first("body").alias("body"), F.min("content_type").alias("content_type")).withColumn("prefix", F.substring("sha256", 1, 2))
    new = given
    while True:
        last, _ = entries(spark, base)
        folder = f"save={uuid.uuid4().hex}"
        new.join(contents(spark, base).select("sha256"), "sha256", "left_anti").write.partitionBy("prefix").parquet(f"{base}/{folder}")
        written = _contents_in(spark, base, [folder])
        if written.isEmpty():
            break
        try:
            commit(spark, base, last, {"contents": True, "folder": folder})
            break
        except Moved:
            new = written
    return contents(spark, base).join(bodies.select(F.sha2("body", 256).alias("sha256")).distinct(), "sha256", "left_semi")
