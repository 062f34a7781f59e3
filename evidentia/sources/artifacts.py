"""Artifacts and results of jobs read back from where they may lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RESULT = "research_result.json"


def _under(spark: SparkSession, root: str) -> DataFrame | None:
    """name (path below the root), modified, content of every file; None if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    top = fs.resolvePath(path).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = F.regexp_replace(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", ""), "^/+", "/")
    return files.select(F.substring(inner, len(top) + 2, 1 << 20).alias("name"), F.col("modificationTime").alias("modified"), "content")


def read_artifacts(wanted: DataFrame, *roots: str) -> DataFrame:
    """name, root (number of the folder, from 0) and content of each of ``wanted`` (name): from the first folder that has it. Names that no folder has, and null, have null; folders may be missing."""
    spark = wanted.sparkSession
    names = wanted.select("name").distinct()
    found = None
    for k, root in enumerate(roots):
        here = _under(spark, root)
        if here is not None:
            part = here.join(names, "name", "left_semi").select("name", F.lit(k).alias("root"), "content")
            found = part if found is None else found.union(part)
    if found is None:
        return names.select("name", F.lit(None).cast("int").alias("root"), F.lit(None).cast("binary").alias("content"))
    first = found.groupBy("name").agg(F.min("root").alias("root"), F.min_by("content", "root").alias("content"))
    return names.join(first, "name", "left").select("name", "root", "content")


def valid_results(spark: SparkSession, root: str, schema: StructType, required: tuple[str, ...]) -> DataFrame:
    """name, modified, result (null unless the file is whole): a file must be one JSON value that fits the schema throughout and gives every required field (dotted names)."""
    files = _under(spark, root)
    if files is None:
        return spark.createDataFrame([], StructType.fromDDL("name string, modified timestamp").add("result", schema))
    marked = StructType(list(schema.fields)).add("_torn", "string")
    read = files.where(F.col("name").endswith(".json")).select("name", "modified", F.from_json(F.try_to_binary(F.col("content").cast("string"), F.lit("utf-8")).cast("string"), marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r"))
    whole = F.col("r._torn").isNull() & F.col("r").isNotNull()
    for f in required:
        whole = whole & F.col(f"r.{f}").isNotNull()
    return read.select("name", "modified", F.when(whole, F.struct(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields))).alias("result"))


def recovered(jobs: DataFrame, root: str, schema: StructType, required: tuple[str, ...] = ("run_id", "completed_at"), next_if_torn: bool = False) -> DataFrame:
    """The ledger with jobs completed whose result lies whole on disk. jobs: job_id, status, result_path, output_dir (both below ``root``, either may be null), run_id, completed_at, message, error, and what else to keep.

    A job looks for its stated path, then for ``research_result.json`` in its folder. The first of them that exists decides, and a torn one leaves the job as it is; with ``next_if_torn`` the next
    place is tried then. Completed jobs, and jobs without a result, stay as they are. Completion is never inferred from other files.
    """
    spark = jobs.sparkSession
    found = valid_results(spark, root, schema, required)
    places = F.array(F.struct(F.lit(0).alias("place"), F.col("result_path").alias("name")), F.struct(F.lit(1).alias("place"), F.concat_ws("/", F.nullif(F.rtrim(F.col("output_dir"), F.lit("/")), F.lit("")), F.lit(RESULT)).alias("name")))
    wanted = jobs.where("status != 'completed'").select("job_id", F.explode(places).alias("p")).select("job_id", "p.place", "p.name").where("name is not null")
    met = wanted.join(found, "name")
    if next_if_torn:
        met = met.where("result is not null")
    first = met.withColumn("__n", F.row_number().over(Window.partitionBy("job_id").orderBy("place"))).where("__n = 1 and result is not null")
    results = first.select("job_id", F.col("name").alias("__path"), F.col("result.run_id").alias("__run"), F.col("result.completed_at").cast(jobs.schema["completed_at"].dataType).alias("__at"))
    restored = F.col("__path").isNotNull()
    new = {
        "status": F.lit("completed"), "result_path": F.col("__path"), "run_id": F.col("__run"), "completed_at": F.col("__at"), "message": F.lit("Research complete (restored from durable artifacts)"), "error": F.lit(None).cast("string"),
    }
    joined = jobs.join(results, "job_id", "left")
    return joined.select(*(F.when(restored, new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in jobs.columns))
