"""Where intermediate tables go, and small planning helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a table may have to be sent to every executor: with rows of under 100 bytes, less than 10 MB.
BROADCAST_ROWS = 100_000


def work_dir(spark: SparkSession) -> str:
    """A fresh path in the folder named by spark.checkpoint.dir; a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_evidentia_work", None)
        if base is None:
            base = tempfile.mkdtemp(prefix="evidentia-")
            spark._evidentia_work = base
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here, and no executor's loss undoes it. ``by``: a column whose values get folders of their own."""
    path = work_dir(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches_of(spark: SparkSession, rows: int) -> None:
    """Arrow batches have this many rows at most, so that whole texts fit a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named input columns under the operator's own names; whatever else the input has is left out."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
