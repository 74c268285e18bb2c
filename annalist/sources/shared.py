"""Intermediate tables in the folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a session in one process uses a temporary folder; a cluster has no folder that it could be, so that raises."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        there = f"file:{tempfile.gettempdir()}/annalist-shared"
    return there.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/annalist-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(table: DataFrame) -> None:
    """Deletes a table of `written` that a later round replaces: what reads it must have been written before."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
