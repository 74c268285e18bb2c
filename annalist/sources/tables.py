"""Readers: Parquet tables, JSON lines with explicit schemas, and whole text files by explicit roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file; a missing file gives no rows; malformed lines fail, or are left out if not strict."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def whole_texts(spark: SparkSession, roots: list[str], below: bool = False) -> DataFrame:
    """path and text of whole files, those in folders below the roots too if asked. Folders that begin with an underscore are read only where they are roots themselves."""
    return spark.read.option("recursiveFileLookup", below).text(roots, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def artifacts(index: DataFrame, files: DataFrame, events: DataFrame, personas: DataFrame) -> DataFrame:
    """Normalised artifacts: index rows whose file exists, header stripped, dated by their event or their header, author by name."""
    from annalist.functions import text as T

    joined = index.join(files, "path").join(events.select(F.col("id").alias("event_id"), "occurred_at"), "event_id", "left")
    joined = joined.join(personas.select(F.col("persona_id").alias("author"), "display_name"), "author", "left")
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    return joined.select(
        "slot_id", F.coalesce("genre", F.lit("unknown")).alias("source_type"), T.strip_header("text").alias("text"),
        F.coalesce(F.substring("occurred_at", 1, 10), T.header_date(F.substring("text", 1, 300))).alias("timestamp"),
        F.col("display_name").alias("author"), first("event_id", "emergent_pattern", "customer_id").alias("thread_id"), "role", "path",
    )
