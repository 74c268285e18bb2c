"""Append-only logs fed by streams: each micro-batch is one folder, written again as a whole if it is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from annalist.operators import state, temporal


def append(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that is exact once: a repeated batch replaces its own folder and no other."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a log with the number of their batch."""
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", path).parquet(path)


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; of equal ones that of the later batch."""
    return state.last_wins(log, key, [*order, "batch"])


def as_of(log: DataFrame, key: list[str], valid_at: str, order: str, at) -> DataFrame:
    """The log's facts that were valid at a time."""
    return temporal.as_of(temporal.versions(log, key, valid_at, order).withColumnRenamed(valid_at, "valid_at"), at)


def purge(log: DataFrame, status: str = "ok") -> DataFrame:
    """Rows of finished units; the rest is to run again."""
    return log.where(F.col("status") == status)


def windows(events: DataFrame, at: str, key: list[str], value: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event time, of a stream or a table; what comes later than `late` is left out of a stream."""
    rows = events.withWatermark(at, late).groupBy(F.window(at, length), *key)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("since"), *key, "n", "total")
