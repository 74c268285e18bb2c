"""What the operators of this subpackage share: the shared folder, Arrow batches, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text per Arrow batch: long documents must not add up to more than a worker can hold.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader (any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Text comes in batches of at most BATCH_ROWS rows, or fewer where the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset a session in one
    process uses a temporary folder; a cluster has no folder that it could be, so that raises."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        there = f"file:{tempfile.gettempdir()}/annalist-shared"
    return there.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/annalist-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(table: DataFrame) -> None:
    """Deletes a table of `written` that a later round replaces: what reads it must have been written before."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns (a dict of name to values, in the order of schema)."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = make(batch)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, what: str, limit: int = 100) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, component), component the smallest id reached.

    Alternating large-star and small-star steps: each is a group-by with a partial minimum, the number of rounds grows
    with the logarithm of the longest path. Rounds are written to the shared folder. No edge leaves the cluster.
    """
    e = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), what)
    before = None
    for _ in range(limit):
        # large star: what is larger than v goes to the smallest neighbour of v
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: what is not larger than v, and v, go to the smallest of them
        least = large.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("m"))
        small = large.select(F.col("b").alias("v"), F.col("a").alias("n")).join(least, "v")
        small = small.select(F.col("m").alias("a"), F.col("n").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("v").alias("b")))
        last, e = e, written(small.where("a < b").distinct(), what)
        forget(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components of {what}: not settled after {limit} rounds")
    return e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
