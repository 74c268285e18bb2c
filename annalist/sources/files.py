"""Small things that the driver does to folders of any Hadoop file system: names, renames, short texts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, by name; nothing if it is not there."""
    fs, there = at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(there)) if fs.exists(there) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, there = at(spark, path)
    return fs.delete(there, True)


def put(spark: SparkSession, path: str, text: str, over: bool = False) -> bool:
    """Writes a short text as a whole or not at all; false if the file is there already and may not be replaced."""
    fs, there = at(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if over and fs.exists(there):
        fs.delete(there, False)
    return not fs.exists(there) and fs.rename(part, there)


def get(spark: SparkSession, path: str) -> str | None:
    """A short text; null if the file is not there."""
    fs, there = at(spark, path)
    if not fs.exists(there):
        return None
    read = fs.open(there)
    try:
        return bytes(read.readAllBytes()).decode()
    finally:
        read.close()
