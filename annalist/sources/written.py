"""A file for each row, as a sink of Spark: tasks write their rows into folders of their own, the commit makes them known.

Rows have `name` (the file's name, which may hold folders), `text` and any other columns, which the index keeps. Under the path
a task writes files/JOB/TASK/NAME and a list of them, _pending/JOB/TASK.jsonl. The commit takes out lists of tasks that did not
win and renames the job's folder of lists into _index, one rename a job. A task that fails takes its files with it, and a job
that is aborted all of its files; what a task that is still running writes after that is listed by nobody. Appending jobs add
lists. Files are written through Arrow's file systems, so the path may be of any store that these know and all executors see.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from annalist.sources import files


@dataclass
class Task(WriterCommitMessage):
    name: str
    rows: int


class Writer(DataSourceWriter):
    def __init__(self, path: str, over: bool) -> None:
        self.path, self.over, self.job = path, over, uuid.uuid4().hex

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else "file://" + self.path.removeprefix("file:"))

    def write(self, rows) -> Task:
        store, root = self._fs()
        task, listed, made = uuid.uuid4().hex, [], set()
        own = f"files/{self.job}/{task}"
        try:
            for row in rows:
                held = row.asDict(recursive=True)
                name = posixpath.normpath(held["name"] or "")
                if name in (".", "..") or name.startswith(("/", "../")) or name in made:
                    raise ValueError(f"no name of a new file: {held['name']!r}")
                made.add(name)
                store.create_dir(posixpath.dirname(f"{root}/{own}/{name}"), recursive=True)
                body = (held.pop("text") or "").encode()
                with store.open_output_stream(f"{root}/{own}/{name}") as out:
                    out.write(body)
                listed.append(json.dumps(held | {"path": f"{own}/{name}", "bytes": len(body)}, default=str))
            store.create_dir(f"{root}/_pending/{self.job}", recursive=True)
            with store.open_output_stream(f"{root}/_pending/{self.job}/{task}.jsonl") as out:
                out.write("".join(line + "\n" for line in listed).encode())
        except BaseException:
            _drop(store, f"{root}/{own}")
            raise
        return Task(task, len(listed))

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root = self._fs()
        won = {m.name for m in messages if m is not None}
        lists = lambda at: [i.base_name for i in store.get_file_info(fs.FileSelector(f"{root}/{at}", allow_not_found=True))]
        for name in lists(f"_pending/{self.job}"):
            if name.removesuffix(".jsonl") not in won:
                store.delete_file(f"{root}/_pending/{self.job}/{name}")
                _drop(store, f"{root}/files/{self.job}/{name.removesuffix('.jsonl')}")
        old = lists("_index") if self.over else []
        store.create_dir(f"{root}/_index", recursive=True)
        if won:
            store.move(f"{root}/_pending/{self.job}", f"{root}/_index/{self.job}")
        for job in old:
            _drop(store, f"{root}/_index/{job}")
            _drop(store, f"{root}/files/{job}")

    def abort(self, messages: list) -> None:
        store, root = self._fs()
        _drop(store, f"{root}/files/{self.job}")
        _drop(store, f"{root}/_pending/{self.job}")


def _drop(store, folder: str) -> None:
    from pyarrow.fs import FileType

    if store.get_file_info(folder).type != FileType.NotFound:
        store.delete_dir(folder)


class FilePerRow(DataSource):
    """df.write.format("file_per_row").mode("append" or "overwrite").save(path), once `register` was called for the session."""

    @classmethod
    def name(cls) -> str:
        return "file_per_row"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"].rstrip("/"), overwrite)


def save(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Writes rows (name, text, more columns for the index) as files under path."""
    rows.sparkSession.dataSource.register(FilePerRow)
    rows.write.format("file_per_row").mode(mode).save(path)


def index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the commits made known: name, path (below the root), bytes and the columns of schema."""
    full = "name string, path string, bytes bigint" + (f", {schema}" if schema else "")
    lists = [f"{path}/_index/{n}" for n in files.names(spark, f"{path}/_index")]
    return spark.read.schema(full).json(lists) if lists else spark.createDataFrame([], full)


def load(spark: SparkSession, path: str, schema: str = "") -> DataFrame:
    """The index with the files' texts: only files that it names are told of. An empty file is an empty text, a lost one null."""
    listed = index(spark, path, schema)
    if not files.names(spark, f"{path}/files"):
        return listed.withColumn("text", F.lit(None).cast("string"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/files")
    found = read.select(F.regexp_extract("path", r"/(files/[0-9a-f]{32}/[0-9a-f]{32}/.*)$", 1).alias("path"), F.decode("content", "UTF-8").alias("_text"))
    return listed.join(found, "path", "left").withColumn("text", F.coalesce("_text", F.when(F.col("bytes") == 0, ""))).drop("_text")
