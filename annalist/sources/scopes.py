"""Tables partitioned by scope: what a system under test has stored for each tier, wiped, verified, written and reused as wholes."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.sources import files

log = logging.getLogger(__name__)


class Residue(RuntimeError):
    """A scope that still holds rows after it was wiped."""


class Scopes:
    """Rows in folders by scope under one path, which all executors share. schema: of the rows without the scope."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "scope") -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def folder(self, scope: str) -> str:
        return f"{self.path}/{self.key}={self._escaped(scope)}"

    def _escaped(self, scope: str) -> str:
        return self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(scope)

    def rows(self) -> DataFrame:
        """All rows with their scope as text."""
        full = f"{self.schema}, {self.key} string"
        if not any(n.startswith(f"{self.key}=") for n in files.names(self.spark, self.path)):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.path).parquet(self.path)

    def scopes(self) -> list[str]:
        unescaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return sorted(unescaped(n[len(self.key) + 1 :]) for n in files.names(self.spark, self.path) if n.startswith(f"{self.key}="))

    def count(self, scope: str) -> int:
        """Rows that a scope holds; -1 if that cannot be told."""
        try:
            return self.rows().where(F.col(self.key) == scope).count()
        except Exception as failed:
            log.warning("rows of scope %s cannot be counted: %s", scope, str(failed)[:200])
            return -1

    def wipe(self, scope: str) -> bool:
        """Deletes what a scope holds, and the record of its ingest first; whether it held anything."""
        files.delete(self.spark, self._record(scope))
        return files.delete(self.spark, self.folder(scope))

    def wipe_all(self, prefix: str) -> list[str]:
        """Wipes the scopes whose names begin with a prefix."""
        return [s for s in self.scopes() if s.startswith(prefix) and self.wipe(s)]

    def clean(self, scope: str) -> None:
        """Wipes a scope and makes sure of it: raises if rows are left, warns if they cannot be counted."""
        self.wipe(scope)
        left = self.count(scope)
        if left > 0:
            raise Residue(f"scope {scope!r} holds {left} rows after it was wiped: nothing is written on top of them")
        if left < 0:
            log.warning("scope %r cannot be verified to be empty", scope)

    def write(self, rows: DataFrame) -> None:
        """Rows with their scope, in the place of all that these scopes held; other scopes stay as they are."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.key).parquet(self.path)

    def _record(self, scope: str) -> str:
        return f"{self.path}/_ingests/{self._escaped(scope)}.json"

    def finished(self, scope: str, version: str) -> bool:
        """Whether an ingest of this version ended and its rows are still there, all of them."""
        said = json.loads(files.get(self.spark, self._record(scope)) or "{}")
        return said.get("version") == version and self.count(scope) == said.get("rows")

    def ingest(self, rows: DataFrame, scope: str, version: str, reuse: bool = True) -> str:
        """Writes a scope's rows into the clean scope and records that; "reused" if an ingest of this version stands.

        An ingest that fails leaves no record, so the next one starts from a clean scope.
        """
        if reuse and self.finished(scope, version):
            return "reused"
        self.clean(scope)
        self.write(rows.withColumn(self.key, F.lit(scope)))
        files.put(self.spark, self._record(scope), json.dumps({"version": version, "rows": self.count(scope)}), over=True)
        return "written"
