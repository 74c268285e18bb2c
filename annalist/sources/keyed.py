"""Tables updated by key: buckets that a change touches are written anew, all others keep their files; a manifest makes it one step.

A folder holds data/NAME/_bucket=B (what an update wrote), history/NAME (a row for each changed field) and manifest/G.json,
which names the folder of each bucket and all of history; G counts updates, NAME is G and a mark of its writer. A reader takes
the newest manifest, so it sees an update as a whole or not at all; of two updates at once the second to end raises, and what it
wrote is named nowhere. Files of older updates stay for readers of older manifests (`swept` deletes them).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.sources import files

HISTORY = "key string, field string, old string, new string, gen bigint"


class Keyed:
    """rows of a schema, of which `key` tells one from the other; null keys are one bucket's."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def generation(self) -> int:
        """The newest update that ended; -1 before the first."""
        done = [int(n.split(".")[0]) for n in files.names(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
        return max(done, default=-1)

    def manifest(self, generation: int | None = None) -> dict:
        at = self.generation() if generation is None else generation
        return json.loads(files.get(self.spark, f"{self.path}/manifest/{at}.json") or '{"schema": null, "written": {}, "history": []}')

    def _commit(self, generation: int, schema: str, written: dict, history: list[str]) -> None:
        if not files.put(self.spark, f"{self.path}/manifest/{generation}.json", json.dumps({"schema": schema, "written": written, "history": history})):
            raise RuntimeError(f"update {generation} of {self.path} was made by another")

    def rows(self, buckets: list[int] | None = None, generation: int | None = None) -> DataFrame:
        """All rows, or those of some buckets, as an update left them: only the folders that its manifest names are read."""
        said = self.manifest(generation)
        schema = self.spark.createDataFrame([], said["schema"]).schema
        paths = [f"{self.path}/data/{name}/_bucket={b}" for b, name in said["written"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str) -> dict:
        out = f"{self.path}/data/{name}"
        rows.withColumn("_bucket", self._bucket(self.key)).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(out)
        return {n.split("=")[1]: name for n in files.names(self.spark, out) if n.startswith("_bucket=")}

    def create(self, rows: DataFrame) -> None:
        """The first rows, as update 0."""
        if self.generation() >= 0:
            raise RuntimeError(f"{self.path} holds a table already")
        self._commit(0, rows._jdf.schema().toDDL(), self._write(rows, f"0-{uuid.uuid4().hex}"), [])

    def _touched(self, *keys: DataFrame) -> list[int]:
        """Buckets of some keys: as many as there are buckets at most."""
        found: set[int] = set()
        for frame in keys:
            found |= {r[0] for r in frame.select(self._bucket(frame.columns[0]).alias("b")).distinct().collect()}
        return sorted(found)

    def update(self, changes: DataFrame) -> int:
        """changes: the key and some fields; a null leaves a field as it is, keys that no row has are left out. Returns the update's number.

        One change for each key (of several the largest). Only touched buckets are read and written; fields that do change get a row of history.
        """
        fields = [c for c in changes.columns if c != self.key]
        new = changes.groupBy(self.key).agg(F.max(F.struct(*fields)).alias("_new")).select(F.col(self.key).alias("_key"), "_new")
        touched = self._touched(new)
        rows = self.rows(touched)
        both = rows.join(new, rows[self.key] == new["_key"], "left")
        value = lambda f: F.coalesce(F.col("_new")[f].cast(rows.schema[f].dataType), F.col(f))
        text = lambda c: c.cast("string")
        entries = F.array(*[F.when(~value(f).eqNullSafe(F.col(f)), F.struct(text(F.col(self.key)).alias("key"), F.lit(f).alias("field"), text(F.col(f)).alias("old"), text(value(f)).alias("new"))) for f in fields])
        history = both.select(F.explode(F.array_compact(entries)).alias("h")).select("h.*")
        return self._apply(both.select(*[value(c).alias(c) if c in fields else F.col(c) for c in rows.columns]), history, touched)

    def append(self, items: DataFrame, field: str) -> int:
        """items: the key and `field`, one item each; they go to the end of the array of their row, in order, those that it holds already left out."""
        new = items.where(F.col(field).isNotNull()).groupBy(self.key).agg(F.array_sort(F.collect_set(field)).alias("_items")).select(F.col(self.key).alias("_key"), "_items")
        touched = self._touched(new)
        rows = self.rows(touched)
        both = rows.join(new, rows[self.key] == new["_key"], "left")
        old = F.coalesce(F.col(field), F.array().cast(rows.schema[field].dataType))
        more = F.array_except(F.coalesce(F.col("_items").cast(rows.schema[field].dataType), F.array().cast(rows.schema[field].dataType)), old)
        history = both.where(F.size(more) > 0).select(F.col(self.key).cast("string").alias("key"), F.lit(field).alias("field"), F.to_json(old).alias("old"), F.to_json(F.concat(old, more)).alias("new"))
        return self._apply(both.select(*[F.when(F.size(more) > 0, F.concat(old, more)).otherwise(F.col(c)).alias(c) if c == field else F.col(c) for c in rows.columns]), history, touched)

    def rename(self, names: DataFrame) -> int:
        """names: (old, new) keys. Rows take their new keys and move to the buckets of these; a history row for each."""
        new = names.where("old is not null and new is not null").groupBy("old").agg(F.max("new").alias("new"))
        touched = self._touched(new.select("old"), new.select("new"))
        rows = self.rows(touched)
        both = rows.join(new, rows[self.key] == new["old"], "left")
        history = both.where("new is not null").select(F.col(self.key).cast("string").alias("key"), F.lit(self.key).alias("field"), F.col("old").cast("string").alias("old"), F.col("new").cast("string").alias("new"))
        return self._apply(both.select(*[F.coalesce(F.col("new").cast(rows.schema[c].dataType), F.col(c)).alias(c) if c == self.key else F.col(c) for c in rows.columns]), history, touched)

    def _apply(self, rows: DataFrame, history: DataFrame, touched: list[int]) -> int:
        said, generation = self.manifest(), self.generation() + 1
        name = f"{generation}-{uuid.uuid4().hex}"
        history.withColumn("gen", F.lit(generation).cast("bigint")).write.parquet(f"{self.path}/history/{name}")
        kept = {b: old for b, old in said["written"].items() if int(b) not in touched}
        self._commit(generation, said["schema"], kept | self._write(rows, name), [*said["history"], name])
        return generation

    def history(self) -> DataFrame:
        """key, field, old, new, gen of all updates that ended."""
        done = self.manifest()["history"]
        return self.spark.read.schema(HISTORY).parquet(*[f"{self.path}/history/{n}" for n in done]) if done else self.spark.createDataFrame([], HISTORY)

    def swept(self) -> int:
        """Deletes folders of buckets that the newest manifest does not name; how many. Not while an update is being made."""
        keep = {f"{name}/_bucket={b}" for b, name in self.manifest()["written"].items()}
        all_ = [f"{g}/{b}" for g in files.names(self.spark, f"{self.path}/data") for b in files.names(self.spark, f"{self.path}/data/{g}") if b.startswith("_bucket=")]
        return sum(files.delete(self.spark, f"{self.path}/data/{x}") for x in all_ if x not in keep)


def repointed(rows: DataFrame, key: str, ids: str, names: DataFrame) -> DataFrame:
    """rows with the array `ids` of citations led to new names (old, new), in order; null and empty arrays stay."""
    new = names.where("old is not null and new is not null").groupBy("old").agg(F.max("new").alias("_to"))
    cited = rows.select(key, F.posexplode(ids).alias("_i", "old")).join(new, "old", "left")
    changed = cited.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_to", "old").alias("_id")))).alias("_ids"), F.count("_to").alias("_n")).where("_n > 0")
    joined = rows.join(changed.select(key, "_ids"), key, "left")
    return joined.select(*[F.when(F.col("_ids").isNotNull(), F.transform("_ids", lambda x: x["_id"])).otherwise(F.col(c)).alias(c) if c == ids else F.col(c) for c in rows.columns])
