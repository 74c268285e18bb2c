"""Repair of texts that do not tell what they have to: rounds over the deficient rows only, the best version kept, an appendix in the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators import merging
from annalist.sources import files


def missing(text, facts) -> Column:
    """The facts that a text does not contain, in any case; null facts and empty ones ask for nothing."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    some = F.coalesce(F.col(facts) if isinstance(facts, str) else facts, F.array().cast("array<string>"))
    return F.filter(some, lambda f: ~F.contains(t, F.lower(F.trim(f))))


def coverage(text, facts) -> Column:
    """The share of facts that a text contains; 1 of none."""
    n = F.size(F.filter(F.coalesce(F.col(facts) if isinstance(facts, str) else facts, F.array().cast("array<string>")), lambda f: f.isNotNull()))
    return F.when(n > 0, 1 - F.size(missing(text, facts)) / n).otherwise(1.0)


def rounds(rows: DataFrame, key: str, rewrite: Callable[[DataFrame, int], DataFrame], path: str, least: float = 1.0, attempts: int = 2, score: Callable[[Column, Column], Column] = coverage) -> DataFrame:
    """key, text, score, attempts, kept: each text after its repair. rows: key, text, facts.

    rewrite gets the deficient rows (key, text, facts, gone: the facts that are missing) and the attempt's number and gives new
    texts (key, text), none where it failed. Of a text's versions the best is kept, of equal ones the first; attempts counts those
    made, kept is the number of the one that stands, 0 for the text as it was. What is below `least` after the last attempt gets
    its missing facts as an appendix, in order, and kept is -1. Each round is a table under path, read by the next; a run that
    was cut off goes on from the last round that is whole.
    """
    spark = rows.sparkSession
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, text string, facts array<string>, score double, attempts int, kept int"

    def at(n: int, make: Callable[[], DataFrame]) -> DataFrame:
        where = f"{path}/round={n}"
        if "_SUCCESS" not in files.names(spark, where):
            make().write.mode("overwrite").parquet(where)
        return spark.read.schema(schema).parquet(where)

    zero = lambda: F.lit(0)
    now = at(0, lambda: rows.select(key, "text", "facts", score(F.col("text"), F.col("facts")).cast("double").alias("score"), zero().alias("attempts"), zero().alias("kept")))
    for n in range(1, attempts + 1):
        now = at(n, lambda now=now, n=n: _round(now, key, rewrite, n, least, score))
    said = merging.appended("text", "Facts", F.array_join(F.transform(missing("text", "facts"), lambda f: F.concat(F.lit("- "), F.trim(f))), "\n"))
    low = F.col("score") < least
    final = now.withColumns({"text": F.when(low, said).otherwise(F.col("text")), "kept": F.when(low, -1).otherwise(F.col("kept"))})
    return final.select(key, "text", F.when(low, score(F.col("text"), F.col("facts"))).otherwise(F.col("score")).cast("double").alias("score"), "attempts", "kept")


def _round(now: DataFrame, key: str, rewrite, n: int, least: float, score) -> DataFrame:
    """One round: what is good passes through, the rest meets its new versions by key."""
    low = now.where(F.col("score") < least)
    new = rewrite(low.select(key, "text", "facts", missing("text", "facts").alias("gone")), n).select(F.col(key).alias("_key"), F.col("text").alias("_text"))
    both = low.join(new, F.col(key) == F.col("_key"), "left").withColumn("_score", F.when(F.col("_text").isNotNull(), score(F.col("_text"), F.col("facts"))).cast("double"))
    better = F.coalesce(F.col("_score") > F.col("score"), F.lit(False))
    pick = lambda a, b: F.when(better, a).otherwise(F.col(b)).alias(b)
    tried = both.select(key, pick(F.col("_text"), "text"), "facts", pick(F.col("_score"), "score"), F.lit(n).alias("attempts"), pick(F.lit(n), "kept"))
    return now.where(~(F.col("score") < least)).unionByName(tried)
