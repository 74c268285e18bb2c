"""Exact percentiles by rank: histograms of ranges, narrowed until what a range holds is few, so no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.sources.shared import forget, written

#: Parts of a range, and values of a range from which on it is divided again.
PARTS, FEW = 1024, 100_000


def percentiles(rows: DataFrame, group: list[str], value: str, wanted: dict[str, float], few: int = FEW) -> DataFrame:
    """group and a column for each wanted share p: the value at place (n - 1) p of a group's values in order, between two by their distance.

    Null values are left out; a group without others has no row. Null group keys are a group. Each round counts the values of
    the open ranges by PARTS equal parts (partial counts meet, not values) and goes on in the part that holds the rank; a range
    of one value is done, one of up to `few` values is sorted. Ranges shrink by PARTS each round, so two or three rounds do.
    """
    held = written(rows.where(F.col(value).isNotNull()).select(F.struct(*group).alias("g"), F.col(value).cast("double").alias("v")), "ranks")
    whole = held.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in wanted.values()])))
    sizes = whole.select("g", F.col("n").alias("size"))
    open_ = written(whole.select("g", F.explode(ranks).alias("rank"), F.lit(0).cast("bigint").alias("skip"), "n", "lo", "hi"), "ranks")
    by = ["g", "lo", "hi"]
    while not (wide := open_.where((F.col("lo") < F.col("hi")) & (F.col("n") > few))).isEmpty():
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS))
        counted = held.join(wide.select(*by).distinct(), "g").where("v between lo and hi").groupBy(*by, part.alias("part")).agg(F.count("*").alias("m"), F.min("v").alias("a"), F.max("v").alias("z"))
        counted = counted.withColumn("before", F.sum("m").over(Window.partitionBy(*by).orderBy("part")) - F.col("m"))
        inner = wide.join(counted, by).where("rank - skip >= before and rank - skip < before + m").select("g", "rank", (F.col("skip") + F.col("before")).alias("skip"), F.col("m").alias("n"), F.col("a").alias("lo"), F.col("z").alias("hi"))
        last, open_ = open_, written(open_.where(~((F.col("lo") < F.col("hi")) & (F.col("n") > few))).unionByName(inner), "ranks")
        forget(last)
    sort = open_.where("lo < hi")
    placed = held.join(sort.select(*by, "skip").distinct(), "g").where("v between lo and hi").withColumn("rank", F.col("skip") + F.row_number().over(Window.partitionBy(*by).orderBy("v")) - 1)
    known = open_.where("lo = hi").select("g", "rank", F.col("lo").alias("v")).unionByName(placed.join(sort.select("g", "rank", "lo", "hi"), ["g", "rank", "lo", "hi"]).select("g", "rank", "v"))
    found = known.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at")).join(sizes.withColumnRenamed("size", "n"), "g")

    def between(p):
        low, high, at = F.floor(place(p)), F.ceil(place(p)), F.col("at")
        return F.when(at[low] == at[high], at[low]).otherwise((high - place(p)) * at[low] + (place(p) - low) * at[high])

    return found.select(*[F.col("g")[k].alias(k) for k in group], *[between(p).alias(name) for name, p in wanted.items()])
