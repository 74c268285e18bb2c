"""Spines and allocations: lifetimes as rows, grids, ids in sequence, gaps filled in order, deterministic draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alive(rows: DataFrame, first, last, name: str, end: Column | int) -> DataFrame:
    """A row for each step that a lifetime covers, from first to last (null: to the end). Lifetimes that end before they begin give none."""
    until = F.least(F.coalesce(last, F.lit(end) if isinstance(end, int) else end), F.lit(end) if isinstance(end, int) else end)
    return rows.where(first <= until).withColumn(name, F.explode(F.sequence(first, until)))


def sequence_ids(rows: DataFrame, key: list[str], order: list[str], prefix: Column, name: str = "id") -> DataFrame:
    """prefix-001, prefix-002 and so on within each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn(name, F.concat(prefix, F.format_string("-%03d", n)))


def neighbours(rows: DataFrame, at: str, value: str, name: str, reach: int = 1) -> DataFrame:
    """rows with the sum of value over the rows at most `reach` steps away, the row itself left out; 0 if there are none.

    Each row is given to the steps around it and summed there: an equi-join, no window over all rows.
    """
    near = rows.select(F.explode(F.array(*[F.col(at) + d for d in range(-reach, reach + 1) if d])).alias(at), F.col(value).alias("_v")).groupBy(at).agg(F.sum("_v").alias("_near"))
    return rows.join(near, at, "left").withColumn(name, F.coalesce("_near", F.lit(0).cast(rows.schema[value].dataType))).drop("_near")


def fill_gaps(gaps: DataFrame, category: str, gap: str, total: int) -> DataFrame:
    """What each category is asked for: the largest gap first, an even share of what is left, at least one, until it is spent.

    The categories are a few rows: the fold is over one sorted array of them. Equal gaps go by category.
    """
    item = F.struct((-F.col(gap)).cast("bigint").alias("neg"), F.col(category).alias("category"))
    rows = gaps.where(F.col(gap) > 0).agg(F.array_sort(F.collect_list(item)).alias("g"), F.least(F.lit(total), F.sum(gap)).cast("bigint").alias("total"))
    start = F.struct(F.col("total").alias("left"), F.array().cast("array<struct<category:string,ask:bigint>>").alias("out"))

    def take(s, x):
        share = F.greatest(F.lit(1).cast("bigint"), F.floor(s["left"] / F.size("g")))
        ask = F.least(-x["neg"], share, s["left"])
        return F.struct((s["left"] - ask).alias("left"), F.concat(s["out"], F.array(F.struct(x["category"].cast("string").alias("category"), ask.alias("ask")))).alias("out"))

    return rows.select(F.explode(F.aggregate("g", start, take)["out"]).alias("r")).select(F.col("r.category").alias(category), F.col("r.ask").alias("ask")).where("ask > 0")


def draw(rows: DataFrame, key: list[str], identity: str, n: int, seed: int) -> DataFrame:
    """n rows of each key in the order of a seeded digest of their identity: a sampling operator, the same on every run."""
    by = F.md5(F.concat(F.col(identity).cast("string"), F.lit(f":{seed}")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(by, identity))).where(F.col("rank") <= n)


def grid(rows: DataFrame, **axes) -> DataFrame:
    """A row for each value of each axis, in the order of the axes."""
    for name, values in axes.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows


def repeated(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row as often as it says, numbered from 1; none for 0."""
    return rows.withColumn(name, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))


def batches(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """rows numbered from 0 within their key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def capped(rows: DataFrame, key: list[str], order: list[str], n: int, name: str) -> DataFrame:
    """The first n rows of each key, as the feature is."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= n)


def ranked(rows: DataFrame, key: list[str], order: list[str], score: str, n: int) -> DataFrame:
    """The n best of each key by score, ties by order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), *order))).where(F.col("rank") <= n)


def tenure(number: Column, first: int, span: int, last: int) -> list[Column]:
    """first_year and last_year from a running number: starts go round `span` years, stays last one to four years, none beyond `last`."""
    start = (F.lit(first) + number % span).cast("int")
    return [start.alias("first_year"), F.least(start + 1 + (number % 4).cast("int"), F.lit(last)).alias("last_year")]


def slots_of(event: Column, people: Column, n: int, primary: list[str], secondary: list[str]) -> Column:
    """An event's n slots: the first is primary, the others go round the secondary genres, authors go round its people."""
    genre = lambda i: F.when(i == 0, F.lit(primary[0])).otherwise(F.get(F.array(*map(F.lit, secondary)), i % len(secondary)))
    slot = lambda i: F.struct(F.concat(F.lit("ART-"), event, F.format_string("-%03d", i + 1)).alias("slot_id"), genre(i).alias("genre"), F.when(i == 0, "primary").otherwise("secondary").alias("role"), F.get(people, i % F.size(people)).alias("author"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), slot)


def drawn(key, what: str, choices: list, seed: int) -> Column:
    """One of some choices by a digest of a key, of what is drawn and of a seed."""
    n = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string") if isinstance(key, str) else key, F.lit(what), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.element_at(F.array(*map(F.lit, choices)), (n % len(choices) + 1).cast("int"))


def doc_plan(rows: DataFrame, key: str, types: list[str], topics: list[str], years: list[int], seed: int = 44) -> DataFrame:
    """key, type, topic, year, month: what each row's document is to be, drawn by seeded digests."""
    return rows.select(key, drawn(key, "type", types, seed).alias("type"), drawn(key, "topic", topics, seed).alias("topic"), drawn(key, "year", years, seed).alias("year"), drawn(key, "month", list(range(1, 13)), seed).alias("month"))
