"""Incremental state: resume, last wins, merges, settled series, cheapest fits and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def remaining(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units that no checkpoint names."""
    return units.join(done.select(key).distinct(), key, "left_anti")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a maximum of structs, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    at = F.struct(*order, *[c for c in rest if c not in order])
    return rows.groupBy(*key).agg(F.max(at).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def patched(rows: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with the patches' non-null fields."""
    p = patches.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(p, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def settled(polls: DataFrame, key: list[str], order: str, count: str, stable: int, positive: bool = False) -> DataFrame:
    """The first poll of each key that ends `stable` equal counts in a row: runs by gaps and islands."""
    by = Window.partitionBy(*key).orderBy(order)
    rows = polls.where(F.col(count) > 0) if positive else polls
    rows = rows.withColumn("_new", F.coalesce((F.col(count) != F.lag(count).over(by)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(by))
    rows = rows.withColumn("run", F.row_number().over(Window.partitionBy(*key, "_island").orderBy(order)))
    return rows.where(F.col("run") >= stable).groupBy(*key).agg(F.min_by(F.struct(order, count), order).alias("f")).select(*key, F.col("f")[order].alias(order), F.col("f")[count].alias(count))


def first_fit(needs: DataFrame, key: str, need: str, tiers: DataFrame) -> DataFrame:
    """The cheapest tier (tier, cap, fee) that takes each need; fee -1 and tier null if none does. The tiers are a few rows."""
    fits = needs.join(tiers, F.col(need) <= F.col("cap"), "left")
    best = fits.groupBy(key, need).agg(F.min_by(F.struct("tier", "fee"), F.struct("fee", "cap")).alias("t"))
    return best.select(key, need, F.col("t.tier").alias("tier"), F.coalesce("t.fee", F.lit(-1)).alias("fee"))


def plan(profiles: DataFrame, sizes: DataFrame, budget: float) -> DataFrame:
    """Every system on every tier: its cost, and whether that is below the budget. Both sides are a few rows of parameters."""
    cost = F.col("calls") * F.col("artifacts") * F.col("price_in") + F.col("questions") * F.col("price_out")
    return profiles.crossJoin(sizes).withColumn("cost", cost).withColumn("included", F.col("cost") < budget)
