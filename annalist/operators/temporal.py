"""Bi-temporal facts: versions with half-open intervals, as-of slices, intervals as dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(log: DataFrame, key: list[str], valid_at: str, order: str) -> DataFrame:
    """A change log with invalid_at: when the next version of its key becomes valid; null for the last."""
    w = Window.partitionBy(*key).orderBy(valid_at, order)
    return log.withColumn("invalid_at", F.lead(valid_at).over(w))


def valid(at, since: str = "valid_at", until: str = "invalid_at") -> Column:
    """since <= at < until, an open end counting as later than all."""
    at = F.lit(at) if isinstance(at, str) else at
    return (F.col(since) <= at) & (F.col(until).isNull() | (F.col(until) > at))


def as_of(facts: DataFrame, valid_time=None, known_time=None) -> DataFrame:
    """What was valid at one time, as it was known at another."""
    if valid_time is not None:
        facts = facts.where(valid(valid_time))
    if known_time is not None:
        facts = facts.where(valid(known_time, "ingested_at", "expired_at"))
    return facts


def latest(log: DataFrame, key: list[str], valid_at: str, order: str, at) -> DataFrame:
    """The version of each key that holds at one time: of those not later the last, by a maximum of structs."""
    rest = [c for c in log.columns if c not in (*key, valid_at, order)]
    best = F.max(F.struct(valid_at, order, *rest)).alias("_v")
    return log.where(F.col(valid_at) <= at).groupBy(*key).agg(best).select(*key, *[F.col("_v")[c].alias(c) for c in (valid_at, order, *rest)])


def facts_bt(events: DataFrame, relations: DataFrame) -> DataFrame:
    """Four times a fact: superseding or reversing edges close validity, retroactive corrections close knowledge."""
    e = events.select(F.col("id").alias("fact_id"), F.col("decision").alias("value"), F.col("occurred_at").alias("valid_at"), F.coalesce("recorded_at", "occurred_at").alias("ingested_at"))
    closing = relations.where(F.col("relation").isin("supersedes", "reverses")).join(e.select(F.col("fact_id").alias("source"), F.col("valid_at").alias("closed")), "source")
    closed = closing.groupBy(F.col("target").alias("fact_id")).agg(F.min("closed").alias("invalid_at"), F.min_by("source", F.struct("closed", "source")).alias("superseded_by"))
    expiring = relations.where("relation = 'retroactively_corrected_by'").join(e.select(F.col("fact_id").alias("target"), F.col("ingested_at").alias("known")), "target")
    expired = expiring.groupBy(F.col("source").alias("fact_id")).agg(F.min("known").alias("expired_at"))
    return e.join(closed, "fact_id", "left").join(expired, "fact_id", "left")


def interval_lookup(rows: DataFrame, at: str, dimension: DataFrame, first: str, last: str, name: str, order: str) -> DataFrame:
    """rows with the name of the first interval that holds `at`, else the first of all. The dimension is expanded to an equi-join."""
    spread = dimension.select(F.explode(F.sequence(first, last)).alias(at), order, name).groupBy(at).agg(F.min_by(name, order).alias(name))
    default = dimension.agg(F.min_by(name, order).alias("_default"))
    return rows.join(spread, at, "left").crossJoin(F.broadcast(default)).withColumn(name, F.coalesce(name, "_default")).drop("_default")
