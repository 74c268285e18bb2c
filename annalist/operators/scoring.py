"""Scoring: rubric means, run metrics, leaderboards, verdicts, dispositions, and the judge's hook."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators import ranks


def exact(x, scale: int = 6) -> Column:
    """A double as a decimal: sums of it do not depend on their order."""
    return F.col(x).cast(f"decimal(28,{scale})") if isinstance(x, str) else x.cast(f"decimal(28,{scale})")


def mean(x, scale: int = 12) -> Column:
    return F.sum(exact(x, scale)).cast("double") / F.count(x if isinstance(x, str) else x)


def weight(value) -> Column:
    """A rubric's weight: not a number counts as 0, and 0 as 1."""
    w = F.coalesce(F.try_to_number(value, F.lit("999999.99")).cast("double") if isinstance(value, str) else value.cast("double"), F.lit(0.0))
    return F.when(w == 0, 1.0).otherwise(w)


def clip(x) -> Column:
    x = F.coalesce(x, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rubric(rows: DataFrame, key: list[str], w: Column, f: Column) -> DataFrame:
    """Sum of weight times fraction over sum of weights, by key."""
    terms = rows.select(*key, exact(w).alias("w"), exact(clip(f)).alias("f"))
    return terms.groupBy(*key).agg(F.sum((F.col("w") * F.col("f")).cast("decimal(28,6)")).cast("double").alias("a"), F.sum("w").cast("double").alias("b")).select(*key, (F.col("a") / F.col("b")).alias("score"))


def run_metrics(rows: DataFrame, key: list[str]) -> DataFrame:
    """score, exact (boolean), latency of each judged query: means and rates, percentiles of non-zero latencies (0 if there are none)."""
    found = rows.groupBy(*key).agg(F.count("*").alias("n"), mean("score").alias("accuracy_mean"), (F.count_if(F.col("exact")) / F.count("*")).alias("exact_match_rate"))
    return with_percentiles(found, rows.where("latency <> 0"), key, "latency", {"latency_p50": 0.5, "latency_p95": 0.95})


def with_percentiles(found: DataFrame, rows: DataFrame, key: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """found, a row for each key, with percentiles of a column of rows; 0 where a key has no value."""
    late = ranks.percentiles(rows, key, value, wanted)
    late = late.select(*[F.col(k).alias(f"_{k}") for k in key], *wanted)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return found.join(late, same, "left").select(*[found[c] for c in found.columns], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in wanted])


def leaderboard(scores: DataFrame, tier: str, system: str, category: str, categories: list[str]) -> DataFrame:
    """A row for each tier and system: mean, rank within the tier, and a column for each category."""
    total = scores.groupBy(tier, system).agg(mean("score").alias("accuracy_mean"))
    wide = scores.groupBy(tier, system).pivot(category, categories).agg(mean("score"))
    w = Window.partitionBy(tier).orderBy(F.desc("accuracy_mean"), system)
    return total.withColumn("rank", F.row_number().over(w)).join(wide, [tier, system])


def verdict_score(verdict: Column) -> Column:
    return F.when(verdict == "yes", 1.0).when(verdict == "partial", 0.5).otherwise(0.0)


def disposition(schema_ok: Column, evidence: Column, complete: Column, memorised: Column) -> Column:
    """The first reason to leave a question out, or pass."""
    return F.when(~schema_ok, "schema").when(evidence == 0, "no_evidence").when(~complete, "incomplete").when(memorised, "memorised").otherwise("pass")


def judge(rows: DataFrame, schema: str, verdicts: Callable | None = None) -> DataFrame:
    """Rows judged in batches by a function of pandas frames; without one, the dry run's rows: score 0, mode dry_run."""
    if verdicts is None:
        return rows.select("*", F.lit(0.0).alias("score"), F.lit("dry_run").alias("failure_mode"))

    def run(batches):
        for batch in batches:
            yield verdicts(batch)

    return rows.mapInPandas(run, schema)
