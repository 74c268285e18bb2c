"""Tables of runs: the whole leaderboard, old against new judgements, totals of plans, counts of a corpus, pinned versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import rules as R
from annalist.operators import scoring

#: Columns of a leaderboard: metrics with their headings. Fixed values.
METRICS = {
    "accuracy_mean": "Acc", "exact_match_rate": "EM", "semantic_mean": "Sem", "hallucination_rate": "Halluc", "latency_ms_p50": "p50ms",
    "latency_ms_p95": "p95ms", "cost_per_query_usd": "$/q", "tokens_stored": "Tok.stored", "ingest_seconds": "Ingest.s",
}
CATEGORIES = [name for name, _ in R.CATEGORIES.values()]


def board(records: DataFrame, ingests: DataFrame | None = None) -> DataFrame:
    """tier, rank, system (with its version, and a mark of dry runs), the nine metrics and the eight categories, null where a run lacks one.

    records: tier, system, system_version, dry_run, metrics and by_category (a map); ingests: tier, system, tokens_stored, ingest_seconds.
    """
    rows = records if ingests is None else records.join(ingests, ["tier", "system"], "left")
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("double")
    mark = F.when(F.coalesce(have("dry_run").cast("boolean"), F.lit(False)), " [dry-run]").otherwise("")
    name = F.concat("system", F.lit(" ("), F.coalesce(have("system_version").cast("string"), F.lit("?")), F.lit(")"), mark)
    w = Window.partitionBy("tier").orderBy(F.coalesce("accuracy_mean", F.lit(0.0)).desc(), "system")
    return rows.select("tier", F.row_number().over(w).alias("rank"), name.alias("system"), *[have(m).alias(m) for m in METRICS], *[F.col("by_category")[c].alias(c) for c in CATEGORIES])


def matrix(old: DataFrame, new: DataFrame, systems: list[str]) -> DataFrame:
    """A row for each question that either side has, and one of means (question null): per system old, new and delta. Sides: question, system, score.

    A question that a system has on one side only has no delta, and the means are each side's own.
    """
    both = old.select("question", "system", F.col("score").alias("old")).join(new.select("question", "system", F.col("score").alias("new")), ["question", "system"], "full")
    mean = lambda c: scoring.mean(c)
    rows = both.groupBy("question").pivot("system", systems).agg(F.first("old").alias("old"), F.first("new").alias("new"), F.first(F.col("new") - F.col("old")).alias("delta"))
    means = both.withColumn("question", F.lit(None).cast(both.schema["question"].dataType)).groupBy("question").pivot("system", systems).agg(mean("old").alias("old"), mean("new").alias("new"), (mean("new") - mean("old")).alias("delta"))
    return rows.unionByName(means)


def totals(plan: DataFrame) -> DataFrame:
    """tier (null for all), cost of what is included, included and excluded systems in order. plan: tier, system, cost, included."""
    listed = lambda of: F.array_sort(F.collect_set(F.when(of, F.col("system"))))
    kept = F.coalesce(F.col("included"), F.lit(False))
    cost = F.coalesce(F.sum(F.when(kept, scoring.exact("cost", 9))), F.lit(0)).cast("double")
    return plan.rollup("tier").agg(F.grouping("tier").alias("_all"), cost.alias("cost"), listed(kept).alias("included"), listed(~kept).alias("excluded")).drop("_all")


def overview(artifacts: DataFrame) -> DataFrame:
    """One row: artifacts, how many have a time, characters, a quarter of them as tokens, and counts by type and by role. Null types and roles count as "null".

    Histograms are group-bys of their own, so that no task holds more than the kinds there are.
    """
    base = artifacts.agg(F.count("*").alias("n_artifacts"), F.count("timestamp").alias("n_dated"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).cast("bigint").alias("total_chars"))
    base = base.withColumn("approx_tokens", F.expr("total_chars div 4"))
    kind = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    each = artifacts.groupBy(kind("source_type").alias("t"), kind("role").alias("r")).agg(F.count("*").alias("n"))
    for column, name in (("t", "by_source_type"), ("r", "by_role")):
        counts = each.groupBy(column).agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))
        base = base.crossJoin(counts)  # a row each
    return base


def drifted(runs: DataFrame, pins: dict[str, str]) -> DataFrame:
    """system, pinned, running: systems that ran in another version than the pinned one; unknown versions and systems without a pin are none."""
    pinned = F.create_map(*[F.lit(x) for pair in pins.items() for x in pair])[F.col("system")] if pins else F.lit(None).cast("string")
    rows = runs.select("system", pinned.alias("pinned"), F.coalesce("system_version", F.lit("unknown")).alias("running")).distinct()
    return rows.where(F.col("pinned").isNotNull() & ~F.contains(F.lower("running"), F.lit("unknown")) & (F.col("pinned") != F.col("running")))


def usable_line(text) -> Column:
    """The first line of a reply that says something: neither blank nor a heading nor a fence; empty if there is none."""
    lines = F.transform(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    good = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("```")))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def hardest(candidates: DataFrame, n: int | None = None) -> DataFrame:
    """Candidates with their place, the longest chains first, equal ones by root; the first n if given (a run's limit)."""
    from annalist.operators import evaluation

    rows = evaluation.numbered(candidates, [F.desc("chain_length"), F.col("root")], "place", n)
    return rows.withColumn("place", F.col("place").cast("bigint"))


def year_contexts(years: DataFrame, customers: DataFrame, events: DataFrame, seed: int = 0) -> DataFrame:
    """year, context: the theme, up to ten customers of the year by id and up to eight topics of its events, drawn by a seeded digest.

    years: year, theme; customers: id, name, joined, left (years); events: id, occurred_at, summary. A customer meets the years
    of its lifetime only, topics are thinned to eight a year before they are gathered.
    """
    span = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    c = customers.crossJoin(span)  # one row
    c = c.where(R.active("joined", "left", F.col("hi")) | (F.coalesce(F.col("left").try_cast("int"), F.col("hi")) >= F.col("lo")))
    alive = c.where("joined is not null").select("id", "name", F.explode(F.sequence(F.greatest("joined", "lo"), F.greatest(F.greatest("joined", "lo"), F.least(F.coalesce("left", "hi"), "hi")))).alias("year")).join(years.select("year"), "year", "left_semi")
    alive = alive.join(customers.select("id", "joined", "left"), "id").where((F.col("year") >= F.col("joined")) & (F.col("left").isNull() | (F.col("left") >= F.col("year"))))
    first = lambda rows, order, n: rows.withColumn("_i", F.row_number().over(Window.partitionBy("year").orderBy(*order))).where(F.col("_i") <= n)
    names = first(alive, ["id"], 10).groupBy("year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "name"))), lambda x: x["name"]), ", ").alias("names"))
    topics = events.select(F.substring(F.col("occurred_at").cast("string"), 1, 4).try_cast("int").alias("year"), F.substring(F.trim("summary"), 1, 90).alias("topic"), F.crc32(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))).alias("_d"), "id").where("topic <> ''")
    drawn = first(topics, ["_d", "id"], 8).groupBy("year").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "topic"))), lambda x: F.concat(F.lit("    - "), x["topic"])).alias("topics"))
    head = F.concat(F.lit("- Year "), F.col("year").cast("string"), F.when(F.coalesce("theme", F.lit("")) != "", F.concat(F.lit(": "), F.col("theme"))).otherwise(""))
    lines = F.concat(F.array(head, F.concat(F.lit("- Customers: "), F.col("names")), F.when(F.size("topics") > 0, F.lit("- At work on:"))), F.coalesce("topics", F.array().cast("array<string>")))
    return years.join(names, "year", "left").join(drawn, "year", "left").select("year", F.array_join(F.array_compact(lines), "\n").alias("context"))


def windows(years: DataFrame, eras: DataFrame, teams: list[str], size: str, quarters: tuple[int, ...] = (2, 4)) -> DataFrame:
    """year, quarter, team: the parts of a history that a size covers. years: year; eras: start and end ('YYYY-MM'), discipline_level.

    small: the second quarter of the first inner year in an era of medium or high discipline (else the middle one), first team;
    medium: all quarters and teams of the middle year; large: some quarters and all teams of all years but that.
    """
    ordered = years.select("year").distinct().withColumn("_i", F.row_number().over(Window.orderBy("year")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))  # a row a year
    middle = F.col("_i") == F.floor(F.col("_n") / 2)
    team, quarter = (lambda xs: F.explode(F.array(*[F.lit(x) for x in xs])))(teams), lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    if size == "medium":
        return ordered.where(middle).select("year", quarter([1, 2, 3, 4]).alias("quarter")).select("*", team.alias("team"))
    if size == "large":
        return ordered.where(~middle).select("year", quarter(quarters).alias("quarter")).select("*", team.alias("team"))
    inner = ordered.where((F.col("_n") <= 2) | ((F.col("_i") > 0) & (F.col("_i") < F.col("_n") - 1)))
    inner = inner.withColumn("_j", F.row_number().over(Window.orderBy("year")) - 1).withColumn("_m", F.count("*").over(Window.partitionBy()))
    strict = eras.where(F.col("discipline_level").isin("medium", "high")).select(F.substring("start", 1, 4).cast("int").alias("_a"), F.substring("end", 1, 4).cast("int").alias("_z"))
    good = strict.select(F.explode(F.sequence("_a", "_z")).alias("year")).distinct().withColumn("_good", F.lit(0))
    rank = F.coalesce("_good", F.when(F.col("_j") == F.floor(F.col("_m") / 2), 1).otherwise(2))
    return inner.join(good, "year", "left").groupBy().agg(F.min_by("year", F.struct(rank, "year")).alias("year")).where("year is not null").select("year", F.lit(2).alias("quarter"), F.lit(teams[0]).alias("team"))
