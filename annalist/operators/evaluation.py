"""Questions, submissions, validation reports and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import rules as R
from annalist.functions import text as T
from annalist.operators import scoring, state
from annalist.sources.shared import written


def questions(raw: DataFrame) -> DataFrame:
    """Raw questions in one shape: either name of the evidence, empty lists for null ones, what their category says, and their as-of date.

    raw: id, category, metadata and ground_truth_answer as JSON text, evidence_artefact_ids or evidence_artifact_ids, paraphrases, and more.
    """
    none = F.array().cast("array<string>")
    names = [c for c in ("evidence_artefact_ids", "evidence_artifact_ids") if c in raw.columns]
    made = {
        "evidence_artifact_ids": F.coalesce(*names, none), "paraphrases": F.coalesce("paraphrases", none), "metadata": F.coalesce("metadata", F.lit("{}")), "ground_truth_answer": F.coalesce("ground_truth_answer", F.lit("{}")),
        "public_category": R.public_category("category"), "capabilities_required": R.capabilities("category"), "is_emergent": R.is_emergent("category", "metadata"), "as_of": R.question_as_of("metadata", "ground_truth_answer"),
    }
    return raw.withColumns(made).drop("evidence_artefact_ids")


def question_stats(rows: DataFrame) -> DataFrame:
    """kind, key, n: counts by category, public category and difficulty, of emergent ones, of those that need time, and of all; one pass."""
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    each = [entry(k, F.col(c)) for k, c in (("category", "category"), ("public_category", "public_category"), ("difficulty", "difficulty"))]
    each += [F.when(F.col("is_emergent"), entry("emergent", F.lit("true"))), F.when(F.array_contains("capabilities_required", "temporal"), entry("temporal", F.lit("true"))), entry("questions", F.lit("all"))]
    return rows.select(F.explode(F.array_compact(F.array(*each))).alias("e")).groupBy("e.kind", "e.key").agg(F.count("*").alias("n"))


def submission(lines: DataFrame, order: str) -> DataFrame:
    """Predictions by question_id, the last line of each; a line without question_id or answer_text fails the job."""
    bad = F.col("question_id").isNull() | F.col("answer_text").isNull()
    checked = lines.withColumn("question_id", F.when(bad, F.raise_error(F.lit("submission record without question_id or answer_text"))).otherwise(F.col("question_id")))
    return state.last_wins(checked, ["question_id"], [order])


def answered(ids: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every question with its answer, empty if there is no prediction."""
    p = predictions.select(F.col("question_id").alias("id"), "answer_text")
    return ids.join(p, "id", "left").withColumn("answer_text", F.coalesce("answer_text", F.lit("")))


def validated(ids: DataFrame, predictions: DataFrame) -> DataFrame:
    """kind, n: questions, predictions, questions missing, predictions unknown; one full join."""
    both = ids.select(F.col("id"), F.lit(1).alias("q")).join(predictions.select(F.col("question_id").alias("id"), F.lit(1).alias("p")), "id", "full")
    n = both.agg(F.count("q").alias("questions"), F.count("p").alias("predictions"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("q").isNull()).alias("unknown"))
    return n.select(F.explode(F.create_map(*[x for c in n.columns for x in (F.lit(c), F.col(c))])).alias("kind", "n"))


def with_prior(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows with the decision and date of the event that each corrects, null if none or none such.

    The key is a struct with a hash of the row's own id where it corrects none, so that such rows do not meet in one task;
    two keys would not do, as the planner takes one of them for a constant.
    """
    key = lambda of, spread: F.struct(F.col(of).alias("of"), spread.cast("bigint").alias("spread")).alias("_key")
    prior = events.where("id is not null").select(key("id", F.lit(0)), F.coalesce("decision", F.lit("")).alias("prior_decision"), F.coalesce("occurred_at", F.lit("")).alias("prior_occurred_at"))
    return rows.withColumn("_key", key("corrects_event_id", F.when(F.col("corrects_event_id").isNull(), F.xxhash64("id")).otherwise(0))).join(prior, "_key", "left").drop("_key")


def significant(events: DataFrame, people: str, least: int, n: int | None = None) -> DataFrame:
    """Events with a decision and `least` people, with their rank by people and alternatives; the first n if given.

    Ranks of all rows need one order of all: they come from a sort by ranges and counts of each partition, not from one task.
    """
    rows = events.where((F.trim(F.coalesce("decision", F.lit(""))) != "") & (F.size(people) >= least)).withColumn("_score", F.size(people) + F.greatest(F.size("alternatives_considered"), F.lit(0)))
    return numbered(rows, [F.desc("_score"), F.col("id")], "rank", n).drop("_score")


def numbered(rows: DataFrame, order: list, name: str, n: int | None = None) -> DataFrame:
    """rows with their place (from 1) in one order of all; the first n if given. A sort by ranges, then places within partitions and offsets by partition."""
    if n is not None:
        rows = rows.orderBy(*order).limit(n)
    ranged = rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    held = written(ranged, "numbered")
    sizes = held.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = sizes.select("_p", "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row a partition
    return held.join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.col("_i") - F.col("_first") + 1).cast("bigint" if n is None else "int")).drop("_p", "_i", "_first", "_before")


def question_ids(rows: DataFrame, order: list) -> DataFrame:
    """rows with ids Q-0001, Q-0002 and so on in one order of all."""
    return numbered(rows, order, "_place").withColumn("question_id", F.format_string("Q-%04d", "_place")).drop("_place")


def answer_context(text, most: int = 40_000) -> Column:
    """What an answerer gets of a retrieved text: its beginning, or a line that there is none. The limit is the feature."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.trim(F.coalesce(t, F.lit(""))) == "", "(no context was retrieved)").otherwise(F.substring(t, 1, most))


def facets_covered(facets: DataFrame, exhibits: DataFrame, least: float = 0.8) -> DataFrame:
    """By question: facets, those that any of their evidence exhibits, and whether `least` of them are covered; no facets pass nothing.

    facets: question, facet, ids, all_ids; exhibits: question, facet, slot_id of evidence that shows the facet.
    """
    each = facet_evidence(facets).select("question", "facet", F.explode_outer("ids").alias("slot_id"))
    shown = each.join(exhibits.withColumn("_yes", F.lit(True)), ["question", "facet", "slot_id"], "left").groupBy("question", "facet").agg(F.coalesce(F.bool_or("_yes"), F.lit(False)).alias("covered"))
    n = shown.groupBy("question").agg(F.count("*").alias("facets"), F.count_if("covered").alias("covered"))
    return n.withColumn("fraction", R.rounded(R.share("covered", "facets"), 3)).withColumn("complete", R.share("covered", "facets") >= least)


def reports(rows: DataFrame) -> DataFrame:
    """slot_id, score, missing of artefacts (slot_id, verdicts array): yes counts 1, partial a half, over the number of facts."""
    count = lambda v: F.size(F.filter("verdicts", lambda x: x == v))
    return rows.select("slot_id", R.share(count("yes") + 0.5 * count("partial"), F.size("verdicts")).alias("score"), count("no").alias("missing"))


def question_substrate(evidence: DataFrame, found: DataFrame, key: list[str], least: float = 0.7) -> DataFrame:
    """By question: pieces of evidence, those with a report, their mean score (0 if none), and how many are below `least` with facts missing."""
    rows = evidence.join(found, "slot_id", "left")
    deficient = F.count_if((F.col("score") < least) & (F.col("missing") > 0))
    mean = F.coalesce(F.round(F.avg(F.col("score").cast("decimal(20,9)")), 6).cast("double"), F.lit(0.0))
    return rows.groupBy(*key).agg(F.count("*").alias("evidence"), F.count("score").alias("present"), mean.alias("substrate"), deficient.alias("deficient"))


def on_disk(rows: DataFrame, key: str, evidence: str, index: DataFrame) -> DataFrame:
    """rows with the evidence ids that the index has; rows that are left with none go. Order and repeats of ids do not count."""
    each = rows.select(key, F.explode(F.array_distinct(evidence)).alias("slot_id")).join(index.select("slot_id").distinct(), "slot_id", "left_semi")
    kept = each.groupBy(key).agg(F.array_sort(F.collect_list("slot_id")).alias(evidence))
    return rows.drop(evidence).join(kept, key)


def facet_evidence(facets: DataFrame) -> DataFrame:
    """(question, facet, ids, all_ids) with the facet's own evidence, or all of the question's where it has none."""
    return facets.withColumn("ids", F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.col("all_ids"))).drop("all_ids")


def counter(key: str, n: str) -> Column:
    """A map of counts, by key in order."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(n)))))


def records(rows: DataFrame, key: list[str]) -> DataFrame:
    """The metric record of each run: means and rates to four digits, percentiles of non-zero latencies to two, cost to six.

    rows: score, exact_match, faithful, latency_ms, cost_usd of each judged query; semantic_score where there is one.
    """
    rate = lambda c: R.rounded(F.count_if(F.col(c)) / F.count("*"), 4)
    mean = lambda c, n: R.rounded(scoring.mean(c, 9), n)
    semantic = mean("semantic_score", 4) if "semantic_score" in rows.columns else F.max(F.lit(None).cast("double"))
    found = rows.groupBy(*key).agg(
        F.count("*").alias("n_questions"), mean("score", 4).alias("accuracy_mean"), rate("exact_match").alias("exact_match_rate"), semantic.alias("semantic_mean"), rate("faithful").alias("faithfulness_rate"),
        R.rounded(1 - F.count_if(F.col("faithful")) / F.count("*"), 4).alias("hallucination_rate"), mean("cost_usd", 6).alias("cost_per_query_usd"),
    )
    wanted = {"latency_ms_p50": 0.5, "latency_ms_p95": 0.95}
    found = scoring.with_percentiles(found, rows.where("latency_ms <> 0"), key, "latency_ms", wanted)
    return found.withColumns({c: F.round(c, 2) for c in wanted})


def breakdown(rows: DataFrame, key: list[str], by: str, name: str, default: str | None = None) -> DataFrame:
    """Mean scores to four digits by one more column, as a map of each run; rows without it are left out, or counted under a default."""
    rows = rows.where(F.col(by).isNotNull()) if default is None else rows.withColumn(by, F.coalesce(by, F.lit(default)))
    mean = rows.groupBy(*key, by).agg(R.rounded(scoring.mean("score", 9), 4).alias("_m"))
    return mean.groupBy(*key).agg(counter(by, "_m").alias(name))


def full_records(rows: DataFrame, key: list[str]) -> DataFrame:
    """records with maps by public category, by difficulty and of failure modes: one wide aggregate and three that meet it by key."""
    modes = rows.groupBy(*key, "failure_mode").agg(F.count("*").alias("_n")).groupBy(*key).agg(counter("failure_mode", "_n").alias("failure_modes"))
    out = records(rows, key)
    for part in (breakdown(rows, key, "public_category", "by_category"), breakdown(rows, key, "difficulty", "by_difficulty", "unspecified"), modes):
        out = out.join(part, key, "left")
    return out


def best_paraphrase(paraphrases: Column, answer: Column) -> Column:
    """The paraphrase that leaks least of the answer; of several the longest, then the first by letters."""
    ranked = F.array_sort(F.transform(paraphrases, lambda p: F.struct(T.leak(p, answer).alias("leak"), (-F.length(p)).alias("n"), p.alias("p"))))
    return F.get(ranked, F.lit(0))["p"]


def rated(rows: DataFrame, key: list[str], before: str, after: str) -> DataFrame:
    """Means before and after, and their difference, by key."""
    return rows.groupBy(*key).agg(scoring.mean(before).alias("old"), scoring.mean(after).alias("new"), (scoring.mean(after) - scoring.mean(before)).alias("delta"))
