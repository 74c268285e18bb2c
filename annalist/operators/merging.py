"""Patches of records, scopes and their counts, breakers, draws with replacement, mentions by containment, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_map(old, new) -> Column:
    """Two maps as one; of a key in both the new value holds. A null map is an empty one."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (old, new))
    left = F.map_filter(a, lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False)))
    return F.coalesce(F.map_concat(left, b), b, a)


def patch(rows: DataFrame, patches: DataFrame, key: str, plain: list[str], maps: list[str], stash: str | None = None) -> DataFrame:
    """rows with the patches' fields: plain ones replaced where the patch has a value, maps merged key by key.

    stash: the column that keeps the old value of the first plain field where the patch gives another one.
    """
    p = patches.select(key, *[F.col(c).alias(f"_{c}") for c in (*plain, *maps)])
    joined = rows.join(p, key, "left")
    out = [F.coalesce(f"_{c}", c).alias(c) if c in plain else merged_map(c, f"_{c}").alias(c) if c in maps else F.col(c) for c in rows.columns]
    if stash:
        first = plain[0]
        out.append(F.when(F.col(f"_{first}").isNotNull() & ~F.col(f"_{first}").eqNullSafe(F.col(first)), F.col(first)).alias(stash))
    return joined.select(*out)


def unknown(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Keys of patches that no row has."""
    return patches.select(key).distinct().join(rows.select(key), key, "left_anti")


def without(ids, gone) -> Column:
    """An array of ids less those that another array names, in order; null in either counts as empty."""
    none = F.array().cast("array<string>")
    return F.filter(F.coalesce(ids, none), lambda x: ~F.array_contains(F.coalesce(gone, none), x))


def corrected(questions: DataFrame, fixes: DataFrame) -> DataFrame:
    """questions (id, evidence_artifact_ids, status, rubric) with their fixes (id, phantoms, status, rubric): phantom evidence dropped, status and rubric replaced where the fix has one."""
    f = fixes.select("id", F.col("phantoms").alias("_gone"), F.col("status").alias("_status"), F.col("rubric").alias("_rubric"))
    rows = questions.join(f, "id", "left")
    new = {"evidence_artifact_ids": without(F.col("evidence_artifact_ids"), F.col("_gone")), "status": F.coalesce("_status", "status"), "rubric": F.coalesce("_rubric", "rubric")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in questions.columns])


def scope_counts(rows: DataFrame, scopes: DataFrame, key: str) -> DataFrame:
    """How many rows each scope holds, 0 for those that hold none, and whether it is clean."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return scopes.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).withColumn("clean", F.col("n") == 0)


def reset(rows: DataFrame, key: str, scope) -> DataFrame:
    """rows without those of a scope."""
    return rows.where(~F.col(key).eqNullSafe(F.lit(scope)))


def steady(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Scopes with their counts at query time and after the run, and whether they agree: a scope that one of them lacks holds 0."""
    both = before.select(key, F.col("n").alias("at_query")).join(after.select(key, F.col("n").alias("after_run")), key, "full")
    rows = both.select(key, F.coalesce("at_query", F.lit(0)).alias("at_query"), F.coalesce("after_run", F.lit(0)).alias("after_run"))
    return rows.withColumn("valid", (F.col("at_query") == F.col("after_run")) & (F.col("at_query") > 0))


def broken(calls: DataFrame, key: list[str], order: list[str], empty: Column, limit: int) -> DataFrame:
    """Where a breaker opens: the first call of each key that ends `limit` empty answers in a row."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = calls.withColumn("_ok", (~empty).cast("int")).withColumn("_run", F.sum("_ok").over(w))
    rows = rows.withColumn("_n", F.count_if(F.col("_ok") == 0).over(Window.partitionBy(*key, "_run").orderBy(*order)))
    return rows.where(F.col("_n") >= limit).groupBy(*key).agg(F.min(F.struct(*order)).alias("_f")).select(*key, *[F.col("_f")[c].alias(c) for c in order])


def beyond(rows: DataFrame, key: list[str], order: list[str], target: int, seed: int) -> DataFrame:
    """Every row once, then draws with replacement until `target` rows of each key: round r takes the row that a seeded digest names.

    `round` is 0 for the rows themselves. Draws are a join on the row's number, so no key's rows meet in one task but to be numbered.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    numbered = rows.withColumn("_i", F.row_number().over(w) - 1)
    sizes = numbered.groupBy(*key).agg(F.count("*").alias("_size"))
    draws = sizes.where(F.col("_size") < target).select(*key, "_size", F.explode(F.sequence(F.lit(1), (F.lit(target) - F.col("_size")).cast("int"))).alias("round"))
    pick = F.pmod(F.crc32(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.col("round").cast("string"), F.lit(str(seed)))), F.col("_size")).cast("int")
    drawn = draws.withColumn("_i", pick).drop("_size").join(numbered, [*key, "_i"])
    return numbered.withColumn("round", F.lit(0)).unionByName(drawn).drop("_i")


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, order: str) -> DataFrame:
    """key and the first of names, by order, that its text contains; null if none does. A key tells one text.

    The names' leading words meet the texts' words by an equi-join of keys alone; only the candidates that it finds fetch their
    text, once each, and are compared. So texts are neither crossed with names nor copied for their words.
    """
    lead = lambda c: F.regexp_extract(F.lower(c), r"([\p{L}\p{N}]+)", 1)
    n = names.where(F.coalesce(name, F.lit("")) != "").select(F.col(name).alias("_name"), F.col(order).alias("_order"), lead(F.col(name)).alias("_word"))
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))).alias("_word"))
    few = words.join(n, "_word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_order", "_name"))).alias("_names"))
    return texts.join(few, key, "left").select(key, F.get(F.filter("_names", lambda x: F.contains(F.col(text), x["_name"])), F.lit(0))["_name"].alias("mention"))


def coverage(events: DataFrame) -> DataFrame:
    """kind, key, n: events by target category and by year of four digits, nulls and others left out; one pass."""
    year = F.regexp_extract("occurred_at", "^([0-9]{4})", 1)
    entry = lambda kind, k: F.when(F.coalesce(k, F.lit("")) != "", F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    rows = events.select(F.explode(F.array_compact(F.array(entry("category", F.col("category_target")), entry("year", year)))).alias("e"))
    return rows.groupBy("e.kind", "e.key").agg(F.count("*").alias("n"))


def last_numbers(ids: DataFrame, column: str = "id") -> DataFrame:
    """The largest running number of each year in ids like EV-2020-17; ids of another form are left out."""
    part = lambda i: F.regexp_extract(column, r"^EV-([0-9]{4})-([0-9]+)", i)
    return ids.where(part(1) != "").groupBy(part(1).cast("int").alias("year")).agg(F.max(part(2).cast("bigint")).alias("last"))


def targets(rows: DataFrame, flag: str, wanted: dict[bool, int]) -> DataFrame:
    """Rows by a flag (null counts as false) against what is wanted: flag, n, short."""
    n = rows.groupBy(F.coalesce(flag, F.lit(False)).alias(flag)).agg(F.count("*").alias("n"))
    want = rows.sparkSession.createDataFrame(list(wanted.items()), f"{flag} boolean, wanted bigint")
    return want.join(n, flag, "left").select(flag, F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.col("wanted") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("short"))


def category_needs(questions: DataFrame) -> DataFrame:
    """Capabilities that any question of a category needs."""
    return questions.groupBy("public_category").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("capabilities_required")))).alias("needs"))


def bullets(rows: DataFrame, key: list[str], order: list[str], line: Column, empty: str = "(none)") -> DataFrame:
    """Each key's lines as one text of bullets, in order; lines that are null are left out."""
    item = F.struct(*order, F.concat(F.lit("- "), line).alias("_line"))
    listed = F.filter(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_line"]), lambda x: x.isNotNull())
    return rows.groupBy(*key).agg(listed.alias("_l")).select(*key, F.when(F.size("_l") == 0, empty).otherwise(F.array_join("_l", "\n")).alias("block"))


def judge_prompt(text, truth, rubric, answer, emergent) -> Column:
    """What a judge is asked: question, ground truth and rubric as JSON, the answer's first 6,000 characters.

    rubric: structs of id, criterion, fail_criterion and fail_if; a missing id is sub1, sub2 and so on by its place.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    blank = F.lit("")
    points = F.transform(c(rubric), lambda p, i: F.struct(F.coalesce(p["id"], F.concat(F.lit("sub"), (i + 1).cast("string"))).alias("id"), F.coalesce(p["criterion"], blank).alias("criterion"), F.coalesce(F.nullif(p["fail_criterion"], blank), p["fail_if"], blank).alias("fail_criterion")))
    note = F.when(c(emergent), "The truth is a pattern that no one wrote down; a later formal version of it fails its points.\n").otherwise("")
    return F.concat(F.lit("Question:\n"), c(text), F.lit("\n"), note, F.lit("\nTruth:\n"), F.coalesce(c(truth), F.lit("{}")), F.lit("\n\nPoints:\n"), F.to_json(points), F.lit("\n\nAnswer:\n"), F.substring(F.coalesce(c(answer), blank), 1, 6000), F.lit("\n\nReply with JSON: subpoint_scores, exact_match, semantic_score, faithful, failure_mode, rationale."))


def front_matter(fields: dict[str, Column], body: Column) -> Column:
    """A text after a block of `name: value` lines between dashes; fields without a value are left out."""
    lines = F.concat_ws("\n", *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()])
    return F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n"), F.coalesce(body, F.lit("")))


def appended(text, header: str, body) -> Column:
    """A text with a section after a rule; an empty text is the section alone."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    section = F.concat(F.lit(f"## {header}\n\n"), c(body))
    return F.when(F.coalesce(c(text), F.lit("")) == "", section).otherwise(F.concat(F.rtrim(c(text)), F.lit("\n\n---\n\n"), section))
