"""Queries of patches, scopes, breakers, draws, mentions, coverage and prompts, with their SQL. Tables stand for what evaluation says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators import evaluation, merging
from annalist.plans.evaluation import _NEEDS, _QUESTIONS, _CATEGORY, questions
from annalist.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *tables: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(*[table(spark, folder, t) for t in tables])
        ORACLES[f.__name__] = sql
        return f

    return register


def s(x):
    return (F.col(x) if isinstance(x, str) else x).cast("string")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_custkey ELSE c_name END AS text, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS old_text,
    CASE WHEN c_custkey % 3 = 0 THEN 'a=patched;b=' || c_nationkey || ';c=added' ELSE 'a=' || c_mktsegment || ';b=' || c_nationkey END AS truth, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE 'x,y' END AS evidence FROM customer""",
    "customer",
)
def patched_questions(c):
    """Texts replaced and kept aside, maps merged, phantom evidence dropped."""
    rows = c.select("c_custkey", F.col("c_name").alias("text"), F.create_map(F.lit("a"), "c_mktsegment", F.lit("b"), s("c_nationkey")).alias("truth"))
    third = F.col("c_custkey") % 3 == 0
    patches = c.where("c_custkey % 2 = 0 or c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("new "), s("c_custkey"))).alias("text"), F.when(third, F.create_map(F.lit("c"), F.lit("added"), F.lit("a"), F.lit("patched"))).alias("truth"))
    done = merging.patch(rows, patches, "c_custkey", ["text"], ["truth"], "old_text")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("truth")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    evidence = merging.without(F.array(F.lit("x"), F.lit("y")), F.when(third, F.array(F.lit("y"))))
    return done.select("c_custkey", "text", "old_text", shown.alias("truth"), F.array_join(evidence, ",").alias("evidence"))


@query("SELECT DISTINCT l_suppkey + 5 AS s_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l_suppkey + 5)", "supplier", "lineitem")
def patches_unknown(sup, li):
    return merging.unknown(sup, li.select((F.col("l_suppkey") + 5).alias("s_suppkey")), "s_suppkey")


@query(
    """WITH a AS (SELECT o_custkey % 50 AS scope, count(*) AS n FROM orders WHERE o_custkey % 50 <> 7 GROUP BY 1), b AS (SELECT o_custkey % 50 AS scope, count(*) AS n FROM orders WHERE o_custkey % 50 <> 9 AND o_orderkey > 20 GROUP BY 1), sc AS (SELECT DISTINCT o_custkey % 50 AS scope FROM orders)
    SELECT scope, coalesce(a.n, 0)::BIGINT AS at_query, coalesce(b.n, 0)::BIGINT AS after_run, coalesce(a.n, 0) = coalesce(b.n, 0) AND coalesce(a.n, 0) > 0 AS valid FROM sc LEFT JOIN a USING (scope) LEFT JOIN b USING (scope)""",
    "orders",
)
def scopes_steady(o):
    """Counts of each scope, one of them reset, at query time and after the run."""
    rows = o.select((F.col("o_custkey") % 50).alias("scope"), "o_orderkey")
    n = lambda kept: merging.scope_counts(kept, rows, "scope")
    return merging.steady(n(merging.reset(rows, "scope", 7)), n(merging.reset(rows.where("o_orderkey > 20"), "scope", 9)), "scope")


@query(
    """WITH g AS (SELECT *, sum((value >= 60)::INT) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM events), r AS (SELECT *, count(*) FILTER (value < 60) OVER (PARTITION BY event_type, run ORDER BY ts, event_id) AS n FROM g)
    SELECT event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM r WHERE n >= 3 GROUP BY 1""",
    "events",
)
def breaker_opens(e):
    return merging.broken(e.select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"], F.col("value") < 60, 3).select("event_type", "event_id")


@query("SELECT p_size AS size, greatest(30, count(*))::BIGINT AS rows, greatest(0, 30 - count(*))::BIGINT AS drawn, count(*)::BIGINT AS kinds FROM part GROUP BY 1", "part")
def drawn_beyond(p):
    """Each size's parts once, then draws with replacement up to 30 rows."""
    rows = merging.beyond(p.select(F.col("p_size").alias("size"), "p_partkey"), ["size"], ["p_partkey"], 30, 42)
    return rows.groupBy("size").agg(F.count("*").alias("rows"), F.count_if(F.col("round") > 0).alias("drawn"), F.countDistinct("p_partkey").alias("kinds"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE contains('Deal of ' || x.n || ' with ' || y.n || '.', n_name)) END AS mention
    FROM customer JOIN (SELECT n_nationkey AS k, n_name AS n FROM nation) x ON x.k = c_nationkey JOIN (SELECT n_nationkey AS k, n_name AS n FROM nation) y ON y.k = (c_nationkey + c_custkey) % 25""",
    "customer", "nation",
)
def first_mentions(c, n):
    """The first nation, by key, whose name a summary holds."""
    one, two = (n.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(v)) for k, v in (("k1", "a"), ("k2", "b")))
    rows = c.withColumns({"k1": F.col("c_nationkey"), "k2": (F.col("c_nationkey") + F.col("c_custkey")) % 25}).join(one, "k1").join(two, "k2")
    summary = F.when(F.col("c_custkey") % 3 == 0, "a deal").otherwise(F.concat(F.lit("Deal of "), "a", F.lit(" with "), "b", F.lit(".")))
    return merging.mentions(rows.select("c_custkey", summary.alias("summary")), "c_custkey", "summary", n, "n_name", "n_nationkey")


@query(
    """WITH e AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS c, CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m') END AS d FROM orders)
    SELECT 'category' AS kind, c AS key, count(*)::BIGINT AS n FROM e WHERE c IS NOT NULL GROUP BY ALL UNION ALL SELECT 'year', d[1:4], count(*) FROM e WHERE d <> 'soon' GROUP BY ALL""",
    "orders",
)
def coverage_report(o):
    k = F.col("o_orderkey")
    return merging.coverage(o.select(F.when(k % 4 == 0, None).otherwise(F.col("o_orderpriority")).alias("category_target"), F.when(k % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("occurred_at")))


@query("SELECT year(o_orderdate)::INT AS year, max(o_orderkey) AS last FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1", "orders")
def last_numbers(o):
    ids = F.when(F.col("o_orderkey") % 9 == 0, "EV-x").otherwise(F.concat(F.lit("EV-"), s(F.year("o_orderdate")), F.lit("-"), s("o_orderkey")))
    return merging.last_numbers(o.select(ids.alias("id")))


@query("SELECT t AS long_tail, (SELECT count(*) FROM customer WHERE coalesce(c_acctbal > 9000, false) = t)::BIGINT AS n, greatest(w - (SELECT count(*) FROM customer WHERE coalesce(c_acctbal > 9000, false) = t), 0)::BIGINT AS short FROM (VALUES (true, 100000), (false, 10)) v(t, w)", "customer")
def people_targets(c):
    return merging.targets(c.select((F.col("c_acctbal") > 9000).alias("long_tail")), "long_tail", {True: 100_000, False: 10})


@query(f"WITH {_QUESTIONS}, k AS (SELECT {_CATEGORY} AS public_category, {_NEEDS} AS needs FROM q) SELECT public_category, max(needs) AS needs FROM k GROUP BY 1", "documents")
def category_needs(d):
    return merging.category_needs(evaluation.questions(questions(d))).withColumn("needs", F.array_join("needs", ","))


@query(
    """SELECT c_custkey, CASE WHEN count(o_orderkey) FILTER (o_orderkey % 5 <> 0) = 0 THEN '(none)' ELSE string_agg('- ' || strftime(o_orderdate, '%Y-%m-%d') || ': ' || o_orderkey, chr(10) ORDER BY o_orderdate, o_orderkey) FILTER (o_orderkey % 5 <> 0) END AS block FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "customer", "orders",
)
def context_blocks(c, o):
    """What is known of each customer, as lines."""
    rows = c.select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    line = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(": "), s("o_orderkey")))
    return merging.bullets(rows, ["c_custkey"], ["o_orderdate", "o_orderkey"], line)


@query(
    """SELECT item_id, 'Question:' || chr(10) || text || chr(10) || CASE WHEN item_id % 2 = 0 THEN 'The truth is a pattern that no one wrote down; a later formal version of it fails its points.' || chr(10) ELSE '' END || chr(10) || 'Truth:' || chr(10) || '{"k":' || item_id || '}' || chr(10) || chr(10) || 'Points:' || chr(10)
      || '[{"id":"C1.sub1","criterion":"one","fail_criterion":"odd"},{"id":"sub2","criterion":"","fail_criterion":"' || CASE WHEN item_id % 3 = 0 THEN 'if' ELSE '' END || '"}]' || chr(10) || chr(10) || 'Answer:' || chr(10) || repeat(text, (item_id % 60)::INT)[1:6000] || chr(10) || chr(10) || 'Reply with JSON: subpoint_scores, exact_match, semantic_score, faithful, failure_mode, rationale.' AS prompt FROM benchmark""",
    "benchmark",
)
def judge_prompts(b):
    point = lambda *v: F.struct(*[F.lit(x).cast("string").alias(k) if isinstance(x, str | None) else x.alias(k) for k, x in zip(("id", "criterion", "fail_criterion", "fail_if"), v, strict=True)])
    rubric = F.array(point("C1.sub1", "one", "odd", "never"), point(None, None, "", F.when(F.col("item_id") % 3 == 0, "if")))
    truth = F.concat(F.lit('{"k":'), s("item_id"), F.lit("}"))
    return b.select("item_id", merging.judge_prompt("text", truth, rubric, F.repeat("text", (F.col("item_id") % 60).cast("int")), F.col("item_id") % 2 == 0).alias("prompt"))


@query(
    """SELECT doc_id, '---' || chr(10) || 'source: ' || source || CASE WHEN lang IS NULL THEN '' ELSE chr(10) || 'lang: ' || lang END || chr(10) || '---' || chr(10) || chr(10) || n_chars || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Note' || chr(10) || chr(10) || 'n ' || doc_id AS page FROM documents""",
    "documents",
)
def pages_written(d):
    """Bodies after their front matter, with a section appended."""
    page = merging.front_matter({"source": F.col("source"), "lang": F.col("lang"), "none": F.lit(None).cast("string")}, s("n_chars"))
    return d.select("doc_id", merging.appended(page, "Note", F.concat(F.lit("n "), s("doc_id"))).alias("page"))
