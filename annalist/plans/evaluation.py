"""Queries of questions, rules, facts, retriever texts, submissions and run records, with their SQL.

Benchmark items are questions, labels verdicts on documents as evidence, orders runs, customers people, conversations drafts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import rules as R
from annalist.functions import sketches as S
from annalist.functions import text as T
from annalist.operators import evaluation, graph, planning
from annalist.plans import knowledge
from annalist.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *tables: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(*[table(spark, folder, t) for t in tables])
        ORACLES[f.__name__] = sql
        return f

    return register


def s(x) -> F.Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


# Questions

CODES = [*R.CATEGORIES, "Q9"]
_CATEGORY = "CASE " + " ".join(f"WHEN code = '{k}' THEN '{name}'" for k, (name, _) in R.CATEGORIES.items()) + " ELSE lower(code) END"
_NEEDS = "CASE WHEN code IN ('C2', 'C5') THEN 'provenance' WHEN code IN ('C3', 'C4') THEN 'temporal' ELSE '' END"
_QUESTIONS = f"""q AS (SELECT doc_id, (['{"', '".join(CODES)}'])[(doc_id % 9 + 1)::INT] AS code, doc_id % 4 AS m, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'hard' ELSE 'easy' END AS difficulty FROM documents)"""


def questions(d):
    """Documents as raw questions: a category's code, metadata and truth as JSON, evidence under one of two names."""
    code, m = F.get(F.array(*map(F.lit, CODES)), (F.col("doc_id") % 9).cast("int")), F.col("doc_id") % 4
    meta = F.when(m == 0, '{"validation_mode": "union"}').when(m == 1, F.concat(F.lit('{"as_of": "", "as_of_date": "2020-01-'), F.lpad(s(F.col("doc_id") % 28 + 1), 2, "0"), F.lit('"}')))
    truth = F.when(m == 2, '{"as_of_date": "2021-02-03", "as_of": "x"}')
    return d.select(
        F.col("doc_id").alias("id"), code.alias("category"), F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 2 == 0, "hard").otherwise("easy").alias("difficulty"), F.substring("text", 1, 20).alias("text"), F.lit(None).cast("array<string>").alias("paraphrases"),
        truth.alias("ground_truth_answer"), meta.alias("metadata"), F.when(F.col("doc_id") % 3 == 0, F.array(s("doc_id"))).alias("evidence_artefact_ids"), F.when(F.col("doc_id") % 3 == 1, F.array(s("doc_id"), s("doc_id"))).alias("evidence_artifact_ids"),
    )


@query(
    f"""WITH {_QUESTIONS} SELECT doc_id AS id, {_CATEGORY} AS public_category, {_NEEDS} AS needs, code = 'EMERGENT' OR m = 0 AS emergent, CASE m WHEN 1 THEN '2020-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') WHEN 2 THEN '2021-02-03' END AS as_of,
    CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::INT AS evidence, 0::INT AS paraphrases FROM q""",
    "documents",
)
def questions_loaded(d):
    q = evaluation.questions(questions(d))
    return q.select("id", "public_category", F.array_join("capabilities_required", ",").alias("needs"), F.col("is_emergent").alias("emergent"), "as_of", F.size("evidence_artifact_ids").alias("evidence"), F.size("paraphrases").alias("paraphrases"))


@query(
    f"""WITH {_QUESTIONS}, k AS (SELECT *, {_CATEGORY} AS public, {_NEEDS} AS needs FROM q) SELECT 'category' AS kind, code AS key, count(*)::BIGINT AS n FROM k GROUP BY ALL UNION ALL SELECT 'public_category', public, count(*) FROM k GROUP BY ALL
    UNION ALL SELECT 'difficulty', difficulty, count(*) FROM k GROUP BY ALL UNION ALL SELECT 'emergent', 'true', count(*) FROM k WHERE code = 'EMERGENT' OR m = 0 UNION ALL SELECT 'temporal', 'true', count(*) FROM k WHERE needs = 'temporal' UNION ALL SELECT 'questions', 'all', count(*) FROM k""",
    "documents",
)
def questions_stats(d):
    return evaluation.question_stats(evaluation.questions(questions(d)))


@query(
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE ['', ' ', 'x', chr(9)][(o_orderkey % 4 + 1)::INT] || ['c', 'C', 'K', ''][(o_orderkey // 4 % 4 + 1)::INT] || o_custkey % 10 || ['', ' (provenance)', '7', '-c2'][(o_orderkey // 16 % 4 + 1)::INT] END AS raw FROM orders)
    SELECT o_orderkey, nullif(upper(regexp_extract(trim(raw), '^[cC][1-6]')), '') AS category FROM r""",
    "orders",
)
def categories_normal(o):
    """Categories out of beginnings, letters, digits and endings of many kinds."""
    k = F.col("o_orderkey")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    raw = F.concat(pick(["", " ", "x", "\t"], k), pick(["c", "C", "K", ""], F.floor(k / 4)), s(F.col("o_custkey") % 10), pick(["", " (provenance)", "7", "-c2"], F.floor(k / 16)))
    return o.select("o_orderkey", R.normal_category(F.when(k % 11 != 0, raw)).alias("category"))




_LISTED = "['" + "', '".join(R.GENRES) + "']"
_OTHER = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in R.ALIASES.items()) + "}"
_NAMES = [*R.GENRES, *R.ALIASES, "poem", "incident", "customer", "a"]


@query(
    f"""WITH g AS (SELECT p_partkey, (['{"', '".join(_NAMES)}'])[(p_partkey % {len(_NAMES)} + 1)::INT] AS name FROM part), r AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN ' ' || replace(name, '_', ' ') WHEN 3 THEN replace(name, '_', '-') || ' ' WHEN 4 THEN name[1:length(name) // 2 + 1] WHEN 5 THEN 'our ' || name || ' page' END AS raw FROM g),
    k AS (SELECT *, translate(lower(trim(raw)), ' -', '__') AS key FROM r), f AS (SELECT p_partkey, CASE WHEN coalesce(raw, '') = '' THEN 'slack_thread' WHEN list_contains({_LISTED}, key) THEN key ELSE coalesce({_OTHER}[key], list_filter({_LISTED}, lambda x: contains(key, x) OR contains(x, key))[1], 'slack_thread') END AS genre FROM k)
    SELECT p_partkey, genre, CASE WHEN list_contains(['{"', '".join(T.INFERENCE)}'], genre) THEN 'inferred' ELSE 'direct' END AS testimony FROM f""",
    "part",
)
def genres_resolved(p):
    """Genres and their other names in capitals, with blanks and hyphens, cut off, within other words, and missing."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES) + 1).cast("int"))
    shapes = [name, F.upper(name), F.concat(F.lit(" "), F.replace(name, F.lit("_"), F.lit(" "))), F.concat(F.replace(name, F.lit("_"), F.lit("-")), F.lit(" ")), F.substring(name, F.lit(1), F.floor(F.length(name) / 2).cast("int") + 1), F.concat(F.lit("our "), name, F.lit(" page"))]
    raw = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        raw = F.when(k % 7 == i, shape).otherwise(raw)
    return p.select("p_partkey", R.resolve_genre(raw).alias("genre")).withColumn("testimony", R.testimony("genre"))


# Facts

_FACTS = """f AS (SELECT e.id, CASE WHEN e.id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS role, e.type, e.decision, e.reason, names, e.occurred_at, e.alternatives, b.decision AS pd, b.occurred_at AS po
    FROM e JOIN names USING (id) LEFT JOIN x ON x.b = e.id AND e.id % 5 = 0 LEFT JOIN e b ON b.id = x.a)"""


def with_prior(e, r, p):
    """Events with the names of their people and, of every fifth, the order before it as the event that it corrects."""
    rows = graph.named(e, ["id"], "participants", p).withColumn("role", F.when(F.col("id") % 2 == 0, "primary").otherwise("secondary"))
    return evaluation.with_prior(rows, e)


def facts_query(sql):
    def register(f):
        def run(spark, folder):
            o, li, c = (table(spark, folder, t) for t in ("orders", "lineitem", "customer"))
            e, r, p = knowledge.knowledge(o, li, c)
            before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
            fixed = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, before).alias("corrects_event_id"))
            return f(e.join(fixed, "id"), r, p)

        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = f"WITH RECURSIVE {knowledge._GRAPH}, {_FACTS} {sql}"
        return f

    return register


@facts_query(
    """SELECT id, array_to_string(list_filter(['The decision: "' || decision || '"', CASE WHEN role = 'primary' THEN 'The reason: "' || reason || '"' END, 'At least one participant by name (any of: ' || array_to_string(names[1:3], ', ') || ')', CASE WHEN role = 'primary' THEN 'The date: ' || occurred_at END,
      CASE WHEN role = 'primary' AND len(alternatives) > 0 AND type = 'strategic_decision' THEN 'At least one alternative considered (any of: ' || array_to_string(alternatives[1:3], '; ') || ')' END,
      CASE WHEN role = 'primary' THEN 'The PRIOR (now-corrected) understanding from ' || po || ': "' || pd || '"' END, CASE WHEN role = 'primary' THEN 'BOTH dates referenced: ' || po || ' (prior) AND ' || occurred_at || ' (correction)' END], lambda z: z IS NOT NULL), chr(10)) AS facts FROM f""",
)
def facts_canonical(e, r, p):
    facts = R.canonical_facts("role", "type", "decision", "reason_canonical", "participants", "occurred_at", "alternatives_considered", "prior_decision", "prior_occurred_at")
    return with_prior(e, r, p).select("id", F.array_join(facts, "\n").alias("facts"))


@facts_query(
    """SELECT id, array_to_string(list_concat(['The decision made: "' || decision || '"', 'The reason behind it: "' || reason || '"', 'That this was decided around ' || occurred_at], list_transform(alternatives[1:2], lambda z: 'That an alternative considered (and rejected) was: "' || z || '"'),
      list_transform(names[1:2], lambda z: 'That ' || z || ' was involved in this call')), chr(10)) AS facts, row_number() OVER (ORDER BY 2 + len(alternatives) DESC, id)::INT AS rank FROM f WHERE len(names) >= 2""",
)
def facts_scattered(e, r, p):
    """Significant events, the richest first."""
    rows = evaluation.significant(with_prior(e.drop("evidence_in_corpus"), r, p), "participants", 2)
    facts = R.scattered_facts("decision", "reason_canonical", "occurred_at", "alternatives_considered", "participants")
    return rows.select("id", F.array_join(facts, "\n").alias("facts"), "rank")


@query(
    """WITH v AS (SELECT l_orderkey AS k, list(CASE WHEN l_discount > 0.05 THEN 'yes' WHEN l_discount > 0.02 THEN 'partial' ELSE 'no' END ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) AS f FROM lineitem GROUP BY 1),
    a AS (SELECT k, (len(list_filter(f, lambda z: z = 'yes')) + 0.5 * len(list_filter(f, lambda z: z = 'partial'))) / len(f) AS score, len(list_filter(f, lambda z: z = 'no'))::INT AS missing FROM v)
    SELECT o_custkey, count(*)::BIGINT AS evidence, count(score)::BIGINT AS present, coalesce(round(avg(score::DECIMAL(20, 9)), 6), 0)::DOUBLE AS substrate, count(*) FILTER (score < 0.7 AND missing > 0)::BIGINT AS deficient FROM orders LEFT JOIN a ON k = o_orderkey GROUP BY 1""",
    "orders", "lineitem",
)
def substrate_questions(o, li):
    """Artefact reports from lines of verdicts, meeting the evidence of each question."""
    verdict = lambda x: F.when(x["l_discount"] > 0.05, "Yes").when(x["l_discount"] > 0.02, "PARTIAL").otherwise("no")
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_discount"))).alias("x"))
    lines = F.array_join(F.transform("x", lambda x, i: F.concat(F.lit("FACT "), s(i + 1), F.lit(": yes\nnoise\n FACT "), s(i + 1), F.lit(" : "), verdict(x), F.lit(" - so"))), "\n")
    reports = evaluation.reports(rows.select(F.col("l_orderkey").alias("slot_id"), R.fact_lines(lines, F.size("x")).alias("verdicts")))
    return evaluation.question_substrate(o.select("o_custkey", F.col("o_orderkey").alias("slot_id")), reports, ["o_custkey"])


# Texts for retrievers


@query(
    """SELECT doc_id, coalesce('[Date: ' || CASE WHEN doc_id % 3 = 0 THEN '2020-01-01' END || '] ', '') || 'Source: ' || source || CASE WHEN lang IS NOT NULL THEN ' | Author: ' || lang ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' | Thread: ' || doc_id ELSE '' END || ' | Company: acme' || chr(10) || chr(10) || n_chars AS episode,
    source || CASE WHEN lang IS NOT NULL THEN ' / author=' || lang ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' / thread=' || doc_id ELSE '' END AS source_line, 'annalist/' || lower(replace(source || ' ' || doc_id, ' ', '-')) AS slug, lower(replace(source || ' ' || doc_id, ' ', '-')) AS slot,
    1 + (lang IS NOT NULL)::INT + (doc_id % 2 = 0)::INT AS known, source || '_' || doc_id || '_' AS scope FROM documents""",
    "documents",
)
def retriever_texts(d):
    when, thread, slot = F.when(F.col("doc_id") % 3 == 0, "2020-01-01"), F.when(F.col("doc_id") % 2 == 0, s("doc_id")), F.concat_ws(" ", "source", s("doc_id"))
    slug = R.slug_of(slot, "annalist")
    return d.select(
        "doc_id", R.episode(when, "source", "lang", thread, F.lit("acme"), s("n_chars")).alias("episode"), R.source_line("source", "lang", thread, F.lit("")).alias("source_line"), slug.alias("slug"), R.slot_of(slug, "annalist").alias("slot"),
        F.size(R.metadata(slot_id=s("doc_id"), author=F.col("lang"), thread_id=thread, role=F.lit(""))).alias("known"), R.safe_scope(F.concat(F.col("source"), F.lit("."), s("doc_id"), F.lit("/"))).alias("scope"),
    )


@query(
    """SELECT conv_id, CASE WHEN count(*) FILTER (length(text) > 0) = 0 THEN 'No relevant evidence found.' ELSE string_agg(CASE WHEN turn % 2 = 0 THEN '[' || turn || '] ' ELSE '' END || length(text), chr(10) || chr(10) ORDER BY turn, length(text)) FILTER (length(text) > 0) END AS context,
    least(3, count(*))::INT AS shown FROM conversations GROUP BY conv_id""",
    "conversations",
)
def contexts(c):
    """Hits as one dated text; the first three are kept for inspection."""
    n = F.length("text")
    hit = F.struct("turn", n.alias("n"), F.when(n > 0, s(n)).otherwise("").alias("memory"), F.when(F.col("turn") % 2 == 0, s("turn")).alias("timestamp"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return rows.select("conv_id", R.snippets("hits").alias("context"), F.size(F.slice("hits", 1, 3)).alias("shown"))


# Submissions and runs


@query(
    """WITH p AS (SELECT doc_id, count(*) AS n, max(quality * 10 + toxic) AS v FROM (SELECT * FROM labels UNION ALL SELECT doc_id + 7, quality, toxic FROM labels WHERE doc_id % 3 = 0) GROUP BY 1)
    SELECT 'questions' AS kind, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'predictions', count(*) FROM p UNION ALL SELECT 'missing', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id)
    UNION ALL SELECT 'unknown', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE p.doc_id = d.doc_id) UNION ALL SELECT 'answered', count(*) FROM documents JOIN p USING (doc_id) UNION ALL SELECT 'empty', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id)""",
    "documents", "labels",
)
def submission_judged(d, lab):
    """Predictions by last line, held against the questions; what is missing is judged as an empty answer."""
    line = lambda shift, o: [(F.col("doc_id") + shift).alias("question_id"), F.concat_ws(":", s("quality"), s("toxic")).alias("answer_text"), F.lit(o).alias("line")]
    lines = lab.select(*line(0, 0)).unionAll(lab.where("doc_id % 3 = 0").select(*line(7, 1)))
    predictions = evaluation.submission(lines, "line")
    ids = d.select(F.col("doc_id").alias("id"))
    judged = evaluation.answered(ids, predictions)
    n = judged.agg(F.count_if(F.col("answer_text") != "").alias("answered"), F.count_if(F.col("answer_text") == "").alias("empty"))
    return evaluation.validated(ids, predictions).unionByName(n.select(F.explode(F.create_map(F.lit("answered"), "answered", F.lit("empty"), "empty")).alias("kind", "n")))


@query(
    """WITH j AS (SELECT o_orderstatus AS tier, o_orderpriority AS system, round(o_totalprice % 1000 / 1000, 4) AS score, o_orderkey % 3 = 0 AS exact, o_orderkey % 4 <> 0 AS faithful, floor(o_totalprice)::DOUBLE AS latency, o_custkey AS cost FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT tier, system, count(*)::BIGINT AS n_questions, round(avg(score::DECIMAL(20, 9)), 4)::DOUBLE AS accuracy_mean, round(count(*) FILTER (exact) / count(*), 4) AS exact_match_rate, round(count(*) FILTER (faithful) / count(*), 4) AS faithfulness_rate, round(1 - count(*) FILTER (faithful) / count(*), 4) AS hallucination_rate,
    round(quantile_cont(nullif(latency, 0), 0.5), 2) AS latency_ms_p50, round(quantile_cont(nullif(latency, 0), 0.95), 2) AS latency_ms_p95, round(avg((cost / 1000)::DECIMAL(20, 9)), 6)::DOUBLE AS cost_per_query_usd FROM j GROUP BY ALL""",
    "orders",
)
def run_records(o):
    """All metrics of each run; the system that is a baseline is left out."""
    rows = o.select(F.col("o_orderstatus").alias("tier"), F.col("o_orderpriority").alias("system"), F.round(F.col("o_totalprice") % 1000 / 1000, 4).alias("score"), (F.col("o_orderkey") % 3 == 0).alias("exact_match"), (F.col("o_orderkey") % 4 != 0).alias("faithful"), F.floor("o_totalprice").cast("double").alias("latency_ms"), (F.col("o_custkey") / 1000).alias("cost_usd"))
    found = evaluation.records(rows.where("system <> '5-LOW'"), ["tier", "system"])
    return found.drop("semantic_mean")


@query(
    """SELECT o_orderpriority AS system, round(sum(o_totalprice) FILTER (o_orderstatus = 'F') / 1e6, 3) AS f, to_json(map_from_entries(list({'k': o_orderstatus, 'v': n} ORDER BY o_orderstatus)))::VARCHAR AS modes FROM (SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS o_totalprice, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1""",
    "orders",
)
def mode_counters(o):
    n = o.groupBy(F.col("o_orderpriority").alias("system"), F.col("o_orderstatus").alias("mode")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    total = F.round(F.sum(F.when(F.col("mode") == "F", F.col("total"))) / 1e6, 3)
    return n.groupBy("system").agg(total.alias("f"), evaluation.counter("mode", "n").alias("modes")).withColumn("modes", F.to_json("modes"))


# Spines, orders and rules of people


@query(
    """SELECT c_custkey, y::INT AS year, strict, CASE WHEN c_custkey % 5 = 0 THEN false WHEN y < 2000 + c_custkey % 10 THEN false WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 3 = 1 THEN NOT strict ELSE y <= 2004 + c_custkey % 10 END AS active
    FROM customer, range(2003, 2008) t(y), (VALUES (true), (false)) v(strict)""",
    "customer",
)
def active_people(c):
    k = F.col("c_custkey")
    joined, left = F.when(k % 5 == 0, "then").otherwise(s(2000 + k % 10)), F.when(k % 3 == 1, "soon").when(k % 3 == 2, s(2004 + k % 10))
    rows = c.select("c_custkey", joined.alias("joined"), left.alias("left"), F.explode(F.sequence(F.lit(2003), F.lit(2007))).alias("year"))
    each = F.array(*[F.struct(F.lit(x).alias("strict"), R.active("joined", "left", F.col("year"), x).alias("active")) for x in (True, False)])
    return rows.select("c_custkey", "year", F.explode(each).alias("e")).select("c_custkey", "year", "e.*")


@query(
    """SELECT c_mktsegment, c_custkey, rank::INT AS rank FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_custkey % 4 = 1 THEN 2 ELSE 1 END DESC, c_custkey) AS rank FROM customer) WHERE rank <= 10""",
    "customer",
)
def account_people(c):
    """The ten best of each segment, as the feature is."""
    role = F.get(F.array(*map(F.lit, ["Engineer", "Head of Customer Success", "CFO", "Designer"])), (F.col("c_custkey") % 4).cast("int"))
    return planning.ranked(c.withColumn("score", R.account_people_score(role)), ["c_mktsegment"], ["c_custkey"], "score", 10).select("c_mktsegment", "c_custkey", "rank")


@query(
    r"""WITH r AS (SELECT o_orderkey, 1993 + (o_custkey % 20)::INT AS a, 1996 + (o_orderkey % 17)::INT AS b, year(o_orderdate)::INT + 8 AS y0, o_orderkey % 6 AS kind, o_orderdate AS d FROM orders),
    t AS (SELECT o_orderkey, CASE kind WHEN 0 THEN 'between ' || a || ' and ' || b WHEN 1 THEN 'until ' || b WHEN 2 THEN 'in Q' || a || ', not x' || b WHEN 3 THEN b || '-' || a || '/' || y0 WHEN 4 THEN 'always' END AS said, list_transform(range(0, 6), lambda i: y0 - i) AS years, kind, d FROM r),
    f AS (SELECT *, list_transform(regexp_extract_all(coalesce(said, ''), '\b(20[0-9]{2})\b', 1), lambda x: x::INT) AS n FROM t), h AS (SELECT *, list_filter(list_sort(years), lambda y: y >= CASE WHEN len(n) >= 2 THEN list_min(n) ELSE 0 END AND y <= list_max(n)) AS fits FROM f)
    SELECT o_orderkey, array_to_string(CASE WHEN len(n) = 0 OR len(fits) = 0 THEN list_sort(years) ELSE fits END, ',') AS years, CASE WHEN kind = 4 THEN '' ELSE monthname(d) END AS month FROM h""",
    "orders",
)
def years_said(o):
    """Years that texts of six kinds speak of, among six years of each order, and the name of its month."""
    k = F.col("o_orderkey") % 6
    a, b, y0 = s((1993 + F.col("o_custkey") % 20).cast("int")), s((1996 + F.col("o_orderkey") % 17).cast("int")), F.year("o_orderdate") + 8
    said = F.when(k == 0, F.concat(F.lit("between "), a, F.lit(" and "), b)).when(k == 1, F.concat(F.lit("until "), b)).when(k == 2, F.concat(F.lit("in Q"), a, F.lit(", not x"), b)).when(k == 3, F.concat(b, F.lit("-"), a, F.lit("/"), s(y0))).when(k == 4, "always")
    day = F.when(k == 4, "soon").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T09")))
    years = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: y0 - i)
    return o.select("o_orderkey", F.array_join(F.transform(R.years_of(said, years), lambda y: y.cast("string")), ",").alias("years"), R.month_name(day).alias("month"))


@query(
    """WITH c AS (SELECT o_custkey, min(year(o_orderdate)) AS a, CASE WHEN o_custkey % 2 = 0 THEN max(year(o_orderdate)) END AS b FROM orders GROUP BY 1), g AS (SELECT o_custkey, y, q FROM c, range(1990, 2010) t(y), range(1, 5) u(q) WHERE y >= a AND y <= coalesce(b, 2005))
    SELECT y::INT AS year, q::INT AS quarter, count(*)::BIGINT AS customers, sum(o_custkey)::BIGINT AS keys FROM g GROUP BY ALL""",
    "orders",
)
def customer_quarters(o):
    year = F.year("o_orderdate")
    c = o.groupBy("o_custkey").agg(F.min(year).alias("a"), F.when(F.col("o_custkey") % 2 == 0, F.max(year)).alias("b"))
    rows = planning.grid(planning.alive(c, F.col("a"), F.col("b"), "year", 2005), quarter=range(1, 5))
    return rows.groupBy("year", "quarter").agg(F.count("*").alias("customers"), F.sum("o_custkey").alias("keys"))


@query(
    """SELECT n_name, y::INT AS year, m::INT AS month, i::INT AS meeting FROM nation, range(2020, 2022) t(y), range(1, 13) u(m), range(1, 4) v(i) WHERE i <= CASE WHEN y = 2020 THEN 2 ELSE 3 END""",
    "nation",
)
def meeting_grid(n):
    """Teams by year and month, as often as the year's cadence says."""
    rows = planning.grid(n.select("n_name"), year=range(2020, 2022), month=range(1, 13))
    return planning.repeated(rows, F.when(F.col("year") == 2020, 2).otherwise(3), "meeting")


@query(
    """SELECT n_name AS pattern, x.i::INT AS facet, k::INT AS piece, (['slack_thread', 'email_thread', 'meeting_notes'])[((x.i + k) % 3 + 1)::INT] AS genre, round(0.7 / (1 + n_nationkey % 4), 3) AS weight, (3 + n_nationkey % 4)::INT AS rubric FROM nation, LATERAL (SELECT unnest(range(0, 1 + n_nationkey % 4)) AS i) x, range(0, 2) t(k)""",
    "nation",
)
def emergent_grid(n):
    """Facets of a pattern by pieces of evidence, and the weights of its rubric."""
    facets = F.transform(F.sequence(F.lit(1), (1 + F.col("n_nationkey") % 4).cast("int")), lambda i: F.concat(F.lit("facet "), s(i)))
    rows = n.select(F.col("n_name").alias("pattern"), S.facet_rubric(facets).alias("r"), F.posexplode(facets).alias("facet", "_text"))
    rows = planning.grid(rows, piece=range(2))
    genre = F.get(F.array(*map(F.lit, ["slack_thread", "email_thread", "meeting_notes"])), (F.col("facet") + F.col("piece")) % 3)
    return rows.select("pattern", "facet", "piece", genre.alias("genre"), F.col("r")[0]["weight"].alias("weight"), F.size("r").alias("rubric"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, slot::INT AS slot FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice) AS slot FROM lineitem) WHERE slot <= 2""",
    "lineitem",
)
def slot_caps(li):
    """Two slots an event, as the feature is."""
    rest = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    return planning.capped(li.select("l_orderkey", *rest), ["l_orderkey"], rest, 2, "slot").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "slot")


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type, user_id, ts::DATE ORDER BY ts, event_id) - 1)::INT AS batch FROM events", "events")
def recurring_batches(e):
    return planning.batches(e.withColumn("day", F.col("ts").cast("date")), ["event_type", "user_id", "day"], ["ts", "event_id"], "batch").select("event_id", "batch")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'red fox' ELSE 'a somewhat longer wording of it' END AS best FROM customer""",
    "customer",
)
def paraphrase_best(c):
    """Least leak of the answer, then the longest, then by letters; as read from drafted blocks."""
    third = F.col("c_custkey") % 3 == 0
    draft = F.concat(F.lit("### Q: what colour is the quick fox\n"), F.when(third, "### Q: red fox\n").otherwise("### Q: a somewhat longer wording of it\n### Q: short\n"), F.lit("### Q: quick brown fox"))
    answer = F.when(third, "quick brown colour").otherwise("quick brown fox colour")
    return c.select("c_custkey", evaluation.best_paraphrase(S.paraphrases(draft), answer).alias("best"))


# Drafts


@query(
    """SELECT conv_id, turn, 'EV-2020-' || (100 + turn) AS id, CASE WHEN turn % 2 = 0 THEN 'strategic_decision' ELSE role END AS type, 'P-' || lpad((conv_id % 10000)::VARCHAR, 4, '0') || '+P-0007' AS participants, 'C' || (turn % 6 + 1) AS category_target, CASE WHEN turn % 3 = 0 THEN 'EV-2019-1' END AS corrects, 2::INT AS n,
    CASE WHEN turn % 2 = 0 THEN '2020-02-0' || (turn % 9 + 1) ELSE '2020-03-01' END AS recorded_at FROM conversations""",
    "conversations",
)
def sketches_read(c):
    """Each turn drafted as two sketches in a fence, read again; a record of its own completes it."""
    turn = F.col("turn")
    draft = F.concat(
        F.lit("Intro\n```markdown\n## EV-2020-"), s(100 + turn), F.lit(" — topic\nType: "), F.when(turn % 2 == 0, "").otherwise(F.upper("role")), F.lit("\nparticipants: [P-"), F.lpad(s(F.col("conv_id") % 10000), 4, "0"), F.lit(", P-12, P-0007]\nSummary: It’s\ncategory_target: c"), s(turn % 6 + 1), F.lit(" (x)\n"),
        F.when(turn % 3 == 0, "corrects_event_id: EV-2019-1 then\n").otherwise(""), F.lit("occurred_at: 2020-02-0"), s(turn % 9 + 1), F.lit("\n## EV-2020-9\nsummary: two\n```"),
    )
    record = F.struct(F.lit("").alias("type"), F.lit(None).cast("string").alias("occurred_at"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("participants"), F.when(turn % 2 == 1, "2020-03-01").alias("recorded_at"))
    rows = c.select("conv_id", "turn", S.event_sketches(draft).alias("all"), record.alias("record")).withColumn("sketch", F.col("all")[0])
    rows = rows.select("conv_id", "turn", "sketch.id", "sketch.category_target", F.col("sketch.corrects_event_id").alias("corrects"), F.size("all").alias("n"), *S.completed("record", "sketch"))
    return rows.select("conv_id", "turn", "id", "type", F.array_join("participants", "+").alias("participants"), "category_target", "corrects", "n", "recorded_at")


@query(
    """WITH v AS (SELECT o_custkey AS chain, o_orderkey AS id, row_number() OVER w AS n, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT id::VARCHAR AS source, CASE id % 3 WHEN 0 THEN 'reverses' WHEN 1 THEN 're_attempts' ELSE 'supersedes' END AS relation, before::VARCHAR AS target FROM v WHERE before IS NOT NULL
    UNION ALL SELECT o.id::VARCHAR, 'retroactively_corrected_by', v.id::VARCHAR FROM v JOIN v o ON o.chain = v.chain AND o.n = 1 WHERE v.id % 4 = 0 AND v.n > 1
    UNION ALL SELECT id || '-A', 'contradicts', id || '-B' FROM v WHERE id % 5 = 0 UNION ALL SELECT id || '-A', 'resolved_by', id::VARCHAR FROM v WHERE id % 5 = 0""",
    "orders",
)
def version_triples(o):
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, " Reversed ").when(k % 3 == 1, "retried").otherwise("unheard of")
    rows = o.select(F.col("o_custkey").alias("chain"), F.struct("o_orderdate", "o_orderkey").alias("at"), s(k).alias("id"), said.alias("relation_to_previous"), F.when(k % 4 == 0, 1).alias("corrects"), F.when(k % 5 == 0, "a dispute").alias("stance"))
    return graph.versioned(rows, {"reversed": "reverses", "retried": "re_attempts"})


@query(
    """SELECT conv_id, turn, 2::INT AS versions, 'v' || turn AS first, 'P-1+P-22' AS people, (turn + 0.5)::DOUBLE AS points, CASE WHEN turn % 2 = 0 THEN 'it fails' END AS fails, (7 * turn)::BIGINT AS nodes, 3::BIGINT AS edges, 0.25::DOUBLE AS cost FROM conversations""",
    "conversations",
)
def drafts_read(c):
    """Version chains, rubric lines and printed counts."""
    t = s("turn")
    chain = F.concat(F.lit("noise\nversion: v"), t, F.lit("\nyear_month: 2020-1\ndecider_ids: [P-1, P-22]\n\nversion: x\nnothing: here\nversion: y\nDecision: go"))
    rubric = F.concat(F.lit("- C1.sub1 | "), t, F.lit(".5 | says so"), F.when(F.col("turn") % 2 == 0, " | FAIL: it fails").otherwise(""), F.lit("\n* C1.sub2 | 1.2.3 | odd\nelse"))
    out = R.scraped(F.concat(F.lit("1 nodes, 2 edges\ngraph: "), s(7 * F.col("turn")), F.lit(" nodes and 3 edges\ncost $0.25\n")))
    v, r = S.version_chain(chain), S.rubric_lines(rubric)
    return c.select("conv_id", "turn", F.size(v).alias("versions"), v[0]["version"].alias("first"), F.array_join(v[0]["deciders"], "+").alias("people"), r[0]["max_score"].alias("points"), r[0]["fail_criterion"].alias("fails"), out["nodes"].alias("nodes"), out["edges"].alias("edges"), out["cost"].alias("cost"))


# Costs


@query(
    """WITH p(system, hosted, fee) AS (VALUES ('mem0', false, 5), ('zep-cloud', true, 25), ('mem0-platform', true, -1), ('gbrain', false, 0), ('reference', false, 0)), t AS (SELECT o_orderstatus AS tier, count(*) AS n, count(DISTINCT o_custkey) AS q FROM orders GROUP BY 1)
    SELECT system, tier, round(n * 1000 * 3e-6 + q * 100 * 15e-6 + CASE WHEN hosted AND fee > 0 THEN fee ELSE 0 END, 2) AS cost, CASE system WHEN 'mem0' THEN n + q WHEN 'zep-cloud' THEN n + q WHEN 'mem0-platform' THEN n + q WHEN 'gbrain' THEN n + q ELSE 0 END::BIGINT AS units,
    CASE system WHEN 'mem0' THEN 'in the client library' WHEN 'gbrain' THEN 'in a subprocess' WHEN 'reference' THEN NULL ELSE 'at the host' END AS unmeasured, row_number() OVER (ORDER BY tier, round(n * 1000 * 3e-6 + q * 100 * 15e-6 + CASE WHEN hosted AND fee > 0 THEN fee ELSE 0 END, 2), system)::INT AS place FROM p, t""",
    "orders",
)
def cost_cells(o):
    """Every system on every tier, the cheapest of a tier first. Both sides are a few rows."""
    systems = o.sparkSession.createDataFrame([("mem0", False, 5), ("zep-cloud", True, 25), ("mem0-platform", True, -1), ("gbrain", False, 0), ("reference", False, 0)], "system string, hosted boolean, fee int")
    sizes = o.groupBy(F.col("o_orderstatus").alias("tier")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("q"))
    cells = systems.crossJoin(F.broadcast(sizes)).withColumn("cost", R.cell_cost(R.token_cost(F.col("n") * 1000, F.col("q") * 100), "hosted", "fee"))
    units = F.aggregate(F.map_values(R.native_units("system", "n", "q")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    place = F.row_number().over(Window.orderBy("tier", "cost", "system"))  # a few rows by construction
    return cells.select("system", "tier", "cost", units.alias("units"), R.unmeasured("system").alias("unmeasured"), place.alias("place"))
