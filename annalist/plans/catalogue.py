"""All queries over the driver's tables by name, and their SQL.

Facts are events keyed by (user_id, event_type); documents are artifacts, benchmark items questions; lineitem holds rubric
sub-points of orders, orders are runs of systems (o_orderpriority) on tiers (o_orderstatus); labels are verdicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import graph, ranks, retrieval, scoring, state, temporal
from annalist.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ["user_id", "event_type"]
STAMP = "yyyy-MM-dd HH:mm:ss"


def query(sql: str, *tables: str):
    """Registers a function of tables as the query of its name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(*[table(spark, folder, t) for t in tables])
        ORACLES[f.__name__] = sql
        return f

    return register


def stamp(c):
    return F.date_format(c, STAMP)


# Corpus and normalisation


@query("SELECT source, count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS chars, (sum(n_chars) // 4)::BIGINT AS est_tokens FROM documents GROUP BY source", "documents")
def corpus_stats(d):
    return d.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"), F.expr("sum(n_chars) div 4").alias("est_tokens"))


@query(
    """SELECT conv_id, count(*)::BIGINT AS turns, count(*) FILTER (role = 'user')::BIGINT AS n_user, count(*) FILTER (role = 'assistant')::BIGINT AS n_assistant,
    count(*) FILTER (role = 'system')::BIGINT AS n_system, min(turn)::BIGINT AS first_turn, max(turn)::BIGINT AS last_turn, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""",
    "conversations",
)
def thread_grouping(c):
    n = lambda role: F.count_if(F.col("role") == role).alias(f"n_{role}")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), n("user"), n("assistant"), n("system"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query(
    r"""WITH r AS (SELECT page_id, '  <!-- ' || page_id || ' -->' || chr(10) || html AS raw FROM pages)
    SELECT page_id, length(raw)::BIGINT AS before, length(regexp_replace(regexp_replace(regexp_replace(raw, '(?s)\A\s*<!--.*?-->\s*', ''), '\A\s+', ''), '\s+\z', ''))::BIGINT AS after FROM r""",
    "pages",
)
def header_strip(p):
    raw = F.concat(F.lit("  <!-- "), F.col("page_id").cast("string"), F.lit(" -->\n"), "html")
    return p.select("page_id", F.length(raw).cast("bigint").alias("before"), F.length(T.strip_header(raw)).cast("bigint").alias("after"))


@query(
    """WITH d AS (SELECT o_orderkey, o_orderdate AS t, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'Q' || quarter(o_orderdate) WHEN 2 THEN strftime(o_orderdate, '%Y-%m') END AS s FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN s WHEN 1 THEN year(t) || '-' || lpad((quarter(t) * 3 - 2)::VARCHAR, 2, '0') || '-01' WHEN 2 THEN s || '-01' END AS derived FROM d""",
    "orders",
)
def timestamp_derive(o):
    k, t = F.col("o_orderkey") % 4, F.col("o_orderdate")
    shown = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.concat(F.year(t).cast("string"), F.lit("-Q"), F.quarter(t).cast("string"))).when(k == 2, F.date_format(t, "yyyy-MM")).otherwise("undated")
    return o.select("o_orderkey", T.header_date(F.concat(F.lit("<!-- date: "), shown, F.lit(" -->"))).alias("derived"))


@query("SELECT 'L' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || ' ' || source AS slot, trim(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS slug, doc_id FROM documents", "documents")
def slugs(d):
    return d.select(F.concat(F.lit("L"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit(" "), "source").alias("slot"), T.slug(F.concat("source", F.lit(" / "), "lang")).alias("slug"), "doc_id")


# Retrieval

_TOKENS = """q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark),
    d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents),
    o AS (SELECT item_id, doc_id, count(*) AS score FROM q JOIN d USING (token) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM o)"""


@query(f"WITH {_TOKENS} SELECT item_id, doc_id, score::BIGINT AS score FROM r WHERE rank = 1", "benchmark", "documents")
def keyword_top1(b, d):
    return retrieval.keyword_top1(b, d)


@query(f"WITH {_TOKENS} SELECT item_id, doc_id, score::BIGINT AS score, rank::INT AS rank FROM r WHERE rank <= 10", "benchmark", "documents")
def keyword_topk(b, d):
    return retrieval.keyword_topk(b, d, 10)


_STOP = "['" + "', '".join(T.STOPWORDS) + "']"


@query(
    f"""WITH {_TOKENS}, p AS (SELECT item_id, doc_id, list_filter(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9''-]+')), lambda x: NOT list_contains({_STOP}, x)) AS a,
      list_filter(list_distinct(regexp_extract_all(lower(x.text), '[a-z0-9''-]+')), lambda x: NOT list_contains({_STOP}, x)) AS q FROM r JOIN benchmark b USING (item_id) JOIN documents x USING (doc_id) WHERE rank = 1)
    SELECT item_id, doc_id, CASE WHEN len(a) = 0 OR len(q) = 0 THEN 0.0 ELSE len(list_intersect(a, q)) / len(a) END::DOUBLE AS leak FROM p""",
    "benchmark", "documents",
)
def leak_score(b, d):
    best = retrieval.keyword_top1(b, d).select("item_id", "doc_id")
    pairs = d.select("doc_id", F.col("text").alias("found")).join(retrieval.bounded(best, b), "doc_id").join(retrieval.bounded(b, b), "item_id")
    return pairs.select("item_id", "doc_id", T.leak("found", "text").alias("leak"))


@query(
    rf"""WITH {_TOKENS}, p AS (SELECT item_id, doc_id, lower(x.text) AS c, list_filter(list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}_-]+')), lambda x: NOT list_contains({_STOP}, x) AND regexp_matches(x, '^([a-z][a-z0-9-]{{3,}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}})$')) AS t
      FROM r JOIN benchmark b USING (item_id) JOIN documents x USING (doc_id) WHERE rank = 1)
    SELECT item_id, doc_id, CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_filter(t, lambda x: contains(c, x))) / len(t) END::DOUBLE AS memorised FROM p""",
    "benchmark", "documents",
)
def memorisation_score(b, d):
    best = retrieval.keyword_top1(b, d).select("item_id", "doc_id")
    pairs = d.select("doc_id", F.col("text").alias("found")).join(retrieval.bounded(best, b), "doc_id").join(retrieval.bounded(b, b), "item_id")
    return pairs.select("item_id", "doc_id", T.memorised("found", "text").alias("memorised"))


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d::DECIMAL(20, 9), 6) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank::INT AS rank FROM r WHERE rank <= 10""",
    "embeddings",
)
def vector_search(e):
    """Every row whose id is divisible by 100 against all rows, in blocks as matrices."""
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return retrieval.nearest(rows, queries, 10).select("query_id", F.col("id").alias("vec_id"), "rank")


@query(
    f"""WITH {_TOKENS}, l AS (SELECT item_id AS query, doc_id AS id, rank FROM r WHERE rank <= 10
      UNION ALL SELECT query, id, rank FROM (SELECT a.item_id AS query, d.doc_id AS id, row_number() OVER (PARTITION BY a.item_id ORDER BY abs(length(a.text) - d.n_chars), d.doc_id) AS rank FROM benchmark a, documents d) WHERE rank <= 10)
    SELECT query, id, sum((1.0 / (60 + rank))::DECIMAL(20, 12))::DECIMAL(20, 9)::DOUBLE AS rrf FROM l GROUP BY ALL""",
    "benchmark", "documents",
)
def rrf_fusion(b, d):
    words = retrieval.keyword_topk(b, d, 10).select(F.col("item_id").alias("query"), F.col("doc_id").alias("id"), "rank")
    sizes = d.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("value"))
    lengths = retrieval.closest(sizes, b.select(F.col("item_id").alias("query_id"), F.length("text").alias("value")), 10).withColumnRenamed("query_id", "query")
    fused = retrieval.reciprocal_ranks(words.unionByName(lengths))
    return fused.withColumn("rrf", F.col("rrf").cast("decimal(20,9)").cast("double"))


# Bi-temporal facts

_V = "v AS (SELECT *, lead(ts) OVER w AS invalid_at, lag(value) OVER w AS prior, lag(ts) OVER w AS prior_ts, lag(event_id) OVER w AS prior_id FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"


def versions(e):
    return temporal.versions(e.select("event_id", "ts", *KEY, "value"), KEY, "ts", "event_id").withColumnRenamed("ts", "valid_at")


@query(f"WITH {_V} SELECT user_id, event_type, event_id, value FROM v WHERE ts <= TIMESTAMP '2024-01-02' AND (invalid_at > TIMESTAMP '2024-01-02' OR invalid_at IS NULL)", "events")
def asof_slice(e):
    """The slice at one time needs no versions: the last fact of each key that is not later, by a maximum that combines before the shuffle; the date reaches the scan."""
    return temporal.latest(e.select("event_id", "ts", *KEY, "value"), KEY, "ts", "event_id", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).select(*KEY, "event_id", "value")


@query(
    f"""WITH {_V}, b AS (SELECT *, ts + INTERVAL 1 HOUR * (event_id % 7) AS ingested_at FROM v), k AS (SELECT *, lead(ingested_at) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS expired_at FROM b)
    SELECT user_id, event_type, event_id, value FROM k WHERE ts <= TIMESTAMP '2024-01-15' AND (invalid_at > TIMESTAMP '2024-01-15' OR invalid_at IS NULL) AND ingested_at <= TIMESTAMP '2024-01-14 22:00:00' AND (expired_at > TIMESTAMP '2024-01-14 22:00:00' OR expired_at IS NULL)""",
    "events",
)
def asof_bitemporal(e):
    facts = versions(e).withColumn("ingested_at", F.expr("valid_at + make_dt_interval(0, cast(event_id % 7 as int))"))
    facts = facts.withColumn("expired_at", F.lead("ingested_at").over(Window.partitionBy(*KEY).orderBy("valid_at", "event_id")))
    stamp_ = lambda s: F.lit(s).cast("timestamp_ntz")
    return temporal.as_of(facts, stamp_("2024-01-15 00:00:00"), stamp_("2024-01-14 22:00:00")).select(*KEY, "event_id", "value")


_NEXT = "nx AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS b FROM orders), ed AS (SELECT a, b FROM nx WHERE b IS NOT NULL)"


def next_orders(o):
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b is not null")


@query(f"WITH {_NEXT} SELECT a AS root FROM ed EXCEPT SELECT b FROM ed", "orders")
def roots_except(o):
    e = next_orders(o)
    return e.select(F.col("a").alias("root")).distinct().join(e.select(F.col("b").alias("root")), "root", "left_anti")


@query(
    f"""WITH {_NEXT}, s AS (SELECT o_orderkey AS seed FROM orders WHERE o_orderkey % 100 = 0), f AS (SELECT seed, seed AS id, 0 AS depth FROM s UNION SELECT seed, b, 1 FROM s JOIN ed ON a = seed
      UNION SELECT seed, e2.b, 2 FROM s JOIN ed e1 ON e1.a = seed JOIN ed e2 ON e2.a = e1.b), n AS (SELECT seed, id, min(depth) AS depth FROM f GROUP BY ALL),
    c AS (SELECT seed, id, depth, sum((id % 7 + 1)) OVER (PARTITION BY seed ORDER BY depth, id ROWS UNBOUNDED PRECEDING) AS spent FROM n) SELECT seed, id, depth::INT AS depth, spent::BIGINT AS spent FROM c WHERE spent <= 12""",
    "orders",
)
def bfs_budget(o):
    seeds = o.where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("id"))
    cost = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7 + 1).alias("cost"))
    return graph.neighbourhood(next_orders(o), seeds, 2, 12, cost).select("seed", "id", "depth", "spent")


@query(
    f"""WITH {_NEXT}, t AS (SELECT a AS s, b AS t FROM ed UNION ALL SELECT b, a FROM ed UNION ALL SELECT a, -a FROM ed), d AS (SELECT t.*, x.o_orderdate AS ds, y.o_orderdate AS dt FROM t LEFT JOIN orders x ON x.o_orderkey = s LEFT JOIN orders y ON y.o_orderkey = t)
    SELECT CASE WHEN dt IS NULL THEN 'dangling' WHEN dt < ds THEN 'order' WHEN date_diff('day', ds::DATE, dt::DATE) < 90 THEN 'gap' ELSE 'ok' END AS rule, count(*)::BIGINT AS n FROM d GROUP BY 1""",
    "orders",
)
def edge_constraints(o):
    e = next_orders(o)
    t = e.toDF("s", "t").unionAll(e.select("b", "a")).unionAll(e.select("a", (-F.col("a")).alias("b")))
    at = lambda k, d: o.select(F.col("o_orderkey").alias(k), F.col("o_orderdate").cast("date").alias(d), F.col("o_orderdate").alias(d + "t"))
    d = t.join(at("s", "ds"), "s", "left").join(at("t", "dt"), "t", "left")
    rule = F.when(F.col("dt").isNull(), "dangling").when(F.col("dtt") < F.col("dst"), "order").when(F.datediff("dt", "ds") < 90, "gap").otherwise("ok")
    return d.groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT user_id, event_type, max(ts) AS t FROM events GROUP BY ALL), l AS (SELECT s.user_id, s.event_type, s.t, e.event_id, e.ts FROM s JOIN events e ON e.user_id = s.user_id AND e.event_type <> s.event_type AND e.ts > s.t)
    SELECT user_id, event_type, arg_min(event_id, ts) AS cited_by, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS cited_at FROM l GROUP BY ALL""",
    "events",
)
def stale_citations(e):
    """The last event of each key and the user's next one, which is of another type: one window by user, no join."""
    next_ = F.lead(F.struct("ts", "event_id")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select(*KEY, "ts", "event_id", next_.alias("n")).groupBy(*KEY).agg(F.max_by("n", F.struct("ts", "event_id")).alias("n"))
    return rows.where("n is not null").select(*KEY, F.col("n.event_id").alias("cited_by"), stamp("n.ts").alias("cited_at"))


# Scores and reports

_SCORE = "sum((l_quantity::DECIMAL(28, 6) * least(1, greatest(0, 10 * l_discount))::DECIMAL(28, 6))::DECIMAL(28, 6))::DOUBLE / sum(l_quantity::DECIMAL(28, 6))::DOUBLE"


def rubric_scores(li):
    return scoring.rubric(li, ["l_orderkey"], F.col("l_quantity"), 10 * F.col("l_discount"))


@query(f"SELECT l_orderkey, {_SCORE} AS score FROM lineitem GROUP BY l_orderkey", "lineitem")
def rubric_score(li):
    return rubric_scores(li)


_RUN = f"s AS (SELECT l_orderkey, {_SCORE} AS score FROM lineitem GROUP BY l_orderkey), j AS (SELECT o.*, coalesce(score, 0) AS score FROM orders o LEFT JOIN s ON l_orderkey = o_orderkey)"
_MEAN = "sum(score::DECIMAL(28, 12))::DOUBLE / count(score)"


def judged(o, li):
    return o.join(rubric_scores(li).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


@query(
    f"""WITH {_RUN} SELECT o_orderstatus AS tier, o_orderpriority AS system, count(*)::BIGINT AS n, {_MEAN} AS accuracy_mean, count(*) FILTER (score >= 0.5) / count(*) AS exact_match_rate,
    round(quantile_cont(nullif(floor(o_totalprice), 0), 0.5), 2) AS latency_p50, round(quantile_cont(nullif(floor(o_totalprice), 0), 0.95), 2) AS latency_p95 FROM j GROUP BY ALL""",
    "orders", "lineitem",
)
def run_metrics(o, li):
    rows = judged(o, li).select(F.col("o_orderstatus").alias("tier"), F.col("o_orderpriority").alias("system"), "score", (F.col("score") >= 0.5).alias("exact"), F.floor("o_totalprice").cast("double").alias("latency"))
    found = scoring.run_metrics(rows, ["tier", "system"])  # twentieths of whole latencies: engines differ in the last bits of what they interpolate
    return found.withColumns({c: F.round(c, 2) for c in ("latency_p50", "latency_p95")})


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type", "events")
def percentiles(e):
    return ranks.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query(f"WITH {_RUN} SELECT c_mktsegment AS category, count(*)::BIGINT AS n, {_MEAN} AS accuracy_mean FROM j JOIN customer ON c_custkey = o_custkey GROUP BY 1", "orders", "lineitem", "customer")
def category_scores(o, li, c):
    rows = judged(o, li).join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("category")), "o_custkey")
    return rows.groupBy("category").agg(F.count("*").alias("n"), scoring.mean("score").alias("accuracy_mean"))


@query(f"WITH {_RUN} SELECT CASE WHEN o_totalprice >= 300000 THEN 'hard' WHEN o_totalprice >= 100000 THEN 'medium' WHEN o_totalprice > 0 THEN 'easy' ELSE 'unspecified' END AS difficulty, count(*)::BIGINT AS n, {_MEAN} AS accuracy_mean FROM j GROUP BY 1", "orders", "lineitem")
def difficulty_scores(o, li):
    p = F.col("o_totalprice")
    level = F.when(p >= 300000, "hard").when(p >= 100000, "medium").when(p > 0, "easy").otherwise("unspecified")
    return judged(o, li).groupBy(level.alias("difficulty")).agg(F.count("*").alias("n"), scoring.mean("score").alias("accuracy_mean"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    f"""WITH {_RUN}, k AS (SELECT o_orderstatus AS tier, o_orderpriority AS system, c_mktsegment AS g, score FROM j JOIN customer ON c_custkey = o_custkey), t AS (SELECT tier, system, {_MEAN} AS accuracy_mean,
      {", ".join(f"sum(score::DECIMAL(28, 12)) FILTER (g = '{s}')::DOUBLE / count(score) FILTER (g = '{s}') AS {s}" for s in SEGMENTS)} FROM k GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY tier ORDER BY accuracy_mean DESC, system)::INT AS rank FROM t""",
    "orders", "lineitem", "customer",
)
def leaderboard_pivot(o, li, c):
    rows = judged(o, li).join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return scoring.leaderboard(rows.select(F.col("o_orderstatus").alias("tier"), F.col("o_orderpriority").alias("system"), "c_mktsegment", "score"), "tier", "system", "c_mktsegment", SEGMENTS)


@query("SELECT event_type AS failure_mode, count(*)::BIGINT AS n FROM events GROUP BY 1", "events")
def failure_histogram(e):
    return e.groupBy(F.col("event_type").alias("failure_mode")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS tier, o_orderpriority AS system, count(*)::BIGINT AS calls, sum(o_totalprice::DECIMAL(28, 6))::DOUBLE AS cost FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "orders")
def usage_rollup(o):
    return o.rollup(F.col("o_orderstatus").alias("tier"), F.col("o_orderpriority").alias("system")).agg(F.count("*").alias("calls"), F.sum(scoring.exact("o_totalprice")).cast("double").alias("cost"))


@query(
    f"""WITH {_RUN}, h AS (SELECT o_orderpriority AS system, o_orderkey % 2 = 0 AS new, score FROM j)
    SELECT system, sum(score::DECIMAL(28, 12)) FILTER (new)::DOUBLE / count(*) FILTER (new) - sum(score::DECIMAL(28, 12)) FILTER (NOT new)::DOUBLE / count(*) FILTER (NOT new) AS delta FROM h GROUP BY system""",
    "orders", "lineitem",
)
def rejudge_delta(o, li):
    rows = judged(o, li).select(F.col("o_orderpriority").alias("system"), (F.col("o_orderkey") % 2 == 0).alias("new"), "score")
    half = lambda new: scoring.mean(F.when(F.col("new") == new, F.col("score")))
    return rows.groupBy("system").agg((half(True) - half(False)).alias("delta"))


# Quality of data

_VERDICT = "CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0 END"


def verdicts():
    return F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "yes").when(F.col("quality") == 1, "partial").otherwise("no")


@query(f"SELECT source, count(*)::BIGINT AS facts, sum({_VERDICT})::DOUBLE / count(*) AS substrate FROM labels JOIN documents USING (doc_id) GROUP BY source", "labels", "documents")
def substrate_score(lab, d):
    rows = lab.join(d.select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("facts"), (F.sum(scoring.verdict_score(verdicts())) / F.count("*")).alias("substrate"))


@query("SELECT pattern, count(*)::BIGINT AS facets, count(*) FILTER (covered) / count(*) AS coverage FROM (SELECT doc_id % 50 AS pattern, doc_id % 5 AS facet, bool_or(toxic = 1) AS covered FROM labels GROUP BY ALL) GROUP BY pattern", "labels")
def facet_coverage(lab):
    facets = lab.groupBy((F.col("doc_id") % 50).alias("pattern"), (F.col("doc_id") % 5).alias("facet")).agg(F.bool_or(F.col("toxic") == 1).alias("covered"))
    return facets.groupBy("pattern").agg(F.count("*").alias("facets"), (F.count_if("covered") / F.count("*")).alias("coverage"))


@query(
    """SELECT CASE WHEN lang IS NULL OR n_chars < 40 THEN 'schema' WHEN l.doc_id IS NULL THEN 'no_evidence' WHEN quality = 0 THEN 'incomplete' WHEN toxic = 1 THEN 'memorised' ELSE 'pass' END AS disposition, count(*)::BIGINT AS n
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
    "documents", "labels",
)
def disposition_cascade(d, lab):
    rows = d.select("doc_id", "lang", "n_chars").join(lab.withColumn("labelled", F.lit(1)), "doc_id", "left")
    kind = scoring.disposition(F.col("lang").isNotNull() & (F.col("n_chars") >= 40), F.coalesce("labelled", F.lit(0)), F.coalesce(F.col("quality") != 0, F.lit(True)), F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return rows.groupBy(kind.alias("disposition")).agg(F.count("*").alias("n"))


@query(
    """WITH t(category, target) AS (VALUES ('click', 2000), ('purchase', 4000), ('error', 3000), ('signup', 2500), ('view', 1000), ('refund', 7)), n AS (SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1)
    SELECT category, (target - coalesce(n, 0))::BIGINT AS gap FROM t LEFT JOIN n USING (category) WHERE target > coalesce(n, 0)""",
    "events",
)
def coverage_gap(e):
    targets = e.sparkSession.createDataFrame([("click", 2000), ("purchase", 4000), ("error", 3000), ("signup", 2500), ("view", 1000), ("refund", 7)], "category string, target bigint")
    n = e.groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"))
    return targets.join(n, "category", "left").select("category", (F.col("target") - F.coalesce("n", F.lit(0))).alias("gap")).where("gap > 0")


@query(
    """SELECT event_type, ((rn - 1) // 50)::BIGINT AS chunk, count(*)::BIGINT AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY ALL""",
    "events",
)
def chunking(e):
    rn = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))
    return e.select("event_type", "event_id", F.floor((rn - 1) / 50).alias("chunk")).groupBy("event_type", "chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT DISTINCT line, n FROM (SELECT line, count(DISTINCT doc_id)::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY line) WHERE n >= 2", "documents")
def phrase_collision(d):
    """Lines are counted once a document before they meet: the shuffle carries a hash, and one copy of the line a partition."""
    lines = d.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.trim("line") != "")
    return lines.groupBy("line").agg(F.count("*").alias("n")).where("n >= 2")


# State, plans, merges


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations) WHERE rn = 1", "conversations")
def dedup_last_wins(c):
    return state.last_wins(c.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"])


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R')::INT DESC, l_partkey, l_suppkey, l_returnflag) AS rn FROM lineitem) WHERE rn = 1""",
    "lineitem",
)
def primary_pick(li):
    best = F.min(F.struct((F.col("l_returnflag") != "R").cast("int").alias("late"), "l_partkey", "l_suppkey", "l_returnflag"))
    return li.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.l_partkey", "b.l_suppkey", "b.l_returnflag")


@query(
    """SELECT 'missing' AS kind, count(*)::BIGINT AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT 'unknown', count(*)::BIGINT FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT 'present', count(*)::BIGINT FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "documents", "labels",
)
def set_validate(d, lab):
    d, lab = d.select("doc_id"), lab.select("doc_id")
    n = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("missing", d.join(lab, "doc_id", "left_anti")).unionAll(n("unknown", lab.join(d, "doc_id", "left_anti"))).unionAll(n("present", d.join(lab, "doc_id", "left_semi")))


@query("SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')", "events")
def resume_anti(e):
    return state.remaining(e.select("event_id", "event_type"), e.where("event_type = 'click'"), "event_id")


@query(
    """WITH d(n, era, a, b) AS (VALUES (1, 'founding', 1992, 1993), (2, 'growth', 1993, 1996), (3, 'scale', 1997, 1997)) SELECT o_orderkey, coalesce((SELECT arg_min(era, n) FROM d WHERE year(o_orderdate) BETWEEN a AND b), 'founding') AS era FROM orders""",
    "orders",
)
def interval_dim_join(o):
    eras = o.sparkSession.createDataFrame([(1, "founding", 1992, 1993), (2, "growth", 1993, 1996), (3, "scale", 1997, 1997)], "n int, era string, a int, b int")
    return temporal.interval_lookup(o.select("o_orderkey", F.year("o_orderdate").alias("year")), "year", eras, "a", "b", "era", "n").select("o_orderkey", "era")


@query(
    """WITH t(tier, cap, fee) AS (VALUES ('free', 5, 0), ('starter', 10, 19), ('growth', 15, 79)), n AS (SELECT o_custkey, count(*) AS need FROM orders GROUP BY 1)
    SELECT o_custkey, need::BIGINT AS need, arg_min(tier, fee) AS tier, coalesce(min(fee), -1)::INT AS fee FROM n LEFT JOIN t ON need <= cap GROUP BY ALL""",
    "orders",
)
def tier_first_fit(o):
    tiers = o.sparkSession.createDataFrame([("free", 5, 0), ("starter", 10, 19), ("growth", 15, 79)], "tier string, cap bigint, fee int")
    return state.first_fit(o.groupBy("o_custkey").agg(F.count("*").alias("need")), "o_custkey", "need", tiers)


@query(
    """WITH p(system, calls, price_in, price_out) AS (VALUES ('a', 1.5, 0.25, 0.5), ('b', 17.0, 0.125, 0.25), ('c', 0.0, 0.5, 1.0)), s AS (SELECT o_orderstatus AS tier, count(*) AS artifacts, count(DISTINCT o_custkey) AS questions FROM orders GROUP BY 1)
    SELECT system, tier, (calls * artifacts * price_in + questions * price_out)::DOUBLE AS cost, (calls * artifacts * price_in + questions * price_out) < 2000 AS included FROM p, s""",
    "orders",
)
def budget_plan(o):
    profiles = o.sparkSession.createDataFrame([("a", 1.5, 0.25, 0.5), ("b", 17.0, 0.125, 0.25), ("c", 0.0, 0.5, 1.0)], "system string, calls double, price_in double, price_out double")
    sizes = o.groupBy(F.col("o_orderstatus").alias("tier")).agg(F.count("*").alias("artifacts"), F.countDistinct("o_custkey").alias("questions"))
    return state.plan(profiles, sizes, 2000.0).select("system", "tier", "cost", "included")


@query(
    """WITH p AS (SELECT event_type, date_trunc('hour', ts) AS h, (count(*) // 3)::BIGINT AS n FROM events GROUP BY ALL), g AS (SELECT *, CASE WHEN n = lag(n) OVER w THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY event_type ORDER BY h)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY h) AS island FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, island ORDER BY h) AS run FROM i)
    SELECT event_type, strftime(min(h), '%Y-%m-%d %H:%M:%S') AS settled_at, arg_min(n, h) AS n FROM r WHERE run >= 3 GROUP BY event_type""",
    "events",
)
def settle_detector(e):
    polls = e.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.expr("count(*) div 3").alias("n"))
    return state.settled(polls, ["event_type"], "h", "n", 3).select("event_type", stamp("h").alias("settled_at"), "n")


@query(
    """SELECT p_partkey, coalesce(s_name, p_name) AS p_name, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, p_retailprice) AS p_retailprice, p_size FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""",
    "part", "supplier",
)
def patch_merge(p, s):
    patches = s.select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("p_name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("p_retailprice"))
    return state.patched(p.select("p_partkey", "p_name", "p_retailprice", "p_size"), patches, "p_partkey", ["p_name", "p_retailprice"])


@query(
    """SELECT r_name, y::INT AS year, q::INT AS quarter, coalesce(n, 0)::BIGINT AS n FROM region, range(1992, 1999) a(y), range(1, 5) b(q) LEFT JOIN (SELECT n_regionkey AS k, year(o_orderdate) AS oy, quarter(o_orderdate) AS oq, count(*) AS n
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) ON k = r_regionkey AND oy = y AND oq = q""",
    "region", "nation", "customer", "orders",
)
def spine_grid(r, n, c, o):
    spine = r.select("r_regionkey", "r_name", F.explode(F.sequence(F.lit(1992), F.lit(1998))).alias("year")).select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("quarter"))
    own = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("r_regionkey"))
    counts = o.join(own, "o_custkey").groupBy("r_regionkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").alias("n"))
    return spine.join(counts, ["r_regionkey", "year", "quarter"], "left").select("r_name", "year", "quarter", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT user_id, n::BIGINT AS sessions FROM (SELECT user_id, count(*) AS n FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts > p + INTERVAL 6 HOUR GROUP BY 1)", "events")
def sessions(e):
    p = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", "ts", p.alias("p")).where("p is null or ts > p + interval 6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"))
