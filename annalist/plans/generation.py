"""Queries of spines, allocations, cross references, histories and loose texts, with their SQL. The tables stand for what catalogue says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import parse as P
from annalist.functions import text as T
from annalist.operators import planning
from annalist.plans import catalogue
from annalist.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *tables: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(*[table(spark, folder, t) for t in tables])
        ORACLES[f.__name__] = sql
        return f

    return register


# Spines


@query(
    """WITH c AS (SELECT o_custkey, min(year(o_orderdate)) AS a, CASE WHEN o_custkey % 3 <> 0 THEN max(year(o_orderdate)) END AS b FROM orders GROUP BY 1)
    SELECT y::INT AS year, count(*)::BIGINT AS customers FROM c JOIN range(1992, 1999) t(y) ON y >= a AND y <= coalesce(b, 1998) GROUP BY 1""",
    "orders",
)
def active_years(o):
    """Customers by the years of their lifetime; every third one has no end."""
    year = F.year("o_orderdate")
    c = o.groupBy("o_custkey").agg(F.min(year).alias("a"), F.max(year).alias("b"))
    rows = planning.alive(c, F.col("a"), F.when(F.col("o_custkey") % 3 != 0, F.col("b")), "year", 1998)
    return rows.groupBy("year").agg(F.count("*").alias("customers"))


@query(
    """WITH c AS (SELECT o_custkey, min(year(o_orderdate) * 12 + month(o_orderdate)) AS a, max(year(o_orderdate) * 12 + month(o_orderdate)) AS b FROM orders GROUP BY 1)
    SELECT m::INT AS month, count(*)::BIGINT AS customers FROM c, range(23905, 23990) t(m) WHERE m >= a AND m < b GROUP BY 1""",
    "orders",
)
def alive_months(o):
    """Half-open months, by way of their texts."""
    month = P.month_index(F.date_format("o_orderdate", "yyyy-MM"))
    c = o.groupBy("o_custkey").agg(F.min(month).alias("a"), F.max(month).alias("b"))
    return planning.alive(c, F.col("a"), F.col("b") - 1, "month", 23989).groupBy("month").agg(F.count("*").alias("customers"))


@query(
    """SELECT event_id, 'EV-' || strftime(ts, '%Y%m%d') || '-' || lpad(row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::VARCHAR, 3, '0') AS id FROM events""",
    "events",
)
def sequence_ids(e):
    rows = e.select("event_id", "user_id", "ts", F.col("ts").cast("date").alias("day"))
    return planning.sequence_ids(rows, ["user_id", "day"], ["ts", "event_id"], F.concat(F.lit("EV-"), F.date_format("ts", "yyyyMMdd"))).select("event_id", "id")


@query(
    """WITH n AS (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1) SELECT a.year::INT AS year, a.n::BIGINT AS n, coalesce(sum(b.n), 0)::BIGINT AS around FROM n a LEFT JOIN n b ON abs(a.year - b.year) = 1 GROUP BY ALL""",
    "orders",
)
def adjacent_years(o):
    n = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return planning.neighbours(n, "year", "n", "around")


@query(
    """WITH RECURSIVE n AS (SELECT event_type AS category, (12 - min(user_id) % 10)::BIGINT AS gap FROM events GROUP BY 1), g AS (SELECT *, row_number() OVER (ORDER BY gap DESC, category) AS i, count(*) OVER () AS k, least(20, sum(gap) OVER ())::BIGINT AS total FROM n WHERE gap > 0),
    f AS (SELECT 0::BIGINT AS i, '' AS category, 0::BIGINT AS ask, max(total) AS rest FROM g
      UNION ALL SELECT g.i, g.category, least(g.gap, greatest(1, f.rest // g.k), f.rest), f.rest - least(g.gap, greatest(1, f.rest // g.k), f.rest) FROM f JOIN g ON g.i = f.i + 1)
    SELECT category, ask::BIGINT AS ask FROM f WHERE ask > 0""",
    "events",
)
def gap_fill(e):
    gaps = e.groupBy(F.col("event_type").alias("category")).agg((12 - F.min("user_id") % 10).alias("gap"))
    return planning.fill_gaps(gaps, "category", "gap", 20)


@query("SELECT event_type, event_id, rank::INT AS rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || ':42'), event_id) AS rank FROM events) WHERE rank <= 5", "events")
def seeded_draw(e):
    """The draw is the feature: five of each kind."""
    return planning.draw(e.select("event_type", "event_id"), ["event_type"], "event_id", 5, 42)


# Histories and references


_PRIMARY = "p AS (SELECT l_orderkey AS k, l_partkey AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R')::INT DESC, l_partkey, l_suppkey, l_returnflag) AS rn FROM lineitem) WHERE rn = 1)"


@query(f"WITH {catalogue._NEXT}, {_PRIMARY} SELECT a, b, x.part AS part_a, y.part AS part_b FROM ed JOIN p x ON x.k = a JOIN p y ON y.k = b", "orders", "lineitem")
def cross_references(o, li):
    """Edges with the preferred evidence of both ends."""
    best = catalogue.primary_pick(li)
    side = lambda s: best.select(F.col("l_orderkey").alias(s), F.col("l_partkey").alias(f"part_{s}"))
    return catalogue.next_orders(o).join(side("a"), "a").join(side("b"), "b").select("a", "b", "part_a", "part_b")


@query("SELECT o_custkey, o_orderstatus, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS targets, count(*)::BIGINT AS n FROM orders GROUP BY ALL", "orders")
def relation_multimap(o):
    keys = F.array_sort(F.collect_list("o_orderkey"))
    return o.groupBy("o_custkey", "o_orderstatus").agg(F.array_join(F.transform(keys, lambda k: k.cast("string")), ",").alias("targets"), F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT 'x' AS kind, o_orderkey AS a, o_orderkey + 1 AS b FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT 'x', o_orderkey, o_orderkey + 1 FROM orders WHERE o_orderkey % 2 = 0),
    s AS (SELECT n.* FROM n JOIN orders o ON o.o_orderkey = n.b) SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = s.a AND o.o_orderkey % 10 = 0)""",
    "orders",
)
def derived_edges(o):
    """Edges from a correcting id: both ends exist, doubles are one, those there already are left out."""
    edge = lambda m: o.where(F.col("o_orderkey") % m == 0).select(F.lit("x").alias("kind"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    there = o.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("a"))
    ends = o.select(F.col("o_orderkey").alias("b"))
    return edge(3).unionByName(edge(2)).join(ends, "b", "left_semi").join(there, "a", "left_anti").select("kind", "a", "b").dropDuplicates(["kind", "a", "b"])


@query(
    """SELECT source, lang, n_docs::BIGINT AS n_docs, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_docs DESC, lang) AS rank FROM (SELECT source, lang, count(*) AS n_docs FROM documents WHERE lang IS NOT NULL GROUP BY ALL)) WHERE rank <= 2""",
    "documents",
)
def first_per_category(d):
    """The top two of each category, as the feature is."""
    n = d.where("lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n_docs"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_docs"), "lang"))).where("rank <= 2")


@query(
    """WITH a AS (SELECT o_orderstatus AS tier, o_orderpriority AS system, sum(o_totalprice::DECIMAL(28, 6))::DOUBLE AS actual FROM orders GROUP BY ALL), e(tier, system, estimate) AS (VALUES ('F', '1-URGENT', 1000.0), ('O', '2-HIGH', 2000.0))
    SELECT tier, system, actual, estimate::DOUBLE AS estimate, actual - estimate AS over FROM a LEFT JOIN e USING (tier, system)""",
    "orders",
)
def actual_and_estimate(o):
    estimates = o.sparkSession.createDataFrame([("F", "1-URGENT", 1000.0), ("O", "2-HIGH", 2000.0)], "tier string, system string, estimate double")
    actual = o.groupBy(F.col("o_orderstatus").alias("tier"), F.col("o_orderpriority").alias("system")).agg(F.sum(F.col("o_totalprice").cast("decimal(28,6)")).cast("double").alias("actual"))
    return actual.join(estimates, ["tier", "system"], "left").withColumn("over", F.col("actual") - F.col("estimate"))


# Loose texts


@query(
    """WITH t AS (SELECT o_orderkey, o_orderdate AS d FROM orders) SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(d, '%Y-%m-%dT00:00:00Z') WHEN 1 THEN strftime(d, '%Y-%m-%dT00:00:00Z') WHEN 2 THEN strftime(d, '%Y-%m-%dT07:08:09Z') END AS parsed FROM t""",
    "orders",
)
def iso_times(o):
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit(" or so"))).when(k == 2, F.concat(day, F.lit("T07:08:09Z"))).otherwise("soon")
    return o.select("o_orderkey", P.iso_text(P.iso_time(raw)).alias("parsed"))


@query(
    r"""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN year(d) || '-' || month(d) WHEN 1 THEN strftime(d, '%Y-%m') WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN ' ' || year(d) || ' ' WHEN 4 THEN strftime(d, '%Y%m%d') WHEN 5 THEN year(d) || '-Q' || quarter(d) WHEN 6 THEN 'in ' || year(d) WHEN 7 THEN year(d) || '/' || month(d) END AS raw FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)),
    p AS (SELECT o_orderkey, regexp_extract(trim(raw), '^([0-9]{4})(-([0-9]{1,2}))?', ['y', 'x', 'm']) AS f FROM r) SELECT o_orderkey, CASE WHEN coalesce(f.m, '') <> '' THEN f.y || '-' || lpad(f.m, 2, '0') || '-15' WHEN coalesce(f.y, '') <> '' THEN f.y || '-06-15' ELSE '2023-06-15' END AS middle FROM p""",
    "orders",
)
def middle_dates(o):
    """Loose dates of nine kinds."""
    k, d = F.col("o_orderkey") % 9, F.col("o_orderdate")
    y, m = F.year(d).cast("string"), F.month(d).cast("string")
    shapes = [F.concat_ws("-", y, m), F.date_format(d, "yyyy-MM"), F.date_format(d, "yyyy-MM-dd"), F.concat(F.lit(" "), y, F.lit(" ")), F.date_format(d, "yyyyMMdd"), F.concat(y, F.lit("-Q"), F.quarter(d).cast("string")), F.concat(F.lit("in "), y), F.concat_ws("/", y, m)]
    raw = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        raw = F.when(k == i, shape).otherwise(raw)
    return o.select("o_orderkey", P.middle_date(raw).alias("middle"))


@query(
    """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, length(coalesce(text, '')) AS n FROM conversations) SELECT conv_id, turn, r AS role, n::BIGINT AS size, (2 + turn % 3)::INT AS docs, CASE WHEN turn % 3 > 0 THEN turn END::BIGINT AS more FROM t""",
    "conversations",
)
def yaml_fields(c):
    """Each turn written as two small documents and up to two more in a fence, and read again."""
    role, size = F.coalesce("role", F.lit("")), F.length(F.coalesce("text", F.lit(""))).cast("string")
    raw = F.concat(F.lit("```yaml\nrole: old\nrole: ‘"), role, F.lit("’\n- noise\n---\nsize: "), size, F.lit("\n"), F.repeat(F.concat(F.lit("---\nmore: "), F.col("turn").cast("string"), F.lit("\n---\n")), (F.col("turn") % 3).cast("int")), F.lit("```\nend"))
    docs = P.yaml_documents(raw)
    return c.select("conv_id", "turn", docs[0]["role"].alias("role"), docs[1]["size"].cast("bigint").alias("size"), F.size(docs).alias("docs"), F.get(docs, F.lit(2))["more"].cast("bigint").alias("more"))


_KINDS = [*T.DIRECT, *T.INFERENCE, "poem", "adr2", ""]


@query(
    f"""WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN upper(g) WHEN 1 THEN '  ' || g || ' ' WHEN 2 THEN replace(g, '_', ' ') WHEN 3 THEN g END AS raw FROM (SELECT p_partkey, (['{"', '".join(_KINDS)}'])[(p_partkey % {len(_KINDS)} + 1)::INT] AS g FROM part))
    SELECT p_partkey, CASE WHEN list_contains(['{"', '".join(T.DIRECT)}'], lower(trim(raw))) THEN 'direct_testimony' WHEN list_contains(['{"', '".join(T.INFERENCE)}'], lower(trim(raw))) THEN 'inference' ELSE 'unknown' END AS testimony FROM r""",
    "part",
)
def testimony_types(p):
    """Kinds of testimony of genres in capitals, with blanks, misspelt and missing."""
    k = F.col("p_partkey")
    g = F.element_at(F.array(*map(F.lit, _KINDS)), (k % len(_KINDS) + 1).cast("int"))
    raw = F.when(k % 5 == 0, F.upper(g)).when(k % 5 == 1, F.concat(F.lit("  "), g, F.lit(" "))).when(k % 5 == 2, F.replace(g, F.lit("_"), F.lit(" "))).when(k % 5 == 3, g)
    return p.select("p_partkey", T.testimony_type(raw).alias("testimony"))
