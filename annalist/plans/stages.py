"""Queries of model stages, graph searches, stored scopes and keyed tables, exact ranks and date joins, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import nested
from annalist.functions import rules as R
from annalist.operators import adapters, boards, calls, evaluation, graph, merging, planning, repair, retrieval
from annalist.plans import knowledge
from annalist.sources import harness, shared, written
from annalist.sources.keyed import Keyed, repointed
from annalist.sources.scopes import Scopes
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


# Model stages


def scheduled():
    """A client of prompts `id|failures|reply`: it fails so often and then replies, which may be with nothing."""
    left: dict[str, int] = {}

    def client(prompt: str) -> str:
        _, fails, reply = prompt.split("|")
        if left.setdefault(prompt, int(fails)) > 0:
            left[prompt] -= 1
            raise ConnectionError("as scheduled")
        return reply

    return client


GUARD = calls.Guard(attempts=4, wait=2.0, doublings=1, cap=3.0, breaker=5, sleep=None)
_SCHEDULE = """t AS (SELECT o_orderkey, (o_custkey % 64)::INT AS lane, o_orderkey % CASE WHEN o_custkey % 64 < 32 THEN 6 ELSE 3 END AS fails FROM orders),
    p AS (SELECT *, fails >= 4 AS lost, o_orderkey % 4 = 3 OR fails >= 4 AS missed FROM t),
    q AS (SELECT *, sum((NOT missed)::INT) OVER (PARTITION BY lane ORDER BY o_orderkey) AS island FROM p),
    r AS (SELECT *, count(*) FILTER (missed) OVER (PARTITION BY lane, island ORDER BY o_orderkey) AS row_of FROM q),
    o AS (SELECT *, min(CASE WHEN row_of = 5 THEN o_orderkey END) OVER (PARTITION BY lane) AS opened FROM r),
    c AS (SELECT *, max(CASE WHEN o_orderkey = opened THEN island END) OVER (PARTITION BY lane) AS broke FROM o),
    f AS (SELECT o_orderkey, lane, CASE WHEN o_orderkey > opened THEN 'skipped' WHEN island = broke AND missed AND row_of <= 5 THEN 'broken' WHEN lost THEN 'failed' WHEN missed THEN 'empty' ELSE 'ok' END AS status,
      CASE WHEN o_orderkey > opened THEN 0 WHEN lost THEN 4 ELSE fails + 1 END::INT AS attempts, CASE WHEN o_orderkey > opened THEN 0 ELSE list_sum([[0, 2, 5, 8][least(fails, 3) + 1]]) END::DOUBLE AS waited FROM c)"""


@query(f"WITH {_SCHEDULE} SELECT o_orderkey, lane, status, attempts, waited FROM f", "orders")
def calls_guarded(o):
    """A call for each order by its schedule of failures and blanks, in lanes of customers."""
    return outcomes(o).select("o_orderkey", "lane", "status", "attempts", "waited")


@query(f"WITH {_SCHEDULE} SELECT o_orderkey FROM f WHERE status NOT IN ('ok', 'empty', 'failed')", "orders")
def calls_remaining(o):
    """What a second run has to call: rows that broke a lane or came after."""
    return calls.remaining(o.select("o_orderkey"), outcomes(o), ["o_orderkey"])


@query(f"WITH {_SCHEDULE} SELECT o_orderkey, CASE WHEN status = 'ok' AND o_orderkey % 5 > 0 THEN least(1, (o_orderkey % 40) / 32) ELSE 0 END::DOUBLE AS score, CASE WHEN status <> 'ok' THEN status WHEN o_orderkey % 5 = 0 THEN 'unreadable' ELSE 'none' END AS failure_mode FROM f", "orders")
def verdicts_guarded(o):
    """Verdicts out of the replies: cut to 0 to 1, blank and lost ones told apart from unreadable ones."""
    return calls.verdicts(outcomes(o), ["o_orderkey"])


def outcomes(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    reply = F.when(k % 4 == 3, "").when(k % 5 == 0, "no json").otherwise(F.format_string('{"score": %s}', s(k % 40 / F.lit(32.0))))
    return calls.called(o, ["o_orderkey"], ["o_orderkey"], F.concat_ws("|", s(k), s(F.when(F.col("o_custkey") % 64 < 32, k % 6).otherwise(k % 3)), reply), scheduled, GUARD, lanes=64, lane=F.col("o_custkey") % 64)


# Graphs


@query(
    """WITH RECURSIVE q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark), t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents),
    o AS (SELECT item_id, doc_id, count(*) AS score FROM q JOIN t USING (token) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM o),
    x AS (SELECT doc_id AS a, coalesce(lead(doc_id) OVER w, first(doc_id) OVER (PARTITION BY lang ORDER BY doc_id)) AS b, lead(doc_id, 5) OVER w AS c FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)),
    ed AS (SELECT a, b FROM x UNION SELECT a, c FROM x WHERE a % 5 = 0 AND c IS NOT NULL),
    f AS (SELECT item_id AS query, doc_id AS id, 0 AS depth FROM r WHERE rank <= 2 UNION SELECT query, b, depth + 1 FROM f JOIN ed ON a = id WHERE depth < 60), n AS (SELECT query, id, min(depth) AS depth FROM f GROUP BY ALL),
    s AS (SELECT query, id, depth, sum(1 + n_chars // 4) OVER (PARTITION BY query ORDER BY depth, id ROWS UNBOUNDED PRECEDING) AS spent FROM n JOIN documents ON doc_id = id)
    SELECT query, id, depth::INT AS depth, spent::BIGINT AS spent FROM s WHERE spent <= 12000""",
    "benchmark", "documents",
)
def subgraph_budget(b, d):
    """Around the two best documents of each question along rings of their languages with short cuts, until 12,000 tokens are spent."""
    w = Window.partitionBy("lang").orderBy("doc_id")
    x = d.select(F.col("doc_id").alias("a"), F.coalesce(F.lead("doc_id").over(w), F.first("doc_id").over(w)).alias("b"), F.lead("doc_id", 5).over(w).alias("c"))
    edges = x.select("a", F.explode(F.array_compact(F.array_distinct(F.array("b", F.when(F.col("a") % 5 == 0, F.col("c")))))).alias("b"))
    seeds = retrieval.keyword_topk(b, d, 2).select(F.col("item_id").alias("query"), F.col("doc_id").alias("id"))
    return graph.subgraph(edges, seeds, d.select(F.col("doc_id").alias("id"), F.expr("1 + n_chars div 4").alias("cost")), 12_000)


@query(
    f"""WITH {knowledge._GRAPH}, af AS (SELECT id AS event_id, unnest(evidence) AS v, generate_subscripts(evidence, 1) AS i FROM e), a AS (SELECT event_id, v.slot_id AS slot_id, CASE WHEN event_id % 4 = 1 THEN 'secondary' ELSE 'primary' END AS role, event_id * 10 + i AS ord FROM af),
    st AS (SELECT event_id, arg_min(slot_id, ord) AS stale, arg_min(slot_id, {{'k': (role <> 'secondary')::INT, 'o': ord}}) AS slot, min({{'k': (role <> 'secondary')::INT, 'o': ord}}) AS best, count(*) AS n, any_value(occurred_at) AS day FROM a JOIN e ON e.id = a.event_id GROUP BY 1),
    dt AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY day ORDER BY best) <= 3), dn AS (SELECT day, sum(n) AS n FROM st GROUP BY 1), days AS (SELECT DISTINCT occurred_at AS day FROM e),
    tops AS (SELECT a.day, dt.event_id, dt.slot, row_number() OVER (PARTITION BY a.day ORDER BY dt.best) AS place FROM days a JOIN dt ON dt.day > a.day QUALIFY place <= 3), cn AS (SELECT a.day, sum(dn.n) AS n FROM days a JOIN dn ON dn.day > a.day GROUP BY 1),
    ed AS (SELECT r.source, r.target, s.occurred_at AS day, st.stale, st.day AS tday, st.n AS tn FROM r JOIN e s ON s.id = r.source JOIN st ON st.event_id = r.target WHERE r.relation IN ('supersedes', 'reverses'))
    SELECT source, target, any_value(stale) AS stale, arg_min(slot, place) AS host, any_value(cn.n - CASE WHEN tday > ed.day THEN tn ELSE 0 END)::BIGINT AS later FROM ed JOIN cn USING (day) JOIN tops ON tops.day = ed.day AND event_id <> source AND event_id <> target GROUP BY source, target, ed.day""",
    "orders", "lineitem", "customer",
)
def stale_planted(o, li, c):
    """The artefact that may cite what each superseding or reversing edge left behind, without meeting all later ones."""
    events, relations, _ = knowledge.knowledge(o, li, c)
    pieces = events.select(F.col("id").alias("event_id"), F.posexplode("evidence_in_corpus").alias("i", "e"))
    artefacts = pieces.select("event_id", "e.slot_id", F.when(F.col("event_id") % 4 == 1, "secondary").otherwise("primary").alias("role"), (F.col("event_id") * 10 + F.col("i") + 1).alias("ord"))
    return graph.planted(relations, events, artefacts)


# Scoped vectors

_EDGES = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, vec_id % 5 AS scope, DATE '2020-01-01' + (vec_id % 700)::INT AS valid_at, CASE WHEN vec_id % 3 = 0 THEN DATE '2020-01-01' + (vec_id % 700 + vec_id % 90)::INT END AS invalid_at FROM embeddings),
    q AS (SELECT id AS query_id, x, scope, DATE '2021-01-01' + (id % 300)::INT AS as_of FROM v WHERE id % 100 = 0),
    p AS (SELECT query_id, v.id, round(list_dot_product(q.x, v.x)::DECIMAL(20, 9), 6) AS score FROM q JOIN v ON v.scope = q.scope AND v.id <> q.query_id AND v.valid_at <= q.as_of AND (v.invalid_at IS NULL OR v.invalid_at > q.as_of)),
    t AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p)"""


def edges(e: DataFrame):
    """Vectors as facts of five scopes with times of validity, and every hundredth as a question of its scope and time."""
    k = F.col("vec_id")
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))
    rows = e.select(k.alias("id"), F.col("embedding").alias("vector"), (k % 5).alias("scope"), day(k % 700).alias("valid_at"), F.when(k % 3 == 0, day(k % 700 + k % 90)).alias("invalid_at"))
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", "scope", F.date_add(F.lit("2021-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("as_of"))
    return rows, queries


@query(f"WITH {_EDGES} SELECT query_id, id, rank::INT AS rank FROM t WHERE rank <= 20", "embeddings")
def scoped_search(e):
    """The twenty facts nearest to each question, of its scope and valid at its time."""
    return retrieval.nearest(*edges(e), 20).drop("score")


@query(
    f"""WITH {_EDGES} SELECT query_id, string_agg('- fact ' || id || ' (' || strftime(valid_at, '%Y-%m-%d') || ' to ' || coalesce(strftime(invalid_at, '%Y-%m-%d'), 'present') || ')', chr(10) ORDER BY rank) AS block
    FROM t JOIN v USING (id) WHERE rank <= 20 GROUP BY query_id""",
    "embeddings",
)
def fact_blocks(e):
    """What is found, as an answerer reads it."""
    rows, queries = edges(e)
    facts = rows.select("id", F.concat(F.lit("fact "), s("id")).alias("fact"), "valid_at", "invalid_at")
    return retrieval.fact_block(retrieval.nearest(rows, queries, 20), facts)


# Stored tables


def folder(spark: SparkSession) -> str:
    return f"{shared.shared_dir(spark)}/annalist-stored-{uuid.uuid4().hex}"


@query(
    """SELECT 'tier-' || o_custkey % 4 AS scope, count(*)::BIGINT AS before, CASE o_custkey % 4 WHEN 1 THEN 0 WHEN 2 THEN count(*) FILTER (o_orderkey % 2 = 0) ELSE count(*) END::BIGINT AS after,
    CASE o_custkey % 4 WHEN 0 THEN 'reused' WHEN 1 THEN 'wiped' WHEN 2 THEN 'written' ELSE 'untouched' END AS outcome, CASE o_custkey % 4 WHEN 1 THEN NULL WHEN 2 THEN sum(o_totalprice::DECIMAL(12, 2)) FILTER (o_orderkey % 2 = 0) ELSE sum(o_totalprice::DECIMAL(12, 2)) END::DOUBLE AS total
    FROM orders GROUP BY o_custkey % 4""",
    "orders",
)
def scopes_stored(o):
    """Orders stored in four scopes: one ingested again and reused, one wiped, one written anew with half its rows, one left alone; read back."""
    store = Scopes(o.sparkSession, folder(o.sparkSession), "o_orderkey bigint, o_totalprice double")
    names = [f"tier-{i}" for i in range(4)]
    own = lambda i: o.where(F.col("o_custkey") % 4 == i).select("o_orderkey", "o_totalprice")
    for i, name in enumerate(names):
        store.ingest(own(i), name, "v1")
    before = {name: store.count(name) for name in names}
    outcomes = [store.ingest(own(0), names[0], "v1"), "wiped" if store.wipe(names[1]) else "", store.ingest(own(2).where("o_orderkey % 2 = 0"), names[2], "v2"), "untouched"]
    said = o.sparkSession.createDataFrame([(n, before[n], outcomes[i]) for i, n in enumerate(names)], "scope string, before bigint, outcome string")
    after = store.rows().groupBy("scope").agg(F.count("*").alias("after"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("total"))
    return said.join(after, "scope", "left").select("scope", "before", F.coalesce("after", F.lit(0)).alias("after"), "outcome", "total")


def customers(c: DataFrame) -> Keyed:
    """Customers stored by key; two updates touch some of their buckets: new names and balances, then new keys."""
    table_ = Keyed(c.sparkSession, folder(c.sparkSession), "c_custkey", 32)
    table_.create(c.select("c_custkey", "c_name", "c_acctbal"))
    few = c.where("c_custkey % 300 = 0")
    table_.update(few.select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.when(F.col("c_custkey") % 600 == 0, F.lit(0.0)).alias("c_acctbal")))
    table_.rename(names_of(c))
    return table_


def names_of(c: DataFrame) -> DataFrame:
    return c.where("c_custkey % 250 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 10_000_000).alias("new"))


_RENAMED = "CASE WHEN {0} % 250 = 0 THEN {0} + 10000000 ELSE {0} END"


@query(f"SELECT {_RENAMED.format('c_custkey')} AS c_custkey, CASE WHEN c_custkey % 300 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name, CASE WHEN c_custkey % 600 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer", "customer")
def keyed_updates(c):
    """The table as it reads after both updates."""
    return customers(c).rows()


@query(
    """SELECT c_custkey::VARCHAR AS key, 'c_name' AS field, c_name AS old, 'new ' || c_name AS new, 1::BIGINT AS gen FROM customer WHERE c_custkey % 300 = 0
    UNION ALL SELECT c_custkey::VARCHAR, 'c_custkey', c_custkey::VARCHAR, (c_custkey + 10000000)::VARCHAR, 2 FROM customer WHERE c_custkey % 250 = 0""",
    "customer",
)
def keyed_history(c):
    """What the updates changed, but for balances, whose texts engines write in different ways."""
    return customers(c).history().where("field <> 'c_acctbal'")


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey * 25 AS id FROM lineitem), c AS (SELECT c_custkey FROM customer WHERE c_custkey % 250 = 0)
    SELECT l_orderkey, string_agg((CASE WHEN c_custkey IS NULL THEN id ELSE id + 10000000 END)::VARCHAR, ',' ORDER BY l_linenumber, id) AS cited FROM t LEFT JOIN c ON c_custkey = id GROUP BY l_orderkey""",
    "customer", "lineitem",
)
def citations_repointed(c, li):
    """Citations of customers in orders, led to the new keys."""
    cited = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") * 25).alias("id")))), lambda x: x["id"]).alias("cited"))
    return repointed(cited, "l_orderkey", "cited", names_of(c)).select("l_orderkey", F.array_join("cited", ",").alias("cited"))


# Malformed records, files of rows, repair

_SHAPES = """k AS (SELECT o_orderkey AS k, o_custkey::VARCHAR AS c, o_orderstatus AS s, o_orderpriority AS p FROM orders),
    y AS (SELECT k, 0 AS doc, 'order.customer' AS path, c AS value, false AS repaired, NULL AS error FROM k WHERE k % 7 = 0 UNION ALL SELECT k, 0, 'order.state.code', s, false, NULL FROM k WHERE k % 7 = 0 UNION ALL SELECT k, 0, 'order.state.note', 'p: ' || p, false, NULL FROM k WHERE k % 7 = 0
      UNION ALL SELECT k, 0, 'items[' || i || ']', CASE i WHEN 0 THEN c WHEN 1 THEN s END, false, NULL FROM k, (SELECT unnest([0, 1, 2]) AS i) WHERE k % 7 = 1
      UNION ALL SELECT k, 0, 'people[' || i || '].' || f, CASE WHEN f = 'id' THEN 'P-' || i ELSE c END, false, NULL FROM k, (SELECT unnest([0, 1]) AS i), (SELECT unnest(['id', 'name']) AS f) WHERE k % 7 = 2 AND (f = 'id' OR i = 1)
      UNION ALL SELECT k, d, CASE d WHEN 0 THEN 'a' ELSE 'b.c' END, CASE d WHEN 0 THEN c ELSE s END, false, NULL FROM k, (SELECT unnest([0, 1]) AS d) WHERE k % 7 = 3
      UNION ALL SELECT k, 0, 'text', 'line ' || c || chr(10) || '  more', false, NULL FROM k WHERE k % 7 = 4 UNION ALL SELECT k, 0, 'tags[0]', s, false, NULL FROM k WHERE k % 7 = 4 UNION ALL SELECT k, 0, 'tags[1].of', c, false, NULL FROM k WHERE k % 7 = 4
      UNION ALL SELECT k, 0, 'who', c, true, NULL FROM k WHERE k % 7 = 5 UNION ALL SELECT k, 0, 'in.said', 'it', true, NULL FROM k WHERE k % 7 = 5
      UNION ALL SELECT k, NULL, NULL, NULL, true, 'neither a key nor an item: words of ' || c FROM k WHERE k % 7 = 6)"""


@query(f"WITH {_SHAPES} SELECT k AS o_orderkey, doc::INT AS doc, path, value, repaired, error FROM y", "orders")
def yaml_nested(o):
    """Records of seven shapes: maps in maps, lists, lists of maps, two documents, block and bracketed texts, one to repair, one beyond repair."""
    k, c, st = F.col("o_orderkey"), s("o_custkey"), F.col("o_orderstatus")
    shapes = [
        ("order:\n  customer: ", c, "\n  state: # as it is\n    code: ", st, "\n    note: 'p: ", F.col("o_orderpriority"), "'\n"), ("items:\n- ", c, "\n- ", st, "\n- null\n"), ("people:\n  - id: P-0\n  - id: P-1\n    name: ", c, "\n"), ("a: ", c, "\n---\nb:\n  c: ", st, "\n"),
        ("text: |\n  line ", c, "\n    more\ntags: [", st, ", {of: ", c, "}]\n"), ("Here:\n```yaml\nwho:", c, ",\nin:\n\tsaid: \u2018it\u2019\n```\n"), ("words of ", c, "\nmore words\n"),
    ]
    text = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        text = F.when(k % len(shapes) == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in shape])).otherwise(text)
    return nested.yaml_rows(o.select("o_orderkey", text.alias("text")), ["o_orderkey"], "text")


@query("""SELECT doc_id, '---' || chr(10) || 'source: ' || source || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || chr(10) || text AS text, n_chars FROM documents""", "documents")
def files_written(d):
    """Each document as a file of its own after its front matter, read back by the index."""
    at = folder(d.sparkSession)
    page = merging.front_matter({"source": F.col("source"), "lang": F.col("lang")}, F.col("text"))
    written.save(d.select(F.concat("source", F.lit("/"), s("doc_id"), F.lit(".md")).alias("name"), page.alias("text"), "doc_id", "n_chars"), at)
    return written.load(d.sparkSession, at, "doc_id bigint, n_chars bigint").select("doc_id", "text", "n_chars")


@query(
    """WITH f AS (SELECT o_orderkey AS k, o_orderkey % 4 AS has, (o_orderkey % 4 + o_orderkey % 3) % 5 AS one, o_orderkey % 6 AS two FROM orders), n AS (SELECT k, has, least(one, 4) AS one, least(two, 4) AS two, k % 11 = 0 AS lost FROM f),
    r AS (SELECT k, has, CASE WHEN lost THEN NULL ELSE one END AS one, two FROM n), a AS (SELECT k, has, CASE WHEN has < 4 THEN one END AS one, two FROM r), b AS (SELECT k, has, one, greatest(has, coalesce(one, 0)) AS best1, two FROM a),
    c AS (SELECT *, CASE WHEN best1 < 4 THEN greatest(best1, two) ELSE best1 END AS best2 FROM b)
    SELECT k AS o_orderkey, CASE WHEN best1 < 4 THEN 2 ELSE 1 END::INT AS attempts, CASE WHEN best2 < 4 THEN -1 WHEN best1 < 4 THEN 2 ELSE 1 END::INT AS kept, 1::DOUBLE AS score, best2::INT AS told FROM c""",
    "orders",
)
def texts_repaired(o):
    """Texts that lack some of four facts, written again twice by a writer that a digest seeds and that sometimes fails; the rest appended."""
    k = F.col("o_orderkey")
    facts = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("Fact "), i.cast("string"), F.lit(" of "), s(k), F.lit(".")))
    rows = o.select("o_orderkey", F.array_join(F.slice(facts, 1, (k % 4).cast("int")), " ").alias("text"), facts.alias("facts"))

    def rewrite(low: DataFrame, attempt: int) -> DataFrame:
        n = F.least((k % 4 + k % 3) % 5 if attempt == 1 else k % 6, F.lit(4)).cast("int")
        return low.where("o_orderkey % 11 <> 0" if attempt == 1 else "true").select("o_orderkey", F.array_join(F.slice("facts", 1, n), " ").alias("text"))

    done = repair.rounds(rows, "o_orderkey", rewrite, folder(o.sparkSession))
    told = F.size(F.regexp_extract_all(F.substring_index("text", "## Facts", 1), F.lit("(Fact [0-9])"), F.lit(1)))
    return done.select("o_orderkey", "attempts", "kept", "score", told.alias("told"))


# Boards

_CATS = ["supersession", "decision_provenance", "bitemporal", "audit_replay", "justification_chain", "contradiction", "multi_hop_lineage", "emergent_pattern"]
_BOARD = """j AS (SELECT o_orderstatus AS tier, o_orderpriority AS system, o_orderkey % 7 / 7 AS score, o_orderkey % 11 / 11 AS semantic, o_orderkey % 3 = 0 AS exact, o_orderkey % 4 <> 0 AS faithful, floor(o_totalprice)::DOUBLE AS latency, o_custkey AS cost, o_custkey % 8 AS cat, o_orderkey FROM orders),
    m AS (SELECT tier, system, round(avg(score::DECIMAL(20, 9)), 4)::DOUBLE AS accuracy_mean, round(count(*) FILTER (exact) / count(*), 4) AS exact_match_rate, round(avg(semantic::DECIMAL(20, 9)), 4)::DOUBLE AS semantic_mean, round(1 - count(*) FILTER (faithful) / count(*), 4) AS hallucination_rate,
      round(quantile_cont(nullif(latency, 0), 0.5), 2) AS latency_ms_p50, round(quantile_cont(nullif(latency, 0), 0.95), 2) AS latency_ms_p95, round(avg((cost / 1000)::DECIMAL(20, 9)), 6)::DOUBLE AS cost_per_query_usd, CASE WHEN system <> '5-LOW' THEN (sum(o_orderkey) // 4)::DOUBLE END AS tokens_stored, CASE WHEN system <> '5-LOW' THEN count(*)::DOUBLE END AS ingest_seconds FROM j GROUP BY tier, system)"""


@query(
    f"""WITH {_BOARD} SELECT m.*, row_number() OVER (PARTITION BY m.tier ORDER BY accuracy_mean DESC, m.system)::INT AS rank, m.system || ' (' || CASE WHEN m.system = '1-URGENT' THEN '?' ELSE 'v' || m.tier END || ')' || CASE WHEN m.system = '2-HIGH' THEN ' [dry-run]' ELSE '' END AS name,
      {", ".join(f"(SELECT round(avg(score::DECIMAL(20, 9)), 4)::DOUBLE FROM j WHERE j.tier = m.tier AND j.system = m.system AND cat = {i}) AS {c}" for i, c in enumerate(_CATS) if i != 7)}, NULL::DOUBLE AS emergent_pattern FROM m""".replace("SELECT m.*, row_number", "SELECT m.* EXCLUDE (system), row_number").replace("AS name,", "AS system,"),
    "orders",
)
def leaderboard_full(o):
    """Nine metrics and eight categories of each run, one of which no run has."""
    names = F.array(*[F.lit(c) for c in _CATS])
    category = F.when(F.col("o_custkey") % 8 != 7, F.get(names, (F.col("o_custkey") % 8).cast("int")))
    rows = o.select(
        F.col("o_orderstatus").alias("tier"), F.col("o_orderpriority").alias("system"), (F.col("o_orderkey") % 7 / 7).alias("score"), (F.col("o_orderkey") % 11 / 11).alias("semantic_score"), (F.col("o_orderkey") % 3 == 0).alias("exact_match"),
        (F.col("o_orderkey") % 4 != 0).alias("faithful"), F.floor("o_totalprice").cast("double").alias("latency_ms"), (F.col("o_custkey") / 1000).alias("cost_usd"), category.alias("public_category"), "o_orderkey",
    )
    key = ["tier", "system"]
    records = evaluation.records(rows, key).join(evaluation.breakdown(rows, key, "public_category", "by_category"), key, "left")
    records = records.withColumns({"system_version": F.when(F.col("system") != "1-URGENT", F.concat(F.lit("v"), "tier")), "dry_run": F.col("system") == "2-HIGH"})
    ingests = rows.where("system <> '5-LOW'").groupBy(*key).agg(F.expr("sum(o_orderkey) div 4").cast("double").alias("tokens_stored"), F.count("*").cast("double").alias("ingest_seconds"))
    return boards.board(records, ingests)


@query(
    """WITH s AS (SELECT o_custkey AS question, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS system, o_orderkey % 2 = 0 AS new, o_orderkey % 41 / 40 AS score, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3, o_orderkey % 2 ORDER BY o_orderkey) AS i FROM orders),
    b AS (SELECT question, system, max(score) FILTER (NOT new) AS old, max(score) FILTER (new) AS new FROM s WHERE i = 1 GROUP BY ALL)
    SELECT question, max(old) FILTER (system = 'a') AS a_old, max(new) FILTER (system = 'a') AS a_new, max(new - old) FILTER (system = 'a') AS a_delta, max(old) FILTER (system = 'b') AS b_old, max(new) FILTER (system = 'b') AS b_new, max(new - old) FILTER (system = 'b') AS b_delta FROM b GROUP BY question
    HAVING count(*) > 0 UNION ALL SELECT NULL, round(avg(old::DECIMAL(28, 12)) FILTER (system = 'a'), 9), round(avg(new::DECIMAL(28, 12)) FILTER (system = 'a'), 9), round(avg(new::DECIMAL(28, 12)) FILTER (system = 'a') - avg(old::DECIMAL(28, 12)) FILTER (system = 'a'), 9),
      round(avg(old::DECIMAL(28, 12)) FILTER (system = 'b'), 9), round(avg(new::DECIMAL(28, 12)) FILTER (system = 'b'), 9), round(avg(new::DECIMAL(28, 12)) FILTER (system = 'b') - avg(old::DECIMAL(28, 12)) FILTER (system = 'b'), 9) FROM b""",
    "orders",
)
def rejudge_matrix(o):
    """Old and new scores of two of three systems by question, with their means below."""
    system = F.when(F.col("o_orderkey") % 3 == 0, "a").when(F.col("o_orderkey") % 3 == 1, "b").otherwise("c")
    rows = o.select(F.col("o_custkey").alias("question"), system.alias("system"), (F.col("o_orderkey") % 2 == 0).alias("is_new"), (F.col("o_orderkey") % 41 / 40).alias("score"), "o_orderkey")
    first = rows.groupBy("question", "system", "is_new").agg(F.min_by("score", "o_orderkey").alias("score"))
    found = boards.matrix(first.where("not is_new"), first.where("is_new"), ["a", "b"])
    means = F.col("question").isNull()
    return found.withColumns({c: F.when(means, F.round(c, 9)).otherwise(F.col(c)) for c in found.columns if c != "question"})


@query(
    """WITH d AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS t, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS r FROM documents)
    SELECT count(*)::BIGINT AS n_artifacts, count(*) FILTER (doc_id % 3 > 0)::BIGINT AS n_dated, sum(length(text))::BIGINT AS total_chars, (sum(length(text)) // 4)::BIGINT AS approx_tokens,
    (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT coalesce(t, 'null') AS k, count(*) AS n FROM d GROUP BY 1)) AS by_source_type, (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT coalesce(r, 'null') AS k, count(*) AS n FROM d GROUP BY 1)) AS by_role FROM d""",
    "documents",
)
def corpus_overview(d):
    """Counts of the corpus as a whole, with histograms as text."""
    rows = d.select("text", F.when(F.col("doc_id") % 3 > 0, "2020-01-01").alias("timestamp"), F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source_type"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("role"))
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return boards.overview(rows).withColumns({c: shown(c) for c in ("by_source_type", "by_role")})


@query(
    """WITH c AS (SELECT o_orderstatus AS tier, o_orderpriority AS system, sum(o_totalprice::DECIMAL(18, 2)) AS cost FROM orders GROUP BY ALL), p AS (SELECT *, cost::DECIMAL(28, 9) AS x, cost % 2 < 1 AS included FROM c)
    SELECT tier, coalesce(sum(x) FILTER (included), 0)::DOUBLE AS cost, coalesce(string_agg(DISTINCT system, ',' ORDER BY system) FILTER (included), '') AS included, coalesce(string_agg(DISTINCT system, ',' ORDER BY system) FILTER (NOT included), '') AS excluded FROM p GROUP BY ROLLUP (tier)""",
    "orders",
)
def plan_totals(o):
    """What a plan includes and leaves out, by tier and in all."""
    cells = o.groupBy(F.col("o_orderstatus").alias("tier"), F.col("o_orderpriority").alias("system")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("cost"))
    found = boards.totals(cells.withColumn("included", F.col("cost") % 2 < 1))
    return found.withColumns({c: F.array_join(c, ",") for c in ("included", "excluded")})


@query("SELECT item_id AS id, text FROM benchmark WHERE item_id % 3 > 0", "benchmark")
def benchmark_written(b):
    """The questions that passed, written and read back."""
    at = folder(b.sparkSession)
    harness.write_benchmark(b.select(F.col("item_id").alias("id"), "text"), b.where("item_id % 3 > 0").select(F.col("item_id").alias("id")), at)
    return b.sparkSession.read.schema("id bigint, text string").json(at)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 8 = 4", "orders")
def resumed_pairs(o):
    """Questions still to run after a partial log of pairs, some of whose lines are torn or hold no verdict."""
    at, k = folder(o.sparkSession), F.col("o_orderkey")
    pair = F.to_json(F.struct(F.struct(s(k).alias("question_id"), F.lit("x").alias("answer_text")).alias("query"), F.struct(s(k).alias("question_id"), F.lit(0.5).alias("score")).alias("judge")))
    line = F.when(k % 8 == 0, pair).when(k % 8 == 4, F.substring(pair, 1, 30)).otherwise(F.format_string('{"query": {"question_id": "%s"}}', s(k)))
    o.where("o_orderkey % 4 = 0 or o_orderkey % 16 = 1").select(line.alias("value")).write.text(at)
    return harness.to_run(o.select(s(k).alias("id")), harness.pairs(o.sparkSession, at)).select(F.col("id").cast("bigint").alias("id"))


@query("SELECT DISTINCT o_orderpriority AS system, 'v1' AS pinned, 'v' || (o_custkey % 3) AS running FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey % 3 <> 1 AND o_custkey % 5 > 0", "orders")
def versions_drifted(o):
    """Systems that ran in other versions than their pins."""
    version = F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("v"), s(F.col("o_custkey") % 3))).otherwise("v9-unknown")
    return boards.drifted(o.select(F.col("o_orderpriority").alias("system"), version.alias("system_version")), {"1-URGENT": "v1", "5-LOW": "v1"})


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'said ' || source WHEN 1 THEN '' ELSE 'then ' || lang END AS line FROM documents", "documents")
def lines_usable(d):
    """The first line of a reply that can be used."""
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("\n# Head\n```text\n  said "), "source", F.lit(" \nmore"))).when(k == 1, "# only\n\n```\n").otherwise(F.concat(F.lit("then "), "lang", F.lit("\r\nmore")))
    return d.select("doc_id", boards.usable_line(reply).alias("line"))


@query(
    """WITH v AS (SELECT o_custkey AS root, count(*) AS chain_length FROM orders GROUP BY 1) SELECT root, chain_length, row_number() OVER (ORDER BY chain_length DESC, root) AS place FROM v""",
    "orders",
)
def hardest_first(o):
    """Chains in one order of all, the longest first."""
    return boards.hardest(o.groupBy(F.col("o_custkey").alias("root")).agg(F.count("*").alias("chain_length")))


@query(
    """WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders), c AS (SELECT c_custkey AS id, c_name AS name, 1990 + (c_custkey % 9)::INT AS j, CASE WHEN c_custkey % 4 > 0 THEN 1993 + (c_custkey % 7)::INT END AS l FROM customer),
    n AS (SELECT year, string_agg(name, ', ' ORDER BY id) AS names FROM (SELECT year, id, name, row_number() OVER (PARTITION BY year ORDER BY id) AS i FROM y JOIN c ON j <= year AND (l IS NULL OR l >= year)) WHERE i <= 10 GROUP BY year)
    SELECT year, concat_ws(chr(10), '- Year ' || year || CASE WHEN year % 2 = 0 THEN ': theme ' || year ELSE '' END, '- Customers: ' || names) AS context FROM y LEFT JOIN n USING (year)""",
    "customer", "orders",
)
def year_contexts(c, o):
    """Themes and customers of each year; the topics are drawn by a digest that SQL lacks and are tested apart."""
    years = o.select(F.year("o_orderdate").alias("year")).distinct().withColumn("theme", F.when(F.col("year") % 2 == 0, F.concat(F.lit("theme "), s("year"))))
    k = F.col("c_custkey")
    people = c.select(k.alias("id"), F.col("c_name").alias("name"), (1990 + k % 9).cast("int").alias("joined"), F.when(k % 4 > 0, (1993 + k % 7).cast("int")).alias("left"))
    none = o.where("false").select(F.col("o_orderkey").alias("id"), F.lit("").alias("occurred_at"), F.lit("").alias("summary"))
    return boards.year_contexts(years, people, none)


@query(
    """WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders), n AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS i, count(*) OVER () AS n FROM y), q AS (SELECT unnest([1, 2, 3, 4]) AS quarter), t AS (SELECT unnest(['A', 'B']) AS team)
    SELECT 'medium' AS size, year, quarter::INT AS quarter, team FROM n, q, t WHERE i = n // 2 UNION ALL SELECT 'large', year, quarter, team FROM n, q, t WHERE i <> n // 2 AND quarter IN (2, 4)
    UNION ALL SELECT 'small', (SELECT min(year) FROM n WHERE i > 0 AND i < n - 1 AND year BETWEEN 1994 AND 1996), 2, 'A'""",
    "orders",
)
def history_windows(o):
    """Years, quarters and teams that each size covers."""
    years = o.select(F.year("o_orderdate").alias("year"))
    eras = o.sparkSession.createDataFrame([("1990-01", "1993-12", "low"), ("1994-02", "1996-05", "high"), ("1996-06", "1999-12", "low")], "start string, end string, discipline_level string")
    out = None
    for size in ("small", "medium", "large"):
        part = boards.windows(years, eras, ["A", "B"], size).withColumn("size", F.lit(size))
        out = part if out is None else out.unionByName(part)
    return out


# Systems under test


def texts(d: DataFrame) -> DataFrame:
    """Documents as artefacts with times: every third one is no longer valid after some days."""
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))
    k = F.col("doc_id")
    return d.select(k.alias("slot_id"), "text", day(k % 400).alias("valid_at"), F.when(k % 3 == 0, day(k % 400 + 30)).alias("invalid_at"))


_ADAPTER = """q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark),
    v AS (SELECT * FROM documents WHERE DATE '2020-01-01' + (doc_id % 400)::INT <= DATE '2020-10-01' AND (doc_id % 3 > 0 OR DATE '2020-01-01' + (doc_id % 400 + 30)::INT > DATE '2020-10-01')),
    d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM v), o AS (SELECT item_id, doc_id, count(*) AS score FROM q JOIN d USING (token) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM o), c AS (SELECT item_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS cited, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1)"""


def echo():
    """A client that fails once in a while for good and else replies with the length of its prompt."""

    def client(prompt: str) -> str:
        if len(prompt) % 5 == 0:
            raise TimeoutError("no reply")
        return f"length {len(prompt)}"

    return client


@query(
    f"""WITH {_ADAPTER}, p AS (SELECT item_id, coalesce(cited, '') AS cited, length('Question:' || chr(10) || b.text || chr(10) || chr(10) || 'Context:' || chr(10) || CASE WHEN trim(coalesce(context, '')) = '' THEN '(no context was retrieved)' ELSE context[1:40000] END) AS n FROM benchmark b LEFT JOIN c USING (item_id))
    SELECT item_id AS query_id, cited, CASE WHEN n % 5 = 0 THEN '' ELSE 'length ' || n END AS answer_text, CASE WHEN n % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM p""",
    "benchmark", "documents",
)
def adapter_run(b, d):
    """A system's run: documents ingested in two phases, questions asked as of a day, answers by a client that sometimes fails."""
    system = adapters.KeywordAdapter(d.sparkSession, folder(d.sparkSession))
    system.ingest("tier", texts(d.where("doc_id % 2 = 0")), texts(d.where("doc_id % 2 = 1")))
    questions = b.select(F.col("item_id").alias("query_id"), "text")
    found = shared.written(system.query("tier", questions, as_of="2020-10-01"), "contexts")
    said = adapters.answered(found, questions, echo, calls.Guard(attempts=2, breaker=0, sleep=None))
    return found.select("query_id", F.array_join("cited", ",").alias("cited")).join(said, "query_id")


@query(
    """WITH o AS (SELECT o_orderkey AS id, ['E-' || o_custkey] AS ids FROM orders), n AS (SELECT l_orderkey AS id, list_sort(list_distinct(list('E-' || l_suppkey * 3))) AS more FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY 1)
    SELECT id, array_to_string(CASE WHEN more IS NULL THEN ids ELSE list_concat(ids, list_filter(more, lambda x: NOT list_contains(ids, x))) END, ',') AS ids FROM o LEFT JOIN n USING (id)""",
    "orders", "lineitem",
)
def evidence_appended(o, li):
    """Evidence slots added to the arrays of some stored events."""
    stored = Keyed(o.sparkSession, folder(o.sparkSession), "id", 16)
    stored.create(o.select(F.col("o_orderkey").alias("id"), F.array(F.concat(F.lit("E-"), s("o_custkey"))).alias("ids")))
    stored.append(li.where("l_orderkey % 20 = 0").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("E-"), s(F.col("l_suppkey") * 3)).alias("ids")), "ids")
    return stored.rows().select("id", F.array_join("ids", ",").alias("ids"))


_PICK = lambda what, xs: "([" + ", ".join(repr(x) for x in xs) + f"])[('0x' || substr(md5(p_partkey || ':{what}:44'), 1, 8))::BIGINT % {len(xs)} + 1]"
_TYPES, _TOPICS, _YEARS = ["guide", "runbook", "notes"], ["Security", "Data", "On-call", "Release"], [2019, 2020, 2021, 2022]


@query(f"SELECT p_partkey, {_PICK('type', _TYPES)} AS type, {_PICK('topic', _TOPICS)} AS topic, {_PICK('year', _YEARS)}::INT AS year, {_PICK('month', range(1, 13))}::INT AS month FROM part", "part")
def documents_planned(p):
    """What each routine document is to be about, drawn by digests."""
    return planning.doc_plan(p, "p_partkey", _TYPES, _TOPICS, _YEARS)


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'e-' || o_custkey ELSE 'e-' || o_custkey || ',e-x' END AS evidence, CASE WHEN o_orderkey % 3 = 0 THEN 'needs review' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 7 = 0 THEN 'one:2.0,two:1.0' ELSE 'old:1.0' END AS rubric FROM orders""",
    "orders",
)
def questions_corrected(o):
    """Phantom evidence dropped, statuses and rubrics replaced, each by fixes of its own."""
    k, points = F.col("o_orderkey"), lambda *xs: F.array(*[F.struct(F.lit(n).alias("id"), F.lit(w).alias("weight")) for n, w in xs])
    rows = o.select(k.alias("id"), F.array(F.concat(F.lit("e-"), s("o_custkey")), F.lit("e-x")).alias("evidence_artifact_ids"), F.col("o_orderstatus").alias("status"), points(("old", 1.0)).alias("rubric"))
    fixes = o.where("o_orderkey % 5 = 0 or o_orderkey % 3 = 0 or o_orderkey % 7 = 0").select(k.alias("id"), F.when(k % 5 == 0, F.array(F.lit("e-x"), F.lit("e-y"))).alias("phantoms"), F.when(k % 3 == 0, "needs review").alias("status"), F.when(k % 7 == 0, points(("one", 2.0), ("two", 1.0))).alias("rubric"))
    shown = F.array_join(F.transform("rubric", lambda p: F.concat(p["id"], F.lit(":"), p["weight"].cast("string"))), ",")
    return merging.corrected(rows, fixes).select("id", F.array_join("evidence_artifact_ids", ",").alias("evidence"), "status", shown.alias("rubric"))


@query(
    """SELECT doc_id, 'S' || doc_id AS name, length(text)::INT AS size, source || '' AS source_description, 'g-' || lang AS group_id, CASE doc_id % 3 WHEN 0 THEN '2020-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 00:00:00' WHEN 1 THEN '2021-03-04 05:06:07' ELSE '2024-01-01 00:00:00' END AS at FROM documents""",
    "documents",
)
def episodes_mapped(d):
    """Documents as episodes of a graph; those without a time get the present, here a fixed one."""
    k = F.col("doc_id")
    day = F.when(k % 3 == 0, F.concat(F.lit("2020-02-"), F.lpad(s(k % 28 + 1), 2, "0"))).when(k % 3 == 1, "2021-03-04T05:06:07Z").otherwise("then")
    e = R.graph_episode(F.concat(F.lit("S"), s(k)), "text", day, "source", F.concat(F.lit("g-"), "lang"), "2024-01-01 00:00:00")
    rows = d.select("doc_id", e.alias("e"))
    return rows.select("doc_id", "e.name", F.length("e.episode_body").alias("size"), "e.source_description", "e.group_id", F.date_format("e.reference_time", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    """SELECT item_id AS question_id, CASE WHEN item_id % 3 = 0 THEN 0.5 WHEN item_id % 3 = 1 THEN 1 ELSE 0 END::DOUBLE AS score, CASE item_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'hallucination' ELSE 'unreadable' END AS failure_mode FROM benchmark WHERE item_id % 4 > 0""",
    "benchmark",
)
def judge_run(b):
    """Answers that have a question, judged by a client that reads the prompt."""
    point = F.array(F.struct(F.lit("a").alias("id"), F.lit("b").alias("criterion"), F.lit("").alias("fail_criterion"), F.lit("").alias("fail_if")))
    questions = b.select(F.col("item_id").alias("id"), "text", F.lit("{}").alias("truth"), point.alias("rubric"), F.lit(False).alias("emergent"))
    answers = b.where("item_id % 4 > 0").select(F.col("item_id").alias("question_id"), F.concat(F.lit("<"), s(F.col("item_id") % 3), F.lit(">")).alias("answer_text")).unionByName(b.limit(1).select(F.lit(-1).cast("bigint").alias("question_id"), F.lit("stray").alias("answer_text")))
    return adapters.judged(questions, answers, verdict_client)


def verdict_client():
    said = {"<0>": '{"score": 0.5}', "<1>": '{"score": 3, "failure_mode": "hallucination"}', "<2>": "no json"}
    return lambda prompt: next(v for k, v in said.items() if k in prompt)


@query(
    f"""WITH {_EDGES}, l AS (SELECT query_id, id, rank FROM t WHERE rank <= 20 UNION ALL SELECT query_id, id, rank FROM (SELECT q.query_id, v.id, row_number() OVER (PARTITION BY q.query_id ORDER BY abs(q.query_id % 700 - v.id % 700), v.id) AS rank FROM q, v) WHERE rank <= 20)
    SELECT query_id, id, sum((1.0 / (60 + rank))::DECIMAL(20, 12))::DECIMAL(20, 9)::DOUBLE AS rrf FROM l GROUP BY ALL""",
    "embeddings",
)
def edges_fused(e):
    """Facts by vectors, in scope and time, fused with those closest in time."""
    rows, queries = edges(e)
    near = retrieval.nearest(rows, queries, 20).select(F.col("query_id").alias("query"), "id", "rank")
    close = retrieval.closest(rows.select("id", (F.col("id") % 700).alias("value")), queries.select("query_id", (F.col("query_id") % 700).alias("value")), 20).withColumnRenamed("query_id", "query")
    fused = retrieval.reciprocal_ranks(near.unionByName(close))
    return fused.select(F.col("query").alias("query_id"), "id", F.col("rrf").cast("decimal(20,9)").cast("double").alias("rrf"))
