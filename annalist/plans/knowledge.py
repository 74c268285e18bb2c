"""Queries of the knowledge graph, with their SQL: categories C1 to C6 and the lineage, their ground truth, facts and difficulty.

Orders are events: participants are the customer and a number, alternatives the suppliers of its line items, evidence the line
items themselves. Consecutive orders of a customer are versions, linked by the kind that the newer one's key says; every
fourth key also supersedes the order before the last one. Customers are personas; every fourth one is unknown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.operators import graph
from annalist.sources.shared import written
from annalist.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_GRAPH = """ev AS (SELECT l_orderkey AS k, list({'slot_id': l_orderkey || '-' || l_linenumber || '-' || l_partkey, 'genre': CASE l_returnflag WHEN 'A' THEN 'slack_thread' WHEN 'R' THEN 'rfc' ELSE 'poem' END, 'role': lower(l_linestatus), 'author': 'S' || l_suppkey}
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS evidence, list_sort(list_distinct(list(l_suppkey::VARCHAR))) AS alternatives FROM lineitem GROUP BY 1),
    e AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority < '3' THEN 'strategic_decision' ELSE 'routine' END AS type, strftime(o_orderdate, '%Y-%m-%d') AS occurred_at, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') END AS recorded_at,
      'order ' || o_orderkey || ' of customer ' || o_custkey AS summary, o_orderstatus || '-' || o_orderkey AS decision, o_orderpriority AS reason, [o_custkey::VARCHAR, (o_orderkey % 50)::VARCHAR] AS participants, coalesce(alternatives, []) AS alternatives, coalesce(evidence, []) AS evidence FROM orders LEFT JOIN ev ON k = o_orderkey),
    p AS (SELECT c_custkey::VARCHAR AS persona_id, c_mktsegment || ' ' || c_nationkey AS display_name FROM customer WHERE c_custkey % 4 <> 3),
    x AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER w AS b, lead(o_orderkey, 2) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    r AS (SELECT b AS source, CASE b % 7 WHEN 3 THEN 'reverses' WHEN 4 THEN 're_attempts' ELSE 'supersedes' END AS relation, a AS target, b * 4 AS ord FROM x WHERE b % 7 < 5 UNION ALL SELECT a, 'retroactively_corrected_by', b, b * 4 FROM x WHERE b % 7 = 5
      UNION ALL SELECT a, 'contradicts', b, b * 4 FROM x WHERE b % 7 = 6 UNION ALL SELECT a, 'resolved_by', b, b * 4 + 1 FROM x WHERE b % 5 = 0 UNION ALL SELECT c, 'supersedes', a, c * 4 + 2 FROM x WHERE c % 4 = 0),
    names AS (SELECT id, list(coalesce(display_name, q) ORDER BY i) AS names FROM (SELECT id, unnest(participants) AS q, generate_subscripts(participants, 1) AS i FROM e) LEFT JOIN p ON persona_id = q GROUP BY 1)"""
_SLOTS = lambda s: f"list_transform({s}.evidence, lambda z: z.slot_id)"
_BOTH = f"array_to_string(list_concat({_SLOTS('s')}, {_SLOTS('t')}), ',')"


def query(sql: str, once: bool = False, told: list[str] | None = None, apart: bool = False):
    """Registers a function of (events, relations, personas) as the query of its name; once: events and relations are written for what reads them often.

    told: the columns of events that the query reads, where it needs no more of them than these and of evidence the ids.
    apart: f is given the events a second time, without evidence and alternatives; of what it reads only relations are written.
    """

    def register(f):
        def run(spark, folder):
            o, li, c = [table(spark, folder, t) for t in ("orders", "lineitem", "customer")]
            e, r, p = knowledge(o, li, c, whole=told is None)
            if apart:
                return f(e, written(r, "relations"), p, plain(o).withColumns({n: F.array().cast(e.schema[n].dataType) for n in ("evidence_in_corpus", "alternatives_considered")}))
            if told is not None:
                e = e.select("id", *told, "evidence_in_corpus")
            return f(written(e, "events"), written(r, "relations"), p) if once else f(e, r, p)

        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = f"WITH RECURSIVE {_GRAPH}{', ' if sql.startswith('o AS') or sql.startswith('n AS') else ' '}{sql}"
        return f

    return register


def knowledge(o: DataFrame, li: DataFrame, c: DataFrame, whole: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events, relations, personas. Evidence has its ids alone if not whole."""
    s = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    grouped = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("x"))  # texts are made of what was collected, none is shuffled
    genre = lambda x: F.when(x["l_returnflag"] == "A", "slack_thread").when(x["l_returnflag"] == "R", "rfc").otherwise("poem")
    piece = lambda x: F.struct(F.concat_ws("-", s("id"), s(x["l_linenumber"]), s(x["l_partkey"])).alias("slot_id"), genre(x).alias("genre"), F.lower(x["l_linestatus"]).alias("role"), F.concat(F.lit("S"), s(x["l_suppkey"])).alias("author"))
    if not whole:
        piece = lambda x: F.struct(F.concat_ws("-", s("id"), s(x["l_linenumber"]), s(x["l_partkey"])).alias("slot_id"))
    suppliers = F.array_sort(F.array_distinct(F.transform(F.filter("x", lambda x: x["l_suppkey"].isNotNull()), lambda x: s(x["l_suppkey"]))))
    pieces = grouped.select("id", F.transform("x", piece).alias("evidence_in_corpus"), suppliers.alias("alternatives_considered"))
    events = plain(o).join(pieces, "id", "left")
    none = lambda name: F.coalesce(name, F.array().cast(pieces.schema[name].dataType)).alias(name)
    events = events.select(*[c for c in events.columns if c not in pieces.columns or c == "id"], none("evidence_in_corpus"), none("alternatives_considered"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = o.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b"), F.lead("o_orderkey", 2).over(w).alias("c"))
    k = F.col("b") % 7
    edge = lambda source, relation, target, ord_: F.struct(F.col(source).alias("source"), relation.alias("relation"), F.col(target).alias("target"), ord_.alias("ord"))
    kind = F.when(k == 3, "reverses").when(k == 4, "re_attempts").otherwise("supersedes")
    found = [
        F.when(k < 5, edge("b", kind, "a", F.col("b") * 4)), F.when(k == 5, edge("a", F.lit("retroactively_corrected_by"), "b", F.col("b") * 4)), F.when(k == 6, edge("a", F.lit("contradicts"), "b", F.col("b") * 4)),
        F.when(F.col("b") % 5 == 0, edge("a", F.lit("resolved_by"), "b", F.col("b") * 4 + 1)), F.when(F.col("c") % 4 == 0, edge("c", F.lit("supersedes"), "a", F.col("c") * 4 + 2)),
    ]
    relations = x.select(F.explode(F.array_compact(F.array(*found))).alias("r")).select("r.*")
    personas = c.where("c_custkey % 4 <> 3").select(s("c_custkey").alias("persona_id"), F.concat_ws(" ", "c_mktsegment", s("c_nationkey")).alias("display_name"))
    return events, relations, personas


def plain(o: DataFrame) -> DataFrame:
    """Events without what line items tell."""
    s, day = lambda x: F.col(x).cast("string"), lambda x: F.date_format(x, "yyyy-MM-dd")
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") < "3", "strategic_decision").otherwise("routine").alias("type"), day("o_orderdate").alias("occurred_at"),
        F.when(F.col("o_orderkey") % 3 == 0, day(F.date_add("o_orderdate", 10))).alias("recorded_at"), F.concat(F.lit("order "), s("o_orderkey"), F.lit(" of customer "), s("o_custkey")).alias("summary"),
        F.concat("o_orderstatus", F.lit("-"), s("o_orderkey")).alias("decision"), F.col("o_orderpriority").alias("reason_canonical"), F.array(s("o_custkey"), (F.col("o_orderkey") % 50).cast("string")).alias("participants"),
    )


def joined(*names: str):
    """Arrays as text, so that results are rows of plain values."""
    return {n: F.array_join(n, ",") for n in names}


@query(
    f"""SELECT r.source, r.relation, r.target, t.summary[1:120] AS topic, t.decision AS prior_value, s.decision AS current_value, s.occurred_at AS change_date, s.reason AS change_reason, {_BOTH} AS evidence
    FROM r JOIN e s ON s.id = r.source JOIN e t ON t.id = r.target WHERE r.relation IN ('supersedes', 'reverses')"""
)
def supersession_c1(e, r, p):
    return graph.supersession(r, e).withColumns(joined("evidence"))


@query(
    f"""SELECT e.id, e.summary[1:120] AS topic, e.decision, array_to_string(names, ',') AS deciders, e.occurred_at AS decision_date, array_to_string(e.alternatives, ',') AS alternatives, e.reason AS decision_reason, array_to_string({_SLOTS("e")}, ',') AS evidence
    FROM e JOIN names USING (id) WHERE e.type = 'strategic_decision' AND len(e.alternatives) >= 2"""
)
def provenance_c2(e, r, p):
    return graph.provenance(e, p).withColumns(joined("deciders", "alternatives", "evidence"))


@query(
    f"""SELECT r.source, r.target, s.summary[1:120] AS topic, s.decision AS original_value, coalesce(s.recorded_at, s.occurred_at) AS original_recorded_at, t.decision AS corrected_value, coalesce(t.recorded_at, t.occurred_at) AS correction_recorded_at,
    s.occurred_at AS true_occurred_at, {_BOTH} AS evidence FROM r JOIN e s ON s.id = r.source JOIN e t ON t.id = r.target WHERE r.relation = 'retroactively_corrected_by'"""
)
def correction_c3(e, r, p):
    return graph.corrections(r, e).withColumns(joined("evidence"))


_AUDIT = """o AS (SELECT DISTINCT target AS start, target AS node, []::BIGINT[] AS path FROM r WHERE relation = 'supersedes' UNION ALL SELECT o.start, r.target, list_append(o.path, r.ord) FROM o JOIN r ON r.source = o.node AND r.relation = 'supersedes'),
    n AS (SELECT DISTINCT source AS start, source AS node, []::BIGINT[] AS path FROM r WHERE relation = 'supersedes' UNION ALL SELECT n.start, r.source, list_append(n.path, r.ord) FROM n JOIN r ON r.target = n.node AND r.relation = 'supersedes'),
    oc AS (SELECT start, list({'node': node, 'd': decision, 's': list_transform(evidence, lambda z: z.slot_id)} ORDER BY path) AS l FROM (SELECT start, node, min(path) AS path FROM o GROUP BY ALL) q JOIN e ON e.id = q.node GROUP BY 1),
    nc AS (SELECT start, list({'node': node, 'd': decision, 's': list_transform(evidence, lambda z: z.slot_id)} ORDER BY path) AS l FROM (SELECT start, node, min(path) AS path FROM n GROUP BY ALL) q JOIN e ON e.id = q.node GROUP BY 1),
    au AS (SELECT r.source, r.target, t.summary[1:120] AS topic, strftime(t.occurred_at::DATE + INTERVAL 30 DAY, '%Y-%m-%d') AS as_of_date, t.decision AS held, list_concat(oc.l, nc.l) AS chain, nc.l[-1] AS head
      FROM r JOIN e s ON s.id = r.source JOIN e t ON t.id = r.target JOIN oc ON oc.start = r.target JOIN nc ON nc.start = r.source WHERE r.relation = 'supersedes'),
    aud AS (SELECT *, list_transform(list_filter(chain, lambda z: z.node <> head.node), lambda z: z.d) AS changed, list_sort(list_distinct(list_transform(chain, lambda z: z.node))) AS ids FROM au)"""


@query(
    f"""{_AUDIT} SELECT source, target, topic, as_of_date, held AS asof_facts, array_to_string(changed, ',') AS changed_facts, head.d AS replacements, array_to_string(ids, ',') AS chain_event_ids,
    array_to_string(flatten(list_transform(ids, lambda i: list_filter(chain, lambda z: z.node = i)[1].s)), ',') AS evidence FROM aud""",
    once=True,
    told=["occurred_at", "summary", "decision"],
)
def audit_replay_c4(e, r, p):
    rows = graph.audit(r, e).withColumn("chain_event_ids", F.transform("chain_event_ids", lambda x: x.cast("string")))
    return rows.withColumns(joined("asof_facts", "changed_facts", "replacements", "chain_event_ids", "evidence"))


_KIND = "CASE z.genre WHEN 'slack_thread' THEN 'direct_testimony' WHEN 'rfc' THEN 'inference' ELSE 'unknown' END"
_LINES = f"list_transform(e.evidence, lambda z, i: i || '. ' || z.genre || ' by ' || z.author || ' (' || z.role || ') → ' || {_KIND})"


@query(
    f"""SELECT e.id, e.decision AS claim, e.summary[1:120] AS topic, array_to_string({_LINES}, ',') AS evidence_summary, array_to_string(list_transform(e.evidence, lambda z: z.genre), ',') AS evidence_types,
    array_to_string(list_transform(e.evidence, lambda z: z.slot_id || ':' || {_KIND}), ',') AS testimony_attribution, e.reason AS inferential_steps, array_to_string({_SLOTS("e")}, ',') AS evidence FROM e WHERE len(e.evidence) >= 3"""
)
def justification_c5(e, r, p):
    rows = graph.justification(e).withColumn("testimony_attribution", F.transform("testimony_attribution", lambda x: F.concat(x["slot_id"], F.lit(":"), x["testimony_type"])))
    return rows.withColumns(joined("evidence_summary", "evidence_types", "testimony_attribution", "evidence"))


_CONTRA = """ct AS (SELECT r.source, r.target, s.summary[1:120] AS topic, list_filter(s.participants, lambda z: NOT list_contains(t.participants, z))[1] AS pa, list_filter(t.participants, lambda z: NOT list_contains(s.participants, z))[1] AS pb, s.decision AS da, t.decision AS db,
      s.occurred_at AS ta, t.occurred_at AS tb, s.evidence AS se, t.evidence AS te, coalesce((SELECT arg_min(y.target, y.ord) FROM r y WHERE y.relation = 'resolved_by' AND y.source = r.source), (SELECT arg_min(y.target, y.ord) FROM r y WHERE y.relation = 'resolved_by' AND y.source = r.target)) AS resolver
      FROM r JOIN e s ON s.id = r.source JOIN e t ON t.id = r.target WHERE r.relation = 'contradicts'),
    cn AS (SELECT ct.*, coalesce(a.display_name, pa) AS na, coalesce(b.display_name, pb) AS nb, v.decision AS how FROM ct LEFT JOIN p a ON a.persona_id = pa LEFT JOIN p b ON b.persona_id = pb LEFT JOIN e v ON v.id = resolver WHERE pa IS NOT NULL AND pb IS NOT NULL)"""


@query(
    f"""n AS (SELECT 1), {_CONTRA} SELECT source, target, topic, pa AS party_a, na AS party_a_name, da AS party_a_claim, ta AS party_a_date, pb AS party_b, nb AS party_b_name, db AS party_b_claim, tb AS party_b_date, resolver,
    CASE WHEN resolver IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution_status, coalesce(how, '') AS resolution_details,
    array_to_string(list_concat(list_transform(se, lambda z: z.slot_id), list_transform(te, lambda z: z.slot_id)), ',') AS evidence FROM cn WHERE na <> nb"""
)
def contradiction_c6(e, r, p):
    return graph.contradictions(r, e, p).withColumns(joined("evidence"))


_CHAIN = """o AS (SELECT *, CASE relation WHEN 'supersedes' THEN 1 WHEN 'reverses' THEN 2 ELSE 3 END AS kind, min(ord) OVER (PARTITION BY relation, source) AS met FROM r WHERE relation IN ('supersedes', 'reverses', 're_attempts')),
    nx AS (SELECT target AS a, arg_min(source, [kind, met, ord]) AS b FROM o GROUP BY 1),
    wk AS (SELECT a AS root, a AS cur, 1 AS n FROM nx WHERE a NOT IN (SELECT b FROM nx) UNION ALL SELECT root, nx.b, wk.n + 1 FROM wk JOIN nx ON nx.a = wk.cur WHERE wk.n <= 20),
    st AS (SELECT root, list({'id': e.id, 'date': occurred_at, 'decision': decision[1:200], 'reason': reason[1:150], 'participants': names} ORDER BY n) AS steps, list(list_transform(evidence, lambda z: z.slot_id) ORDER BY n) AS ev, arg_min(summary, n)[1:120] AS topic,
      min(occurred_at[1:4]) || '-' || max(occurred_at[1:4]) AS year_span, count(*) AS chain_length FROM wk JOIN e ON e.id = wk.cur JOIN names USING (id) GROUP BY 1 HAVING count(*) >= 3)"""


@query(
    f"""{_CHAIN} SELECT root, topic, chain_length::INT AS chain_length, year_span, array_to_string(list_transform(steps, lambda z: z.id || '|' || z.date || '|' || z.decision || '|' || z.reason || '|' || array_to_string(z.participants, '+')), ';') AS chain_steps,
    array_to_string(flatten(ev), ',') AS evidence FROM st""",
    told=["occurred_at", "summary", "decision", "reason_canonical", "participants"],
)
def lineage_hard(e, r, p):
    step = lambda x: F.concat_ws("|", x["id"].cast("string"), x["date"], x["decision"], x["reason"], F.array_join(x["participants"], "+"))
    return graph.lineage(r, e, p).withColumn("chain_steps", F.array_join(F.transform("chain_steps", step), ";")).withColumns(joined("evidence"))


@query(
    f"""{_AUDIT}, {_CONTRA}, {_CHAIN.replace("o AS (SELECT *, CASE", "vo AS (SELECT *, CASE").replace("FROM o GROUP", "FROM vo GROUP")}
    SELECT 'C1' AS kind, r.source::VARCHAR AS a, r.target::VARCHAR AS b, to_json({{'current_value': s.decision, 'prior_value': t.decision, 'change_date': s.occurred_at, 'change_reason': s.reason}})::VARCHAR AS truth FROM r JOIN e s ON s.id = r.source JOIN e t ON t.id = r.target WHERE r.relation IN ('supersedes', 'reverses')
    UNION ALL SELECT 'C2', e.id::VARCHAR, '', to_json({{'decision': e.decision, 'deciders': names, 'decision_date': e.occurred_at, 'alternatives': e.alternatives, 'deciding_factor': e.reason}})::VARCHAR FROM e JOIN names USING (id) WHERE e.type = 'strategic_decision' AND len(e.alternatives) >= 2
    UNION ALL SELECT 'C3', r.source::VARCHAR, r.target::VARCHAR, to_json({{'original_value': s.decision, 'corrected_value': t.decision, 'original_recorded_at': coalesce(s.recorded_at, s.occurred_at), 'correction_recorded_at': coalesce(t.recorded_at, t.occurred_at), 'true_occurred_at': s.occurred_at}})::VARCHAR
      FROM r JOIN e s ON s.id = r.source JOIN e t ON t.id = r.target WHERE r.relation = 'retroactively_corrected_by'
    UNION ALL SELECT 'C4', source::VARCHAR, target::VARCHAR, to_json({{'as_of_date': as_of_date, 'asof_facts': [held], 'changed_facts': changed, 'replacements': [head.d]}})::VARCHAR FROM aud
    UNION ALL SELECT 'C5', e.id::VARCHAR, '', to_json({{'claim': e.decision, 'evidence_summary': {_LINES}, 'evidence_types': list_transform(e.evidence, lambda z: z.genre), 'testimony_attribution': list_transform(e.evidence, lambda z: {{'slot_id': z.slot_id, 'testimony_type': {_KIND}}}), 'inferential_steps': e.reason}})::VARCHAR FROM e WHERE len(e.evidence) >= 3
    UNION ALL SELECT 'C6', source::VARCHAR, target::VARCHAR, to_json({{'party_a': na, 'party_a_claim': da, 'party_a_date': ta, 'party_b': nb, 'party_b_claim': db, 'party_b_date': tb, 'resolution_status': CASE WHEN resolver IS NULL THEN 'unresolved' ELSE 'resolved' END, 'resolution_details': coalesce(how, '')}})::VARCHAR FROM cn WHERE na <> nb
    UNION ALL SELECT 'HARD', root::VARCHAR, '', to_json({{'topic': topic, 'chain_length': chain_length, 'year_span': year_span, 'chain_steps': steps, 'current_state': steps[-1].decision}})::VARCHAR FROM st""",
    apart=True,
)
def ground_truths(e, r, p, bare):
    """The ground truth of all candidates, as JSON. It tells evidence of C5 and alternatives of C2 alone, so the others go without."""
    found = {"C1": graph.supersession(r, bare), "C2": graph.provenance(e, p), "C3": graph.corrections(r, bare), "C4": graph.audit(r, bare), "C5": graph.justification(e), "C6": graph.contradictions(r, bare, p), "HARD": graph.lineage(r, bare, p)}
    out = None
    for kind, rows in found.items():
        keys = [c for c in ("source", "target") if c in rows.columns] or [c for c in ("id", "root") if c in rows.columns]
        a, b = F.col(keys[0]).cast("string"), F.col(keys[1]).cast("string") if len(keys) > 1 else F.lit("")
        part = rows.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), graph.ground_truth(rows, kind).alias("truth"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""{_CHAIN}, c AS (SELECT id AS k, len(evidence) AS n, 1 AS steps FROM e UNION ALL SELECT -root, len(flatten(ev)), chain_length FROM st) SELECT k::BIGINT AS k, CASE WHEN steps >= 3 OR n >= 6 THEN 'hard' WHEN n >= 3 THEN 'medium' ELSE 'easy' END AS difficulty FROM c""",
    told=[],
)
def difficulties(e, r, p):
    single = e.select(F.col("id").alias("k"), graph.difficulty(F.size("evidence_in_corpus")).alias("difficulty"))
    return single.unionByName(graph.chain_sizes(r, e).select((-F.col("root")).alias("k"), graph.difficulty(F.col("evidence"), F.col("chain_length")).alias("difficulty")))
