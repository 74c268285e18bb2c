"""Typed edges over events: candidates of each question category and their ground truth, walks, lineage, constraints.

events: id, type, occurred_at, recorded_at, summary, decision, reason_canonical, participants array, alternatives_considered array,
evidence_in_corpus array<struct<slot_id, genre, role, author>>. relations: source, relation, target, ord (the place in the log;
"first" below is by it). personas: persona_id, display_name. Null texts count as empty, null arrays as empty; edges with an end
that is no event are left out.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.sources.shared import forget, written

#: Kinds of edges from a newer version to an older one, in the order in which they are followed: fixed values.
VERSIONS = ["supersedes", "reverses", "re_attempts"]


def text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def topic(name: str = "summary") -> Column:
    return F.substring(text(name), 1, 120).alias("topic")


def slots(name: str = "evidence_in_corpus") -> Column:
    return F.coalesce(F.col(f"{name}.slot_id"), F.array().cast("array<string>"))


def expand(relations: DataFrame, events: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges of some kinds with both events as structs src and tgt; dangling edges go."""
    rows = relations.where(F.col("relation").isin(kinds))
    side = lambda name, key: events.select(F.col("id").alias(key), F.struct(*events.columns).alias(name))
    return rows.join(side("src", "source"), "source").join(side("tgt", "target"), "target")


def named(rows: DataFrame, key: list[str], ids: str, personas: DataFrame) -> DataFrame:
    """rows with their array of persona ids as display names in order; an unknown id stands for itself. Persons meet by an equi-join."""
    each = rows.select(*key, F.posexplode(ids).alias("_at", "persona_id"))
    found = each.join(personas.select("persona_id", "display_name"), "persona_id", "left")
    listed = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("display_name", F.col("persona_id").cast("string")).alias("name")))).alias("_names"))
    return rows.join(listed, key, "left").withColumn(ids, F.coalesce(F.col("_names.name"), F.array().cast("array<string>"))).drop("_names")


def supersession(relations: DataFrame, events: DataFrame) -> DataFrame:
    """C1: prior and current value of each superseding or reversing edge, evidence of both in order."""
    return expand(relations, events, ["supersedes", "reverses"]).select(
        "source", "relation", "target", topic("tgt.summary"), text("tgt.decision").alias("prior_value"), text("src.decision").alias("current_value"),
        text("src.occurred_at").alias("change_date"), text("src.reason_canonical").alias("change_reason"), F.concat(slots("src.evidence_in_corpus"), slots("tgt.evidence_in_corpus")).alias("evidence"),
    )


def provenance(events: DataFrame, personas: DataFrame) -> DataFrame:
    """C2: strategic decisions with two alternatives or more, and who decided, by name."""
    rows = events.where((F.col("type") == "strategic_decision") & (F.size("alternatives_considered") >= 2)).select(
        "id", topic(), text("decision").alias("decision"), F.col("participants").alias("deciders"), text("occurred_at").alias("decision_date"),
        F.col("alternatives_considered").alias("alternatives"), text("reason_canonical").alias("decision_reason"), slots().alias("evidence"),
    )
    return named(rows, ["id"], "deciders", personas)


def corrections(relations: DataFrame, events: DataFrame) -> DataFrame:
    """C3: what was recorded first and what corrected it; an event that has no time of recording was recorded when it occurred."""
    recorded = lambda side: F.coalesce(F.col(f"{side}.recorded_at"), text(f"{side}.occurred_at"))
    return expand(relations, events, ["retroactively_corrected_by"]).select(
        "source", "target", topic("src.summary"), text("src.decision").alias("original_value"), recorded("src").alias("original_recorded_at"), text("tgt.decision").alias("corrected_value"),
        recorded("tgt").alias("correction_recorded_at"), text("src.occurred_at").alias("true_occurred_at"), F.concat(slots("src.evidence_in_corpus"), slots("tgt.evidence_in_corpus")).alias("evidence"),
    )


def segments(edges: DataFrame, starts: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, ord) with their unbranched stretches drawn together: steps and what lies within them, both written.

    A node with one edge in and one out that is no start lies within. steps: a, b, label (the ord if a has more edges than one,
    else nothing), length in edges, head (the first node within, if any). within: node, head, offset from it. Nodes find the
    head of their stretch by doubling: each round reads on from where the last one ended, log2 of the longest stretch in all.
    """
    out, into = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("out")), edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("into"))
    inner = out.where("out = 1").join(into.where("into = 1"), "node").join(starts.select(F.col("start").alias("node")), "node", "left_anti").select("node")
    before = edges.select(F.col("b").alias("node"), F.col("a").alias("head"))
    inside = inner.select(F.col("node").alias("head"), F.lit(True).alias("_in"))
    held = inner.join(before, "node").join(inside, "head", "left").select("node", F.when(F.col("_in"), F.col("head")).otherwise(F.col("node")).alias("head"), F.when(F.col("_in"), 1).otherwise(0).cast("bigint").alias("offset"))
    held = written(held, what)
    reached, n = 1, held.count()
    label = F.when(F.col("out") > 1, F.array("ord")).otherwise(F.array().cast("array<bigint>"))
    if not n:
        plain = edges.join(out.select(F.col("node").alias("a"), "out"), "a").select("a", "b", label.alias("label"), F.lit(1).cast("bigint").alias("length"), F.lit(None).cast(edges.schema["b"].dataType).alias("head"))
        return plain, held
    while reached < n:
        ahead = held.select(F.col("node").alias("head"), F.col("head").alias("_head"), F.col("offset").alias("_offset"))
        moved = F.col("_head") != F.col("head")
        last, held = held, written(held.join(ahead, "head").select("node", F.col("_head").alias("head"), (F.col("offset") + F.col("_offset")).alias("offset"), moved.alias("moved")), what)
        forget(last)
        if held.where("moved").isEmpty():
            break
        reached *= 2
    tails = held.groupBy("head").agg(F.max(F.struct("offset", "node")).alias("t")).select("head", F.col("t.node").alias("tail"), (F.col("t.offset") + 2).alias("length"))
    after = edges.select(F.col("a").alias("tail"), F.col("b").alias("_end"))
    whole = tails.join(after, "tail").select(F.col("head").alias("b"), "_end", "length")
    first = edges.join(inner.select(F.col("node").alias("a")), "a", "left_anti").join(out.select(F.col("node").alias("a"), "out"), "a").join(whole, "b", "left")
    steps = first.select("a", F.coalesce("_end", "b").alias("b"), label.alias("label"), F.coalesce("length", F.lit(1)).cast("bigint").alias("length"), F.when(F.col("_end").isNotNull(), F.col("b")).alias("head"))
    return written(steps, f"{what}-steps"), held


def reach(starts: DataFrame | None, edges: DataFrame, what: str) -> DataFrame:
    """(start, node, path, depth) of all nodes that edges (a, b, ord) lead to from each start, itself first.

    Without starts every node that an edge leads to is one; no stretch can be drawn together then, and the edges of nodes that
    none leads to are not followed.

    path holds the ords chosen where a node has several edges, depth counts edges: ordered by both, a start's nodes are in the
    order of a depth-first walk that takes edges by ord and no node twice. Unbranched stretches are one step each (`segments`);
    the steps are closed by doubling, joining paths with all that go on from their ends and keeping the least between two nodes,
    twice in a round, so a walk of n steps takes log4(n) rounds, each written. Only paths of as many steps as are doubled are
    joined: every longer path has one such beginning, so none is found twice. There is no bound on depth. A cycle shows as a
    path that ends where it began; then the order of a walk depends on what it met before, and the edges are followed one by one.
    """
    if starts is None:
        ends = edges.select(F.col("b").alias("a")).distinct()
        own = ends.select(F.col("a").alias("start"))
        label = F.when(F.count("*").over(Window.partitionBy("a")) > 1, F.array("ord")).otherwise(F.array().cast("array<bigint>"))
        steps, within = edges.join(ends, "a", "left_semi").select("a", "b", label.alias("label"), F.lit(1).cast("bigint").alias("length")), None
    else:
        edges, own = written(edges, what), starts.select("start").distinct()
        steps, within = segments(edges, starts, what)
    least = lambda rows: rows.groupBy("a", "b").agg(F.min(F.struct("label", "length", "steps")).alias("_l")).select("a", "b", "_l.label", "_l.length", "_l.steps")

    def longer(rows: DataFrame, n: int) -> DataFrame:
        """rows with what goes on from their paths of n steps. All that reads them asks for the same rows, so that they are shuffled once."""
        rows = rows.where("a is not null and b is not null")
        on = rows.select(F.col("a").alias("b"), F.col("b").alias("_to"), F.col("label").alias("_label"), F.col("length").alias("_length"), F.col("steps").alias("_steps"))
        joined = rows.where(F.col("steps") == n).join(on, "b")
        return least(rows.unionByName(joined.select("a", F.col("_to").alias("b"), F.concat("label", "_label").alias("label"), (F.col("length") + F.col("_length")).alias("length"), (F.col("steps") + F.col("_steps")).alias("steps"))))

    closed, n = written(least(steps.withColumn("steps", F.lit(1).cast("bigint"))), what), 1
    while True:
        seen = closed.agg(F.count_if(F.col("steps") == n).alias("on"), F.count_if(F.col("a") == F.col("b")).alias("round")).first()
        if seen["round"]:
            return by_rounds(own, edges, what)
        if not seen["on"]:
            break
        last, closed, n = closed, written(longer(longer(closed, n), 2 * n), what), 4 * n
        forget(last)
    here = own.select("start", F.col("start").alias("node"), F.array().cast("array<bigint>").alias("path"), F.lit(0).cast("bigint").alias("depth"))
    from_own = closed if within is None else closed.join(own.select(F.col("start").alias("a")), "a")
    ends = here.unionByName(from_own.select(F.col("a").alias("start"), F.col("b").alias("node"), F.col("label").alias("path"), F.col("length").alias("depth")))
    if within is None:
        return ends
    parts = steps.where("head is not null").select(F.col("a").alias("node"), F.col("label").alias("_label"), "head").join(within.select(F.col("node").alias("_inner"), "head", "offset"), "head")
    passed = ends.join(parts, "node").select("start", F.col("_inner").alias("node"), F.concat("path", "_label").alias("path"), (F.col("depth") + 1 + F.col("offset")).alias("depth"))
    return ends.unionByName(passed)


def by_rounds(starts: DataFrame, edges: DataFrame, what: str) -> DataFrame:
    """`reach` one edge a round, for edges with cycles: a round extends the paths that the last one found or made smaller. A cycle makes no path smaller."""
    found = written(starts.select(F.col("start"), F.col("start").alias("node"), F.array().cast("array<bigint>").alias("path")).distinct(), what)
    new, old = found, []
    while not new.isEmpty():
        step = new.join(edges, F.col("node") == F.col("a")).groupBy("start", F.col("b").alias("node")).agg(F.min(F.concat("path", F.array("ord"))).alias("to"))
        new = written(step.join(found, ["start", "node"], "left").where("path is null or to < path").select("start", "node", F.col("to").alias("path")), what)
        old, found = [found, *old], written(found.unionByName(new).groupBy("start", "node").agg(F.min("path").alias("path")), what)
        while old:
            forget(old.pop())
        old = [new]
    return found.withColumn("depth", F.size("path").cast("bigint"))


def audit(relations: DataFrame, events: DataFrame) -> DataFrame:
    """C4: what held 30 days after a superseded event, all that its chain changed since, and what holds now.

    The older chain is walked from the target along superseding edges, the newer one from the source against them, depth
    first; the last of the newer one is the replacement, all others of both are the changed facts, in order.
    """
    as_of = F.date_add(F.try_to_date(F.substring("tgt.occurred_at", 1, 10)), 30).cast("string").alias("as_of_date")
    edges = expand(relations, events, ["supersedes"]).select("source", "target", topic("tgt.summary"), text("tgt.decision").alias("_held"), as_of).where("as_of_date is not null")
    by = relations.where("relation = 'supersedes'")
    ways = [("source", "target", "older"), ("target", "source", "newer")]
    with ThreadPoolExecutor(2) as both_ways:  # their rounds are small jobs, which run beside each other
        walks = [both_ways.submit(reach, None, by.select(F.col(a).alias("a"), F.col(b).alias("b"), "ord"), what) for a, b, what in ways]
        older, newer = (w.result() for w in walks)
    facts = events.select(F.col("id").alias("node"), text("decision").alias("decision"), slots().alias("slots"))

    def chain(rows, key, name):
        with_facts = rows.join(facts, "node", "left").select("start", F.struct("path", "depth", "node", F.coalesce("decision", F.lit("")).alias("decision"), F.coalesce("slots", F.array().cast("array<string>")).alias("slots")).alias("e"))
        fact = lambda e: F.struct(e["node"].alias("node"), e["decision"].alias("decision"), e["slots"].alias("slots"))  # noqa: E731  # the way there told the order
        return with_facts.groupBy(F.col("start").alias(key)).agg(F.transform(F.array_sort(F.collect_list("e")), fact).alias(name))

    both = edges.join(chain(older, "target", "older"), "target").join(chain(newer, "source", "newer"), "source")
    chained, last = F.concat("older", "newer"), F.element_at("newer", -1)
    every = F.array_sort(F.array_distinct(F.transform(chained, lambda e: F.struct(e["node"].alias("node"), e["slots"].alias("slots")))))
    return both.select(
        "source", "target", "topic", "as_of_date", F.array("_held").alias("asof_facts"),
        F.transform(F.filter(chained, lambda e: e["node"] != last["node"]), lambda e: e["decision"]).alias("changed_facts"), F.array(last["decision"]).alias("replacements"),
        F.transform(every, lambda e: e["node"]).alias("chain_event_ids"), F.flatten(F.transform(every, lambda e: e["slots"])).alias("evidence"),
    )


def justification(events: DataFrame) -> DataFrame:
    """C5: events with three pieces of evidence or more, and what kind of testimony each piece is."""
    e, shown = F.col("evidence_in_corpus"), lambda x: F.coalesce(x.cast("string"), F.lit("?"))
    kind = lambda s: T.testimony_type(F.coalesce(s["genre"], F.lit("?")))
    line = lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), shown(s["genre"]), F.lit(" by "), shown(s["author"]), F.lit(" ("), shown(s["role"]), F.lit(") → "), kind(s))
    return events.where(F.size("evidence_in_corpus") >= 3).select(
        "id", text("decision").alias("claim"), topic(), F.transform(e, line).alias("evidence_summary"), F.transform(e, lambda s: shown(s["genre"])).alias("evidence_types"),
        F.transform(e, lambda s: F.struct(s["slot_id"].alias("slot_id"), kind(s).alias("testimony_type"))).alias("testimony_attribution"),
        text("reason_canonical").alias("inferential_steps"), F.filter(slots(), lambda s: s.isNotNull()).alias("evidence"),
    )


def contradictions(relations: DataFrame, events: DataFrame, personas: DataFrame) -> DataFrame:
    """C6: edges with a party on each side only, of different names, and the first event that resolves the source, else the target."""
    first = lambda a, b: F.get(F.array_except(f"{a}.participants", f"{b}.participants"), F.lit(0))
    r = expand(relations, events, ["contradicts"]).withColumn("party_a", first("src", "tgt")).withColumn("party_b", first("tgt", "src")).where("party_a is not null and party_b is not null")
    name = lambda p: personas.select(F.col("persona_id").alias(p), F.col("display_name").alias(f"{p}_name"))
    r = r.join(name("party_a"), "party_a", "left").join(name("party_b"), "party_b", "left")
    r = r.withColumns({f"{p}_name": F.coalesce(f"{p}_name", F.col(p).cast("string")) for p in ("party_a", "party_b")}).where("party_a_name <> party_b_name")
    by = relations.where("relation = 'resolved_by'").groupBy(F.col("source").alias("of")).agg(F.min_by("target", "ord").alias("resolver"))
    of = lambda key, to: by.select(F.col("of").alias(key), F.col("resolver").alias(to))
    r = r.join(of("source", "_by_source"), "source", "left").join(of("target", "_by_target"), "target", "left").withColumn("resolver", F.coalesce("_by_source", "_by_target"))
    r = r.join(events.select(F.col("id").alias("resolver"), text("decision").alias("resolution_details")), "resolver", "left")
    return r.select(
        "source", "target", topic("src.summary"), "party_a", "party_a_name", text("src.decision").alias("party_a_claim"), text("src.occurred_at").alias("party_a_date"),
        "party_b", "party_b_name", text("tgt.decision").alias("party_b_claim"), text("tgt.occurred_at").alias("party_b_date"), "resolver",
        F.when(F.col("resolver").isNull(), "unresolved").otherwise("resolved").alias("resolution_status"), F.coalesce("resolution_details", F.lit("")).alias("resolution_details"),
        F.concat(slots("src.evidence_in_corpus"), slots("tgt.evidence_in_corpus")).alias("evidence"),
    )


def newer_versions(relations: DataFrame) -> DataFrame:
    """(a, b): the first newer version b of each event a: by the kind of edge, then by where its source first is in that kind, then by ord."""
    kind = F.array_position(F.array(*[F.lit(k) for k in VERSIONS]), F.col("relation"))
    rows = relations.where(F.col("relation").isin(VERSIONS)).withColumn("_kind", kind).withColumn("_met", F.min("ord").over(Window.partitionBy("relation", "source")))
    return rows.groupBy(F.col("target").alias("a")).agg(F.min_by("source", F.struct("_kind", "_met", "ord")).alias("b"))


def chains(edges: DataFrame, depth: int = 20) -> DataFrame:
    """root, last, length, path (nodes) of the walk from each root along the one next of every node, at most `depth` steps.

    edges: (a, b), b the next of a; of several the least. Roots are no one's next. Pointer doubling: a round joins the jumps of
    n steps with each other, so jumps that would pass a walk's end are no rows, and the longer they get, the fewer there are;
    log2(depth) rounds, each written. A root then takes the jumps from the longest to the shortest. Cycles end where they close.
    """
    step = written(edges.groupBy("a").agg(F.min("b").alias("b")), "next")
    jumps, n = [step.select("a", F.array("b").alias("path"))], 1
    while 2 * n <= depth:
        on = jumps[-1].select(F.col("a").alias("_end"), F.col("path").alias("_more"))
        further = written(jumps[-1].withColumn("_end", F.element_at("path", -1)).join(on, "_end").select("a", F.concat("path", "_more").alias("path")), "walks")
        if further.isEmpty():
            forget(further)
            break
        jumps, n = [*jumps, further], 2 * n
    roots = step.join(step.select(F.col("b").alias("a")), "a", "left_anti").select(F.col("a").alias("root"), F.array("a").alias("path"))
    for jump in reversed(jumps):
        on = jump.select(F.col("a").alias("_end"), F.col("path").alias("_more"))
        roots = roots.withColumn("_end", F.element_at("path", -1)).join(on, "_end", "left").select("root", F.when(F.col("_more").isNull(), F.col("path")).otherwise(F.concat("path", "_more")).alias("path"))
    walked = roots.select("root", F.array_distinct(F.slice("path", 1, depth + 1)).alias("path"))  # a walk that closes has no new node from there on
    return walked.select("root", F.element_at("path", -1).alias("last"), F.size("path").alias("length"), "path")


def long_walks(relations: DataFrame, least: int) -> DataFrame:
    """root, at, id: the nodes of the chains of versions that have `least` nodes or more, events or not; written."""
    return written(chains(newer_versions(relations)).where(F.col("length") >= least).select("root", F.posexplode("path").alias("at", "id")), "walks")


def chain_sizes(relations: DataFrame, events: DataFrame, least: int = 3) -> DataFrame:
    """root, chain_length and the number of pieces of evidence of each chain of `lineage`, without what its steps tell."""
    steps = long_walks(relations, least).join(events.select("id", F.size(slots()).cast("bigint").alias("n")), "id")
    return steps.groupBy("root").agg(F.count("*").cast("int").alias("chain_length"), F.sum("n").cast("int").alias("evidence")).where(F.col("chain_length") >= least)


def lineage(relations: DataFrame, events: DataFrame, personas: DataFrame, least: int = 3) -> DataFrame:
    """HARD: chains of versions from the oldest, each step with its date, decision, reason and people; the years they span."""
    walks = long_walks(relations, least)
    kept = events.join(walks.select("id").distinct(), "id", "left_semi")  # only what stands in a chain is told of
    step = kept.select("id", topic(), text("occurred_at").alias("date"), F.substring(text("decision"), 1, 200).alias("decision"), F.substring(text("reason_canonical"), 1, 150).alias("reason"), "participants", slots().alias("slots"))
    steps = walks.join(named(step, ["id"], "participants", personas), "id").withColumn("topic", F.when(F.col("at") == 0, F.col("topic")))
    rows = steps.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "id", "date", "decision", "reason", "participants", "topic", "slots"))).alias("s")).where(F.size("s") >= least)
    years = F.filter(F.transform("s", lambda x: F.substring(x["date"], 1, 4)), lambda y: y != "")
    return rows.select(
        "root", F.col("s")[0]["topic"].alias("topic"), F.size("s").alias("chain_length"), F.when(F.size(years) == 0, "?").otherwise(F.concat(F.array_min(years), F.lit("-"), F.array_max(years))).alias("year_span"),
        F.transform("s", lambda x: F.struct(x["id"].alias("id"), x["date"].alias("date"), x["decision"].alias("decision"), x["reason"].alias("reason"), x["participants"].alias("participants"))).alias("chain_steps"),
        F.flatten(F.transform("s", lambda x: x["slots"])).alias("evidence"),
    )


#: Fields of the ground truth of each category, as (field, column of its candidates): fixed values.
TRUTH = {
    "C1": [("current_value",) * 2, ("prior_value",) * 2, ("change_date",) * 2, ("change_reason",) * 2],
    "C2": [("decision",) * 2, ("deciders",) * 2, ("decision_date",) * 2, ("alternatives",) * 2, ("deciding_factor", "decision_reason")],
    "C3": [("original_value",) * 2, ("corrected_value",) * 2, ("original_recorded_at",) * 2, ("correction_recorded_at",) * 2, ("true_occurred_at",) * 2],
    "C4": [("as_of_date",) * 2, ("asof_facts",) * 2, ("changed_facts",) * 2, ("replacements",) * 2],
    "C5": [("claim",) * 2, ("evidence_summary",) * 2, ("evidence_types",) * 2, ("testimony_attribution",) * 2, ("inferential_steps",) * 2],
    "C6": [("party_a", "party_a_name"), ("party_a_claim",) * 2, ("party_a_date",) * 2, ("party_b", "party_b_name"), ("party_b_claim",) * 2, ("party_b_date",) * 2, ("resolution_status",) * 2, ("resolution_details",) * 2],
    "HARD": [("topic",) * 2, ("chain_length",) * 2, ("year_span",) * 2, ("chain_steps",) * 2],
}


def ground_truth(candidates: DataFrame, category: str) -> Column:
    """The candidates' ground truth as JSON text, fields in their order; chains also tell the state that they end in."""
    fields = [F.col(column).alias(field) for field, column in TRUTH[category]]
    if category == "HARD":
        fields.append(F.element_at("chain_steps", -1)["decision"].alias("current_state"))
    return F.to_json(F.struct(*fields))


def difficulty(evidence: Column, steps: Column | int = 1) -> Column:
    steps = F.lit(steps) if isinstance(steps, int) else steps
    return F.when((steps >= 3) | (evidence >= 6), "hard").when(evidence >= 3, "medium").otherwise("easy")


def filtered(triples: DataFrame, events: DataFrame, kinds: list[str]) -> DataFrame:
    """Distinct triples of known kinds whose ends exist and whose dates are in the order their kind asks for."""
    ids = events.select(F.col("id").alias("source"), F.col("occurred_at").alias("s"))
    rows = triples.where(F.col("relation").isin(kinds)).dropDuplicates(["source", "relation", "target"]).join(ids, "source").join(ids.select(F.col("source").alias("target"), F.col("s").alias("t")), "target")
    unknown = (F.coalesce("s", F.lit("")) == "") | (F.coalesce("t", F.lit("")) == "")
    ordered = F.when(F.col("relation") == "contradicts", True).when(F.col("relation").isin("retroactively_corrected_by", "resolved_by"), F.col("t") >= F.col("s")).otherwise(F.col("s") > F.col("t"))
    return rows.where(unknown | ordered).select("source", "relation", "target")


def versioned(versions: DataFrame, relation: dict[str, str]) -> DataFrame:
    """Triples of chains: each version (chain, at, id, relation_to_previous, corrects, stance) with the one before it by `at`.

    relation maps what a version says of the one before it to a kind of edge, supersedes if it says nothing known. corrects is
    the number of an earlier version, which the version corrects. A stance adds two events, id with -A and -B, that contradict
    each other and that the version resolves.
    """
    w = Window.partitionBy("chain").orderBy("at", "id")
    v = versions.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag("id").over(w))
    known = F.create_map(*[F.lit(x) for pair in relation.items() for x in pair])[F.lower(F.trim("relation_to_previous"))]
    linked = v.where("_before is not null").select(F.col("id").alias("source"), F.coalesce(known, F.lit("supersedes")).alias("relation"), F.col("_before").alias("target"))
    old = v.select("chain", F.col("_n").alias("corrects"), F.col("id").alias("source"))
    fixed = v.where("corrects < _n").select("chain", "corrects", F.col("id").alias("target")).join(old, ["chain", "corrects"]).select("source", F.lit("retroactively_corrected_by").alias("relation"), "target")
    a, b = F.concat(F.col("id"), F.lit("-A")), F.concat(F.col("id"), F.lit("-B"))
    stances = v.where(F.coalesce("stance", F.lit("")) != "")
    against = stances.select(a.alias("source"), F.explode(F.array(F.struct(F.lit("contradicts").alias("relation"), b.alias("target")), F.struct(F.lit("resolved_by").alias("relation"), F.col("id").alias("target")))).alias("r")).select("source", "r.*")
    return linked.unionByName(fixed).unionByName(against)


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, budget: int, cost: DataFrame) -> DataFrame:
    """Nodes within `depth` steps of each seed, nearest first, until their running cost passes the budget. cost: (id, cost)."""
    found = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))
    level = found
    for d in range(1, depth + 1):
        level = level.join(edges, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id"), F.lit(d).alias("depth")).distinct()
        found = found.unionByName(level)
    nearest = found.groupBy("seed", "id").agg(F.min("depth").alias("depth")).join(cost, "id")
    w = Window.partitionBy("seed").orderBy("depth", "id").rowsBetween(Window.unboundedPreceding, 0)
    return nearest.withColumn("spent", F.sum("cost").over(w)).where(F.col("spent") <= budget)


def subgraph(edges: DataFrame, seeds: DataFrame, cost: DataFrame, budget: int, every: int = 8) -> DataFrame:
    """query, id, depth, spent: the nodes around each query's seeds, nearest first and by id, while their running cost is within the budget.

    edges: (a, b); seeds: (query, id); cost: (id, cost), nodes that it lacks are passed over. The search has no bound on depth:
    each round joins the last one's nodes with the edges, leaves out what the query has met (an anti-join), adds up costs and
    is written. A query ends with the first node that its budget does not cover, so it reads no further edges; one without a new
    node ends too. Cycles bring no new nodes. Every so many rounds what was met is written as one table.
    """
    running = Window.partitionBy("query").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    level, spent, rounds, depth = seeds.select("query", "id").distinct(), seeds.select("query", F.lit(0).cast("bigint").alias("before")).distinct(), [], 0
    while True:
        rows = level.join(cost.select("id", F.col("cost").cast("bigint").alias("cost")), "id").join(spent, "query")
        now = written(rows.select("query", "id", F.lit(depth).alias("depth"), (F.col("before") + F.sum("cost").over(running)).alias("spent")), "subgraph")
        rounds.append(now)
        spent = now.groupBy("query").agg(F.max("spent").alias("before")).where(F.col("before") <= budget)
        if spent.isEmpty():
            break
        if len(rounds) > every:
            met = written(_united(rounds), "subgraph")
            for table in rounds[:-1]:
                forget(table)
            rounds = [met]
        front = now.join(spent, "query", "left_semi").join(edges.select(F.col("a").alias("id"), "b"), "id").select("query", F.col("b").alias("id")).distinct()
        level, depth = front.join(_united(rounds).select("query", "id"), ["query", "id"], "left_anti"), depth + 1
    return _united(rounds).where(F.col("spent") <= budget)


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def planted(relations: DataFrame, events: DataFrame, artefacts: DataFrame) -> DataFrame:
    """source, target, stale, host, later: of each superseding or reversing edge the first artefact of the older event, the artefact
    that may cite it, and how many could. artefacts: event_id, slot_id, role, ord.

    Those of later days than the newer event that belong to neither end could; of them the first secondary one by ord, else the
    first. Edges do not meet all later artefacts: an artefact's day is its event's, so each day keeps the running count of what
    lies after it and the first artefacts of three events, of which two at most are an edge's own.
    """
    day = lambda c: F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, 10)
    dated = artefacts.join(events.select(F.col("id").alias("event_id"), day("occurred_at").alias("day")), "event_id")
    first = F.struct(F.when(F.col("role") == "secondary", 0).otherwise(1).alias("rank"), "ord", "slot_id")
    by_event = written(dated.groupBy("event_id", "day").agg(F.min(first).alias("best"), F.count("*").alias("n"), F.min(F.struct("ord", "slot_id")).alias("own")), "planted")
    three = Window.partitionBy("day").orderBy("best", "event_id")
    days = by_event.withColumn("_i", F.row_number().over(three)).groupBy("day").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("_i") <= 3, F.struct("best", "event_id"))).alias("three"))
    none = days.sparkSession.createDataFrame([("",)], "day string").select("day", F.lit(0).cast("bigint").alias("n"), F.array().cast(days.schema["three"].dataType).alias("three"))
    days = days.unionByName(none).withColumn("month", F.substring("day", 1, 7))  # a day before all others
    after = lambda *part: Window.partitionBy(*part[1:]).orderBy(F.col(part[0]).desc()).rowsBetween(Window.unboundedPreceding, -1)
    best = lambda xs: F.slice(F.array_sort(F.flatten(xs)), 1, 3)
    months = days.groupBy("month").agg(best(F.collect_list("three")).alias("three"))
    months = months.select("month", best(F.collect_list("three").over(after("month"))).alias("_later"))
    days = days.join(months, "month").withColumn("three", best(F.array(best(F.collect_list("three").over(after("day", "month"))), "_later"))).withColumn("n", F.coalesce(F.sum("n").over(after("day")), F.lit(0)))
    days = days.groupBy("day").agg(F.min("n").alias("n"), F.max("three").alias("three"))
    e = expand(relations, events, ["supersedes", "reverses"]).select("source", "target", day("src.occurred_at").alias("day"), day("tgt.occurred_at").alias("_old"))
    own = by_event.select(F.col("event_id").alias("target"), F.col("n").alias("_n"), F.col("own.slot_id").alias("stale"))
    e = e.join(own, "target").join(asof_days(e, days), "day")
    left = F.filter("three", lambda x: (x["event_id"] != F.col("source")) & (x["event_id"] != F.col("target")))
    later = F.col("n") - F.when(F.col("_old") > F.col("day"), F.col("_n")).otherwise(0)
    return e.select("source", "target", "stale", F.get(left, F.lit(0))["best"]["slot_id"].alias("host"), later.alias("later")).where("host is not null")


def asof_days(edges: DataFrame, days: DataFrame) -> DataFrame:
    """What lies after each day of edges: that of the day itself or, where no artefact is of that day, of the next one before."""
    wanted = edges.select("day").distinct().withColumn("_w", F.lit(1))
    both = days.withColumn("_w", F.lit(0)).unionByName(wanted, allowMissingColumns=True)
    last = Window.orderBy("day", "_w").rowsBetween(Window.unboundedPreceding, 0)  # days, not artefacts
    filled = both.withColumn("_s", F.last(F.when(F.col("_w") == 0, F.struct("n", "three")), ignorenulls=True).over(last))
    return filled.where("_w = 1 and _s is not null").select("day", "_s.n", "_s.three")
