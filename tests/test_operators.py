"""Operators on small hand-made rows: edges of intervals, dates, walks, merges, settled series."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import graph, retrieval, scoring, state, temporal
from annalist.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("<!-- a -->\n b ", "b"), ("b", "b"), ("<!-- a --><!-- c -->d", "<!-- c -->d"), ("x <!-- a -->", "x <!-- a -->"), ("", "")])
def test_header(spark, raw, want):
    assert one(spark, T.strip_header(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("on 2021-03-04", "2021-03-04"), ("2021-Q3", "2021-07-01"), ("2021 Q1", "2021-01-01"), ("2020-11 x", "2020-11-01"), ("none", None)])
def test_date(spark, raw, want):
    assert one(spark, T.header_date(F.lit(raw))) == want


def test_scores(spark):
    assert one(spark, T.leak(F.lit("the cat sat"), F.lit("cat and dog"))) == 0.5
    assert one(spark, T.leak(F.lit("the"), F.lit("cat"))) == 0.0
    assert one(spark, T.memorised(F.lit("in 2021 alpha"), F.lit("Alpha beta 2021"))) == pytest.approx(2 / 3)
    assert [one(spark, scoring.clip(F.lit(x).cast("double"))) for x in (-1, 0.5, 2, None)] == [0, 0.5, 1, 0]


def test_parsers(spark):
    assert one(spark, T.fact_verdicts(F.lit("FACT 1: yes\nnoise\nfact 2: Partial"))) == {1: "yes", 2: "partial"}
    assert [tuple(r) for r in one(spark, T.triples(F.lit("A -> supersedes -> B\nno\nC → caused_by → D")))] == [("A", "supersedes", "B"), ("C", "caused_by", "D")]


def test_as_of_is_half_open(spark):
    log = spark.createDataFrame([(1, "k", date(2020, 1, 1)), (2, "k", date(2020, 2, 1))], "id int, k string, valid_at date")
    facts = temporal.versions(log, ["k"], "valid_at", "id")
    at = lambda d: [r.id for r in temporal.as_of(facts, F.lit(d)).collect()]
    assert at(date(2019, 12, 31)) == [] and at(date(2020, 1, 1)) == [1] and at(date(2020, 2, 1)) == [2] and at(date(2030, 1, 1)) == [2]


EVENTS = "id string, decision string, summary string, occurred_at string, recorded_at string, reason_canonical string, participants array<string>, evidence_in_corpus array<struct<slot_id:string>>"


@pytest.fixture(scope="module")
def small(spark):
    event = lambda i, day, people: (i, f"d{i}", f"s{i}", f"2020-01-{day:02d}", None, "why", people, [(f"slot{i}",)])
    events = spark.createDataFrame([event("A", 1, ["x", "y"]), event("B", 2, ["y", "z"]), event("C", 3, ["y"])], EVENTS)
    relations = spark.createDataFrame([("B", "supersedes", "A"), ("A", "contradicts", "B"), ("A", "contradicts", "C"), ("A", "resolved_by", "C"), ("A", "retroactively_corrected_by", "C"), ("B", "supersedes", "missing")], "source string, relation string, target string").withColumn("ord", F.monotonically_increasing_id())
    return events, relations


def test_graph(small):
    events, relations = small
    c1 = graph.supersession(relations, events).collect()
    assert [(r.prior_value, r.current_value, r.evidence) for r in c1] == [("dA", "dB", ["slotB", "slotA"])]
    people = events.sparkSession.createDataFrame([("x", "X")], "persona_id string, display_name string")
    c6 = {r.target: (r.party_a, r.party_b, r.resolution_status, r.resolver) for r in graph.contradictions(relations, events, people).collect()}
    assert c6 == {"B": ("x", "z", "resolved", "C")}
    assert [r.corrected_value for r in graph.corrections(relations, events).collect()] == ["dC"]
    facts = {r.fact_id: (r.invalid_at, r.superseded_by, r.expired_at) for r in temporal.facts_bt(events, relations).collect()}
    assert facts == {"A": ("2020-01-02", "B", "2020-01-03"), "B": (None, None, None), "C": (None, None, None)}
    kept = graph.filtered(relations, events, ["supersedes", "resolved_by"]).collect()
    assert {(r.source, r.target) for r in kept} == {("B", "A"), ("A", "C")}


def test_chains_stop_at_cycles_and_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2)] + [(100 + i, 101 + i) for i in range(30)], "a int, b int")
    assert {r.root: r.length for r in graph.chains(edges).collect()} == {1: 3, 100: 21}


def test_state(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert {(r.k, r.v) for r in state.last_wins(rows, ["k"], ["o"]).collect()} == {(1, "b"), (2, "c")}
    patch = spark.createDataFrame([(1, None), (2, "z")], "k int, v string")
    assert {(r.k, r.v) for r in state.patched(rows, patch, "k", ["v"]).collect()} == {(1, "a"), (1, "b"), (2, "z")}
    polls = spark.createDataFrame([("s", i, n) for i, n in enumerate([0, 1, 1, 2, 2, 2, 3])], "scope string, t int, n int")
    assert [(r.t, r.n) for r in state.settled(polls, ["scope"], "t", "n", 3).collect()] == [(5, 2)]
    tiers = spark.createDataFrame([("free", 5, 0), ("paid", 10, 9)], "tier string, cap int, fee int")
    needs = spark.createDataFrame([(1, 5), (2, 6), (3, 11)], "k int, need int")
    assert {(r.k, r.tier, r.fee) for r in state.first_fit(needs, "k", "need", tiers).collect()} == {(1, "free", 0), (2, "paid", 9), (3, None, -1)}


def test_missing_file_and_retrievers(spark, tmp_path):
    assert tables.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    with pytest.raises(KeyError):
        retrieval.retriever("none")
    docs = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, "dog")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "the red fox"), (8, "zebra")], "item_id bigint, text string")
    got = {r.item_id: r.doc_id for r in retrieval.retriever("keyword").transform(docs, items).collect()}
    assert got == {7: 1, 8: None}
    assert [r.failure_mode for r in scoring.judge(items.limit(1), "").collect()] == ["dry_run"]


def test_events_that_correct_none_are_spread(spark):
    """They share no key with each other: in one task's partition lie few of them, and the prior event is found as before."""
    from collections import Counter

    from annalist.operators import evaluation

    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        events = spark.createDataFrame([(i, f"d{i}", f"t{i}") for i in range(1000)] + [(None, "lost", "t")], "id bigint, decision string, occurred_at string")
        rows = events.where("id is not null").selectExpr("id", "case when id % 5 = 0 and id > 0 then id - 1 when id = 1 then -7 end as corrects_event_id")
        got = evaluation.with_prior(rows, events).selectExpr("*", "spark_partition_id() as p").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted((r.id, r.corrects_event_id, r.prior_decision, r.prior_occurred_at) for r in got if r.id % 5 == 0 and r.id) == [(i, i - 1, f"d{i - 1}", f"t{i - 1}") for i in range(5, 1000, 5)]
    assert len(got) == 1000 and sum(r.prior_decision is None for r in got) == 801
    assert max(Counter(r.p for r in got).values()) < 400


def test_keyword_search_holds_little_at_once(monkeypatch):
    """10 million pairs of token and question are added up in pieces, with the result of counting them one by one."""
    import tracemalloc

    import pyarrow as pa

    def top(docs, asked, k):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.list_(pa.string()))], names=["doc_id", "tokens"])
        (out,) = retrieval._most_shared(asked, k)(iter([batch]))
        return sorted(zip(*out.to_pydict().values(), strict=True))

    words = [f"w{i}" for i in range(50)]
    tracemalloc.start()
    got = top([(i, words) for i in range(500)], [(q, words) for q in range(400)], 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(q, 0, 50) for q in range(400)] and peak < 60 << 20

    for name, n in [("ASKED", 3), ("ROWS", 4), ("PAIRS", 7), ("BLOCK", 10)]:
        monkeypatch.setattr(retrieval, name, n)
    docs = [(i, None if i % 9 == 4 else [w for j, w in enumerate(words) if (j * 7 + i * 13) % 5 < i % 4]) for i in range(33)]
    asked = [(q, [w for j, w in enumerate([*words, "else"]) if (j * 3 + q * 5) % 7 < 2]) for q in range(10)]
    every = {q: sorted((-len(set(t or []) & set(mine)), i) for i, t in docs if set(t or []) & set(mine))[:2] for q, mine in asked}
    assert top(docs, asked, 2) == sorted((q, i, -n) for q, best in every.items() for n, i in best)


def test_workers_make_no_objects_of_questions():
    """A worker given 3,000 questions of 60 words, all different, holds little beyond the arrays it was sent; nor does it fail without any."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([7, 3], pa.int64()), pa.array([["w5", "w61"], ["w61"]], pa.list_(pa.string()))], names=["doc_id", "tokens"])
    work = retrieval._most_shared([(q, [f"w{60 * q + i}" for i in range(60)]) for q in range(3000)], 2)
    tracemalloc.start()
    (out,) = work(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [{"query_id": 0, "id": 7, "score": 1}, {"query_id": 1, "id": 3, "score": 1}, {"query_id": 1, "id": 7, "score": 1}] and peak < 8 << 20
    assert next(retrieval._most_shared([], 2)(iter([batch]))).num_rows == 0


def test_verdict_lines_are_read_once(spark):
    """The parsed lines are bound before the facts are gone through; in the inner function they would be parsed for each fact."""
    from annalist.functions import rules

    rows = spark.createDataFrame([("FACT 1: yes\nFACT 2: no\nfact 1 : PARTIAL", 3)], "text string, n int")
    verdicts = rows.select(rules.fact_lines("text", rows["n"]).alias("v"))
    assert verdicts.first()["v"] == ["partial", "no", "no"]
    plan = verdicts._jdf.queryExecution().analyzed().toString()
    assert plan.index("regexp_extract") < plan.index("sequence(")


def test_chains_are_measured_without_what_they_tell(spark):
    """Sizes of chains as those of the lineage, also where a node is no event; and texts of evidence are made after its lines were collected."""
    from annalist.plans import knowledge

    piece = "array<struct<slot_id string, genre string, role string, author string>>"
    events = spark.createDataFrame([(i, "t", "2020-01-01", None, f"s{i}", f"d{i}", "r", ["p"], [], [(f"{i}-{j}", "rfc", "r", "a") for j in range(i % 3)]) for i in (1, 2, 3, 4, 11, 13, 21, 22)], f"id bigint, type string, occurred_at string, recorded_at string, summary string, decision string, reason_canonical string, participants array<string>, alternatives_considered array<string>, evidence_in_corpus {piece}".replace("<slot_id string, genre string, role string, author string>", "<slot_id:string,genre:string,role:string,author:string>"))
    edges = [(2, 1), (3, 2), (4, 3), (12, 11), (13, 12), (22, 21)]
    relations = spark.createDataFrame([(s, "supersedes", t, i) for i, (s, t) in enumerate(edges)], "source bigint, relation string, target bigint, ord bigint")
    people = spark.createDataFrame([("p", "P")], "persona_id string, display_name string")
    told = sorted((r.root, r.chain_length, len(r.evidence)) for r in graph.lineage(relations, events, people).collect())
    assert told == sorted((r.root, r.chain_length, r.evidence) for r in graph.chain_sizes(relations, events).collect()) == [(1, 4, 4)]
    lines = spark.createDataFrame([(1, 1, 2, 3, "A", "O")], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string")
    orders = spark.createDataFrame([(1, 5, None, "2", "O")], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string, o_orderstatus string")
    made = knowledge.knowledge(orders, lines, spark.createDataFrame([(5, "s", 1)], "c_custkey bigint, c_mktsegment string, c_nationkey int"))[0]
    assert [tuple(x) for x in made.first()["evidence_in_corpus"]] == [("1-1-2", "slack_thread", "o", "S3")] and made.first()["alternatives_considered"] == ["3"]
    assert all("slot_id" not in line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list" in line)
