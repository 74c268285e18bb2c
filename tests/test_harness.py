"""Loading of tiers, questions, submissions, checkpoints and results from files, and rules that have no table."""

import json

import pytest
from pyspark.sql import functions as F

from annalist.functions import rules as R
from annalist.functions import sketches as S
from annalist.functions import text as T
from annalist.operators import costs, evaluation, graph, planning
from annalist.sources import harness, shared


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def tier(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    d = root / "acme" / "small"
    for sub in ("source_of_truth", "acme_canon", "corpus/chat"):
        (d / sub).mkdir(parents=True)
    lines = lambda name, *rows: (d / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    event = {"type": "strategic_decision", "occurred_at": "2020-01-02", "decision": "go", "participants": ["P-1"]}
    lines("source_of_truth/events.jsonl", {"id": "EV-2020-1", **event}, "", {"id": "EV-2020-2", **event, "occurred_at": "2020-03-01", "decision": "stop"})
    lines("source_of_truth/relations.jsonl", {"source": "EV-2020-2", "relation": "supersedes", "target": "EV-2020-1"}, {"source": "EV-2020-2", "relation": "contradicts", "target": "EV-2020-1"})
    lines("acme_canon/personas.jsonl", {"persona_id": "P-1", "display_name": "Ada", "joined_year": 2019})
    lines("acme_canon/customers.jsonl", {"customer_id": "C-1", "name": "Acme", "first_year": 2019})
    (d / "acme_canon/skeleton.json").write_text(json.dumps({"founding_year": 2019, "eras": [{"n": 1, "name": "first", "start": "2019-01", "end": "2020-12"}], "tooling": [{"year": 2019, "quarter": 2, "description": "a"}, {"year": 2020, "description": "b"}, {"year": 2022, "description": "c"}]}, indent=1))
    lines("corpus_index.jsonl", {"slot_id": "S1", "event_id": "EV-2020-1", "genre": "slack_thread", "author": "P-1", "path": "corpus/chat/S1.md", "chars": 41}, {"slot_id": "S2", "path": "corpus/chat/gone.md", "chars": 3}, {"slot_id": "S3", "path": "corpus/chat/S3.md", "chars": 1})
    (d / "corpus/chat/S1.md").write_text("<!-- artefact_metadata\nslot_id: S9\n-->\n\nhello")
    (d / "corpus/chat/S3.md").write_text("<!-- date: 2021-Q2 -->\nno event")
    question = {"id": "Q-1", "category": "C4", "difficulty": "hard", "text": "t", "evidence_artefact_ids": ["S1"], "ground_truth_answer": {"as_of_date": "2020-02-01"}, "metadata": None}
    lines("benchmark_v0.0.jsonl", question, {"id": "Q-2", "category": "EMERGENT", "text": "u", "evidence_artifact_ids": ["S1", "S2"]}, {"id": "Q-3", "category": "X1", "text": "v"})
    return str(root), str(d)


def test_tier(spark, tier):
    root, folder = tier
    assert harness.tier_dir(spark, root, "small", "acme") == folder
    with pytest.raises(FileNotFoundError):
        harness.tier_dir(spark, root, "large", "acme")
    g, c = harness.graph(spark, folder), harness.canon(spark, folder)
    assert [r.as_of_date for r in graph.audit(g["relations"], g["events"]).collect()] == ["2020-02-01"]
    assert graph.contradictions(g["relations"], g["events"], g["personas"]).count() == 0  # one person on both sides
    assert c["customers"].count() == 1 and c["channels"].count() == 0 and [r.name for r in harness.eras(c["skeleton"]).collect()] == ["first"]
    assert [r.description for r in harness.tooling(c["skeleton"], 2020).collect()] == ["a", "b"] and [r.description for r in harness.tooling(c["skeleton"], 2020, 1).collect()] == ["b"]
    art = {r.slot_id: (r.text, r.timestamp, r.author) for r in harness.corpus(spark, folder).collect()}
    assert art == {"S1": ("hello", "2020-01-02", "Ada"), "S3": ("no event", "2021-04-01", None)}
    assert [r.slot_id for r in harness.up_to(harness.corpus(spark, folder), "2020-12-31").collect()] == ["S1"]


def test_questions_and_submission(spark, tier, tmp_path):
    _, folder = tier
    q = harness.questions(spark, folder)
    got = {r.id: (r.public_category, r.is_emergent, r.as_of, r.evidence_artifact_ids, r.capabilities_required) for r in q.collect()}
    assert got == {"Q-1": ("audit_replay", False, "2020-02-01", ["S1"], ["temporal"]), "Q-2": ("emergent_pattern", True, None, ["S1", "S2"], []), "Q-3": ("x1", False, None, [], [])}
    with pytest.raises(FileNotFoundError):
        harness.questions(spark, folder, emergent=True)
    kept = evaluation.on_disk(q.select("id", "evidence_artifact_ids"), "id", "evidence_artifact_ids", spark.createDataFrame([("S2",)], "slot_id string"))
    assert [(r.id, r.evidence_artifact_ids) for r in kept.collect()] == [("Q-2", ["S2"])]
    (tmp_path / "p.jsonl").write_text('{"question_id": "Q-1", "answer_text": "old"}\n\n{"question_id": "Q-1", "answer_text": "new"}\n{"question_id": "Q-9", "answer_text": "x"}')
    p = harness.submission(spark, f"{tmp_path}/p.jsonl")
    assert {r.id: r.answer_text for r in harness.judged(q, p, "mine").collect()} == {"Q-1": "new", "Q-2": "", "Q-3": ""}
    record = evaluation.records(harness.judged(q, p, "mine"), ["system"]).first()
    assert (record.n_questions, record.accuracy_mean, record.faithfulness_rate, record.latency_ms_p95) == (3, 0.0, 1.0, 0.0)
    assert {r.kind: r.n for r in evaluation.validated(q.select("id"), p).collect()} == {"questions": 3, "predictions": 2, "missing": 2, "unknown": 1}
    (tmp_path / "bad.jsonl").write_text('{"question_id": "Q-1"}')
    with pytest.raises(Exception, match="submission record"):
        harness.submission(spark, f"{tmp_path}/bad.jsonl").collect()


def test_results_and_checkpoints(spark, tmp_path):
    for system, text in (("a", json.dumps({"system": "a", "tier": "small", "metrics": {"usage": {"x": 1}}, "queries": [{"question_id": "1", "input_tokens": 3, "output_tokens": 0, "cost_usd": 0.25}, {"question_id": "2", "input_tokens": 0, "output_tokens": 0}], "judgements": [{"question_id": "1", "cost_usd": 0.5}]}, indent=1)), ("b", "{oops"), ("reference", json.dumps({"system": "reference"}))):
        (tmp_path / system).mkdir()
        (tmp_path / system / "acme-small.json").write_text(text)
    runs = harness.results(spark, str(tmp_path))
    assert [r.system for r in runs.collect()] == ["a"] and harness.measured(runs).count() == 1
    assert tuple(harness.usage(runs).first()) == ("a", "small", 1, 3, 0, 1, 0.75)
    assert harness.results(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "c.jsonl").write_text('{"unit_id": "u1"}\nnot json\n{"status": "x"}\n{"unit_id": "u1"}')
    assert [r.unit_id for r in harness.done(spark, f"{tmp_path}/c.jsonl").collect()] == ["u1"]


def test_command_line(spark, tier, tmp_path, capsys):
    from annalist.__main__ import main

    root, folder = tier
    (tmp_path / "p.jsonl").write_text('{"question_id": "Q-1", "answer_text": "a"}')
    assert main(["judge-submission", root, "--company", "acme", "--tier", "small", "--file", f"{tmp_path}/p.jsonl", "--system", "mine", "--out", f"{tmp_path}/record"], spark) == 0
    record = json.loads(next((tmp_path / "record").glob("*.json")).read_text())
    assert (record["n_questions"], record["tier"], record["by_category"], record["by_difficulty"], record["failure_modes"]) == (3, "small", {"audit_replay": 0.0, "emergent_pattern": 0.0, "x1": 0.0}, {"hard": 0.0, "unspecified": 0.0}, {"dry_run": 3})
    assert main(["questions", root, "--company", "acme", "--tier", "small"], spark) == 0
    assert main(["cost", root, "--company", "acme", "--tier", "small", "--budget", "1"], spark) == 0
    printed = capsys.readouterr().out
    assert "| missing | 2 |" in printed and "| emergent | true | 1 |" in printed and "graphiti" in printed


def test_costs(spark):
    """By hand: 126 artifacts of 70,000 tokens and 14 questions."""
    sizes = spark.createDataFrame([("small", 126, 70_000, 14), ("huge", 900_000, 10, 1)], "tier string, artifacts bigint, tokens bigint, questions bigint")
    got = {(r.system, r.tier): r for r in costs.estimate(sizes).collect()}
    judge, answers = 14 * (2500 * 3e-6 + 4500 * 15e-6), 14 * (4000 * 3e-6 + 3500 * 15e-6)
    ingest = 126 * 17 * ((70_000 / 126 + 500) * 3e-6 + 600 * 15e-6)
    r = got["graphiti", "small"]
    assert (r.judge_usd, r.query_usd, r.ingest_usd, r.embed_usd) == (round(judge, 2), round(answers, 2), round(ingest, 2), round(70_000 * 0.02e-6, 3))
    assert abs(r.cost - (judge + answers + ingest + 0.0014)) < 0.011 and r.fee == 0 and r.sub_tier == "-"
    assert (got["zep-cloud", "small"].sub_tier, got["zep-cloud", "small"].ingest_usd) == ("free", 0.0)
    assert [(got["mem0-platform", t].sub_tier, got["mem0-platform", t].fee) for t in ("small", "huge")] == [("free", 0), ("over", -1)]


def test_collisions(spark, tier):
    _, folder = tier
    index = spark.createDataFrame([("p/S1.md",), ("p/S2.md",)], "path string")
    files = spark.createDataFrame([("p/S1.md", "<!-- artefact_metadata\nslot_id: S9\n-->"), ("p/S2.md", "slot_id: S2"), ("p/S3.md", "slot_id: S4")], "path string, text string")
    assert [(r.slot_id, r.header_id) for r in harness.collided(index, files).collect()] == [("S1", "S9")]


def test_rules(spark):
    x = lambda c: one(spark, c)
    assert x(T.fact_verdicts(F.lit("FACT 1: yes\nFACT 2: no\nfact 1: Partial"))) == {1: "partial", 2: "no"}
    assert x(R.fact_lines(F.lit("FACT 2: Partial because\nFACT 9: yes\nFACT 2 : yes"), F.lit(3))) == ["no", "yes", "no"]
    assert [x(R.rounded(F.lit(v), 2)) for v in (2.675, 0.125, 0.375)] == [round(v, 2) for v in (2.675, 0.125, 0.375)]
    assert [x(R.retry_wait(F.lit(6), F.lit(a))) for a in (0, 1, 2, 9)] == [6, 12, 24, 24] and x(R.retry_wait(F.lit(50), F.lit(3))) == 60
    assert x(R.letters_seed(F.lit("A-b"))) == 65 + 98 and x(R.letters_seed(F.lit("12"))) == sum(map(ord, "Acme"))
    header = R.artefact_header(F.lit("S1"), F.lit(None), F.lit("rfc"), F.lit("primary"), F.lit("P-1"))
    assert x(header).startswith("<!-- artefact_metadata\nslot_id: S1\nevent_id: \n") and "testimony_type: inferred" in x(header)
    assert x(R.strip_artefact_header(F.concat(header, F.lit(" body ")))) == " body " and x(R.strip_artefact_header(F.lit("<!-- other -->b"))) == "<!-- other -->b"
    assert [x(R.failure_mode(F.lit(m))) for m in ("hallucination", "odd")] == ["hallucination", "none"]
    facts = F.array(F.struct(F.lit("a").alias("fact"), F.lit("no").alias("verdict")), F.struct(F.lit("b").alias("fact"), F.lit("yes").alias("verdict")))
    assert [f.fact for f in x(R.verdicts(facts, "no"))] == ["a"] and [f.fact for f in x(R.verdicts(facts, "no", other=True))] == ["b"]
    assert x(S.channels(F.lit("noise\nchannel: ops\ncreated: 2020-01\nchannel: dev\nteam: t")))[1].team == "t"
    drawn = x(S.pattern(F.lit("question: how?\ngt_answer: so\n- one\n* two")))
    assert (drawn.question, drawn.facets) == ("how?", ["one", "two"])
    assert [(r.first_year, r.last_year) for r in spark.range(3).select(*planning.tenure(F.col("id"), 2015, 2, 2017)).collect()] == [(2015, 2016), (2016, 2017), (2015, 2017)]
    slots = x(planning.slots_of(F.lit("EV-1"), F.array(F.lit("P-1"), F.lit("P-2")), 3, ["adr"], ["rfc", "email_thread"]))
    assert [(s.slot_id, s.genre, s.role, s.author) for s in slots] == [("ART-EV-1-001", "adr", "primary", "P-1"), ("ART-EV-1-002", "email_thread", "secondary", "P-2"), ("ART-EV-1-003", "rfc", "secondary", "P-1")]


SKELETON = """## Founding
In 2019 Ada Byron and Grace Hopper-Lee, then Ada Byron again, began.
## Year arcs
- 2019: start
- 2020 : growth
## Doc-discipline eras
""" + "\n".join(f"### Era {i}: Name {i}\nDate span: 201{i}-01 to 201{i}-12\nDiscipline level: {level}\nCharacterisation: text {i}" for i, level in enumerate(["Low", "medium", "high", "low", "medium"], 1)) + """
## Product lines
- One
- Two
## Customer arc count
about 9 of them
## Tooling timeline
- 2019-Q2: chat
- 2020: wiki
"""


def test_skeletons(spark):
    got = one(spark, S.skeleton(F.lit(SKELETON)))
    assert (got.founding_year, got.founders, got.products, got.customer_arc_count, got.problems) == (2019, ["Ada Byron", "Grace Hopper-Lee"], ["One", "Two"], 9, [])
    assert [(a.year, a.arc) for a in got.year_arcs] == [(2019, "start"), (2020, "growth")] and [(t.year, t.quarter, t.description) for t in got.tooling] == [(2019, 2, "chat"), (2020, None, "wiki")]
    assert [(e.n, e.name, e.start, e.end, e.discipline_level, e.characterisation) for e in got.eras][:2] == [(1, "Name 1", "2011-01", "2011-12", "low", "text 1"), (2, "Name 2", "2012-01", "2012-12", "medium", "text 2")]
    bad = one(spark, S.skeleton(F.lit("## Founding\nby Ada Byron\n## Customer arc count\n12\n")))
    assert bad.problems == ["no founding year", "fewer than two founders", "no year arcs", "not five eras", "no era of low or of high discipline", "no product lines", "customer arcs not 8 to 10", "no tooling timeline"]


def test_facets_contexts_and_ids(spark, tier, tmp_path):
    facets = spark.createDataFrame([("q", 0, ["a"], ["a", "b"]), ("q", 1, [], ["a", "b"]), ("r", 0, ["c"], ["c"])], "question string, facet int, ids array<string>, all_ids array<string>")
    exhibits = spark.createDataFrame([("q", 0, "b"), ("q", 1, "b"), ("r", 0, "c")], "question string, facet int, slot_id string")
    got = {r.question: (r.facets, r.covered, r.fraction, r.complete) for r in evaluation.facets_covered(facets, exhibits).collect()}
    assert got == {"q": (2, 1, 0.5, False), "r": (1, 1, 1.0, True)}
    assert [one(spark, evaluation.answer_context(F.lit(t), 3)) for t in ("abcd", " ", None)] == ["abc", "(no context was retrieved)", "(no context was retrieved)"]
    assert {r.id: r.question_id for r in evaluation.question_ids(spark.range(12).repartition(3), [F.desc("id")]).collect()} == {i: f"Q-{12 - i:04d}" for i in range(12)}
    for name, rows in (("questions_draft", [{"id": "Q-1", "category": "C1"}]), ("emergent_questions", [{"id": "E-1", "category": "EMERGENT"}])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert sorted(r.id for r in harness.questions(spark, str(tmp_path), emergent=True).collect()) == ["E-1", "Q-1"]
    (tmp_path / "cp.jsonl").write_text('{"unit_id": "u"}')
    assert harness.forget(spark, f"{tmp_path}/cp.jsonl") and harness.done(spark, f"{tmp_path}/cp.jsonl").count() == 0


def test_rows_numbered_in_one_order(spark):
    rows = spark.range(500).selectExpr("id", "(id * 37) % 500 as v").repartition(7)
    got = {r.id: r.place for r in evaluation.numbered(rows, [F.col("v")], "place").collect()}
    assert got == {i: i * 37 % 500 + 1 for i in range(500)}


def test_walks_beyond_a_recursion_limit(spark):
    """Chains with more rows in all than a recursive query may have: pointer doubling has no such limit."""
    old = spark.conf.get("spark.sql.cteRecursionRowLimit", "1000000")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        edges = spark.range(3000).where("id % 10 <> 9").selectExpr("id as a", "id + 1 as b")
        got = graph.chains(edges).selectExpr("count(*) n", "min(length) least", "max(length) most").first()
        assert (got.n, got.least, got.most) == (300, 10, 10)
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", old)


def test_shared_folder(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
