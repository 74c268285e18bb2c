"""Boards, contexts of years, windows of sizes and partial runs on small rows."""

import json
import os

from pyspark.sql import functions as F

from annalist.operators import boards
from annalist.plans import reports
from annalist.sources import harness


def rows_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_leaderboard_in_a_file(spark, tmp_path):
    records = rows_of(spark, [("s", "a", "1.0", True, 0.5, 12345.0, {"contradiction": 0.25}), ("s", "b", None, None, 0.75, None, {"odd": 1.0}), ("m", "a", "2", False, None, 1.0, None)], "tier string, system string, system_version string, dry_run boolean, accuracy_mean double, latency_ms_p50 double, by_category map<string,double>")
    ingests = rows_of(spark, [("s", "a", 7, 1.5)], "tier string, system string, tokens_stored bigint, ingest_seconds double")
    text = reports.full_leaderboard(boards.board(records, ingests))
    lines = text.splitlines()
    assert [x for x in lines if x.startswith("## ")] == ["## Tier: m", "## Tier: s"] and lines[0] == "# Leaderboard"
    assert "| b (?) | 0.750 | — | — | — | — | — | — | — | — | — | — | — | — | — | — | — | — |" in lines
    own = next(x for x in lines if x.startswith("| a (1.0) [dry-run] |"))
    assert own.split(" | ")[1:10] == ["0.500", "—", "—", "—", "12345.0", "—", "—", "7", "1.500"] and own.split(" | ")[15] == "0.250" and lines.index(own) > lines.index(next(x for x in lines if x.startswith("| b")))
    reports.write(spark, f"file://{tmp_path}/leaderboard.md", text)
    reports.write(spark, f"file://{tmp_path}/leaderboard.md", text)
    assert (tmp_path / "leaderboard.md").read_text() == text and "_No results yet._" in reports.full_leaderboard(boards.board(records.limit(0)))


def test_matrix(spark):
    side = lambda *rows: rows_of(spark, rows, "question string, system string, score double")
    got = {r.question: tuple(r)[1:] for r in boards.matrix(side(("q1", "a", 0.5), ("q2", "a", 1.0)), side(("q1", "a", 0.75), ("q3", "b", 0.25)), ["a", "b"]).collect()}
    assert got == {"q1": (0.5, 0.75, 0.25, None, None, None), "q2": (1.0, None, None, None, None, None), "q3": (None, None, None, None, 0.25, None), None: (0.75, 0.75, 0.0, None, 0.25, None)}


def test_totals_overview_and_versions(spark):
    plan = rows_of(spark, [("s", "a", 1.5, True), ("s", "b", 9.0, False), ("m", "a", 0.25, True), ("m", "c", 1.0, None)], "tier string, system string, cost double, included boolean")
    assert {tuple(map(str, r)) for r in boards.totals(plan).collect()} == {("s", "1.5", "['a']", "['b']"), ("m", "0.25", "['a']", "['c']"), ("None", "1.75", "['a']", "['b', 'c']")}
    arts = rows_of(spark, [("abcd", "2020", "rfc", None), ("ab", None, "rfc", "primary"), (None, None, None, None)], "text string, timestamp string, source_type string, role string")
    one = boards.overview(arts).first()
    assert tuple(one) == (3, 1, 6, 1, {"null": 1, "rfc": 2}, {"null": 2, "primary": 1})
    empty = boards.overview(arts.limit(0)).first()
    assert (empty.n_artifacts, empty.total_chars, empty.by_role) == (0, 0, {})
    runs = rows_of(spark, [("a", "1"), ("a", "2"), ("b", "unknown (sdk)"), ("c", "5"), ("a", None)], "system string, system_version string")
    assert [tuple(r) for r in boards.drifted(runs, {"a": "1", "b": "1"}).collect()] == [("a", "1", "2")] and boards.drifted(runs, {}).count() == 0


def test_year_contexts(spark):
    years = rows_of(spark, [(2020, "Growth"), (2021, None), (2022, "")], "year int, theme string")
    people = rows_of(spark, [(i, f"c{i}", 2020, 2020 if i < 12 else None) for i in range(14)] + [(50, "early", 2001, 2019), (51, "late", 2030, None), (52, "none", None, None), (53, "odd", 2022, 2019)], "id int, name string, joined int, left int")
    events = rows_of(spark, [(i, "2021-02-03", f" topic {i} " + "x" * 100) for i in range(20)] + [(90, "2022", ""), (91, None, "lost")], "id int, occurred_at string, summary string")
    got = {r.year: r.context.split("\n") for r in boards.year_contexts(years, people, events, seed=1).collect()}
    assert got[2020] == ["- Year 2020: Growth", "- Customers: " + ", ".join(f"c{i}" for i in range(10))] and got[2022] == ["- Year 2022", "- Customers: c12, c13"]
    assert got[2021][:3] == ["- Year 2021", "- Customers: c12, c13", "- At work on:"] and len(got[2021]) == 11 and all(x.startswith("    - topic ") and len(x) == 96 for x in got[2021][3:])
    again = {r.year: r.context.split("\n") for r in boards.year_contexts(years.repartition(3), people, events.repartition(4), seed=1).collect()}
    assert again == got


def test_windows_without_a_strict_era(spark):
    years = rows_of(spark, [(y,) for y in (2018, 2019, 2020, 2021)], "year int")
    eras = rows_of(spark, [("2018-01", "2021-12", "low")], "start string, end string, discipline_level string")
    assert [tuple(r) for r in boards.windows(years, eras, ["A", "B"], "small").collect()] == [(2020, 2, "A")]
    assert [tuple(r) for r in boards.windows(years.where("year < 2020"), eras, ["A"], "small").collect()] == [(2019, 2, "A")]
    assert boards.windows(years.limit(0), eras, ["A"], "small").count() == 0 and boards.windows(years, eras, ["A", "B"], "large").count() == 12


def test_partial_runs(spark, tmp_path):
    line = lambda q, v: json.dumps({"query": {"question_id": q, "answer_text": v}, "judge": {"question_id": q, "score": v}})
    (tmp_path / "p.jsonl").write_text("\n".join([line("1", 1), "", "{torn", line("1", 2), json.dumps({"query": {"question_id": "2"}}), line("3", 3)]))
    partial = harness.pairs(spark, f"{tmp_path}/p.jsonl")
    assert {(r.question_id, json.loads(r.judge)["score"]) for r in partial.collect()} == {("1", 2), ("3", 3)}
    ids = rows_of(spark, [(str(i),) for i in range(1, 5)], "id string")
    assert {r.id for r in harness.to_run(ids, partial).collect()} == {"2", "4"} and harness.pairs(spark, f"{tmp_path}/none.jsonl").count() == 0
    harness.write_benchmark(ids.withColumn("text", F.lit("t")), ids.where("id < 3"), f"{tmp_path}/b")
    harness.write_benchmark(ids.withColumn("text", F.lit("t")), ids.where("id = 3"), f"{tmp_path}/b")
    assert [json.loads(x) for f in os.listdir(tmp_path / "b") if f.startswith("part") for x in (tmp_path / "b" / f).read_text().splitlines()] == [{"id": "3", "text": "t"}]


def test_depth_arcs_and_submissions_of_runs(spark, tmp_path):
    canon = tmp_path / "acme_canon"
    canon.mkdir()
    for name in ("personas", "customers"):
        (canon / f"{name}.jsonl").write_text("")
    assert harness.canon(spark, str(tmp_path))["depth_arcs"].count() == 0
    (canon / "depth_arcs.md").write_text("intro\n# One\nfirst arc\nmore\n## Two\nsecond\n")
    assert [tuple(r) for r in harness.canon(spark, str(tmp_path))["depth_arcs"].collect()] == [("One", "first arc\nmore"), ("Two", "second")]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text(json.dumps({"system": "a", "tier": "t", "queries": [{"question_id": "1", "answer_text": "x", "cited_artifact_ids": ["S1"]}, {"question_id": "2"}]}))
    assert [tuple(r) for r in harness.extracted(harness.results(spark, f"{tmp_path}/runs")).collect()] == [("a", "t", "1", "x", ["S1"]), ("a", "t", "2", "", [])]


def test_episodes_without_a_time_are_of_now(spark):
    from annalist.functions import rules as R

    rows = rows_of(spark, [("S1", "2020-01-02"), ("S2", None)], "slot string, day string")
    got = rows.select(R.graph_episode("slot", F.lit(None).cast("string"), "day", F.lit(""), F.lit("g")).alias("e"), F.current_timestamp().alias("now")).collect()
    assert got[0].e.reference_time.strftime("%Y-%m-%d") == "2020-01-02" and got[1].e.reference_time == got[1].now and (got[0].e.episode_body, got[0].e.source_description) == ("", "unknown")
