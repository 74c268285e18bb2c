"""Streams from folders of files, run until all is read; parsers, reports and the command line on small rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from annalist.__main__ import main
from annalist.functions import parse as P
from annalist.operators import planning
from annalist.plans import reports
from annalist.streaming import logs, settle


def feed(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()


RULE = settle.Rule(stable=3, least=20, hold=20, timeout=200)


@pytest.mark.parametrize(
    "counts, want",
    [
        ([1, 2, 5, 5, 5, 5, 5, 5, 5], (70.0, 5, "settled")),
        ([5, 5, 5, 5, 5, 9, 5, 5], (60.0, 5, "settled")),
        ([5] * 6 + [6] * 8, (110.0, 6, "settled")),
        ([1, 2, 5, 5, -1, 5, 5, 5, 5, 5, 5], (100.0, 5, "settled")),
        (list(range(30)), (200.0, 19, "timeout")),
        ([-1, -1], None),
        ([], None),
    ],
)
def test_settle_steps(counts, want):
    state, ends = settle.START, []
    for i, n in enumerate(counts):
        state, status = settle.step(state, 10.0 * i, n, RULE)
        if status:
            ends.append((10.0 * i, state[2], status))
    assert ends == ([want] if want else [])


def test_settle_positive_ignores_zero():
    state, seen = settle.START, []
    for i, n in enumerate([0] * 9 + [4] * 6):
        state, status = settle.step(state, 10.0 * i, n, settle.Rule(3, 20, 20, 2000, True))
        seen.append(status)
    assert seen.index("settled") == 14
    state, seen = settle.START, []
    for i in range(12):
        state, status = settle.step(state, 10.0 * i, 4, settle.Rule(3, 50, 20, 2000, True))
        seen.append(status)
    assert seen.index("settled") == 7


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old)


def states(spark, checkpoint):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "watch").load().count()


def test_watch(spark, tmp_path, rocks):
    """s settles; t and the null scope fall silent and end by their timers when others' polls go on; u never counts; the last to poll is still open."""
    polls = [[("s", 10.0 * i, n) for i, n in enumerate([1, 2, 5, 5, 5])] + [("t", 10.0 * i, i) for i in range(4)] + [("u", None, 1)]]
    polls += [[("s", 10.0 * (i + 5), 5) for i in range(3)] + [(None, 60.0, 9)], [("last", 270.0, 1)], [("last", 275.0, 2)]]
    stream = feed(spark, tmp_path, polls, "scope string, at double, n bigint")
    run(settle.watch(stream, RULE, late="5 seconds").writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "c")))
    got = sorted([tuple(r) for r in spark.table("settled").collect()], key=str)
    assert got == sorted([("s", 70.0, 5, "settled"), ("t", 200.0, 3, "timeout"), (None, 260.0, 9, "timeout")], key=str)
    assert states(spark, str(tmp_path / "c")) == 1  # that of the scope which still polls


def test_log(spark, tmp_path):
    schema = "k string, day date, v int"
    stream = feed(spark, tmp_path, [[("a", date(2020, 1, 1), 1), ("b", date(2020, 1, 1), 7)], [("a", date(2020, 2, 1), 2)]], schema)
    run(logs.append(stream, str(tmp_path / "log"), str(tmp_path / "c")))
    log = logs.read(spark, str(tmp_path / "log"), schema)
    assert {(r.k, r.v) for r in logs.latest(log, ["k"], ["day"]).collect()} == {("a", 2), ("b", 7)}
    assert {(r.k, r.v) for r in logs.as_of(log, ["k"], "day", "batch", F.lit(date(2020, 1, 5))).collect()} == {("a", 1), ("b", 7)}
    run(logs.append(stream, str(tmp_path / "log"), str(tmp_path / "c")))
    assert log.count() == 3


def test_windows_of_a_table(spark):
    rows = spark.sql("select timestamp'2020-01-01 00:10:00' ts, 'a' k, 2 v union all select timestamp'2020-01-01 00:50:00', 'a', 3 union all select timestamp'2020-01-01 01:00:00', 'a', 4")
    assert sorted((r.n, r.total) for r in logs.windows(rows, "ts", ["k"], "v").collect()) == [(1, 4), (2, 5)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_parse(spark):
    assert one(spark, P.unfenced(F.lit("hi\n```json\n{1}\n```\nbye"))) == "{1}" and one(spark, P.unfenced(F.lit(" x "))) == "x"
    assert one(spark, P.plain_quotes(F.lit("“a” – b’s"))) == "\"a\" - b's"
    assert [tuple(r) for r in one(spark, P.sections(F.lit("pre\n# A\nx\n## B\n\ny\nz\n### c")))] == [("A", "x"), ("B", "y\nz\n### c")]
    assert one(spark, P.yaml_documents(F.lit("a: 1\na: '2'\n---\n\n---\nnoise\nb_c: x: y"))) == [{"a": "2"}, {"b_c": "x: y"}]
    assert one(spark, P.yaml_documents(F.lit(""))) == []
    assert str(one(spark, P.later_date(F.lit(date(2025, 12, 31)), 18))) == "2026-06-28"
    assert one(spark, P.month_index(F.lit("2020-3"))) == 24243 and one(spark, P.month_index(F.lit("soon"))) is None


def test_fill_gaps(spark):
    gaps = spark.createDataFrame([("a", 9), ("b", 2), ("c", 14), ("d", 0), ("e", 1)], "category string, gap bigint")
    assert {(r.category, r.ask) for r in planning.fill_gaps(gaps, "category", "gap", 8).collect()} == {("c", 2), ("a", 1), ("b", 1), ("e", 1)}
    assert planning.fill_gaps(gaps.where("gap < 0"), "category", "gap", 8).count() == 0


def test_reports(spark, capsys, tmp_path):
    rows = spark.createDataFrame([("t", "b", 2, 0.5), ("t", "a", 1, 100.0), (None, "c", 1, None)], "tier string, system string, rank int, score double")
    text = reports.leaderboard(rows)
    assert text.index("## N/A") < text.index("## t") and text.index("| a | 1 | 100.0 |") < text.index("| b | 2 | 0.500 |") and "| c | 1 | N/A |" in text
    plan = spark.createDataFrame([("a", "s", 1.5, True), ("a", "m", 9.0, False)], "system string, tier string, cost double, included boolean")
    assert "| a | (9.00) | 1.50 |" in reports.budget(plan) and reports.budget(plan).endswith("Included: 1.50")
    assert main(["list"]) == 0 and "corpus_stats" in capsys.readouterr().out
    assert main(["run", "none", "x", "y"]) == 2
