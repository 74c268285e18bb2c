"""Guarded model stages: outcomes of each row, breakers by lane, resumption, waits."""

from pyspark.sql import functions as F

from annalist.operators import calls


def failing():
    """Replies to 'ok', is blank for 'blank', raises for 'lost', and raises once for 'late'."""
    met = set()

    def client(prompt):
        kind = prompt.split()[0]
        if kind == "lost" or kind == "late" and prompt not in met:
            met.add(prompt)
            raise TimeoutError(prompt)
        return " " if kind == "blank" else f" re {prompt}"

    return client


def outcomes(spark, kinds, **more):
    rows = spark.createDataFrame([(i, lane, f"{kind} {i}") for i, (lane, kind) in enumerate(kinds)], "id bigint, lane int, prompt string")
    guard = calls.Guard(**{"attempts": 3, "breaker": 3, "sleep": None} | more)
    got = calls.called(rows, ["id"], ["id"], F.col("prompt"), failing, guard, lanes=2, lane=F.col("lane"))
    return {r.id: (r.status, r.attempts, r.waited) for r in got.collect()}, got, rows


def test_outcomes_of_rows_and_lanes(spark):
    kinds = [(0, k) for k in ("ok", "blank", "lost", "ok", "late", "blank", "lost", "blank", "ok", "blank")] + [(1, k) for k in ("blank", "blank", "ok", "blank")]
    got, log, rows = outcomes(spark, kinds)
    assert [got[i][0] for i in range(10)] == ["ok", "empty", "failed", "ok", "ok", "broken", "broken", "broken", "skipped", "skipped"]
    assert [got[i][0] for i in range(10, 14)] == ["empty", "empty", "ok", "empty"]
    assert got[2][1:] == (3, 15.0) and got[4][1:] == (2, 5.0) and got[8][1:] == (0, 0.0)
    assert {r.id for r in calls.remaining(rows.select("id"), log, ["id"]).collect()} == {5, 6, 7, 8, 9}
    assert {r.error for r in log.where("status = 'failed'").collect()} == {"TimeoutError: lost 2"} and {r.reply for r in log.where("id = 0").collect()} == {"re ok 0"}


def test_no_breaker_and_no_rows(spark):
    got, *_ = outcomes(spark, [(0, "blank")] * 6, breaker=0)
    assert [v[0] for v in got.values()] == ["empty"] * 6
    rows = spark.createDataFrame([], "id bigint, lane int, prompt string")
    assert calls.called(rows, ["id"], ["id"], F.col("prompt"), failing).count() == 0


def test_waits():
    slept = []
    guard = calls.Guard(attempts=6, wait=10.0, sleep=slept.append)
    assert calls.Lane(0, failing(), guard).call("lost 1")[0] == "failed"
    assert slept == [10.0, 20.0, 40.0, 40.0, 40.0] and calls.Guard(wait=40).pause(9) == 60


def test_dry_run_and_unreadable_verdicts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, prompt string")
    got = calls.verdicts(calls.called(rows, ["id"], ["id"], F.col("prompt"), calls.dry), ["id"])
    assert {tuple(r) for r in got.collect()} == {(1, 0.0, "dry_run"), (2, 0.0, "dry_run")}
    log = spark.createDataFrame([(1, "ok", '{"score": 7, "failure_mode": "hallucination"}'), (2, "ok", "{}"), (3, "failed", ""), (4, "ok", '{"score": 0.25}')], "id bigint, status string, reply string")
    assert {tuple(r) for r in calls.verdicts(log, ["id"]).collect()} == {(1, 1.0, "hallucination"), (2, 0.0, "unreadable"), (3, 0.0, "failed"), (4, 0.25, "none")}


def test_settings(spark):
    rows = spark.createDataFrame([("draft", None), ("draft", 7), ("other", None), (None, None)], "stage string, override int")
    assert [r[0] for r in rows.select(calls.settings("stage", "override", {"draft": 6000}, 4000)).collect()] == [6000, 7, 4000, 4000]
