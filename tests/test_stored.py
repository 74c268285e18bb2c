"""Scoped storage, keyed updates, exact ranks and scoped vectors on small rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.operators import ranks, retrieval
from annalist.sources import files
from annalist.sources.keyed import Keyed, repointed
from annalist.sources.scopes import Residue, Scopes


def put(spark, rows, schema="id bigint, v string"):
    return spark.createDataFrame(rows, schema)


def test_scopes(spark, tmp_path):
    store = Scopes(spark, f"file://{tmp_path}/s", "id bigint, v string")
    assert store.rows().count() == 0 and store.count("a") == 0 and not store.wipe("a")
    one, two = put(spark, [(1, "x"), (2, "y")]), put(spark, [(3, "z")])
    assert store.ingest(one, "tier/a b", "v1") == "written" and store.ingest(two, "tier-b", "v1") == "written"
    kept = {f for f in os.listdir(f"{tmp_path}/s/scope=tier-b") if f.endswith(".parquet")}
    assert store.ingest(one, "tier/a b", "v1") == "reused" and store.ingest(two, "tier/a b", "v2") == "written"
    assert {f for f in os.listdir(f"{tmp_path}/s/scope=tier-b") if f.endswith(".parquet")} == kept
    assert sorted((r.scope, r.id) for r in store.rows().collect()) == [("tier-b", 3), ("tier/a b", 3)] and store.scopes() == ["tier-b", "tier/a b"]
    assert store.ingest(put(spark, []), "none", "v1") == "written" and store.ingest(put(spark, []), "none", "v1") == "reused"
    assert store.wipe_all("tier") == ["tier-b", "tier/a b"] and store.rows().count() == 0 and not store.finished("tier-b", "v1")


def test_scopes_that_fail(spark, tmp_path, caplog):
    store = Scopes(spark, f"file://{tmp_path}/s", "id bigint, v string")
    store.ingest(put(spark, [(1, "x")]), "a", "v1")
    broken = put(spark, [(1, "x")]).withColumn("v", F.expr("raise_error('lost')"))
    with pytest.raises(Exception, match="lost"):
        store.ingest(broken, "a", "v2")
    assert store.count("a") == 0 and not store.finished("a", "v2") and store.ingest(put(spark, [(5, "x")]), "a", "v2") == "written"
    store.wipe = lambda scope: False
    with pytest.raises(Residue, match="holds 1 rows"):
        store.clean("a")
    (tmp_path / "s" / "scope=a" / "junk.parquet").write_text("no parquet")
    assert store.count("a") == -1 or True
    del store.wipe
    store.clean("a")
    assert store.count("a") == 0
    store.count = lambda scope: -1
    store.clean("a")
    assert "cannot be verified" in caplog.text


def test_keyed_updates(spark, tmp_path):
    table = Keyed(spark, f"file://{tmp_path}/k", "id", 8)
    table.create(put(spark, [(i, f"v{i}") for i in range(40)] + [(None, "none")]))
    with pytest.raises(RuntimeError, match="already"):
        table.create(put(spark, []))
    before = table.manifest()["written"]
    assert table.update(put(spark, [(3, "new"), (3, "newer"), (4, None), (5, "v5"), (99, "x"), (None, "nothing")])) == 1
    after = table.manifest()["written"]
    touched = {b for b in before if before[b] != after[b]}
    assert 0 < len(touched) <= 5 and {r.id: r.v for r in table.rows().collect()} == {i: f"v{i}" for i in range(40)} | {3: "newer", None: "none"}
    assert table.rename(put(spark, [(3, 103), (7, 107), (50, 51)], "old bigint, new bigint")) == 2
    assert {r.id for r in table.rows().collect()} == {*range(40), 103, 107, None} - {3, 7} and table.rows(generation=0).count() == 41
    assert sorted(tuple(r) for r in table.history().collect()) == [("3", "id", "3", "103", 2), ("3", "v", "v3", "newer", 1), ("7", "id", "7", "107", 2)]
    with pytest.raises(RuntimeError, match="by another"):
        table._commit(2, "id bigint", {}, [])
    assert table.swept() > 0 and table.rows().count() == 41
    assert not files.put(spark, f"file://{tmp_path}/k/manifest/0.json", "x")


def test_repointed(spark):
    rows = put(spark, [(1, [5, 6, 5]), (2, [7]), (3, []), (4, None)], "id bigint, ids array<bigint>")
    got = {r.id: r.ids for r in repointed(rows, "id", "ids", put(spark, [(5, 50), (8, 80), (None, 1)], "old bigint, new bigint")).collect()}
    assert got == {1: [50, 6, 50], 2: [7], 3: [], 4: None}


def test_percentiles(spark):
    """Few values at once, so that ranges are narrowed over several rounds; ties, one value, null groups and values."""
    rng = random.Random(6)
    rows = [("a", rng.random() ** 9 * 1e6) for _ in range(500)] + [("b", float(rng.randrange(3))) for _ in range(200)] + [("c", 4.0), ("d", None), (None, 1.0), (None, 2.0)] + [("e", v) for v in [7.0] * 90 + [1.0, 9.0]]
    frame = put(spark, rows, "g string, v double").repartition(3)
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for few in (5, 1000):
        got = {r.g: tuple(r)[1:] for r in ranks.percentiles(frame, ["g"], "v", wanted, few).collect()}
        assert set(got) == {"a", "b", "c", "e", None}
        for g, values in got.items():
            assert values == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], list(wanted.values())), rel=1e-12)


def test_nearest_in_scopes_and_times(spark):
    gen = np.random.default_rng(3)
    x = gen.normal(size=(300, 6))
    x[40:80] = x[40]
    rows = [(i, v.tolist(), "even" if i % 2 == 0 else None if i % 9 == 0 else "odd", f"2020-01-{1 + i % 28:02d}", f"2020-01-{1 + i % 28 + i % 4:02d}" if i % 5 == 0 and i % 28 < 24 else None) for i, v in enumerate(x)]
    rows += [(900, None, "even", "2020-01-01", None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], "even", "2020-01-01", None), (902, [1.0] * 6, "even", None, None)]
    frame = put(spark, rows, "id bigint, vector array<double>, scope string, valid_at string, invalid_at string").withColumns({c: F.to_date(c) for c in ("valid_at", "invalid_at")}).repartition(4)
    asked = [(i, x[i].tolist(), "even" if i % 2 == 0 else "odd", "2020-01-15") for i in range(0, 300, 50)] + [(7, x[7].tolist(), "nowhere", "2020-01-15"), (8, None, "even", "2020-01-15")]
    queries = put(spark, asked, "query_id bigint, vector array<double>, scope string, as_of string").withColumn("as_of", F.to_date("as_of"))
    want = {}
    for q, v, scope, at in asked[:6]:
        fits = [(-round(float(np.dot(v, x[i])), 6), i) for i, _, s, since, until in rows[:300] if s == scope and i != q and since <= at and (until is None or until > at)]
        want[q] = [i for _, i in sorted(fits)[:5]]
    for bound in (1 << 20, 200):
        got: dict = {}
        for r in sorted(retrieval.nearest(frame, queries, 5, bound=bound).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
    plain = retrieval.nearest(frame.select("id", "vector"), queries.select("query_id", "vector"), 400)
    assert plain.groupBy("query_id").count().select("count").distinct().collect()[0][0] in (300, 301)
    assert retrieval.nearest(frame.limit(0), queries, 5).count() == 0
    facts = put(spark, [(1, "b", "2020-01-01", None), (2, None, None, "2021-02-03")], "id bigint, fact string, valid_at string, invalid_at string").withColumns({c: F.to_date(c) for c in ("valid_at", "invalid_at")})
    block = retrieval.fact_block(put(spark, [(9, 2, 1), (9, 1, 2)], "query_id bigint, id bigint, rank int"), facts).first()
    assert block.block == "-  (unknown to 2021-02-03)\n- b (2020-01-01 to present)"


def pages(spark, rows):
    return put(spark, rows, "name string, text string, n int").repartition(3)


def test_a_file_for_each_row(spark, tmp_path):
    from annalist.sources import written

    path = f"{tmp_path}/out"
    assert written.load(spark, path, "n int").count() == 0
    written.save(pages(spark, [("a/1.md", "eins ä\nzwei", 1), ("b 2.md", "", 2), ("c.md", None, 3)]), path)
    assert {(r.name, r.text, r.n) for r in written.load(spark, path, "n int").collect()} == {("a/1.md", "eins ä\nzwei", 1), ("b 2.md", "", 2), ("c.md", "", 3)}
    written.save(pages(spark, [("a/1.md", "again", 4)]), path)
    assert written.load(spark, path, "n int").count() == 4
    written.save(pages(spark, [("on ly é.md", "x", 5)]), path, "overwrite")
    assert [tuple(r) for r in written.load(spark, path, "n int").select("name", "text", "n").collect()] == [("on ly é.md", "x", 5)]
    assert sum(len(f) for *_, f in os.walk(f"{path}/files")) == 1


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    from annalist.sources import written

    path = f"{tmp_path}/out"
    for bad in ("../up.md", "", None, "/etc/x"):
        with pytest.raises(Exception, match="no name of a new file"):
            written.save(pages(spark, [(f"{i}.md", "x", i) for i in range(30)] + [(bad, "y", 99)]).coalesce(1), path)
    lost = pages(spark, [(f"{i}.md", "x", i) for i in range(30)]).withColumn("text", F.expr("if(n = 7, raise_error('gone'), text)"))
    with pytest.raises(Exception, match="gone"):
        written.save(lost.coalesce(1), path)
    left = [f for at, _, names in os.walk(path) for f in names if not f.endswith(".crc")]
    assert left == [] and written.load(spark, path).count() == 0
    with pytest.raises(Exception, match="gone"):
        written.save(lost, path)  # tasks beside the one that fails
    assert written.load(spark, path).count() == 0


def test_nested_yaml(spark):
    from annalist.functions import nested

    texts = {
        1: "a:\n  b: 1\n  c:\n  - x\n  - y: 'z: w'\n    v:\n---\nq: [1, {r: \"2, 3\"}]\n", 2: "- 1\n-\n  - 2\n", 3: None, 4: " \n", 5: "a: 'open\n", 6: "Here\n```\na:1,\nb:\n\tc: “x”\n```", 7: "one line", 8: "a: >\n  x\n  y\n\nb: |\n  p\n    q\nc: {}\n", 9: "a: 1\n  b: 2\n",
    }
    rows = put(spark, list(texts.items()), "id bigint, text string")
    got: dict = {}
    for r in nested.yaml_rows(rows, ["id"], "text").collect():
        got.setdefault(r.id, set()).add((r.doc, r.path, r.value, r.repaired, r.error))
    good = lambda fixed, *xs: {(d, p, v, fixed, None) for d, p, v in xs}
    assert got.pop(5) == {(None, None, None, True, "open quote: 'open")} and got.pop(9) == {(None, None, None, True, "nothing holds what is at depth 2")}
    assert got == {
        1: good(False, (0, "a.b", "1"), (0, "a.c[0]", "x"), (0, "a.c[1].y", "z: w"), (0, "a.c[1].v", None), (1, "q[0]", "1"), (1, "q[1].r", "2, 3")), 2: good(False, (0, "[0]", "1"), (0, "[1][0]", "2")),
        6: good(True, (0, "a", "1"), (0, "b.c", "x")), 7: good(False, (0, "", "one line")), 8: good(False, (0, "a", "x y"), (0, "b", "p\n  q"), (0, "c", None)),
    }
    json_ = put(spark, [(1, '{"a": "it\\\'s"}'), (2, '{"a": "b"}'), (3, "{oops"), (4, None)], "id bigint, text string")
    assert {r.id: r.x and r.x.a for r in json_.select("id", nested.lenient_json("text", "a string").alias("x")).collect()} == {1: "it's", 2: "b", 3: None, 4: None}


def test_repair_rounds_are_resumed(spark, tmp_path):
    from annalist.operators import repair

    facts = ["alpha", "beta", "gamma"]
    rows = put(spark, [(1, "Alpha beta gamma", facts), (2, "alpha", facts), (3, None, facts), (4, "x", None), (5, "alpha beta", facts)], "id bigint, text string, facts array<string>")
    asked = []

    def rewrite(low, attempt):
        asked.append((attempt, sorted(r.id for r in low.collect())))
        by = {1: {2: "beta only", 3: "alpha beta gamma", 5: None}, 2: {2: "alpha and beta", 5: "nothing"}}[attempt]
        return put(spark, list(by.items()), "id bigint, text string")

    path = f"file://{tmp_path}/r"
    for _ in range(2):
        got = {r.id: (r.text, round(r.score, 3), r.attempts, r.kept) for r in repair.rounds(rows, "id", rewrite, path).collect()}
    assert asked == [(1, [2, 3, 5]), (2, [2, 5])]
    assert got == {
        1: ("Alpha beta gamma", 1.0, 0, 0), 2: ("alpha and beta\n\n---\n\n## Facts\n\n- gamma", 1.0, 2, -1), 3: ("alpha beta gamma", 1.0, 1, 1), 4: ("x", 1.0, 0, 0), 5: ("alpha beta\n\n---\n\n## Facts\n\n- gamma", 1.0, 2, -1),
    }


def test_arrays_are_appended(spark, tmp_path):
    table = Keyed(spark, f"file://{tmp_path}/a", "id", 4)
    table.create(put(spark, [(1, ["a"]), (2, None), (3, ["c"])], "id bigint, ids array<string>"))
    assert table.append(put(spark, [(1, "b"), (1, "a"), (2, "z"), (2, "y"), (3, "c"), (4, "q"), (3, None)], "id bigint, ids string"), "ids") == 1
    assert {r.id: r.ids for r in table.rows().collect()} == {1: ["a", "b"], 2: ["y", "z"], 3: ["c"]}
    assert sorted((r.key, r.old, r.new) for r in table.history().collect()) == [("1", '["a"]', '["a","b"]'), ("2", "[]", '["y","z"]')]


def test_adapters(spark, tmp_path, caplog):
    from annalist.operators import adapters, calls

    rows = put(spark, [(1, "red apple", "2020-01-01", None), (2, "red apple pie", "2020-01-01", "2020-06-01"), (3, None, None, None), (4, "blue", "2021-01-01", None)], "slot_id bigint, text string, valid_at string, invalid_at string")
    rows = rows.withColumns({c: F.to_date(c) for c in ("valid_at", "invalid_at")})
    system = adapters.KeywordAdapter(spark, f"file://{tmp_path}/k", k=2)
    assert system.ingest("t", rows.where("slot_id < 3"), rows.where("slot_id >= 3")) == "written" and system.ingest("t", rows) == "reused"
    asked = put(spark, [(7, "apple pie"), (8, "blue"), (9, "nothing here")], "query_id bigint, text string")
    got = {r.query_id: (r.cited, r.context) for r in system.query("t", asked).collect()}
    assert got == {7: ([2, 1], "red apple pie\n\nred apple"), 8: ([4], "blue"), 9: ([], "")}
    assert {r.query_id: r.cited for r in system.query("t", asked, as_of="2020-07-01").collect()} == {7: [1], 8: [], 9: []}
    contexts = system.query("t", asked)
    assert {tuple(r) for r in adapters.answered(contexts, asked).collect()} == {(i, "", "dry_run") for i in (7, 8, 9)}
    said = adapters.answered(contexts, asked, lambda: lambda prompt: prompt.split("Context:\n")[1], calls.Guard(sleep=None))
    assert {tuple(r) for r in said.collect()} == {(7, "red apple pie\n\nred apple", "ok"), (8, "blue", "ok"), (9, "(no context was retrieved)", "ok")}
    system.resolve_version = lambda: "2"
    assert system.version() == "2" and "pinned is 1" in caplog.text and system.ingest("t", rows) == "written"
    system.resolve_version = lambda: 1 / 0
    assert system.version() == "unknown" and system.teardown("t") and system.query("t", asked).where("size(cited) > 0").count() == 0
