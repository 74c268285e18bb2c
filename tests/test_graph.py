"""Reach by doubling, budgeted subgraphs and planted citations against plain walks."""

import random

from annalist.operators import graph


def walked(edges, start):
    """A depth-first walk that takes edges by ord and no node twice."""
    out, seen, stack = [], set(), [start]
    while stack:
        node = stack.pop()
        if node not in seen:
            seen.add(node)
            out.append(node)
            stack += [b for _, b in sorted(((o, b) for a, b, o in edges if a == node), reverse=True)]
    return out


def reached(spark, edges, starts):
    frame = spark.createDataFrame(edges, "a bigint, b bigint, ord bigint").repartition(3)
    rows = graph.reach(spark.createDataFrame([(x,) for x in starts], "start bigint"), frame, "test").collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.start, r.path, r.depth)):
        found.setdefault(r.start, []).append(r.node)
    return found


def test_reach_is_a_walk_in_order(spark):
    rng = random.Random(7)
    for case in range(3):
        n = 30
        edges = {(a, b): 0 for a, b in [(i, i + 1) for i in range(n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(12 * case)] if a < b}
        edges = [(a, b, i) for i, (a, b) in enumerate(sorted(edges, key=lambda _: rng.random()))]
        starts = list(range(0, n + 1, 3))
        assert reached(spark, edges, starts) == {s: walked(edges, s) for s in starts}


def test_reach_of_a_chain_of_5000_edges(spark):
    edges = [(i, i + 1, 5000 - i) for i in range(5000)] + [(100, 9000, 9000), (9000, 9001, 9001)]
    got = reached(spark, edges, [0, 4990, 9001])
    assert got == {0: [*range(5001), 9000, 9001], 4990: list(range(4990, 5001)), 9001: [9001]}


def test_reach_from_all_nodes_that_edges_lead_to(spark):
    """Without starts, also where edges go round."""
    rng = random.Random(11)
    edges = sorted({(a, b) for a, b in [(rng.randrange(25), rng.randrange(25)) for _ in range(60)] if a < b})
    edges = [(a, b, i) for i, (a, b) in enumerate(sorted(edges, key=lambda _: rng.random()))]
    frame = spark.createDataFrame(edges, "a bigint, b bigint, ord bigint")
    for more in ([], [(24, 3, 99), (3, 24, 100)]):  # the second way round is a cycle
        own = frame.unionByName(spark.createDataFrame(more, frame.schema))
        found = {}
        for r in sorted(graph.reach(None, own, "test").collect(), key=lambda r: (r.start, r.path, r.depth)):
            found.setdefault(r.start, []).append(r.node)
        assert found == {s: walked([*edges, *more], s) for s in {b for _, b, _ in [*edges, *more]}}


def test_walks_along_chains_with_merges(spark):
    """Jumps of exact lengths only: roots of every distance from the end, walks that merge, one that closes."""
    edges = [(i, i + 1) for i in range(13)] + [(100 + i, i) for i in range(0, 13, 3)] + [(50, 51), (51, 52), (52, 51)]
    following = dict(edges)
    want = {}
    for root in {a for a, _ in edges} - {b for _, b in edges}:
        path = [root]
        while path[-1] in following and following[path[-1]] not in path:
            path.append(following[path[-1]])
        want[root] = path
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.root: r.path for r in graph.chains(frame).collect()} == want
    assert {r.root: r.path for r in graph.chains(frame, 5).collect()} == {root: path[:6] for root, path in want.items()}


def test_ended_walks_are_left_behind(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "written", lambda df, what, f=graph.written: kept.append((what, f(df, what))) or kept[-1][1])
    monkeypatch.setattr(graph, "forget", lambda table: None)
    frame = spark.createDataFrame([(10 * i, 10 * i + 1) for i in range(50)] + [(1000 + i, 1001 + i) for i in range(5)], "a bigint, b bigint")
    graph.chains(frame).count()
    assert [t.count() for what, t in kept if what == "walks"] == [4, 2, 0]


def test_reach_with_cycles(spark):
    edges = [(1, 2, 1), (2, 3, 2), (3, 1, 3), (3, 4, 4), (7, 8, 5), (8, 7, 6)]
    assert reached(spark, edges, [1, 4, 5, 7]) == {1: [1, 2, 3, 4], 4: [4], 5: [5], 7: [7, 8]}
    assert reached(spark, edges[4:], [8]) == {8: [8, 7]}
    ring = [(i, (i + 1) % 6, i) for i in range(6)]
    assert reached(spark, ring, [9]) == {9: [9]}


def test_subgraph_against_a_plain_search(spark):
    rng = random.Random(3)
    n = 60
    edges = [(i, (i + 1) % n) for i in range(n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(15)]
    cost = {i: rng.randrange(0, 9) for i in range(n) if i != 17}
    seeds = [(q, rng.randrange(n)) for q in range(8) for _ in range(1 + q % 2)] + [(90, 5), (91, 17)]
    want = set()
    for q in {q for q, _ in seeds}:
        level, met, spent, depth = {x for p, x in seeds if p == q}, set(), 0, 0
        while level:
            full = False
            for x in sorted(level & set(cost)):
                spent += cost[x]
                if spent > 70:
                    full = True
                    break
                want.add((q, x, depth, spent))
            met |= level
            level, depth = set() if full else {b for a, b in edges if a in level & set(cost)} - met, depth + 1
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = graph.subgraph(frame(edges, "a int, b int"), frame(seeds, "query int, id int"), frame(list(cost.items()), "id int, cost int"), 70, every=4)
    assert {tuple(r) for r in got.collect()} == want and max(d for *_, d, _ in want) > 8


def test_planted_citations(spark):
    rng = random.Random(1)
    days = ["2020-01-05", "2020-01-05", "2020-01-20", "2020-02-01", "2021-07-01", "", None]
    events = [(i, rng.choice(days)) for i in range(40)]
    artefacts = [(rng.randrange(36), f"S{i}", rng.choice(["primary", "secondary", None]), i) for i in range(90)]
    edges = [(rng.randrange(40), rng.choice(["supersedes", "reverses", "contradicts"]), rng.randrange(44), i) for i in range(60)]
    at = dict(events)
    day = lambda e: (at[e] or "")[:10]
    want = set()
    for s, kind, t, _ in edges:
        if kind != "contradicts" and t in at:
            later = [(role != "secondary", o, slot) for e, slot, role, o in artefacts if day(e) > day(s) and e not in (s, t)]
            own = [(o, slot) for e, slot, _, o in artefacts if e == t]
            if later and own:
                want.add((s, t, min(own)[1], min(later)[2], len(later)))
    events_ = spark.createDataFrame(events, "id int, occurred_at string")
    got = graph.planted(spark.createDataFrame(edges, "source int, relation string, target int, ord int"), events_, spark.createDataFrame(artefacts, "event_id int, slot_id string, role string, ord int"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
