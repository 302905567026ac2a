"""Closures whose strongly connected groups count as one node."""

import random

import pytest

from graphloom import PropertyGraph
from graphloom.operators import reach


def walked(edges, starts, least):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    pairs = set()
    for s in starts:
        ends = {s}
        for _ in range(least):
            ends = set().union(*(after.get(x, ()) for x in ends))
        todo, seen = list(ends), set(ends)
        while todo:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        pairs |= {(s, e) for e in seen}
    return pairs


@pytest.fixture
def grouping(monkeypatch):
    monkeypatch.setattr(reach, "PLAIN_PAIRS", -1)
    monkeypatch.setattr(reach, "BLOCK", 2)


def test_closure_by_groups(spark, grouping):
    rng = random.Random(1)
    # A cycle, a ring within reach of it, a way out, loose ends, loops, and what nothing leads to; repeated edges.
    edges = [(i, (i + 1) % 5) for i in range(5)] + [(10, 11), (11, 12), (12, 10), (3, 10), (12, 20), (20, 21), (30, 0), (31, 30), (40, 40), (21, 21), (3, 10)]
    edges += [(rng.randrange(45), rng.randrange(45)) for _ in range(12)]
    ids = list(range(45))
    graph = PropertyGraph(spark).add_nodes("P", spark.createDataFrame([(i, i % 3) for i in ids], "pid bigint, k bigint"), "pid")
    graph = graph.add_edges("K", spark.createDataFrame(edges, "a bigint, b bigint"), "P", "a", "P", "b")
    for least, text in ((0, "*0.."), (2, "*2..")):
        got = [tuple(r) for r in graph.query(f"MATCH (a:P {{k: 1}})-[:K{text}]->(b) RETURN a.pid, b.pid, b.k").collect()]
        assert sorted(got) == sorted((a, b, b % 3) for a, b in walked(edges, [i for i in ids if i % 3 == 1], least))
    both = [tuple(r) for r in graph.query("MATCH (a:P)-[:K]->(b:P)-[:K*]->(a) RETURN DISTINCT a.pid, b.pid").collect()]
    back = walked(edges, ids, 1)
    assert sorted(both) == sorted({(a, b) for a, b in edges if (b, a) in back})


def test_closure_across_labels(spark, grouping):
    names = spark.createDataFrame([(i,) for i in range(4)], "i bigint")
    graph = PropertyGraph(spark).add_nodes("A", names, "i").add_nodes("B", names, "i")
    graph = graph.add_edges("R", spark.createDataFrame([(0, 0), (1, 1)], "x bigint, y bigint"), "A", "x", "B", "y")
    graph = graph.add_edges("R", spark.createDataFrame([(0, 1), (1, 0), (1, 3)], "x bigint, y bigint"), "B", "x", "A", "y")
    got = {(r["a"], r["b"], r["l"][0]) for r in graph.query("MATCH (a:A)-[:R*]->(b) RETURN id(a) AS a, id(b) AS b, labels(b) AS l").collect()}
    assert got == {(s, e, k) for s in (0, 1) for e, k in ((0, "A"), (1, "A"), (3, "A"), (0, "B"), (1, "B"))}


def test_closure_writes_no_pairs_of_a_group(spark, monkeypatch):
    from graphloom.sources.tables import table_graph

    monkeypatch.setattr(reach, "PLAIN_PAIRS", -1, raising=False)
    written, write = [], reach.persisted

    def counted(df):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(reach, "persisted", counted)
    got = table_graph(spark, "/root/testdata/sf0.001").query("MATCH (a:Customer)-[:KNOWS*]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b")
    assert got.count() == 22_500 and sum(written) < 5_000
