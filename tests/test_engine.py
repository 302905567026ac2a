"""Loading, changes, sinks, plans and the semantics of small graphs, against answers worked out by hand."""

import csv
import io
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom import AnalysisError, Editor, GraphError, GraphSession, LexError, ParseError, PropertyGraph, create_session, execute_query, register
from graphloom.plans import inspection, parser
from graphloom.plans.compiler import compiled
from graphloom.sources import results

NODES = [
    {"id": 1, "name": "A", "n": 1, "flag": True, "tags": ["x", "y"], "_labels": ["P"]},
    {"id": 2, "name": "B", "n": -7, "flag": False, "_labels": ["P"]},
    {"id": 3, "name": "C", "_labels": ["P"]},
    {"id": 4, "name": "D", "n": 4, "city": "Q", "_labels": ["C"]},
    {"name": "no id"},
]
EDGES = [(1, "K", 2, {"w": 5}), (2, "K", 3, {"w": 7}), (3, "K", 1), (1, "M", 3), (1, "IN", 4, {"w": 1}), (1, "K", 2, {"u": "z"})]


@pytest.fixture(scope="module")
def g(spark):
    return PropertyGraph.from_lists(spark, NODES, EDGES)


def got(g, text, **params):
    return sorted((tuple(r) for r in g.query(text, **params).collect()), key=repr)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("MATCH (a:P) RETURN a.NAME AS x", [("A",), ("B",), ("C",)]),
        ("MATCH (a:P {Name: 'A'}) RETURN a.name", [("A",)]),
        ("MATCH (a) WHERE a.name IN [1, 2] RETURN a.name", []),
        ("MATCH (a) WHERE a.name IN ['A', 3, null] RETURN a.name", [("A",)]),
        ("MATCH (a) WHERE NOT a.name IN ['A', 'B'] RETURN a.name", [("C",), ("D",)]),
        ("MATCH (a) WHERE a.n IN [1, 4.0] RETURN a.name", [("A",), ("D",)]),
        ("MATCH (a:P) WHERE 'x' IN a.tags RETURN a.name", [("A",)]),
        ("MATCH (a) WHERE a.name IN $xs RETURN a.name", [("B",)]),
        ("MATCH (a:P) RETURN a.name AS k, a.flag AND a.n > 0 AS b, a.flag OR a.n > 0 AS c", [("A", True, True), ("B", False, False), ("C", False, False)]),
        ("MATCH (a:P) WHERE a.flag = true RETURN a.name", [("A",)]),
        ("MATCH (a:P) WHERE a.flag XOR a.n < 0 RETURN a.name", [("A",), ("B",)]),
        ("MATCH (a:P) RETURN a.name, CASE WHEN a.n > 0 THEN 'up' WHEN a.n < 0 THEN 'down' ELSE 'none' END AS c", [("A", "up"), ("B", "down"), ("C", "none")]),
        ("MATCH (a:P) RETURN CASE a.name WHEN 'A' THEN 1 END AS c", [(1,), (None,), (None,)]),
        ("UNWIND [3, 1, 2] AS x RETURN x + 1 AS y", [(2,), (3,), (4,)]),
        ("MATCH (a:P) UNWIND a.tags AS t RETURN a.name, t", [("A", "x"), ("A", "y")]),
        ("MATCH (a:P) RETURN a.name AS x LIMIT 1 SKIP 1 ORDER BY x DESC", [("B",)]),
        ("MATCH (a:P) WHERE a.n IS NOT NULL RETURN a.n % 3 AS m, a.n / 0 AS z", [(1, None), (2, None)]),
        ("MATCH (a:P) WHERE a.n IS NOT NULL RETURN a.n % -3 AS m", [(-1,), (-2,)]),
        ("MATCH (a {name: 'A'})-[r:K]->(b) RETURN r.w, r.u, type(r) AS t, b.name", [(5, "z", "K", "B")]),
        ("MATCH (a)-[r {w: 7}]->(b) RETURN a.name, b.name", [("B", "C")]),
        ("MATCH (a:P) WHERE size((a)-[:K]->()) + size((a)-[:M]->()) > 1 RETURN a.name", [("A",)]),
        ("MATCH (a:P) RETURN a.name, size((a)--()) AS d, EXISTS((a)-[:IN]->()) AS e", [("A", 4, True), ("B", 2, False), ("C", 3, False)]),
        ("MATCH (a:P) WHERE EXISTS((a)-[:IN]->()) AND EXISTS((a)-[:M]->()) RETURN a.name", [("A",)]),
        ("MATCH (a:P), (b:P) WHERE a <> b AND a.name < b.name RETURN a.name, b.name", [("A", "B"), ("A", "C"), ("B", "C")]),
        ("OPTIONAL MATCH (x:Nothing) RETURN x.name AS n, 1 AS one", [(None, 1)]),
        ("MATCH (a {name:'A'}) OPTIONAL MATCH (a)-[:K]->(b), (b)-[:M]->(c) RETURN a.name, b.name, c.name", [("A", None, None)]),
        ("MATCH (a {name:'A'}) OPTIONAL MATCH (a)-[:K]->(b), (b)-[:K]->(c) RETURN a.name, b.name, c.name", [("A", "B", "C")]),
        ("MATCH (a {name:'A'}), (d:C) OPTIONAL MATCH (a)-[:K]->(b), (c)-[:IN]->(d) RETURN b.name, c.name, d.name", [("B", "A", "D")]),
        ("MATCH (a {name:'A'})-[:K*0..2]->(b) RETURN b.name", [("A",), ("B",), ("C",)]),
        ("MATCH (a {name:'A'})-[:K*2..2]->(b) RETURN b.name", [("C",)]),
        ("MATCH (a {name:'A'})-[:K*2..4]->(b) RETURN b.name", [("A",), ("B",), ("C",)]),
        ("MATCH (a {name:'D'})<-[*]-(b) RETURN b.name", [("A",), ("B",), ("C",)]),
        ("MATCH (a {name:'B'})-[:K*3..]->(b) RETURN b.name", [("A",), ("B",), ("C",)]),
        ("MATCH (a:P) RETURN avg(a.n) AS m, collect(a.flag) AS f, count(a.n) AS c", [(-3.0, [True, False], 2)]),
        ("MATCH (a {name:'D'}) RETURN a.name AS n UNION MATCH (a) WHERE a.n = 4 RETURN a.name AS n", [("D",)]),
    ],
)
def test_answers(g, query, want):
    assert got(g, query, **({"xs": ["B", 9]} if "$xs" in query else {})) == want


def test_entities(g):
    row = g.query("MATCH (a:P)-[r:K {w: 7}]->(b) RETURN a, r").first()
    (star,) = g.query("MATCH (a:P)-[:IN]->(c) RETURN *").collect()
    assert star["c"]["id"] == 4 and star["a"]["labels"] == ["P"] and star["c"]["properties"]["city"] == "Q"
    assert row["a"]["id"] == 2 and row["a"]["properties"]["name"] == "B"
    assert (row["r"]["id"], row["r"]["type"], row["r"]["source"], row["r"]["target"], row["r"]["properties"]["w"]) == ("2_K_3", "K", 2, 3, 7)


def test_node_without_properties_and_multi_type_column(spark):
    g = PropertyGraph.from_lists(spark, [{"id": "a", "_labels": ["X"]}, {"id": "b", "v": 1, "_labels": ["Y"]}, {"id": "c", "v": "t", "_labels": ["Z"]}])
    assert got(g, "MATCH (n) RETURN id(n) AS i, n.v AS v") == [("a", None), ("b", "1"), ("c", "t")]


def test_reload_puts_properties_over(spark):
    g = PropertyGraph.from_lists(spark, [{"id": 1, "x": 1, "y": 1, "_labels": ["P"]}, {"id": 1, "y": 2}])
    assert got(g, "MATCH (a:P) RETURN a.x, a.y") == [(1, 2)]


def test_adjacency_and_relationship_scan(g):
    m = g.add_adjacency({"adjacency": {(1, 2): True, (2, 3): 0}, "GRID": [[0, 0, 0, 0], [0, 0, 0, 1]]}, "P")
    assert got(m, "MATCH (a)-[:ADJACENT|GRID]->(b) RETURN a.name, b.name") == [("A", "B"), ("A", "C")]
    assert sorted((r.source, r.target) for r in g.relationship_scan("K").collect()) == [(1, 2), (2, 3), (3, 1)]
    assert [(r.source, r.type) for r in g.relationship_scan(w=7).collect()] == [(2, "K")]
    assert g.relationship_scan("NONE").count() == 0 and g.relationship_scan("M", w=7).count() == 0


@pytest.mark.parametrize("stated", [True, False])
def test_random_graphs_against_all_walks(spark, stated):
    """Chains, cycles and column-stated relationships against a search over all tuples of nodes."""
    rng = random.Random(5)
    people = [(i, rng.choice("xyz"), rng.choice([0, 1, 2, None])) for i in range(9)]
    teams = [(i, f"t{i}") for i in range(3)]
    knows = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(20)})
    p = spark.createDataFrame(people, "pid int, kind string, team int")
    graph = PropertyGraph(spark).add_nodes("P", p, "pid").add_nodes("T", spark.createDataFrame(teams, "tid bigint, nm string"), "tid")
    graph = graph.add_edges("K", spark.createDataFrame(knows, "a int, b int"), "P", "a", "P", "b", trusted=stated)
    if stated:
        graph = graph.add_column_edges("IN", "P", "team", "T", trusted=True)
    else:
        graph = graph.add_edges("IN", p.select("pid", "team").where("team is not null"), "P", "pid", "T", "team")
    of = {i: t for i, _, t in people}
    kind = {i: k for i, k, _ in people}
    assert got(graph, "MATCH (a:P)-[:IN]->(t:T) RETURN a.pid, t.nm") == sorted(((i, f"t{t}") for i, t in of.items() if t is not None), key=repr)
    assert got(graph, "MATCH (t:T)<-[r:IN]-(a:P) RETURN id(t) AS t, id(a) AS a, type(r) AS r") == sorted(((t, i, "IN") for i, t in of.items() if t is not None), key=repr)
    assert got(graph, "MATCH (a:P)-[:IN]->(t)<-[:IN]-(b:P)-[:K]->(a) RETURN a.pid, b.pid") == sorted(((a, b) for b, a in knows if of[a] is not None and of[a] == of[b]), key=repr)
    assert got(graph, "MATCH (a:P)-[:K]->(b)-[:K]->(c {kind: 'x'}) WHERE a.kind <> 'x' RETURN a.pid, c.pid") == sorted(((a, d) for (a, b), (c, d) in itertools.product(knows, knows) if b == c and kind[d] == "x" and kind[a] != "x"), key=repr)
    assert got(graph, "MATCH (a:P)-[:K]->(a) RETURN a.pid") == sorted(((a,) for a, b in knows if a == b), key=repr)
    assert got(graph, "MATCH (a:P)-[:K]-(b) RETURN a.pid, b.pid") == sorted({x for a, b in knows for x in ((a, b), (b, a))}, key=repr)
    assert got(graph, "MATCH ()-[:K]->() RETURN count(*) AS n") == [(len(knows),)]
    assert got(graph, "MATCH (b)<-[:K]-(a)-[:IN]->(t {nm: 't1'}) RETURN count(b) AS n") == [(sum(of[a] == 1 for a, _ in knows),)]
    reach = {i: {j for a, j in knows if a == i} for i in of}
    two = {i: set().union(*(reach[j] for j in reach[i])) for i in of}
    assert got(graph, "MATCH (a:P)-[:K*1..2]->(b) RETURN a.pid, b.pid") == sorted(((i, j) for i in of for j in reach[i] | two[i]), key=repr)
    assert got(graph, "MATCH (a:P)-[:K*0..1]->(b) RETURN id(a) AS a, id(b) AS b") == sorted(((i, j) for i in of for j in reach[i] | {i}), key=repr)
    closure = {i: set(s) for i, s in reach.items()}
    for _ in of:
        closure = {i: s.union(*(reach[j] for j in s)) for i, s in closure.items()}
    assert got(graph, "MATCH (a:P)-[:K*]->(b) RETURN a.pid, b.pid") == sorted(((i, j) for i in of for j in closure[i]), key=repr)


def test_elision_reads_no_node_table(spark):
    from graphloom.sources.tables import table_graph

    graph = table_graph(spark, "/root/testdata/sf0.001")

    def scans(text):
        return graph.query(text)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")

    assert scans("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, o.o_orderkey AS o") == 1
    assert scans("MATCH (o:Order)<-[:PLACED]-(c:Customer) RETURN c.c_name AS c, o.o_orderkey AS o") == 2
    assert scans("MATCH ()-[l:CONTAINS]->() RETURN sum(l.l_quantity) AS q") == 1
    assert scans("MATCH (c:Customer)-[:LIVES_IN]->(n)-[:IN_REGION]->(r) RETURN c.c_custkey AS c, r.r_name AS r") == 3
    plan = graph.query("MATCH (o:Order) WHERE o.o_orderpriority IN ['1-URGENT', '2-HIGH'] AND o.o_totalprice > 5 RETURN o.o_orderkey AS k")._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderpriority" in plan and "GreaterThan(o_totalprice" in plan and "o_comment" not in plan


def test_long_paths_have_a_plan_in_proportion(g):
    joins = [g.query(f"MATCH (a:P)-[:K*1..{n}]->(b) RETURN b.name")._jdf.queryExecution().optimizedPlan().toString().count("Join ") for n in (3, 6, 9)]
    assert joins[2] - joins[1] == joins[1] - joins[0] <= 6


def test_editor(g):
    e = Editor(g)
    assert e.create_node({"name": "E", "_labels": ["P"]}) == 5
    assert e.create_nodes([{"id": 9, "name": "F", "_labels": ["Q"]}, {"id": 3, "name": "CC", "_labels": ["P"]}]) == [9, 3]
    assert e.create_edge(5, 9, "K", {"w": 2}) == "5_K_9" and e.create_edges([(9, "NEW", 1)]) == ["9_NEW_1"]
    assert got(e.graph, "MATCH (a)-[r:K]->(b:Q) RETURN a.name, r.w, b.name") == [("E", 2, "F")]
    assert got(e.graph, "MATCH (a {id: 3}) RETURN a.name, a.n") == [("CC", None)]
    assert e.update_node(2, {"name": "BB", "new": 1}) and not e.update_node(77, {"name": "x"})
    assert got(e.graph, "MATCH (a:P) WHERE a.new = 1 RETURN a.name") == [("BB",)]
    assert e.update_edge(2, "K", 3, {"w": 70}) and not e.update_edge(2, "K", 1, {"w": 1})
    assert got(e.graph, "MATCH ({id: 2})-[r:K]->() RETURN r.w") == [(70,)]
    assert e.update_node(2, {"_labels": ["R"]})
    assert got(e.graph, "MATCH (a:P)-[:K]->(b:R)-[:K]->(c:P) RETURN a.name, b.name, c.name") == [("A", "BB", "CC")]
    assert e.delete_edge(1, "M", 3) and not e.delete_edge(1, "M", 3)
    assert e.delete_node(1) and not e.delete_node(1)
    assert got(e.graph, "MATCH (a)-[r]->(b) RETURN a.name, type(r) AS t, b.name") == [("BB", "K", "CC"), ("E", "K", "F")]
    with pytest.raises(GraphError):
        e.create_edge(1, 5, "K")
    assert e.statistics == {"nodes_created": 3, "edges_created": 2, "nodes_updated": 2, "edges_updated": 1, "nodes_deleted": 1, "edges_deleted": 1}
    e.reset_statistics()
    assert not any(e.statistics.values())
    assert got(g, "MATCH (a:P) RETURN a.name") == [("A",), ("B",), ("C",)]


def test_changes_follow_column_edges(spark):
    p = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "pid bigint, team bigint")
    g = PropertyGraph(spark).add_nodes("P", p, "pid").add_nodes("T", spark.createDataFrame([(10,), (20,)], "tid bigint"), "tid").add_column_edges("IN", "P", "team", "T", trusted=True)
    text = "MATCH (a:P)-[:IN]->(t:T) RETURN id(a) AS a, id(t) AS t"
    assert got(g, text) == [(1, 10), (2, 20)]
    assert got(g.without_nodes("T", "tid = 10"), text) == [(2, 20)]
    assert got(g.without_nodes("P", "pid = 2"), text) == [(1, 10)]
    assert got(g.set_property("P", "team", "20", "pid = 3"), text) == [(1, 10), (2, 20), (3, 20)]
    assert got(g.set_property("P", "team", "99", "pid = 3"), text) == [(1, 10), (2, 20)]


def test_sinks(spark, g, tmp_path):
    s = GraphSession(spark, g)
    out = s.execute("MATCH (a) RETURN a.name AS name, a.n AS n, a.tags AS tags ORDER BY name")
    assert out.success and out.data.to_dict_records()[0] == {"name": "A", "n": 1, "tags": ["x", "y"]}
    assert json.loads(out.data.to_json(2))["columns"] == ["name", "n", "tags"]
    rows = list(csv.reader(io.StringIO(out.data.to_csv())))
    assert rows[1] == ["A", "1", '["x", "y"]'] and rows[3] == ["C", "", ""] and '"A"' in out.data.to_csv()
    assert out.data.to_table(5).splitlines()[2].startswith('A    | 1    | ["x"…')
    results.write_csv(out.data.df, str(tmp_path / "c"))
    results.write_json(out.data.df, str(tmp_path / "j"))
    results.write_parquet(out.data.df, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.csv(str(tmp_path / "c"), header=True).count() == spark.read.parquet(str(tmp_path / "p")).count() == 4


def test_session(spark):
    with create_session(spark, NODES, EDGES, slow_seconds=9.0) as s:
        s.load([{"id": 50, "name": "new", "_labels": ["P"]}, {"name": "skipped"}], [(50, "K", 1)], {"LINK": {(50, 1): 1}}, "P")
        assert [tuple(r) for r in s.cypher("MATCH (a {id: $i})-[:K]->(b) RETURN b.name", i=50).collect()] == [("A",)]
        bad = s.execute("MATCH (a RETURN a")
        assert not bad.success and "line 1" in bad.error
        s.cache()
        stats = s.stats()
        assert stats["nodes"] == {"P": 4, "C": 1} and stats["edges"]["K"] == 4 and stats["queries"] == 1 and stats["failures"] == 1
        s.clear_cache()
    assert execute_query(spark, "MATCH (n:P) RETURN n.name ORDER BY n.name", NODES, EDGES).data.data == [["A"], ["B"], ["C"]]


def test_plans():
    text = "MATCH (a:P {name: 'x'})-[r:K|M*1..3]->(b), (b)-->(c) OPTIONAL MATCH (c)-[:Z]-(d) WHERE NOT EXISTS((d)-->(a)) AND size((a)--()) > 2 WITH a, count(*) AS n WHERE n > 1 RETURN DISTINCT a.name AS nm, n ORDER BY nm DESC SKIP 1 LIMIT 2 UNION RETURN 1 AS nm, 2 AS n"
    plan = inspection.planned(text)
    kinds = [x.operator for x in plan.walk()]
    assert kinds[:2] == ["Distinct", "UnionAll"] and {"VarExpand", "LeftJoin", "AntiJoin", "StructuralFilter", "Aggregate", "Skip", "Limit", "Sort", "Join", "OneRow"} <= set(kinds)
    assert inspection.variables(plan) == ["a", "b", "c", "d", "r"] and inspection.summary(plan)["joins"] >= 5
    assert "VarExpand (a:P {name: 'x'})-[r:K|M*1..3]->(b)" in plan.text()
    again = inspection.format_query(text)
    assert inspection.format_query(again) == again and parser.valid(again)


def test_text_and_errors(g):
    assert [t[0] for t in parser.tokens("MATCH (n) // c\n/* d */ RETURN 'x', $p, 1.5")] == ["name", "op", "name", "op", "name", "str", "op", "param", "op", "num"]
    assert parser.valid("MATCH (ü:`Straße x`) RETURN ü.`a b` AS `c d`") and parser.errors("MATCH (n)\nRETRN n")[0].startswith("line 2, column 1: ")
    for text, kind in [("RETURN ?", LexError), ("MATCH (n RETURN n", ParseError), ("x" * 60_000, ParseError), ("RETURN " + "(" * 150 + "1" + ")" * 150, ParseError), ("RETURN CASE 1 END", ParseError), ("MATCH (n) RETURN m.x", AnalysisError), ("RETURN $p", AnalysisError), ("UNWIND 3 AS x RETURN x", AnalysisError), ("MATCH (n) RETURN n.name - 1", AnalysisError)]:
        with pytest.raises(kind):
            compiled(g, text)
    assert got(g, "RETURN 'it\\'s \\u00fc' AS x, 2e3 AS y") == [("it's ü", 2000.0)]


def test_registered_function(g):
    register("Twice", lambda c: F.concat(c, c))
    assert got(g, "MATCH (a:C) RETURN twice(a.name) AS x") == [("DD",)]
    with pytest.raises(GraphError):
        register("count", F.count)
