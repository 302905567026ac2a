"""Small graphs with known answers, and errors."""

import pytest

from graphloom import GraphError, PropertyGraph

# The people graph, and the answers below that follow from it.
PEOPLE = [("1", "Alice", 30, "Engineer"), ("2", "Bob", 25, "Designer"), ("3", "Charlie", 35, "Manager"), ("4", "Diana", 28, "Engineer"), ("5", "Eve", 22, "Intern"), ("6", "Frank", 45, "Director")]
LINKS = [("1", "KNOWS", "2"), ("1", "KNOWS", "4"), ("2", "KNOWS", "3"), ("2", "WORKS_WITH", "4"), ("3", "MANAGES", "1"), ("3", "MANAGES", "4"), ("4", "MENTORS", "5"), ("6", "MANAGES", "3")]


@pytest.fixture(scope="module")
def people(spark):
    return PropertyGraph.from_lists(spark, [{"id": i, "name": n, "age": a, "role": r, "_labels": ["Person"]} for i, n, a, r in PEOPLE], LINKS)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("MATCH (a:Person {name:'Alice'})-[:KNOWS]->(f) RETURN f.name, f.age", {("Bob", 25), ("Diana", 28)}),
        ("MATCH (a:Person {name:'Alice'})-[:KNOWS]->(f) WHERE f.age > 26 RETURN f.name, f.age", {("Diana", 28)}),
        ("MATCH (p:Person) WHERE p.role = 'Engineer' RETURN p.name, p.age, p.role", {("Alice", 30, "Engineer"), ("Diana", 28, "Engineer")}),
        ("MATCH (a {name:'Charlie'})-[:MANAGES]->(f) RETURN f.name", {("Alice",), ("Diana",)}),
        ("MATCH (a {name:'Alice'})-->()-->(f) RETURN f.name", {("Charlie",), ("Diana",), ("Eve",)}),
        ("MATCH (a:Person {name:'Alice'})-[*1..3]->(f) RETURN f.id", {("1",), ("2",), ("3",), ("4",), ("5",)}),
        ("MATCH (a:Person {name:'Frank'})-[:MANAGES*]->(f) RETURN f.name", {("Charlie",), ("Alice",), ("Diana",)}),
        ("MATCH (p:Person) WHERE p.name > 5 RETURN p.name", set()),
        ("MATCH (p:Person) OPTIONAL MATCH (p)-[:MENTORS]->(q) WITH p, q WHERE q.name IS NOT NULL RETURN p.name, q.name", {("Diana", "Eve")}),
    ],
)
def test_answers(people, query, want):
    assert {tuple(r) for r in people.query(query).collect()} == want


def test_order(people):
    got = people.query("MATCH (p:Person) WHERE p.age > 30 RETURN p.name, p.age ORDER BY p.age").collect()
    assert [r[0] for r in got] == ["Charlie", "Frank"]


def test_isolation(spark, people):
    other = PropertyGraph.from_lists(spark, [{"id": "1", "name": "User1", "_labels": ["Type1"]}], [])
    assert [tuple(r) for r in other.query("MATCH (n) RETURN n.name").collect()] == [("User1",)]


def test_changes(people):
    fewer = people.without_nodes("Person", "name = 'Bob'")
    assert {r[0] for r in fewer.query("MATCH (a {name:'Alice'})-[:KNOWS]->(b) RETURN b.name").collect()} == {"Diana"}
    older = people.set_property("Person", "age", "age + 1", "name = 'Bob'")
    assert older.query("MATCH (a {name:'Bob'}) RETURN a.age").first()[0] == 26


@pytest.mark.parametrize("query", ["MATCH (n RETURN n", "MATCH (n) RETURN m.name", "MATCH (n) RETURN nothing(n)", "MATCH (n)", "RETURN $p", "MATCH (n) RETURN n.name AS a, n.age AS a"])
def test_errors(people, query):
    with pytest.raises(GraphError):
        people.query(query)
