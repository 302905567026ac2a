"""Every graph query against its SQL."""

import duckdb
import pytest

from graphloom import queries
from graphloom.sources.tables import table_graph

SF = "/root/testdata/sf0.001"


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def plain(x):
        return round(x, 4) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_same_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_closure_of_cycles_from_all_customers(spark, duck):
    got = table_graph(spark, SF).query("MATCH (a:Customer)-[:KNOWS*]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b").collect()
    edges = duck.sql(f"{queries._K} SELECT src, dst FROM knows").fetchall()
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    want = set()
    for a in after:
        todo = list(after[a])
        while todo:
            b = todo.pop()
            if (a, b) not in want:
                want.add((a, b))
                todo += after.get(b, ())
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert all((a, a) in want for a in after)
