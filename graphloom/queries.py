"""One query for each operator of the graph engine, with the same in SQL over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import mutate
from graphloom.operators.mutate import Editor
from graphloom.sources.catalog import PropertyGraph
from graphloom.sources.tables import table_graph

_KNOWS = "knows AS (SELECT DISTINCT src, dst FROM (SELECT c_custkey src, (c_custkey * 7 + 1) % n dst FROM customer, m UNION ALL SELECT c_custkey, (c_custkey + 3) % n FROM customer, m UNION ALL SELECT c_custkey, (c_custkey - 3 + n) % n FROM customer, m WHERE c_custkey % 5 = 0))"
_M = "m AS (SELECT max(c_custkey) + 1 n FROM customer)"
_K = f"WITH {_M}, {_KNOWS}"
_URGENT = "(c)-[:PLACED]->(o:Order {o_orderstatus: 'F', o_orderpriority: '1-URGENT'})"
_URGENT_SQL = "o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"


def _where(cypher: str, sql: str) -> tuple[str, str]:
    return f"MATCH (o:Order) WHERE {cypher} RETURN o.o_orderkey AS k", f"SELECT o_orderkey k FROM orders WHERE {sql}"


def _part(cypher: str, sql: str) -> tuple[str, str]:
    return f"MATCH (p:Part) WHERE {cypher} RETURN p.p_partkey AS k", f"SELECT p_partkey k FROM part WHERE {sql}"


#: Name: the query, and its SQL.
PAIRS: dict[str, tuple[str, str]] = {
    "label_scan": ("MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_name AS nm", "SELECT c_custkey k, c_name nm FROM customer"),
    "inline_props": ("MATCH (c:Customer {c_mktsegment: 'BUILDING'}) RETURN c.c_custkey AS k", "SELECT c_custkey k FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "all_node_scan": ("MATCH (n) RETURN labels(n) AS l, count(n) AS n", "SELECT [l] l, n FROM (SELECT 'Region' l, count(*) n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders)"),
    "unknown_label": ("MATCH (x:Nothing) RETURN x.name AS nm", "SELECT NULL nm WHERE false"),
    "unknown_property": ("MATCH (r:Region) RETURN r.r_name AS nm, r.nothing IS NULL AS gone", "SELECT r_name nm, true gone FROM region"),
    "return_only": ("RETURN 1 AS one, 'x' AS t", "SELECT CAST(1 AS BIGINT) one, 'x' t"),
    "where_eq": _where("o.o_orderstatus = 'F'", "o_orderstatus = 'F'"),
    "where_ne": _where("o.o_orderstatus <> 'F'", "o_orderstatus <> 'F'"),
    "where_range": _where("o.o_totalprice > 100000 AND o.o_totalprice <= 200000", "o_totalprice > 100000 AND o_totalprice <= 200000"),
    "where_or": _where("o.o_orderstatus = 'F' OR o.o_totalprice < 5000", "o_orderstatus = 'F' OR o_totalprice < 5000"),
    "where_not": _where("NOT (o.o_orderstatus = 'F' OR o.o_totalprice < 100000)", "NOT (o_orderstatus = 'F' OR o_totalprice < 100000)"),
    "where_in": _where("o.o_orderpriority IN ['1-URGENT', '2-HIGH']", "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "where_lit_left": _where("200000 < o.o_totalprice", "200000 < o_totalprice"),
    "where_and": _where("o.o_orderstatus = 'F' AND o.o_totalprice > 100000 AND o.o_orderpriority <> '5-LOW'", "o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority <> '5-LOW'"),
    "where_xor": _where("o.o_orderstatus = 'F' XOR o.o_totalprice > 100000", "(o_orderstatus = 'F') <> (o_totalprice > 100000)"),
    "where_not_in_null": _where("NOT o.o_orderpriority IN ['1-URGENT', '2-HIGH'] AND o.nothing IS NULL AND o.o_orderstatus IS NOT NULL", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderstatus IS NOT NULL"),
    "where_in_mixed": _where("o.o_orderpriority IN [1, '1-URGENT', 2.5]", "o_orderpriority = '1-URGENT'"),
    "where_text_number": ("MATCH (n:Nation) WHERE n.n_name > 5 OR n.n_regionkey = 1 RETURN n.n_name AS n", "SELECT n_name n FROM nation WHERE n_regionkey = 1 OR coalesce(TRY_CAST(n_name AS DOUBLE) > 5, false)"),
    "where_regex": _part("p.p_name =~ '(red|small) .*t'", "regexp_full_match(p_name, '(red|small) .*t')"),
    "where_contains": _part("p.p_name CONTAINS 'bol'", "contains(p_name, 'bol')"),
    "where_starts": _part("p.p_brand STARTS WITH 'Brand#1'", "starts_with(p_brand, 'Brand#1')"),
    "where_ends": _part("p.p_brand ENDS WITH '2'", "suffix(p_brand, '2')"),
    "where_prop_prop": ("MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey RETURN c.c_custkey AS c, s.s_suppkey AS s", "SELECT c_custkey c, s_suppkey s FROM customer JOIN supplier ON c_nationkey = s_nationkey"),
    "hop_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT o_custkey c, o_orderkey o FROM orders JOIN customer ON c_custkey = o_custkey"),
    "hop_in": ("MATCH (o:Order)<-[:PLACED]-(c:Customer) RETURN c.c_name AS c, o.o_orderkey AS o", "SELECT c_name c, o_orderkey o FROM orders JOIN customer ON c_custkey = o_custkey"),
    "hop_undirected": ("MATCH (a:Customer)-[:KNOWS]-(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b", f"{_K} SELECT src a, dst b FROM knows UNION SELECT dst, src FROM knows"),
    "hop_any": ("MATCH (s:Supplier)-->(x) RETURN labels(x) AS l, count(*) AS n", "SELECT ['Part'] l, count(*) n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT ['Nation'], count(*) FROM supplier"),
    "hop_multi_type": ("MATCH (x)-[r:LIVES_IN|BASED_IN]->(n:Nation) RETURN n.n_name AS n, type(r) AS t, count(*) AS c", "SELECT n_name n, t, count(*) c FROM (SELECT c_nationkey k, 'LIVES_IN' t FROM customer UNION ALL SELECT s_nationkey, 'BASED_IN' FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1, 2"),
    "two_hop": ("MATCH (c:Customer)-[:LIVES_IN]->(n)-[:IN_REGION]->(r:Region {r_name: 'ASIA'}) RETURN c.c_custkey AS k, n.n_name AS n", "SELECT c_custkey k, n_name n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "target_label_props": ("MATCH (o:Order)-[:CONTAINS]->(p:Part {p_size: 7}) RETURN o.o_orderkey AS o, p.p_partkey AS p", "SELECT l_orderkey o, l_partkey p FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size = 7"),
    "rel_props": ("MATCH (o:Order)-[l:CONTAINS {l_returnflag: 'R'}]->(p:Part) RETURN o.o_orderkey AS o, p.p_partkey AS p, l.l_quantity AS q", "SELECT l_orderkey o, l_partkey p, l_quantity q FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'"),
    "three_hop_region": ("MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region {r_name: 'ASIA'}) RETURN n.n_name AS n, count(o) AS orders, round(sum(o.o_totalprice), 2) AS total", "SELECT n_name n, count(*) orders, round(sum(o_totalprice), 2) total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1"),
    "rel_var": ("MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity > 45 RETURN type(l) AS t, o.o_orderkey AS o, p.p_name AS p, l.l_quantity AS q", "SELECT 'CONTAINS' t, l_orderkey o, p_name p, l_quantity q FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45"),
    "rel_scan": ("MATCH ()-[l:CONTAINS|SOLD_BY]->() RETURN type(l) AS t, count(*) AS n, sum(l.l_quantity) AS q", "SELECT 'CONTAINS' t, count(*) n, sum(l_quantity) q FROM lineitem UNION ALL SELECT 'SOLD_BY', count(*), NULL FROM lineitem"),
    "unlabelled_props": ("MATCH (x {s_nationkey: 3}) RETURN x.s_name AS s, labels(x) AS l", "SELECT s_name s, ['Supplier'] l FROM supplier WHERE s_nationkey = 3"),
    "cycle_var": ("MATCH (a:Customer)-[:KNOWS]->(b:Customer)-[:KNOWS]->(a) RETURN a.c_custkey AS a, b.c_custkey AS b", f"{_K} SELECT x.src a, x.dst b FROM knows x JOIN knows y ON x.dst = y.src AND y.dst = x.src"),
    "varlen_1_3": ("MATCH (a:Customer)-[:KNOWS*1..3]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b", f"{_K}, k2 AS (SELECT DISTINCT x.src, y.dst FROM knows x JOIN knows y ON x.dst = y.src) SELECT src a, dst b FROM knows UNION SELECT src, dst FROM k2 UNION SELECT k2.src, y.dst FROM k2 JOIN knows y ON k2.dst = y.src"),
    "varlen_0_2": ("MATCH (a:Customer)-[:KNOWS*0..2]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b", f"{_K} SELECT c_custkey a, c_custkey b FROM customer UNION SELECT src, dst FROM knows UNION SELECT x.src, y.dst FROM knows x JOIN knows y ON x.dst = y.src"),
    "varlen_n": ("MATCH (a:Customer)-[:KNOWS*2]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b", f"{_K} SELECT src a, dst b FROM knows UNION SELECT x.src, y.dst FROM knows x JOIN knows y ON x.dst = y.src"),
    "varlen_regions": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION*]-(x) RETURN c.c_custkey AS c, id(x) AS x, labels(x) AS l", "SELECT c_custkey c, x, l FROM customer JOIN nation n ON c_nationkey = n.n_nationkey JOIN (SELECT n_regionkey k, CAST(n_nationkey AS BIGINT) x, ['Nation'] l FROM nation UNION ALL SELECT r_regionkey, CAST(r_regionkey AS BIGINT), ['Region'] FROM region) ON k = n.n_regionkey"),
    "varlen_from": ("MATCH (r:Region {r_name: 'ASIA'})<-[:IN_REGION|LIVES_IN|BASED_IN*1..2]-(x) RETURN labels(x) AS l, id(x) AS x", "SELECT ['Nation'] l, CAST(n_nationkey AS BIGINT) x FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT ['Customer'], c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT ['Supplier'], s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "varlen_closure": ("MATCH (a:Customer)-[:KNOWS*]->(b:Customer) WHERE a.c_acctbal > 9900 RETURN a.c_custkey AS a, b.c_custkey AS b", f"{_K.replace('WITH', 'WITH RECURSIVE', 1)}, r AS (SELECT src a, dst b FROM knows JOIN customer ON c_custkey = src WHERE c_acctbal > 9900 UNION SELECT a, dst FROM r JOIN knows ON src = b) SELECT a, b FROM r"),
    "join_shared_var": ("MATCH (c:Customer)-[:LIVES_IN]->(n), (s:Supplier)-[:BASED_IN]->(n) RETURN n.n_name AS n, count(*) AS c", "SELECT n_name n, count(*) c FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "cartesian": ("MATCH (a:Region), (b:Region) RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name a, b.r_name b FROM region a, region b"),
    "optional_match": (f"MATCH (c:Customer) OPTIONAL MATCH {_URGENT} RETURN c.c_custkey AS c, o.o_orderkey AS o", f"SELECT c_custkey c, o_orderkey o FROM customer LEFT JOIN orders ON {_URGENT_SQL}"),
    "optional_where": (f"MATCH (c:Customer) OPTIONAL MATCH {_URGENT} WHERE o.o_totalprice > 50000 RETURN c.c_custkey AS c, o.o_orderkey AS o", f"SELECT c_custkey c, o_orderkey o FROM customer LEFT JOIN orders ON {_URGENT_SQL} WHERE o_totalprice > 50000"),
    "optional_comma": (f"MATCH (c:Customer) OPTIONAL MATCH {_URGENT}, (c)-[:LIVES_IN]->(n:Nation {{n_regionkey: 2}}) RETURN c.c_custkey AS c, o.o_orderkey AS o, n.n_name AS n", f"SELECT c_custkey c, o_orderkey o, n_name n FROM customer LEFT JOIN (orders JOIN customer c2 ON c2.c_custkey = o_custkey JOIN nation ON n_nationkey = c2.c_nationkey AND n_regionkey = 2) ON {_URGENT_SQL.replace('c_custkey', 'customer.c_custkey')}".replace("SELECT c_custkey", "SELECT customer.c_custkey")),
    "optional_only": ("OPTIONAL MATCH (r:Region {r_name: 'NOWHERE'}) RETURN r.r_name AS r, 1 AS one", "SELECT CAST(NULL AS VARCHAR) r, CAST(1 AS BIGINT) one"),
    "multi_exists_and": (f"MATCH (c:Customer) WHERE EXISTS({_URGENT}) AND EXISTS((c)-[:LIVES_IN]->(n {{n_regionkey: 1}})) RETURN c.c_custkey AS c", f"SELECT c_custkey c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE {_URGENT_SQL}) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "where_degree": ("MATCH (c:Customer) WHERE size((c)-[:PLACED]->(:Order {o_orderstatus: 'F'})) > 6 RETURN c.c_custkey AS c", "SELECT c_custkey c FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 6"),
    "semi_exists": (f"MATCH (c:Customer) WHERE EXISTS({_URGENT}) RETURN c.c_custkey AS c", f"SELECT c_custkey c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE {_URGENT_SQL})"),
    "anti_exists": (f"MATCH (c:Customer) WHERE NOT EXISTS({_URGENT}) RETURN c.c_custkey AS c", f"SELECT c_custkey c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE {_URGENT_SQL})"),
    "multi_exists_or": (f"MATCH (c:Customer) WHERE EXISTS({_URGENT}) OR c.c_acctbal < 0 RETURN c.c_custkey AS c", f"SELECT c_custkey c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE {_URGENT_SQL}) OR c_acctbal < 0"),
    "order_multi": ("MATCH (s:Supplier) RETURN s.s_name AS s ORDER BY s.s_nationkey DESC, s.s_suppkey LIMIT 20", "SELECT s_name s FROM supplier ORDER BY s_nationkey DESC, s_suppkey LIMIT 20"),
    "limit_before_skip": ("MATCH (c:Customer) RETURN c.c_custkey AS k LIMIT 15 SKIP 10 ORDER BY k DESC", "SELECT c_custkey k FROM customer ORDER BY k DESC LIMIT 15 OFFSET 10"),
    "skip_limit": ("MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY k SKIP 10 LIMIT 15", "SELECT c_custkey k FROM customer ORDER BY k LIMIT 15 OFFSET 10"),
    "topk": ("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k LIMIT 10", "SELECT o_orderkey k, o_totalprice p FROM orders ORDER BY p DESC, k LIMIT 10"),
    "distinct": ("MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s", "SELECT DISTINCT o_orderstatus s FROM orders"),
    "with_filter": ("MATCH (c:Customer) WITH c, c.c_acctbal AS bal WHERE bal > 5000 MATCH (c)-[:LIVES_IN]->(n) RETURN c.c_custkey AS c, n.n_name AS n", "SELECT c_custkey c, n_name n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000"),
    "with_agg_having": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n WHERE n > 10 RETURN c.c_custkey AS c, n", "SELECT o_custkey c, count(*) n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 10"),
    "agg_count": ("MATCH (o:Order) RETURN count(*) AS n, count(DISTINCT o.o_custkey) AS c", "SELECT count(*) n, count(DISTINCT o_custkey) c FROM orders"),
    "agg_group": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.n_name AS nation, count(c) AS cnt", "SELECT n_name nation, count(*) cnt FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"),
    "agg_all": ("MATCH (p:Part) RETURN p.p_brand AS b, sum(p.p_size) AS s, min(p.p_size) AS lo, max(p.p_size) AS hi, count(p) AS n", "SELECT p_brand b, CAST(sum(p_size) AS BIGINT) s, min(p_size) lo, max(p_size) hi, count(*) n FROM part GROUP BY 1"),
    "agg_avg_collect": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, round(avg(n.n_nationkey), 4) AS m, size(collect(n.n_name)) AS c, size(collect(DISTINCT n.n_regionkey)) AS d", "SELECT r_name r, round(avg(n_nationkey), 4) m, CAST(count(n_name) AS INT) c, 1 d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "case_when": ("MATCH (o:Order) RETURN o.o_orderkey AS k, CASE WHEN o.o_totalprice > 200000 THEN 'high' WHEN o.o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS c, CASE o.o_orderstatus WHEN 'F' THEN 1 END AS f", "SELECT o_orderkey k, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END c, CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS BIGINT) END f FROM orders"),
    "unwind": ("UNWIND ['ASIA', 'EUROPE', 'NOWHERE'] AS nm MATCH (r:Region) WHERE r.r_name = nm RETURN nm, r.r_regionkey AS k", "SELECT r_name nm, r_regionkey k FROM region WHERE r_name IN ('ASIA', 'EUROPE')"),
    "bool_values": ("MATCH (s:Supplier) RETURN s.s_suppkey AS k, s.nothing = 1 AND s.s_acctbal > 0 AS a, s.nothing = 1 OR s.s_acctbal > 0 AS o, s.s_acctbal < 5000 AS c", "SELECT s_suppkey k, false a, s_acctbal > 0 o, s_acctbal < 5000 c FROM supplier"),
    "property_case": ("MATCH (r:Region {R_NAME: 'ASIA'}) RETURN r.R_RegionKey AS k", "SELECT r_regionkey k FROM region WHERE r_name = 'ASIA'"),
    "modulo_negative": ("MATCH (c:Customer) RETURN c.c_custkey AS k, (c.c_custkey - 700) % 9 AS m, (c.c_custkey - 700) % -9 AS n, c.c_custkey % 0 AS z", "SELECT c_custkey k, ((c_custkey - 700) % 9 + 9) % 9 m, -((9 - (c_custkey - 700) % 9) % 9) n, CAST(NULL AS BIGINT) z FROM customer"),
    "return_star": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH n.n_name AS nation, r.r_name AS region RETURN *", "SELECT n_name nation, r_name region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "fn_string": ("MATCH (r:Region) RETURN upper(r.r_name) AS u, lower(r.r_name) AS l, trim('  x ') AS t, r.r_name + '!' AS e", "SELECT upper(r_name) u, lower(r_name) l, 'x' t, r_name || '!' e FROM region"),
    "fn_size_length": ("MATCH (r:Region) RETURN size(r.r_name) AS s, length(r.r_name) AS l, length(r.r_regionkey) AS z", "SELECT CAST(length(r_name) AS INT) s, CAST(length(r_name) AS INT) l, 0 z FROM region"),
    "fn_coalesce": ("MATCH (r:Region) RETURN coalesce(r.nothing, r.r_name) AS c", "SELECT r_name c FROM region"),
    "fn_id_labels_keys": ("MATCH (r:Region) RETURN id(r) AS i, labels(r) AS l, keys(r) AS k", "SELECT r_regionkey i, ['Region'] l, ['r_regionkey', 'r_name'] k FROM region"),
    "fn_type": ("MATCH (r:Region) RETURN type(r.r_name) AS t, type(r.r_regionkey) AS i, type(r.nothing) AS n", "SELECT 'String' t, 'Integer' i, 'NULL' n FROM region"),
    "arith": ("MATCH (s:Supplier) RETURN s.s_suppkey + 1 AS a, s.s_suppkey * 2 - 3 AS b, s.s_suppkey / 4 AS c, s.s_suppkey % 7 AS d, s.s_suppkey / 0 AS z", "SELECT s_suppkey + 1 a, s_suppkey * 2 - 3 b, s_suppkey / 4.0::DOUBLE c, s_suppkey % 7 d, CAST(NULL AS DOUBLE) z FROM supplier"),
    "union_distinct": ("MATCH (o:Order) RETURN o.o_orderstatus AS s UNION MATCH (o:Order) WHERE o.o_totalprice > 0 RETURN o.o_orderstatus AS s", "SELECT DISTINCT o_orderstatus s FROM orders"),
    "union_all": ("MATCH (r:Region) RETURN r.r_name AS nm UNION ALL MATCH (n:Nation) RETURN n.n_name AS nm", "SELECT r_name nm FROM region UNION ALL SELECT n_name FROM nation"),
    "params": ("MATCH (o:Order) WHERE o.o_totalprice > $least RETURN o.o_orderkey AS k", "SELECT o_orderkey k FROM orders WHERE o_totalprice > 150000"),
    "revenue_by_region": ("MATCH (c:Customer)-[:PLACED]->(o:Order), (c)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(o) AS orders, round(sum(o.o_totalprice), 2) AS revenue", "SELECT r_name region, count(*) orders, round(sum(o_totalprice), 2) revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
}
PARAMS = {"params": {"least": 150000}}




def _node_struct(g: PropertyGraph) -> DataFrame:
    return g.query("MATCH (r:Region)<-[i:IN_REGION]-(n:Nation) RETURN r, i, n").select("r.id", "r.labels", F.col("r.properties.r_name").alias("nm"), F.col("i.type").alias("t"), F.col("i.source").alias("s"), F.col("n.properties.n_name").alias("n"))


def _created(g: PropertyGraph) -> DataFrame:
    e = Editor(g)
    e.create_nodes([{"r_regionkey": 90, "r_name": "ATLANTIS", "_labels": ["Region"]}, {"n_nationkey": 900, "n_name": "POSEIDONIA", "n_regionkey": 90, "_labels": ["Nation"]}, {"_labels": ["Region"], "r_regionkey": 0, "r_name": "RENAMED"}])
    return e.graph.query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r")


def _updated(g: PropertyGraph) -> DataFrame:
    g = mutate.set_property(g, "Customer", "c_mktsegment", "concat(c_mktsegment, '!')", "c_acctbal < 0")
    g = mutate.change_edges(g, "CONTAINS", "l_returnflag = 'R'", {"l_quantity": 0.0})
    return g.query("MATCH (c:Customer) RETURN c.c_mktsegment AS k, toFloat(count(*)) AS v UNION ALL MATCH ()-[l:CONTAINS]->() RETURN l.l_returnflag AS k, sum(l.l_quantity) AS v")


def _deleted(g: PropertyGraph) -> DataFrame:
    g = mutate.delete_nodes(g, "Nation", "n_regionkey = 2")
    g = mutate.delete_nodes(g, "Order", "o_orderstatus = 'F'")
    return g.query("MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.n_name AS n, count(*) AS v UNION ALL MATCH (o:Order)-[:CONTAINS]->() RETURN o.o_orderstatus AS n, count(*) AS v")


def _edges_changed(g: PropertyGraph) -> DataFrame:
    g = mutate.change_edges(g, "LIVES_IN", {"dst": 3}, None)
    rows = g.nodes["Customer"].df.where("c_acctbal > 5000").select("c_custkey", F.lit(3).alias("nation"), F.col("c_acctbal").alias("w"))
    g = mutate.upsert_edges(g, "LIVES_IN", rows, "Customer", "c_custkey", "Nation", "nation")
    return g.query("MATCH (c:Customer)-[l:LIVES_IN]->(n:Nation) RETURN n.n_nationkey AS n, count(*) AS c, count(l.w) AS w")


def _adjacency(g: PropertyGraph) -> DataFrame:
    return g.add_adjacency({"NEXT_TO": {(0, 1): 1, (1, 2): 1, (2, 0): 0}}, "Region").query("MATCH (a:Region)-[:NEXT_TO]->(b) RETURN a.r_name AS a, b.r_name AS b")


#: Name: what it does with the tables' graph, and its SQL.
FRAMES: dict[str, tuple[Callable[[PropertyGraph], DataFrame], str]] = {
    "node_struct": (_node_struct, "SELECT r_regionkey id, ['Region'] labels, r_name nm, 'IN_REGION' t, n_nationkey s, n_name n FROM region JOIN nation ON r_regionkey = n_regionkey"),
    "relationship_scan": (lambda g: g.relationship_scan("CONTAINS", l_returnflag="R").select("source", "target", "type", "l_quantity"), "SELECT l_orderkey source, l_partkey target, 'CONTAINS' AS type, l_quantity FROM lineitem WHERE l_returnflag = 'R'"),
    "adjacency_load": (_adjacency, "SELECT a.r_name a, b.r_name b FROM region a JOIN region b ON b.r_regionkey = a.r_regionkey + 1 WHERE a.r_regionkey < 2"),
    "mutate_create": (_created, "SELECT n_name n, CASE WHEN r_regionkey = 0 THEN 'RENAMED' ELSE r_name END r FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'POSEIDONIA', 'ATLANTIS'"),
    "mutate_update": (_updated, "SELECT c_mktsegment || CASE WHEN c_acctbal < 0 THEN '!' ELSE '' END k, CAST(count(*) AS DOUBLE) v FROM customer GROUP BY 1 UNION ALL SELECT l_returnflag, sum(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END)::DOUBLE FROM lineitem GROUP BY 1"),
    "mutate_delete_cascade": (_deleted, "SELECT n_name n, count(*) v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2 AND o_orderstatus <> 'F' GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1"),
    "mutate_edges": (_edges_changed, "SELECT n, count(*) c, count(w) w FROM (SELECT c_nationkey n, NULL::DOUBLE w FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 3, c_acctbal FROM customer WHERE c_acctbal > 5000) GROUP BY 1"),
}


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name in FRAMES:
        return lambda spark, sf_dir: FRAMES[name][0](table_graph(spark, sf_dir))
    return lambda spark, sf_dir: table_graph(spark, sf_dir).query(PAIRS[name][0], **PARAMS.get(name, {}))


QUERIES = {name: _run(name) for name in (*PAIRS, *FRAMES)}
SQL = {name: sql for name, (_, sql) in (*PAIRS.items(), *FRAMES.items())}
