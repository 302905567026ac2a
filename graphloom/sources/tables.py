"""The graph over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.sources.catalog import PropertyGraph

NODES = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey")}


#: Graphs by application and folder: a graph holds plans, not rows, and reading the tables' schemas is worth doing once.
_graphs: dict[tuple[str, str], PropertyGraph] = {}


def table_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs[key] = _table_graph(spark, sf_dir)
    return _graphs[key]


def _table_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    g = PropertyGraph(spark)
    for label, (name, key) in NODES.items():
        g = g.add_nodes(label, t[name], key)
    line = t["lineitem"]
    g = g.add_column_edges("PLACED", "Order", "o_custkey", "Customer", incoming=True, trusted=True)
    g = g.add_edges("CONTAINS", line.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"), "Order", "l_orderkey", "Part", "l_partkey", trusted=True)
    g = g.add_edges("SOLD_BY", line.select("l_orderkey", "l_suppkey"), "Order", "l_orderkey", "Supplier", "l_suppkey", trusted=True)
    g = g.add_edges("OFFERS", line.select("l_suppkey", "l_partkey").distinct(), "Supplier", "l_suppkey", "Part", "l_partkey", trusted=True)
    g = g.add_column_edges("LIVES_IN", "Customer", "c_nationkey", "Nation", trusted=True)
    g = g.add_column_edges("BASED_IN", "Supplier", "s_nationkey", "Nation", trusted=True)
    g = g.add_column_edges("IN_REGION", "Nation", "n_regionkey", "Region", trusted=True)
    # Customers are numbered from 0 without gaps: their number comes from the largest key, in the plan.
    n = t["customer"].agg((F.max("c_custkey") + 1).alias("n"))
    k = t["customer"].select("c_custkey").crossJoin(F.broadcast(n))
    near = F.array((F.col("c_custkey") * 7 + 1) % F.col("n"), (F.col("c_custkey") + 3) % F.col("n"), F.when(F.col("c_custkey") % 5 == 0, (F.col("c_custkey") - 3 + F.col("n")) % F.col("n")))
    knows = k.select(F.col("c_custkey").alias("src"), F.explode(near).alias("dst")).where("dst is not null").distinct()
    return g.add_edges("KNOWS", knows, "Customer", "src", "Customer", "dst", trusted=True)
