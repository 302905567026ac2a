"""Connected components of a large graph of links, by stars that shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import persisted

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (of one type that has an order). Rows node, root: every node that has a link, with the least node of its component.

    Cases: links of a node with itself are none; repeated links count once; nulls have no place here; without links there are no rows.

    Each round links every larger neighbour, and then every smaller one, to the least neighbour; rounds end when
    nothing changes. Each is two aggregations and joins on a node, whose minimum is taken before the shuffle; joins
    on a node of very many links are left to the skew join.
    """
    e = persisted(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(ROUNDS):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = persisted(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components were not found within {ROUNDS} rounds")
    roots = e.groupBy("v").agg(F.first("v").alias("root")).select(F.col("v").alias("node"), "root")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
