"""Variable-length traversal: pairs of nodes that a walk of allowed length connects."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.catalog import GraphError

PAIR = ["#s", "#sl", "#e", "#el"]
EDGE = ["#src", "#src_label", "#dst", "#dst_label"]
NODE = ["#m", "#ml"]
#: Written levels after which a closure merges them into one table.
MERGE = 32
#: A closure whose starts times relationships are within this keeps its pairs one by one; a larger one finds strongly connected groups first.
PLAIN_PAIRS = 1 << 20
#: Nodes of a group that are joined at once.
BLOCK = 4096
#: Relationships in a partition, about, that the rounds of a closure join with.
PART_EDGES = 1 << 18


def persisted(df: DataFrame) -> DataFrame:
    """df, written to the session's shared checkpoint folder and read back. Only a local session may do without one."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise GraphError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()


def step(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    on = (F.col("#e") == F.col("#src")) & (F.col("#el") == F.col("#src_label"))
    return pairs.join(edges, on).select("#s", "#sl", F.col("#dst").alias("#e"), F.col("#dst_label").alias("#el")).distinct()


def stay(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """A step that a pair may also leave out."""
    on = (F.col("#e") == F.col("#src")) & (F.col("#el") == F.col("#src_label"))
    ends = F.array(F.struct(F.col("#dst").alias("e"), F.col("#dst_label").alias("l")), F.struct(F.col("#e").alias("e"), F.col("#el").alias("l")))
    both = pairs.join(edges, on, "left").select("#s", "#sl", F.explode(ends).alias("#to"))
    return both.select("#s", "#sl", F.col("#to.e").alias("#e"), F.col("#to.l").alias("#el")).where(F.col("#e").isNotNull()).distinct()


def first(starts: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """The pairs of walks of this length."""
    level = starts.select(F.col("#id").alias("#s"), F.col("#label").alias("#sl"), F.col("#id").alias("#e"), F.col("#label").alias("#el"))
    for _ in range(least):
        level = step(level, edges)
    return level


def reach(starts: DataFrame, edges: DataFrame, least: int, most: int) -> DataFrame:
    """Distinct (#s, #sl, #e, #el). starts: #id, #label, distinct; edges: #src, #src_label, #dst, #dst_label.

    One lazy plan, in which every step stands once and joins the distinct frontier with the edges: beyond the least length a pair may
    also stay where it is, so that the last step holds all lengths.
    """
    edges = edges.select(EDGE)
    level = first(starts, edges, least)
    for _ in range(most - least):
        level = stay(level, edges)
    return level


def spread(level: DataFrame, further) -> DataFrame:
    """All rows that repeated steps lead to. Each round goes on from new rows only and writes these once, so that the plan doesn't grow."""
    levels = [persisted(level)]
    while not levels[-1].isEmpty():
        if len(levels) > MERGE:
            levels = [persisted(reduce(DataFrame.unionByName, levels[:-1])), levels[-1]]
        seen = reduce(DataFrame.unionByName, levels)
        levels.append(persisted(further(levels[-1]).join(seen, level.columns, "left_anti")))
    return reduce(DataFrame.unionByName, levels)


def dealt(edges: DataFrame, by: str, count: int) -> DataFrame:
    """edges, made once and dealt out by one end, so that each round's join leaves them where they are."""
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-count // PART_EDGES))
    return persisted(edges.repartition(parts, by, f"{by}_label"))


def grouped(edges: DataFrame, count: int) -> DataFrame | None:
    """Strongly connected groups: #g, #gl (one node, which names the group), #blocks, #b (the block of 0 to #blocks - 1), #m, #ml (a node).

    The group of a node is what it reaches and is reached from; the node with the most relationships either way is taken, again
    among the rest as long as that gives an eighth of it. Nodes of groups that aren't found count as single ones, which is right
    and only takes more room.
    """
    groups = []
    rest = edges.where((F.col("#src") != F.col("#dst")) | (F.col("#src_label") != F.col("#dst_label")))
    while True:
        leaving = rest.groupBy(F.col("#src").alias("#m"), F.col("#src_label").alias("#ml")).agg(F.count("*").alias("#out"))
        coming = rest.groupBy(F.col("#dst").alias("#m"), F.col("#dst_label").alias("#ml")).agg(F.count("*").alias("#in"))
        nodes = leaving.join(coming, NODE).select(*NODE, F.least("#in", "#out").alias("#n"))
        top = persisted(nodes.agg(F.count("*").alias("#all"), F.min_by(F.struct(*NODE), F.struct(-F.col("#n"), *NODE)).alias("#top")))
        among = top.first()["#all"]
        if not among:
            break
        pivot = top.select("#top.#m", "#top.#ml")

        def along(level: DataFrame, a: str, b: str, by: DataFrame) -> DataFrame:
            on = (F.col("#m") == F.col(a)) & (F.col("#ml") == F.col(f"{a}_label"))
            return level.join(by, on).select(F.col(b).alias("#m"), F.col(f"{b}_label").alias("#ml")).distinct()

        after = spread(pivot, lambda level, by=rest: along(level, "#src", "#dst", by))
        back = dealt(rest, "#dst", count)
        found = spread(pivot, lambda level, by=back, within=after: along(level, "#dst", "#src", by).join(within, NODE, "left_semi"))
        size = found.count()
        if size > 1:
            blocks = -(-size // BLOCK)
            name = pivot.select(F.col("#m").alias("#g"), F.col("#ml").alias("#gl"))
            groups.append(found.crossJoin(F.broadcast(name)).select("#g", "#gl", F.lit(blocks).alias("#blocks"), F.pmod(F.xxhash64(*NODE), F.lit(blocks)).cast("int").alias("#b"), *NODE))
        if size == 1 or 8 * size < among:
            break
        for a in ("#src", "#dst"):
            rest = rest.join(found, (F.col(a) == F.col("#m")) & (F.col(f"{a}_label") == F.col("#ml")), "left_anti")
        rest = dealt(rest, "#src", count)
    return reduce(DataFrame.unionByName, groups) if groups else None


@dataclass
class Closure:
    """pairs: distinct #s, #sl, #e, #el, #blocks. Where #blocks isn't null, the end stands for all nodes of its group."""

    pairs: DataFrame
    groups: DataFrame | None

    def whole(self, rows: DataFrame, e: str = "#e", el: str = "#el", blocks: str = "#blocks") -> DataFrame:
        """rows with each end's nodes in place of the end, without blocks. Nothing as large as the result is shuffled or written: each
        row goes to the blocks of its group, and a block of nodes, wherever it is, meets the rows that want it."""
        if self.groups is None:
            return rows.drop(blocks)
        q = lambda name: F.col(f"`{name}`")
        at = F.when(q(blocks).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), q(blocks) - 1))
        both = rows.withColumn("#at", F.explode(at)).join(self.groups.drop("#blocks"), (q(e) == F.col("#g")) & (q(el) == F.col("#gl")) & (F.col("#at") == F.col("#b")), "left")
        # A block without nodes gives nothing.
        both = both.where(q(blocks).isNull() | F.col("#m").isNotNull())
        node = {e: F.coalesce("#m", q(e)).alias(e), el: F.coalesce("#ml", q(el)).alias(el)}
        return both.select(*(node.get(c, q(c)) for c in rows.columns if c != blocks))


def closure(starts: DataFrame, edges: DataFrame, least: int) -> Closure:
    """The ends of walks of this length at least. starts and edges as for reach().

    A strongly connected group counts as one node while the pairs are sought, and is given back as such: from a start that reaches a
    group it is one pair, and only Closure.whole() makes the pairs of its nodes, lazily.
    """
    count = edges.count()
    edges = dealt(edges.select(EDGE).distinct(), "#src", count)
    level = first(starts, edges, least)
    groups = grouped(edges, count) if starts.count() * count > PLAIN_PAIRS else None
    if groups is None:
        return Closure(spread(level, lambda x: step(x, edges)).withColumn("#blocks", F.lit(None).cast("int")), None)

    def named(df: DataFrame, a: str, al: str) -> DataFrame:
        own = groups.select("#g", "#gl", *NODE)
        joined = df.join(own, (F.col(a) == F.col("#m")) & (F.col(al) == F.col("#ml")), "left")
        return joined.select(*(F.coalesce("#g", a).alias(a) if c == a else F.coalesce("#gl", al).alias(al) if c == al else c for c in df.columns))

    between = named(named(edges, "#src", "#src_label"), "#dst", "#dst_label").where((F.col("#src") != F.col("#dst")) | (F.col("#src_label") != F.col("#dst_label")))
    between = dealt(between.distinct(), "#src", count)
    pairs = spread(named(level, "#e", "#el").distinct(), lambda x: step(x, between))
    names = groups.where((F.col("#g") == F.col("#m")) & (F.col("#gl") == F.col("#ml"))).select(F.col("#g").alias("#e"), F.col("#gl").alias("#el"), "#blocks")
    return Closure(pairs.join(names, ["#e", "#el"], "left").select(*PAIR, "#blocks"), groups)
