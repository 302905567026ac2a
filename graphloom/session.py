"""A session: one graph with its queries, counters and settings."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.mutate import Editor
from graphloom.plans import inspection
from graphloom.sources.catalog import GraphError, PropertyGraph
from graphloom.sources.results import ResultSet

log = logging.getLogger("graphloom")


@dataclass(frozen=True)
class Settings:
    """slow_seconds: queries that take longer are logged. shuffle_partitions: of the Spark session; unset leaves it alone."""

    slow_seconds: float = 1.0
    shuffle_partitions: int | None = None


@dataclass
class Outcome:
    """What execute() gives: rows, or why there are none."""

    success: bool
    data: ResultSet | None
    seconds: float
    error: str | None = None
    warnings: list[str] = field(default_factory=list)


class GraphSession:
    """cypher() gives lazy results and raises; execute() fetches rows and reports errors instead."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph | None = None, settings: Settings | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings()
        self.editor = Editor(graph or PropertyGraph(spark))
        self._cached: list[DataFrame] = []
        self.counters = {"queries": 0, "failures": 0, "seconds": 0.0}
        if self.settings.shuffle_partitions:
            spark.conf.set("spark.sql.shuffle.partitions", str(self.settings.shuffle_partitions))

    @property
    def graph(self) -> PropertyGraph:
        return self.editor.graph

    def load(self, nodes: Iterable[dict] = (), edges: Iterable[tuple] = (), adjacency: dict | None = None, label: str = "Node") -> None:
        """Puts nodes and relationships into the graph: dicts, triples or quadruples, matrices between the nodes of a label."""
        nodes = [n for n in nodes if n.get("id") is not None]
        if nodes:
            self.editor.create_nodes(nodes)
        if edges := list(edges):
            self.editor.create_edges(edges)
        if adjacency:
            self.editor.graph = self.graph.add_adjacency(adjacency, label)

    def cypher(self, text: str, **params: object) -> DataFrame:
        return self.graph.query(text, **params)

    def execute(self, text: str, parameters: dict | None = None, graph_data: dict | None = None) -> Outcome:
        """Runs a query and fetches its rows; graph_data: nodes, edges and adjacency_matrices of a graph of this query's own."""
        began = time.time()
        self.counters["queries"] += 1
        try:
            graph = self.graph
            if graph_data:
                graph = PropertyGraph.from_lists(self.spark, graph_data.get("nodes", ()), graph_data.get("edges", ()))
                if graph_data.get("adjacency_matrices"):
                    graph = graph.add_adjacency(graph_data["adjacency_matrices"], next(iter(graph.nodes)))
            rows = ResultSet(graph.query(text, **(parameters or {})))
            rows.to_dict_records()
            out = Outcome(True, rows, time.time() - began)
            rows.statistics = {"rows": len(rows.to_dict_records()), "seconds": round(out.seconds, 3)}
        except GraphError as e:
            self.counters["failures"] += 1
            out = Outcome(False, None, time.time() - began, str(e))
        self.counters["seconds"] += out.seconds
        if out.seconds > self.settings.slow_seconds:
            log.info("%.2f s: %s", out.seconds, text)
        return out

    def plan(self, text: str) -> str:
        """The operators of a query, one a line."""
        return inspection.planned(text).text()

    def explain(self, text: str, **params: object) -> None:
        """Prints the operators and Spark's plan."""
        print(self.plan(text))
        self.cypher(text, **params).explain("formatted")

    def stats(self) -> dict[str, object]:
        """Rows of each table (a count job each) and the counters."""
        edges: dict[str, int] = {}
        for e in self.graph.edges:
            edges[e.type] = edges.get(e.type, 0) + e.df.count()
        return {"nodes": {k: n.df.count() for k, n in self.graph.nodes.items()}, "edges": edges, "changes": dict(self.editor.statistics), **self.counters}

    def cache(self) -> None:
        """Keeps the graph's tables in executor memory and disk from their first use on."""
        for df in [n.df for n in self.graph.nodes.values()] + [e.df for e in self.graph.edges]:
            self._cached.append(df.cache())

    def clear_cache(self) -> None:
        for df in self._cached:
            df.unpersist()
        self._cached.clear()

    def stop(self) -> None:
        """Frees what the session holds; the Spark session goes on."""
        self.clear_cache()
        self.editor = Editor(PropertyGraph(self.spark))

    def __enter__(self) -> GraphSession:
        return self

    def __exit__(self, *_: object) -> None:
        self.stop()


def create_session(spark: SparkSession, nodes: Iterable[dict] = (), edges: Iterable[tuple] = (), **settings: object) -> GraphSession:
    """A session over a graph of lists."""
    return GraphSession(spark, PropertyGraph.from_lists(spark, nodes, edges), Settings(**settings))


def execute_query(spark: SparkSession, text: str, nodes: Iterable[dict], edges: Iterable[tuple] = (), **params: object) -> Outcome:
    """One query over a graph of its own."""
    return GraphSession(spark).execute(text, params, {"nodes": list(nodes), "edges": list(edges)})
