"""Node and relationship tables of a graph."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class GraphError(ValueError):
    """A query that cannot be read or resolved; raised before anything runs."""


class LexError(GraphError):
    """A character that begins no token."""


class ParseError(GraphError):
    """Tokens that form no query."""


class AnalysisError(GraphError):
    """A name, type or parameter that cannot be resolved."""


@dataclass(frozen=True)
class NodeTable:
    label: str
    df: DataFrame
    id_col: str


@dataclass(frozen=True)
class EdgeTable:
    """Columns of df other than the two ends are the relationship's properties. Rows are kept as a bag.

    row_of: `src` or `dst` if each row of df is a row of that end's node table, whose column names the other end: such a
    relationship needs no join with that table. trusted: both ends are known to be the id of one node each, so that a node table
    of which only ids are wanted isn't read.
    """

    type: str
    df: DataFrame
    src_label: str
    src_col: str
    dst_label: str
    dst_col: str
    row_of: str | None = None
    trusted: bool = False


@dataclass
class PropertyGraph:
    """Labels and types are resolved when a query is compiled; tables are read only when its result is."""

    spark: SparkSession
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: list[EdgeTable] = field(default_factory=list)

    def add_nodes(self, label: str, df: DataFrame, id_col: str) -> PropertyGraph:
        return PropertyGraph(self.spark, {**self.nodes, label: NodeTable(label, df, id_col)}, self.edges)

    def add_edges(self, type: str, df: DataFrame, src_label: str, src_col: str, dst_label: str, dst_col: str, trusted: bool = False) -> PropertyGraph:
        return PropertyGraph(self.spark, self.nodes, [*self.edges, EdgeTable(type, df, src_label, src_col, dst_label, dst_col, None, trusted)])

    def add_column_edges(self, type: str, label: str, column: str, other: str, incoming: bool = False, trusted: bool = False) -> PropertyGraph:
        """Relationships that a column of a node table states: from a label's node to the other's of that id, or back if incoming."""
        n = self.nodes[label]
        df = n.df.select(n.id_col, column).where(F.col(column).isNotNull())
        ends = (other, column, label, n.id_col) if incoming else (label, n.id_col, other, column)
        return PropertyGraph(self.spark, self.nodes, [*self.edges, EdgeTable(type, df, *ends, "dst" if incoming else "src", trusted)])

    @staticmethod
    def from_lists(spark: SparkSession, nodes: Iterable[dict], edges: Iterable[tuple] = (), id_key: str = "id", labels_key: str = "_labels") -> PropertyGraph:
        """A small graph of dicts and (src, type, dst) or (src, type, dst, properties).

        A node's first label is its table's; nodes without an id are skipped, and of nodes with one id the later one's properties
        are put over the earlier's. Each (src, type, dst) is one relationship, with the properties that came last.
        """
        graph, found = PropertyGraph(spark), {}
        for n in nodes:
            if n.get(id_key) is not None:
                label = (n.get(labels_key) or ["Node"])[0]
                old = found.get(n[id_key], (label, {}))
                found[n[id_key]] = (label if n.get(labels_key) else old[0], {**old[1], **{k: v for k, v in n.items() if k != labels_key}})
        groups: dict[str, list[dict]] = {}
        for label, props in found.values():
            groups.setdefault(label, []).append(props)
        for label, rows in groups.items():
            graph = graph.add_nodes(label, _frame(spark, rows), id_key)
        kinds: dict[tuple, dict] = {}
        for s, t, d, *props in edges:
            if s not in found or d not in found:
                raise GraphError(f"relationship {s}-{t}->{d} has an unknown end")
            rows = kinds.setdefault((t, found[s][0], found[d][0]), {})
            rows[s, d] = {**rows.get((s, d), {}), **(props[0] or {} if props else {})}
        for (t, a, b), pairs in kinds.items():
            rows = [{**props, "#from": s, "#to": d} for (s, d), props in pairs.items()]
            graph = graph.add_edges(t, _frame(spark, rows), a, "#from", b, "#to", trusted=True)
        return graph

    def add_adjacency(self, matrices: dict[str, object], src_label: str, dst_label: str | None = None) -> PropertyGraph:
        """Relationships from matrices by type: {(row, column): value}, or rows of values; what isn't zero is a relationship between the
        nodes of these ids. The name `adjacency` stands for relationships of no other type, ADJACENT."""
        graph = self
        for name, m in matrices.items():
            cells = [k for k, v in m.items() if v] if isinstance(m, dict) else [(i, j) for i, row in enumerate(m) for j, v in enumerate(row) if v]
            rows = self.spark.createDataFrame([(int(i), int(j)) for i, j in cells], "`#from` bigint, `#to` bigint")
            graph = graph.add_edges("ADJACENT" if name == "adjacency" else name, rows, src_label, "#from", dst_label or src_label, "#to")
        return graph

    def relationship_scan(self, *types: str, **props: object) -> DataFrame:
        """Rows of the relationships of these types (all, without one) and property values: source, target, type and properties."""
        found = [e for e in self.edges if not types or e.type in types]
        if not found:
            return self.spark.createDataFrame([], "source string, target string, type string")
        rows = self.edge_rows(found)
        for k, v in props.items():
            rows = rows.where(F.col(f"`{k}`") == F.lit(v)) if k in rows.columns else rows.where("false")
        return rows.select(F.col("#src").alias("source"), F.col("#dst").alias("target"), F.col("#type").alias("type"), *(F.col(f"`{c}`") for c in rows.columns if not c.startswith("#")))

    def query(self, text: str, **params: object) -> DataFrame:
        from graphloom.plans.compiler import compiled

        return compiled(self, text, params)

    # Changes give a new graph; graphloom.operators.mutate has all of them.
    def without_nodes(self, label: str, condition: str) -> PropertyGraph:
        """Removes nodes by a SQL condition, and the relationships of removed nodes."""
        from graphloom.operators.mutate import delete_nodes

        return delete_nodes(self, label, condition)

    def set_property(self, label: str, name: str, value: str, condition: str = "true") -> PropertyGraph:
        """Sets a property to a SQL expression where a SQL condition holds."""
        from graphloom.operators.mutate import set_property

        return set_property(self, label, name, value, condition)

    # Tables that compiled queries read: `#id`, `#label` and the properties, or both ends and the properties.
    def node_rows(self, labels: Iterable[str]) -> DataFrame:
        found = [self.nodes[x] for x in labels]
        if not found:
            return self.spark.createDataFrame([], StructType([StructField("#id", StringType()), StructField("#label", StringType())]))
        kinds = {n.df.schema[n.id_col].dataType.simpleString() for n in found}
        text = len(kinds) > 1 and "string" in kinds
        parts = [n.df.select((F.col(f"`{n.id_col}`").cast("string") if text else F.col(f"`{n.id_col}`")).alias("#id"), F.lit(n.label).alias("#label"), *(F.col(f"`{c}`") for c in n.df.columns)) for n in found]
        return union_widened(parts)

    def edge_rows(self, edges: list[EdgeTable]) -> DataFrame:
        kinds = {e.df.schema[c].dataType.simpleString() for e in edges for c in (e.src_col, e.dst_col)}
        cast = (lambda c: F.col(f"`{c}`").cast("string")) if len(kinds) > 1 and "string" in kinds else (lambda c: F.col(f"`{c}`"))
        parts = [e.df.select(cast(e.src_col).alias("#src"), F.lit(e.src_label).alias("#src_label"), cast(e.dst_col).alias("#dst"), F.lit(e.dst_label).alias("#dst_label"), F.lit(e.type).alias("#type"), *(F.col(f"`{c}`") for c in e.df.columns if c not in (e.src_col, e.dst_col))) for e in edges]
        return union_widened(parts)


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of dicts with different keys; a value's type is that of the first that isn't null, text if they differ."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    for k in names:
        kinds = {type(r[k]) for r in rows if r.get(k) is not None}
        if len(kinds) > 1:
            to = float if kinds <= {int, float} else str
            rows = [{**r, k: to(r[k])} if r.get(k) is not None else r for r in rows]
    known = [k for k in names if any(r.get(k) is not None for r in rows)]
    out = spark.createDataFrame([tuple(r.get(k) for k in known) for r in rows], known)
    return out.select(*(F.col(f"`{k}`") if k in known else F.lit(None).cast("string").alias(k) for k in names))


def union_widened(parts: list[DataFrame]) -> DataFrame:
    """Union by name; a column whose types differ in a way that Spark does not widen becomes text."""
    kinds: dict[str, set[str]] = {}
    for p in parts:
        for f in p.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    plain = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    mixed = {k for k, v in kinds.items() if len(v - {"void"}) > 1 and not v <= plain | {"void"}}
    if mixed:
        parts = [p.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in p.columns)) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
