"""Changes of a graph. Each gives a new graph of lazy tables; nothing is written, and a batch is one union however long.

Bulk changes take DataFrames or SQL conditions and are what large graphs need. Editor has the same by record, with counters:
its lists of records come from the driver and are as long as the caller makes them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.catalog import EdgeTable, GraphError, NodeTable, PropertyGraph, _frame, union_widened


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _changed(graph: PropertyGraph, label: str, df: DataFrame, removed: bool = False) -> PropertyGraph:
    """The graph with other rows of a label. removed: nodes may have gone, and their relationships go with them."""
    old = graph.nodes[label]
    ids = df.select(_c(old.id_col).alias("#kept"))
    edges = []
    for e in graph.edges:
        own = e.src_label if e.row_of == "src" else e.dst_label
        if e.row_of and own == label:
            column = e.dst_col if e.row_of == "src" else e.src_col
            e = replace(e, df=df.select(old.id_col, column).where(_c(column).isNotNull()), trusted=e.trusted and removed)
        if removed:
            for side, col in ((e.src_label, e.src_col), (e.dst_label, e.dst_col)):
                if side == label and not (e.row_of and col == old.id_col):
                    e = replace(e, df=e.df.join(ids, _c(col) == _c("#kept"), "left_semi"), row_of=None)
        edges.append(e)
    return PropertyGraph(graph.spark, {**graph.nodes, label: NodeTable(label, df, old.id_col)}, edges)


def upsert_nodes(graph: PropertyGraph, label: str, rows: DataFrame, id_col: str | None = None) -> PropertyGraph:
    """Adds nodes, one for each row; a row takes the place of the node of its id. Ids in rows are distinct."""
    old = graph.nodes.get(label)
    if old is None:
        return graph.add_nodes(label, rows, id_col or rows.columns[0])
    kinds = {f.name: f.dataType for f in old.df.schema.fields}
    rows = rows.select(*(_c(c).cast(kinds[c]).alias(c) if c in kinds else _c(c) for c in rows.columns))
    kept = old.df.join(rows.select(_c(old.id_col).alias("#new")), _c(old.id_col) == _c("#new"), "left_anti")
    return _changed(graph, label, union_widened([kept, rows]))


def delete_nodes(graph: PropertyGraph, label: str, condition: str | Column) -> PropertyGraph:
    """Removes nodes by a condition, and the relationships of removed nodes."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return _changed(graph, label, graph.nodes[label].df.where(~F.coalesce(condition, F.lit(False))), removed=True)


def set_property(graph: PropertyGraph, label: str, name: str, value: str | Column, condition: str | Column = "true") -> PropertyGraph:
    """Sets a property where a condition holds."""
    old = graph.nodes[label]
    if name == old.id_col:
        raise GraphError("an id cannot be changed")
    condition, value = (F.expr(x) if isinstance(x, str) else x for x in (condition, value))
    new = F.when(condition, value)
    return _changed(graph, label, old.df.withColumn(name, new.otherwise(_c(name)) if name in old.df.columns else new))


def upsert_edges(graph: PropertyGraph, type: str, rows: DataFrame, src_label: str, src_col: str, dst_label: str, dst_col: str) -> PropertyGraph:
    """Adds relationships, one for each row; a row takes the place of those between the same ends. Pairs of ends in rows are distinct."""
    rows = rows.withColumnsRenamed({src_col: "#from", dst_col: "#to"})
    kept = []
    for e in graph.edges:
        if (e.type, e.src_label, e.dst_label) == (type, src_label, dst_label):
            pairs = rows.select(_c("#from").alias("#f"), _c("#to").alias("#t"))
            e = replace(e, df=e.df.join(pairs, (_c(e.src_col) == _c("#f")) & (_c(e.dst_col) == _c("#t")), "left_anti"), row_of=None)
        kept.append(e)
    return PropertyGraph(graph.spark, graph.nodes, [*kept, EdgeTable(type, rows, src_label, "#from", dst_label, "#to")])


def change_edges(graph: PropertyGraph, type: str, condition: dict | str, updates: dict | None) -> PropertyGraph:
    """Sets properties of relationships of a type, or removes those without updates. condition: SQL, or {"src": id, "dst": id}."""
    edges = []
    for e in graph.edges:
        if e.type == type:
            if isinstance(condition, dict):
                here = F.lit(True)
                for side, col in (("src", e.src_col), ("dst", e.dst_col)):
                    if side in condition:
                        here = here & _is(e.df, col, condition[side])
            else:
                here = F.expr(condition)
            here = F.coalesce(here, F.lit(False))
            if updates is None:
                e = replace(e, df=e.df.where(~here), row_of=None)
            else:
                df = e.df
                for k, v in updates.items():
                    df = df.withColumn(k, F.when(here, F.lit(v)).otherwise(_c(k) if k in df.columns else F.lit(None)))
                e = replace(e, df=df, row_of=None)
        edges.append(e)
    return PropertyGraph(graph.spark, graph.nodes, edges)


def _is(df: DataFrame, col: str, value: object) -> Column:
    """A column equals an id, if an id of this kind can be in it."""
    text = df.schema[col].dataType.simpleString() == "string"
    return _c(col) == F.lit(value) if text == isinstance(value, str) else F.lit(False)


class Editor:
    """Record-level changes. `graph` is the graph as changed so far; ids of nodes are unique over all labels here."""

    def __init__(self, graph: PropertyGraph) -> None:
        self.graph = graph
        self._next: int | None = None
        self.reset_statistics()

    def reset_statistics(self) -> None:
        self.statistics = {k: 0 for k in ("nodes_created", "edges_created", "nodes_updated", "edges_updated", "nodes_deleted", "edges_deleted")}

    def _labels(self, ids: Iterable[object]) -> dict[object, str]:
        """Labels of those ids that are there; one lookup for each label."""
        ids, out = list(dict.fromkeys(ids)), {}
        for label, n in self.graph.nodes.items():
            text = n.df.schema[n.id_col].dataType.simpleString() == "string"
            fit = [i for i in ids if isinstance(i, str) == text]
            if fit:
                out |= {r[0]: label for r in n.df.where(_c(n.id_col).isin(fit)).select(n.id_col).distinct().collect()}
        return out

    def _fresh(self, label: str) -> object:
        if self._next is None:
            tops = [n.df.agg(F.max(_c(n.id_col).try_cast("bigint"))).first()[0] for n in self.graph.nodes.values()]
            self._next = max([0, *(t for t in tops if t is not None)])
        self._next += 1
        n = self.graph.nodes.get(label)
        return str(self._next) if n and n.df.schema[n.id_col].dataType.simpleString() == "string" else self._next

    def create_node(self, data: dict) -> object:
        return self.create_nodes([data])[0]

    def create_nodes(self, nodes: Iterable[dict]) -> list[object]:
        """Ids of new nodes: `id` or `_id` of the dicts, or the next free number. `_labels`: the first is the node's."""
        groups: dict[str, dict] = {}
        out = []
        for data in nodes:
            label = (data.get("_labels") or ["Node"])[0]
            key = self.graph.nodes[label].id_col if label in self.graph.nodes else "id"
            own = next((data[k] for k in (key, "id", "_id") if data.get(k) is not None), None)
            own = self._fresh(label) if own is None else own
            groups.setdefault(label, {})[own] = {key: own} | {k: v for k, v in data.items() if k not in ("_labels", "_id", "id")}
            out.append(own)
        for label, rows in groups.items():
            key = self.graph.nodes[label].id_col if label in self.graph.nodes else "id"
            self.graph = upsert_nodes(self.graph, label, _frame(self.graph.spark, list(rows.values())), key)
        self.statistics["nodes_created"] += len(out)
        return out

    def create_edge(self, src: object, dst: object, type: str, props: dict | None = None) -> str:
        return self.create_edges([(src, type, dst, props or {})])[0]

    def create_edges(self, edges: Iterable[tuple]) -> list[str]:
        """Ids `src_type_dst` of new relationships (src, type, dst) or (src, type, dst, properties)."""
        edges = [(s, t, d, p[0] if p else {}) for s, t, d, *p in edges]
        labels = self._labels(x for s, _, d, _ in edges for x in (s, d))
        if missing := next((x for s, _, d, _ in edges for x in (s, d) if x not in labels), None):
            raise GraphError(f"there is no node {missing}")
        groups: dict[tuple, dict] = {}
        for s, t, d, p in edges:
            groups.setdefault((t, labels[s], labels[d]), {})[s, d] = {"#from": s, "#to": d, **p}
        for (t, a, b), rows in groups.items():
            self.graph = upsert_edges(self.graph, t, _frame(self.graph.spark, list(rows.values())), a, "#from", b, "#to")
        self.statistics["edges_created"] += len(edges)
        return [f"{s}_{t}_{d}" for s, t, d, _ in edges]

    def update_node(self, id: object, updates: dict) -> bool:
        """Puts properties over the node's; `_labels` gives it another label, which its relationships follow. False if there is no such node."""
        label = self._labels([id]).get(id)
        if label is None:
            return False
        n = self.graph.nodes[label]
        here = _c(n.id_col) == F.lit(id)
        for k, v in updates.items():
            if k not in ("_labels", "_id", "id", n.id_col):
                self.graph = set_property(self.graph, label, k, F.lit(v), here)
        to = (updates.get("_labels") or [label])[0]
        if to != label:
            self.graph = self._moved(id, label, to)
        self.statistics["nodes_updated"] += 1
        return True

    def _moved(self, id: object, label: str, to: str) -> PropertyGraph:
        n, edges = self.graph.nodes[label], []
        here = _c(n.id_col) == F.lit(id)
        row = n.df.where(here)
        target = self.graph.nodes.get(to)
        if target and target.id_col != n.id_col:
            row = row.withColumnRenamed(n.id_col, target.id_col)
        for e in self.graph.edges:
            parts = [replace(e, row_of=None)] if label in (e.src_label, e.dst_label) else [e]
            for side, col in (("src_label", "src_col"), ("dst_label", "dst_col")):
                if getattr(e, side) == label:
                    is_it = _c(getattr(e, col)) == F.lit(id)
                    parts = [x for p in parts for x in (replace(p, df=p.df.where(~is_it)), replace(p, df=p.df.where(is_it), **{side: to}))]
            edges += parts
        nodes = {**self.graph.nodes, label: NodeTable(label, n.df.where(~here), n.id_col)}
        nodes[to] = NodeTable(to, union_widened([target.df, row]), target.id_col) if target else NodeTable(to, row, n.id_col)
        return PropertyGraph(self.graph.spark, nodes, edges)

    def update_edge(self, src: object, type: str, dst: object, updates: dict) -> bool:
        if not self._has(src, type, dst):
            return False
        self.graph = change_edges(self.graph, type, {"src": src, "dst": dst}, updates)
        self.statistics["edges_updated"] += 1
        return True

    def delete_node(self, id: object) -> bool:
        """Removes the node and its relationships. False if there is no such node."""
        label = self._labels([id]).get(id)
        if label is None:
            return False
        self.graph = delete_nodes(self.graph, label, _c(self.graph.nodes[label].id_col) == F.lit(id))
        self.statistics["nodes_deleted"] += 1
        return True

    def delete_edge(self, src: object, type: str, dst: object) -> bool:
        if not self._has(src, type, dst):
            return False
        self.graph = change_edges(self.graph, type, {"src": src, "dst": dst}, None)
        self.statistics["edges_deleted"] += 1
        return True

    def _has(self, src: object, type: str, dst: object) -> bool:
        return any(not e.df.where(_is(e.df, e.src_col, src) & _is(e.df, e.dst_col, dst)).isEmpty() for e in self.graph.edges if e.type == type)
