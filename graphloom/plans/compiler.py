"""Clauses to DataFrames.

Bindings are flat columns `variable.property`, with `variable.#id` and `variable.#label` for nodes, so that filters and column
pruning reach the scans. Everything is lazy but an unbounded variable-length traversal.

A node table is not read where only ids are wanted of a node that a trusted relationship leads to, and a relationship that a
column of a node table states needs no join with that table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import AGGREGATES, FUNCTIONS, Value, arithmetic, compared, is_number
from graphloom.operators.reach import closure, reach
from graphloom.plans.parser import Clause, Node, Pattern, Rel, parsed
from graphloom.plans.usage import ALL, conjuncts, contains, names, used
from graphloom.sources.catalog import AnalysisError, EdgeTable, PropertyGraph

Scope = dict[str, "Bound"]


@dataclass(frozen=True)
class Bound:
    """kind: node, rel or value; labels: those a node can have."""

    kind: str
    labels: tuple[str, ...] = ()


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def compiled(graph: PropertyGraph, text: str, params: dict[str, object] | None = None) -> DataFrame:
    parts, every = parsed(text)
    frames = [_Query(graph, params or {}).run(p) for p in parts]
    out = frames[0]
    for f in frames[1:]:
        if f.columns != out.columns:
            raise AnalysisError("the parts of a UNION return different columns")
        out = out.unionByName(f)
    return out if every else out.distinct()


class _Query:
    def __init__(self, graph: PropertyGraph, params: dict[str, object]) -> None:
        self.graph, self.params, self.n, self.strict = graph, params, 0, False
        self.used: dict[str, set[str]] = {}
        #: Conjuncts of the clause at hand, which a variable-length hop's start may already meet.
        self.pending: list[tuple] = []

    def one(self) -> DataFrame:
        return self.graph.spark.range(1).select(F.lit(0).alias("#one"))

    def run(self, clauses: list[Clause]) -> DataFrame:
        df: DataFrame | None = None
        scope: Scope = {}
        self.used = used(clauses)
        for c in clauses:
            if c.kind == "MATCH":
                self.pending = conjuncts(c.where)
                for p in c.patterns:
                    df, scope = self.match(df, scope, p)
                self.pending = []
                df = self.where(df, scope, c.where)
            elif c.kind == "OPTIONAL":
                df, scope = self.optional(df if df is not None else self.one(), scope, c.patterns)
                df = self.where(df, scope, c.where)
            elif c.kind == "UNWIND":
                df = df if df is not None else self.one()
                (e, name), *_ = c.items
                if name in scope:
                    raise AnalysisError(f"{name} is already bound")
                rows = self.value(e, scope, df)
                if not rows[1].startswith("array"):
                    raise AnalysisError("UNWIND needs a list")
                df, scope = df.select("*", F.explode(rows[0]).alias(name)), {**scope, name: Bound("value")}
            else:
                df, scope = self.project(df if df is not None else self.one(), scope, c)
        return df

    # Patterns

    def candidates(self, pattern: Pattern, scope: Scope) -> tuple[list[tuple[str, ...]], list[list[EdgeTable]]]:
        """Labels each node can have and edge tables each relationship can use."""
        labels = []
        for n in pattern.nodes:
            own = tuple(n.labels) if n.labels else tuple(self.graph.nodes)
            # A node has one label here: several required labels can only be the same one.
            own = tuple(x for x in dict.fromkeys(own) if x in self.graph.nodes) if len(set(n.labels)) < 2 else ()
            if n.var in scope:
                if scope[n.var].kind != "node":
                    raise AnalysisError(f"{n.var} is not a node")
                own = tuple(x for x in scope[n.var].labels if x in own)
            labels.append(own)
        tables = []
        for i, r in enumerate(pattern.rels):
            found = [e for e in self.graph.edges if not r.types or e.type in r.types]
            if r.range is None:
                a, b = labels[i], labels[i + 1]
                ends = [(e, x, y) for e in found for x, y in {"out": [(e.src_label, e.dst_label)], "in": [(e.dst_label, e.src_label)], "both": [(e.src_label, e.dst_label), (e.dst_label, e.src_label)]}[r.direction] if x in a and y in b]
                found = [e for e in found if any(e is x for x, _, _ in ends)]
                labels[i] = tuple(x for x in a if any(x == y for _, y, _ in ends))
                labels[i + 1] = tuple(x for x in b if any(x == y for _, _, y in ends))
            tables.append(found)
        return labels, tables

    def scan(self, n: Node, labels: Iterable[str]) -> DataFrame:
        rows = self.graph.node_rows(labels)
        rows = rows.select(*(col(c).alias(f"{n.var}.{c}") for c in rows.columns))
        return self.inline(rows, n.var, n.props)

    def inline(self, df: DataFrame, var: str, props: dict[str, tuple]) -> DataFrame:
        for k, e in props.items():
            df = df.where(compared("=", self.column(df, f"{var}.{k}"), self.value(e, {}, df)))
        return df

    def edges(self, r: Rel, tables: list[EdgeTable]) -> DataFrame | None:
        if not tables:
            return None
        rows = self.inline_rel(self.graph.edge_rows(tables), r)
        turned = {"#src": "#dst", "#src_label": "#dst_label", "#dst": "#src", "#dst_label": "#src_label"}
        back = rows.select(*(col(turned.get(c, c)).alias(c) for c in rows.columns))
        if r.direction == "in":
            return back
        # Both directions are a set, whichever way a pair is stored.
        return rows.unionByName(back).distinct() if r.direction == "both" else rows

    def match(self, df: DataFrame | None, scope: Scope, pattern: Pattern) -> tuple[DataFrame, Scope]:
        if pattern.nodes[0].var not in scope and any(n.var in scope for n in pattern.nodes) and pattern.nodes[-1].var in scope:
            turn = {"in": "out", "out": "in", "both": "both"}
            pattern = Pattern(pattern.nodes[::-1], [Rel(r.var, r.types, r.props, turn[r.direction], r.range) for r in pattern.rels[::-1]])
        labels, tables = self.candidates(pattern, scope)
        scope = dict(scope)
        first = pattern.nodes[0]
        if first.var in scope:
            df = self.bound(df, first, labels[0])
        elif any(n.var in scope for n in pattern.nodes):
            # Bound only inside the chain: the chain is read on its own and joined on the shared nodes.
            own, more = self.match(None, {}, pattern)
            return self.joined(df, scope, own, more, "inner")
        else:
            if df is not None and pattern.rels:
                own, more = self.match(None, {}, pattern)
                return df.crossJoin(own), {**scope, **more}
            led = self.led(pattern, labels, tables)
            rows = led if led is not None else self.scan(first, labels[0])
            df = rows if df is None else df.crossJoin(rows)
        scope[first.var] = Bound("node", labels[0])
        for i, r in enumerate(pattern.rels):
            a, b = pattern.nodes[i], pattern.nodes[i + 1]
            if f"{r.var}.#src" in df.columns and r.var not in scope:
                # The chain began with this relationship's rows.
                if f"{b.var}.#id" not in df.columns:
                    df = self.ended(df, b, labels[i + 1], col(f"{r.var}.{'#src' if r.direction == 'in' else '#dst'}"), tables[i])
                scope[b.var], scope[r.var] = Bound("node", labels[i + 1]), Bound("rel")
                continue
            stated = self.stated(df, scope, pattern, i, labels, tables)
            if stated is not None:
                df = stated
                if b.var not in scope:
                    scope[b.var] = Bound("node", labels[i + 1])
                scope[r.var] = Bound("rel")
                continue
            edges = self.edges(r, tables[i])
            grouped = None
            if r.range is not None:
                reached = [x for x in (b.labels or self.graph.nodes) if x in self.graph.nodes]
                labels[i + 1] = tuple(x for x in labels[i + 1] if x in reached)
                for e in self.pending:
                    if names(e) is not None and names(e) <= set(scope):
                        df = df.where(self.value(e, scope, df)[0])
                starts = df.select(col(f"{a.var}.#id").alias("#id"), col(f"{a.var}.#label").alias("#label")).distinct()
                edges = edges if edges is not None else starts.select(col("#id").alias("#src"), col("#label").alias("#src_label"), col("#id").alias("#dst"), col("#label").alias("#dst_label")).where("false")
                least, most = r.range
                if most is None:
                    found = closure(starts, edges, least)
                    if b.var in scope:
                        pairs = found.whole(found.pairs)
                    else:
                        grouped, pairs = found, found.pairs
                else:
                    pairs = reach(starts, edges, least, most)
                edges = pairs.withColumnsRenamed({"#s": "#src", "#sl": "#src_label", "#e": "#dst", "#el": "#dst_label"})
            elif edges is None:
                edges = df.select(col(f"{a.var}.#id").alias("#src"), col(f"{a.var}.#label").alias("#src_label"), col(f"{a.var}.#id").alias("#dst"), col(f"{a.var}.#label").alias("#dst_label"), F.lit("").alias("#type")).where("false")
            edges = edges.select(*(col(c).alias(f"{r.var}.{c}") for c in edges.columns))
            on = self.same(col(f"{a.var}.#id"), col(f"{r.var}.#src"), labels[i], col(f"{a.var}.#label"), col(f"{r.var}.#src_label"), r, tables[i])
            end = (col(f"{b.var}.#id"), col(f"{r.var}.#dst"), labels[i + 1], col(f"{b.var}.#label"), col(f"{r.var}.#dst_label"), r, tables[i])
            if b.var in scope:
                df = self.bound(df, b, labels[i + 1]).join(edges, on & self.same(*end))
            else:
                df = df.join(edges, on)
                if grouped:
                    df = grouped.whole(df, f"{r.var}.#dst", f"{r.var}.#dst_label", f"{r.var}.#blocks")
                if self.skipped(b, labels[i + 1], tables[i]):
                    df = self.bare(df.where(col(f"{r.var}.#dst_label") == labels[i + 1][0]), b, labels[i + 1][0], col(f"{r.var}.#dst"))
                else:
                    df = df.join(self.scan(b, labels[i + 1]), self.same(*end))
                scope[b.var] = Bound("node", labels[i + 1])
            if r.range is None:
                scope[r.var] = Bound("rel")
        return df, scope

    # Hops without a join of their own

    def skipped(self, n: Node, labels: tuple[str, ...], tables: list[EdgeTable]) -> bool:
        """Whether relationships of these tables lead to all that is wanted of a node: its id."""
        if len(labels) != 1 or n.props or not tables or not all(e.trusted for e in tables):
            return False
        wanted, key = self.used.get(n.var, set()), self.graph.nodes[labels[0]].id_col
        return ALL not in wanted and all(k.lower() == key.lower() for k in wanted)

    def bare(self, df: DataFrame, n: Node, label: str, key: Column) -> DataFrame:
        """df with a node of which only the id is known."""
        name = self.graph.nodes[label].id_col
        return df.select("*", key.alias(f"{n.var}.#id"), F.lit(label).alias(f"{n.var}.#label"), key.alias(f"{n.var}.{name}"))

    def ended(self, df: DataFrame, n: Node, labels: tuple[str, ...], key: Column, tables: list[EdgeTable]) -> DataFrame:
        """df with the node of one label that a column leads to."""
        if self.skipped(n, labels, tables):
            return self.bare(df, n, labels[0], key)
        return df.join(self.scan(n, labels), key == col(f"{n.var}.#id"))

    @staticmethod
    def single(r: Rel, tables: list[EdgeTable]) -> EdgeTable | None:
        return tables[0] if r.range is None and r.direction != "both" and len(tables) == 1 else None

    @staticmethod
    def stated_rel(df: DataFrame, r: Rel, e: EdgeTable, src: Column, dst: Column) -> DataFrame:
        return df.select("*", src.alias(f"{r.var}.#src"), F.lit(e.src_label).alias(f"{r.var}.#src_label"), dst.alias(f"{r.var}.#dst"), F.lit(e.dst_label).alias(f"{r.var}.#dst_label"), F.lit(e.type).alias(f"{r.var}.#type"))

    def led(self, pattern: Pattern, labels: list[tuple[str, ...]], tables: list[list[EdgeTable]]) -> DataFrame | None:
        """The first hop's rows, if these hold all that is wanted of the first node."""
        if not pattern.rels:
            return None
        a, r, b = pattern.nodes[0], pattern.rels[0], pattern.nodes[1]
        e = self.single(r, tables[0])
        if e is None or a.var == b.var or len(labels[1]) != 1 or not self.skipped(a, labels[0], tables[0]):
            return None
        out = r.direction == "out"
        if e.row_of == ("dst" if out else "src"):
            df = self.scan(b, labels[1])
            key, own = col(f"{b.var}.{e.src_col if out else e.dst_col}"), col(f"{b.var}.#id")
            df = self.stated_rel(df.where(key.isNotNull()), r, e, *((key, own) if out else (own, key)))
        else:
            rows = self.inline_rel(self.graph.edge_rows([e]), r)
            df = rows.select(*(col(c).alias(f"{r.var}.{c}") for c in rows.columns))
        return self.bare(df, a, labels[0][0], col(f"{r.var}.{'#src' if out else '#dst'}"))

    def stated(self, df: DataFrame, scope: Scope, pattern: Pattern, i: int, labels: list[tuple[str, ...]], tables: list[list[EdgeTable]]) -> DataFrame | None:
        """A hop that a column of one of its ends' tables states; None if there is no such column here."""
        a, r, b = pattern.nodes[i], pattern.rels[i], pattern.nodes[i + 1]
        e = self.single(r, tables[i])
        if e is None or not e.row_of or r.props or r.var in scope:
            return None
        mine = e.row_of == ("src" if r.direction == "out" else "dst")
        row, column = (e.src_label, e.dst_col) if e.row_of == "src" else (e.dst_label, e.src_col)
        holder, at = (a, i) if mine else (b, i + 1)
        key, own = col(f"{holder.var}.{column}"), col(f"{holder.var}.#id")
        if labels[at] != (row,) or len(labels[i]) != 1 or len(labels[i + 1]) != 1:
            return None
        there = holder.var in scope
        if there and f"{holder.var}.{column}" not in df.columns:
            return None
        if there:
            df = df.where(key.isNotNull() & (col(f"{holder.var}.#label") == row))
        ends = (own, key) if e.row_of == "src" else (key, own)
        if b.var in scope:
            df = self.bound(df, b, labels[i + 1])
            df = df.where((key == col(f"{(b if mine else a).var}.#id")) & (col(f"{(b if mine else a).var}.#label") == labels[i + 1 if mine else i][0]))
            return self.stated_rel(df, r, e, *ends)
        if mine:
            return self.ended(self.stated_rel(df, r, e, *ends), b, labels[i + 1], key, tables[i])
        on = key == col(f"{a.var}.#id")
        if scope[a.var].labels != labels[i]:
            on = on & (col(f"{a.var}.#label") == labels[i][0])
        return self.stated_rel(df.join(self.scan(b, labels[i + 1]), on), r, e, *ends)

    def inline_rel(self, edges: DataFrame, r: Rel) -> DataFrame:
        for k, e in r.props.items():
            edges = edges.where(compared("=", self.column(edges, k), self.value(e, {}, edges)))
        return edges

    @staticmethod
    def same(x: Column, y: Column, labels: tuple[str, ...], lx: Column, ly: Column, r: Rel, tables: list[EdgeTable]) -> Column:
        """Equal nodes; labels are compared only where an end can have several."""
        ends = {x for e in tables for x in (e.src_label, e.dst_label)} if r.direction == "both" or r.range is not None else set()
        simple = len(labels) == 1 and len(ends) < 2 and len({(e.src_label, e.dst_label) for e in tables}) < 2
        return x == y if simple else (x == y) & (lx == ly)

    def bound(self, df: DataFrame, n: Node, labels: tuple[str, ...]) -> DataFrame:
        if n.labels:
            df = df.where(col(f"{n.var}.#label").isin(*labels)) if labels else df.where("false")
        return self.inline(df, n.var, n.props)

    def joined(self, df: DataFrame, scope: Scope, own: DataFrame, more: Scope, how: str) -> tuple[DataFrame, Scope]:
        shared = [v for v in more if v in scope]
        drop = {f"{v}.": v for v in shared}
        keep = [c for c in own.columns if not any(c.startswith(p) for p in drop)]
        keys, on = [], F.lit(True)
        for v in shared:
            # Relationship variables have no identity of their own: their ends and type stand for it.
            for c in ("#id", "#label") if scope[v].kind == "node" else ("#src", "#src_label", "#dst", "#dst_label", "#type"):
                keys.append(col(f"{v}.{c}").alias(f"#k.{v}.{c}"))
                on = on & (col(f"{v}.{c}") == col(f"#k.{v}.{c}"))
        right = own.select(*(col(c) for c in keep), *keys)
        out = df.join(right, on, how)
        return out.select(*(col(c) for c in [*df.columns, *keep])) if how in ("inner", "left") else out, {**scope, **{k: v for k, v in more.items() if k not in scope}}

    def alone(self, scope: Scope, pattern: Pattern) -> tuple[DataFrame, Scope]:
        """The pattern read on its own, its shared nodes with the labels they have outside."""
        nodes = [Node(n.var, n.labels or (list(scope[n.var].labels) if n.var in scope and len(scope[n.var].labels) == 1 else []), n.props) for n in pattern.nodes]
        return self.match(None, {}, Pattern(nodes, pattern.rels))

    def optional(self, df: DataFrame, scope: Scope, patterns: list[Pattern]) -> tuple[DataFrame, Scope]:
        """All patterns hold together, or none of their variables is bound."""
        if len(patterns) == 1:
            return self.joined(df, scope, *self.alone(scope, patterns[0]), "left")
        names = {x.var for p in patterns for x in (*p.nodes, *p.rels)}
        shared = {v: b for v, b in scope.items() if v in names}
        keys = [c for v, b in shared.items() for c in (f"{v}.{k}" for k in (("#id", "#label") if b.kind == "node" else ("#src", "#src_label", "#dst", "#dst_label", "#type")))]
        own: DataFrame | None = df.select(*map(col, keys)).distinct() if keys else None
        inner: Scope = dict(shared)
        for p in patterns:
            rows, more = self.alone(inner, p)
            own, inner = (rows, more) if own is None else self.joined(own, inner, rows, more, "inner")
        return self.joined(df, scope, own, inner, "left")

    # Predicates

    def where(self, df: DataFrame, scope: Scope, e: tuple | None) -> DataFrame:
        if e is None:
            return df
        if e[0] == "and":
            return self.where(self.where(df, scope, e[1]), scope, e[2])
        if e[0] == "exists" or e[0] == "not" and e[1][0] == "exists":
            pattern = e[1] if e[0] == "exists" else e[1][1]
            own, more = self.alone(scope, pattern)
            return self.joined(df, scope, own, {v: b for v, b in more.items()}, "left_semi" if e[0] == "exists" else "left_anti")[0]
        df, e = self.flags(df, scope, e)
        return df.where(self.value(e, scope, df)[0])

    def flags(self, df: DataFrame, scope: Scope, e: tuple) -> tuple[DataFrame, tuple]:
        """EXISTS and pattern sizes below other operators become columns: whether it holds, how often it does."""
        if e[0] in ("exists", "degree"):
            self.n += 1
            name = f"#flag{self.n}"
            own, more = self.alone(scope, e[1])
            shared = {v: b for v, b in more.items() if v in scope}
            keys = [col(f"{v}.{c}") for v, b in shared.items() for c in (("#id", "#label") if b.kind == "node" else ("#src", "#src_label", "#dst", "#dst_label", "#type"))]
            if e[0] == "degree":
                own = own.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
            else:
                own = (own.select(*keys).distinct() if keys else own.limit(1).select()).select("*", F.lit(True).alias(name))
            df, _ = self.joined(df, scope, own, shared, "left")
            return df, ("call", "coalesce", False, ("var", name), ("lit", False if e[0] == "exists" else 0))
        out = []
        for x in e:
            if isinstance(x, tuple) and contains(x, "exists", "degree"):
                df, x = self.flags(df, scope, x)
            out.append(x)
        return df, tuple(out)

    # Expressions

    def value(self, e: tuple, scope: Scope, df: DataFrame) -> Value:
        kind, *args = e
        if kind in ("lit", "param"):
            if kind == "param" and args[0] not in self.params:
                raise AnalysisError(f"parameter ${args[0]} has no value")
            x = self.params[args[0]] if kind == "param" else args[0]
            if isinstance(x, list | tuple):
                return F.array(*map(F.lit, x)), "array"
            return F.lit(x), {bool: "boolean", int: "bigint", float: "double", str: "string", type(None): "void"}.get(type(x), "unknown")
        if kind == "prop":
            if args[0] not in scope or scope[args[0]].kind == "value":
                raise AnalysisError(f"{args[0]} is not a node or relationship")
            return self.column(df, f"{args[0]}.{args[1]}")
        if kind == "var":
            b = scope.get(args[0])
            if b is None or b.kind == "value":
                if args[0] not in df.columns:
                    raise AnalysisError(f"{args[0]} is not bound")
                return self.column(df, args[0])
            return self.entity(df, args[0], b), "struct"
        if kind == "list":
            items = [self.value(x, scope, df) for x in args]
            kinds = {t for _, t in items} - {"void"}
            return F.array(*(x for x, _ in items)), f"array<{kinds.pop()}>" if len(kinds) == 1 else "array"
        if kind == "case":
            *pairs, last = args
            found = [(self.value(c, scope, df)[0], self.value(x, scope, df)) for c, x in pairs]
            end = self.value(last, scope, df)
            out = reduce(lambda w, p: w.when(p[0], p[1][0]), found[1:], F.when(found[0][0], found[0][1][0])).otherwise(end[0])
            return out, next((t for _, (_, t) in [*found, (None, end)] if t != "void"), "void")
        if kind == "call":
            return self.call(args[0], args[1], args[2:], scope, df)
        if kind in ("exists", "degree"):
            raise AnalysisError("a pattern cannot stand here")
        if kind == "star":
            raise AnalysisError("* stands alone or in count(*)")
        if kind == "in":
            return self.among(self.value(args[0], scope, df), args[1], scope, df), "boolean"
        if kind in ("=", "<>") and all(x[0] == "var" and x[1] in scope and scope[x[1]].kind == "node" for x in args):
            (_, x), (_, y) = args
            same = (col(f"{x}.#id") == col(f"{y}.#id")) & (col(f"{x}.#label") == col(f"{y}.#label"))
            return same if kind == "=" else ~same, "boolean"
        values = [self.value(x, scope, df) for x in args]
        if kind in ("+", "-", "*", "/", "%"):
            return arithmetic(kind, *values)
        a, b = (values + [(None, "")])[:2]
        text = kind in ("=~", "contains", "starts", "ends") and {a[1], b[1]} <= {"string", "void"}
        if kind in ("=~", "contains", "starts", "ends"):
            out = F.lit(False) if not text else F.regexp(a[0], F.concat(F.lit("^(?:"), b[0], F.lit(")$"))) if kind == "=~" else {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[kind](a[0], b[0])
        elif kind == "null":
            out = a[0].isNull()
        elif kind == "not":
            out = ~a[0]
        elif kind in ("and", "or"):
            # As values, null counts as false; in WHERE it makes no difference but below NOT, where null stays null.
            x, y = (F.coalesce(v[0], F.lit(False)) if self.strict else v[0] for v in (a, b))
            out = x & y if kind == "and" else x | y
        elif kind == "xor":
            out = a[0] != b[0]
        else:
            out = compared(kind, a, b)
        return out, "boolean"

    def among(self, a: Value, items: tuple, scope: Scope, df: DataFrame) -> Column:
        """Whether a value is equal to one of a list; elements of another type are not."""
        if items[0] == "param" and isinstance(self.params.get(items[1]), list | tuple):
            items = ("list", *(("lit", x) for x in self.params[items[1]]))
        if items[0] != "list":
            whole, kind = self.value(items, scope, df)
            if not kind.startswith("array"):
                raise AnalysisError("IN needs a list")
            return F.exists(whole, lambda x: compared("=", a, (x, kind[6:-1]))) if "<" in kind else F.array_contains(whole, a[0])
        values = [x[1] for x in items[1:] if x[0] == "lit"]
        if values and len(values) == len(items) - 1:
            if a[1] == "string" and all(isinstance(x, str) for x in values) or is_number(a[1]) and all(isinstance(x, int | float) and not isinstance(x, bool) for x in values):
                return a[0].isin(*values)
        return reduce(lambda x, y: x | y, (compared("=", a, self.value(x, scope, df)) for x in items[1:]), F.lit(False))

    @staticmethod
    def column(df: DataFrame, name: str) -> Value:
        """A column by its exact name, or else the only one that differs in case alone; null if there is none."""
        if name not in df.columns:
            alike = [c for c in df.columns if c.lower() == name.lower()]
            if len(alike) != 1:
                return F.lit(None), "void"
            name = alike[0]
        return col(name), df.schema[name].dataType.simpleString()

    @staticmethod
    def entity(df: DataFrame, var: str, b: Bound) -> Column:
        """A node as id, labels, properties; a relationship as id, type, source, target, properties. Null where it isn't bound."""
        here = [c for c in df.columns if c.startswith(f"{var}.") and not c.startswith(f"{var}.#")]
        props = [F.struct(*(col(c).alias(c.split(".", 1)[1]) for c in here)).alias("properties")] if here else []
        if b.kind == "node":
            return F.when(col(f"{var}.#id").isNotNull(), F.struct(col(f"{var}.#id").alias("id"), F.array(col(f"{var}.#label")).alias("labels"), *props))
        src, dst, kind = (col(f"{var}.{k}") for k in ("#src", "#dst", "#type"))
        return F.when(src.isNotNull(), F.struct(F.concat_ws("_", src, kind, dst).alias("id"), kind.alias("type"), src.alias("source"), dst.alias("target"), *props))

    def call(self, name: str, distinct: bool, args: list[tuple], scope: Scope, df: DataFrame) -> Value:
        entity = scope.get(args[0][1]) if args and args[0][0] == "var" else None
        var = args[0][1] if entity else ""
        if entity and entity.kind != "value":
            here = [c for c in df.columns if c.startswith(f"{var}.") and ".#" not in c]
            if name == "id" and entity.kind == "node":
                return self.column(df, f"{var}.#id")
            if name == "labels" and entity.kind == "node":
                return F.array_compact(F.array(col(f"{var}.#label"))), "array"
            if name == "type" and entity.kind == "rel":
                return self.column(df, f"{var}.#type")
            if name == "keys":
                return F.array_compact(F.array(*(F.when(col(c).isNotNull(), F.lit(c.split(".", 1)[1])) for c in here))), "array"
            if name == "properties":
                return F.struct(*(col(c).alias(c.split(".", 1)[1]) for c in here)), "struct"
        if name in AGGREGATES:
            if name == "count" and args and args[0] == ("star",):
                return F.count(F.lit(1)), "bigint"
            if entity and entity.kind != "value":
                keys = ["#id", "#label"] if entity.kind == "node" else ["#src", "#dst", "#type"]
                x: Value = (F.when(col(f"{var}.{keys[0]}").isNotNull(), F.struct(*(col(f"{var}.{k}") for k in keys))), "struct") if distinct or name != "count" else (col(f"{var}.{keys[0]}"), "any")
            else:
                x = self.value(args[0], scope, df)
            if name == "count":
                return (F.count_distinct(x[0]) if distinct else F.count(x[0])), "bigint"
            if name == "collect":
                return (F.collect_set if distinct else F.collect_list)(x[0]), "array"
            f = {"sum": F.sum_distinct if distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name]
            return f(x[0]), "double" if name == "avg" else "bigint" if name == "sum" and x[1] in ("int", "smallint", "tinyint") else x[1]
        if name in ("id", "labels", "keys", "properties"):
            return (F.lit(None), "void") if name in ("id", "properties") else (F.array().cast("array<string>"), "array")
        if name not in FUNCTIONS:
            raise AnalysisError(f"unknown function {name}")
        return FUNCTIONS[name](*(self.value(x, scope, df) for x in args)) if args or name != "type" else (F.lit("NULL"), "string")

    # WITH and RETURN

    def project(self, df: DataFrame, scope: Scope, c: Clause) -> tuple[DataFrame, Scope]:
        items = []
        for e, name in c.items:
            if e[0] == "star":
                items += [(("var", v), v) for v in scope if not v.startswith("#")]
            else:
                items.append((e, name))
        last = c.kind == "RETURN"
        for i, (e, name) in enumerate(items):
            if contains(e, "exists", "degree"):
                df, e = self.flags(df, scope, e)
                items[i] = (e, name)
        self.strict = True
        columns: list[tuple[str, Column, tuple]] = []
        new: Scope = {}
        for e, name in items:
            b = scope.get(e[1]) if e[0] == "var" else None
            if not last and b and b.kind != "value":
                columns += [(f"{name}.{x.split('.', 1)[1]}", col(x), e) for x in df.columns if x.startswith(f"{e[1]}.")]
                new[name] = b
            else:
                columns.append((name, self.value(e, scope, df)[0], e))
                new[name] = Bound("value")
        names = [n for n, _, _ in columns]
        if len(set(names)) < len(names):
            raise AnalysisError("two columns have the same name")
        grouped = any(_aggregates(e) for e, _ in items)
        hidden: list[str] = []
        keys: list[Column] = []
        if grouped:
            plain = [x.alias(n) for n, x, e in columns if not _aggregates(e)]
            sums = [x.alias(n) for n, x, e in columns if _aggregates(e)]
            df = (df.groupBy(*plain) if plain else df.groupBy()).agg(*sums).select(*map(col, names))
        else:
            extra = []
            for e, _ in c.order:
                if not any(e == x or e == ("var", n) for x, n in items) and not c.distinct:
                    hidden.append(f"#o{len(hidden)}")
                    extra.append(self.value(_renamed(e, dict((n, x) for x, n in items)), scope, df)[0].alias(hidden[-1]))
            df = df.select(*(x.alias(n) for n, x, _ in columns), *extra)
            if c.distinct:
                df = df.distinct()
        left = iter(hidden)
        for e, down in c.order:
            match = next((n for x, n in items if e == x or e == ("var", n)), None)
            if match is None and (grouped or c.distinct):
                key = self.value(e, new, df)[0]
            else:
                key = col(match if match is not None else next(left))
            keys.append(key.desc_nulls_first() if down else key.asc_nulls_last())
        if keys:
            df = df.orderBy(*keys)
        if c.skip is not None:
            df = df.offset(self.constant(c.skip))
        if c.limit is not None:
            df = df.limit(self.constant(c.limit))
        self.strict = False
        df = df.select(*map(col, names)) if hidden else df
        return self.where(df, new, c.where), new

    def constant(self, e: tuple) -> int:
        x = self.params.get(e[1]) if e[0] == "param" else e[1] if e[0] == "lit" else None
        if not isinstance(x, int) or x < 0:
            raise AnalysisError("SKIP and LIMIT need a whole number")
        return x


def _aggregates(e: object) -> bool:
    return isinstance(e, tuple) and (e[:1] == ("call",) and e[1] in AGGREGATES or any(map(_aggregates, e)))


def _renamed(e: tuple, named: dict[str, tuple]) -> tuple:
    """An ORDER BY expression with aliases put back to what they name."""
    if e[0] == "var" and e[1] in named:
        return named[e[1]]
    return tuple(_renamed(x, named) if isinstance(x, tuple) else x for x in e)
