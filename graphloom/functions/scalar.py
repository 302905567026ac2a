"""Scalar functions and operators on (Column, type name) values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.sources.catalog import AnalysisError

Value = tuple[Column, str]
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


def is_number(kind: str) -> bool:
    return kind.split("(")[0] in NUMBERS


def _on_text(f: Callable[[Column], Column]) -> Callable[..., Value]:
    return lambda x: (f(x[0]), "string") if x[1] == "string" else x


def _size(x: Value) -> Value:
    if x[1] == "string":
        return F.coalesce(F.length(x[0]), F.lit(0)), "int"
    if x[1].startswith(("array", "map")):
        return F.greatest(F.coalesce(F.size(x[0]), F.lit(0)), F.lit(0)), "int"
    return F.lit(0), "int"


def _type(x: Value) -> Value:
    kind = x[1].split("<")[0].split("(")[0]
    name = {"string": "String", "boolean": "Boolean", "array": "List", "map": "Map", "struct": "Map", "void": "NULL"}.get(kind) or ("Float" if kind in ("float", "double", "decimal") else "Integer" if is_number(kind) else "Unknown")
    return F.when(x[0].isNull(), "NULL").otherwise(name), "string"


def _coalesce(*xs: Value) -> Value:
    return F.coalesce(*(x[0] for x in xs)), next((x[1] for x in xs if x[1] != "void"), "void")


FUNCTIONS: dict[str, Callable[..., Value]] = {
    "upper": _on_text(F.upper),
    "lower": _on_text(F.lower),
    "trim": _on_text(lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")),
    "size": _size,
    "length": lambda x: _size(x) if x[1] == "string" else (F.lit(0), "int"),
    "coalesce": _coalesce,
    "type": _type,
    "abs": lambda x: (F.abs(x[0]), x[1]),
    "round": lambda x, n=None: (F.round(x[0], n[0] if n else 0), x[1]),
    "tostring": lambda x: (x[0].cast("string"), "string"),
    "tointeger": lambda x: (x[0].try_cast("bigint"), "bigint"),
    "tofloat": lambda x: (x[0].try_cast("double"), "double"),
}


def register(name: str, function: Callable[..., Column], kind: str = "string") -> None:
    """Makes a function of columns, whose result has this type, known to queries; its name is read in any case."""
    if name.lower() in AGGREGATES or name.lower() in ("id", "labels", "keys", "properties"):
        raise AnalysisError(f"{name} is a built-in function")
    FUNCTIONS[name.lower()] = lambda *xs: (function(*(x[0] for x in xs)), kind)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    (x, s), (y, t) = a, b
    if op == "+" and "string" in (s, t):
        return F.concat(x.cast("string"), y.cast("string")), "string"
    if not all(is_number(k) or k == "void" for k in (s, t)):
        raise AnalysisError(f"{op} needs numbers, not {s} and {t}")
    kind = "double" if "double" in (s, t) or "float" in (s, t) or op == "/" else "bigint"
    if op == "/":
        return F.try_divide(x.cast("double"), y.cast("double")), kind
    if op == "%":
        # The remainder has the divisor's sign.
        x, y = x.cast(kind), y.cast(kind)
        rest = F.try_mod(x, y)
        return F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest), kind
    return {"+": x + y, "-": x - y, "*": x * y}[op], kind


def compared(op: str, a: Value, b: Value) -> Column:
    """Comparison; text against a number is read as a number where it is one, other mismatches are false."""
    (x, s), (y, t) = a, b
    if "void" not in (s, t) and s != t and not (is_number(s) and is_number(t)):
        if s == "string" and is_number(t):
            x = x.try_cast("double")
        elif t == "string" and is_number(s):
            y = y.try_cast("double")
        elif not {s, t} & {"timestamp_ntz", "timestamp", "date"}:
            return F.lit(False)
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
