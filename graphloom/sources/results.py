"""Results of queries: rows on the driver for small results, and folders of files, written by the executors, for all others."""

from __future__ import annotations

import csv
import datetime
import decimal
import io
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Items of a list that a table of text shows.
LIST_ITEMS = 100


def plain(x: object) -> object:
    """A value of a row in what JSON knows."""
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    if isinstance(x, datetime.datetime | datetime.date):
        return x.isoformat()
    if isinstance(x, datetime.timedelta):
        return x.total_seconds()
    if isinstance(x, decimal.Decimal):
        return float(x)
    return x.hex() if isinstance(x, bytes | bytearray) else x


@dataclass
class ResultSet:
    """The rows of a lazy result, fetched when first asked for; `df` is the result itself."""

    df: DataFrame
    statistics: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    _rows: list[dict] | None = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def data(self) -> list[list]:
        return [list(r.values()) for r in self.to_dict_records()]

    def to_dict_records(self) -> list[dict]:
        if self._rows is None:
            self._rows = [{k: plain(v) for k, v in zip(self.columns, r, strict=True)} for r in self.df.collect()]
        return self._rows

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps({"columns": self.columns, "data": self.data, "statistics": self.statistics, "metadata": self.metadata}, indent=indent, ensure_ascii=False)

    def to_csv(self, sep: str = ",") -> str:
        """A header and rows: text is quoted, null is empty, lists and structures are JSON text."""
        out = io.StringIO()
        w = csv.writer(out, delimiter=sep, quoting=csv.QUOTE_STRINGS, lineterminator="\n")
        w.writerow(self.columns)
        for r in self.data:
            w.writerow([json.dumps(x, ensure_ascii=False) if isinstance(x, list | dict) else str(x).lower() if isinstance(x, bool) else x for x in r])
        return out.getvalue()

    def to_table(self, max_width: int = 30) -> str:
        """Aligned columns under a line of dashes; longer values end in an ellipsis."""

        def cell(x: object) -> str:
            if isinstance(x, list) and len(x) > LIST_ITEMS:
                x = [*x[:LIST_ITEMS], f"... {len(x) - LIST_ITEMS} more"]
            text = "null" if x is None else json.dumps(x, ensure_ascii=False) if isinstance(x, list | dict | bool) else str(x)
            return text if len(text) <= max_width else text[: max_width - 1] + "…"

        rows = [self.columns, *([cell(x) for x in r] for r in self.data)]
        rows[0] = [cell(c) for c in rows[0]]
        widths = [max(len(r[i]) for r in rows) for i in range(len(self.columns))]
        lines = [" | ".join(x.ljust(n) for x, n in zip(r, widths, strict=True)).rstrip() for r in rows]
        return "\n".join([lines[0], "-+-".join("-" * n for n in widths), *lines[1:]])


def _flat(df: DataFrame) -> list[Column]:
    """Columns that text formats can hold: lists, maps and structures become JSON text."""
    deep = ("array", "map", "struct")
    return [(F.to_json(F.col(f"`{f.name}`")) if f.dataType.simpleString().startswith(deep) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Files of quoted text with a header each."""
    df.select(*_flat(df)).write.mode("errorifexists").option("quoteAll", True).option("escape", '"').option("sep", sep).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Files of one JSON object a line; null fields are kept."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
