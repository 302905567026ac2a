"""Benchmark decontamination: a generalised suffix automaton of the normalised test items, fed with the words of each text.

The automaton is built on the driver from the test items, in flat arrays. Items are few and small; if their texts exceed
SHARD_BYTES, they are dealt into shards of about that size, each with an automaton and a pass of its own, so that neither the
driver nor a task ever holds more than one shard. Every pass reads the original texts; hit spans of all shards are gathered by the
text's two hashes, and merged.

Cases: a null or empty text, or one without words, has n_words 0 and no hit; a null item has no words and no window;
repeated items are one item; repeated documents are judged alike, each in its own row; an empty benchmark hits nothing; very long
texts are read whole; windows that overlap or touch are one span.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunks, persisted, sized, trimming
from graphloom.llm.words import LOW, HashIndex, Words, mix, split

WINDOW = 10
#: An automaton takes about 35 bytes for each byte of items: about 150 MB in a task.
SHARD_BYTES = 4 << 20
_SPANS = "array<struct<lo:bigint,hi:bigint,from:bigint,to:bigint>>"


class Automaton:
    """A suffix automaton of several word sequences, with what streaming needs at each state.

    A state's first arc is in two arrays, further ones are in a dictionary that only branching states have.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.items = [i for i, w in items if w]
        sequences = [w for _, w in items if w]
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(x, len(self.ids)) for x in w] for w in sequences]
        self.symbol, self.to = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        for w in coded:
            last = 0
            for x in w:
                last = self._extend(last, x)
        n = len(self.link)
        #: For each state: the state of its last `window` words; the nearest state upwards that ends a short item.
        self.long, self.short = array("i", [-1]) * n, array("i", [-1]) * n
        #: The item whose window a state is, or -2 - k for the k-th of `shared`: windows of several items.
        self.owner = array("i", [-1]) * n
        self.shared: list[tuple[int, ...]] = []
        self.short_items: dict[int, list[tuple[int, int]]] = {}
        for k, w in enumerate(coded):
            if len(w) < window:
                self.short_items.setdefault(self._walk(w), []).append((len(w), k))
                continue
            for i in range(len(w) - window + 1):
                s = self._walk(w[i : i + window])
                old = self.items_of(s)
                if k not in old:
                    self.owner[s] = k if not old else -2 - len(self.shared)
                    if old:
                        self.shared.append((*old, k))
        for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist():
            up = self.link[s]
            if self.length[s] >= window:
                self.long[s] = s if self.length[up] < window else self.long[up]
            self.short[s] = s if s in self.short_items else self.short[up]
        self.least = min([window, *map(len, coded)], default=window)
        text = b" ".join(self.ids)
        heads = split(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hash
        codes = np.array([x for w in coded for x in w], np.int64)
        if self.least == 1:
            grams = heads
        else:
            grams = mix(mix(heads[codes[:-1]]) + heads[codes[1:]])
            ends = np.cumsum(np.array([len(w) for w in coded], np.int64))[:-1]
            grams = np.delete(grams, ends - 1)
        self.grams = HashIndex(grams)

    def items_of(self, state: int) -> tuple[int, ...]:
        k = self.owner[state]
        return () if k == -1 else (k,) if k >= 0 else self.shared[-2 - k]

    def next(self, state: int, x: int) -> int:
        """The state that an arc leads to, or -1."""
        if self.symbol[state] == x:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(x, -1)

    def _put(self, state: int, x: int, to: int) -> None:
        if self.symbol[state] in (-1, x):
            self.symbol[state], self.to[state] = x, to
        else:
            self.more.setdefault(state, {})[x] = to

    def _walk(self, w: list[int]) -> int:
        s = 0
        for x in w:
            s = self.next(s, x)
        return s

    def _add(self, length: int) -> int:
        self.symbol.append(-1)
        self.to.append(0)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, x: int) -> int:
        """The state that p reaches by x, made to have length p + 1."""
        q = self.next(p, x)
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._add(self.length[p] + 1)
        self.symbol[c], self.to[c], self.link[c] = self.symbol[q], self.to[q], self.link[q]
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self.link[q] = c
        while p >= 0 and self.next(p, x) == q:
            self._put(p, x, c)
            p = self.link[p]
        return c

    def _extend(self, last: int, x: int) -> int:
        if self.next(last, x) >= 0:
            return self._split(last, x)
        new, p = self._add(self.length[last] + 1), last
        while p >= 0 and self.next(p, x) < 0:
            self._put(p, x, new)
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, x)
        return new

    def stream(self, run: list[bytes], at: int, spans: list[list[int]], found: set[int]) -> int:
        """Feeds words that start at word number at; adds hit spans, joined where they touch, and items. Returns the longest match."""
        s = size = longest = 0
        for i, word in enumerate(run, at):
            x = self.ids.get(word, -2)
            to = self.next(s, x)
            while s and to < 0:
                s = self.link[s]
                size = self.length[s]
                to = self.next(s, x)
            if to < 0:
                size = 0
                continue
            s = to
            size += 1
            longest = max(longest, size)
            hit = 0
            if size >= self.window:
                hit = self.window
                found.update(self.items_of(self.long[s]))
            t = self.short[s]
            while t > 0:
                for n, k in self.short_items[t]:
                    if n <= size:
                        found.add(k)
                        hit = max(hit, n)
                t = self.short[self.link[t]] if self.link[t] > 0 else -1
            if hit:
                lo = i - hit + 1
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append([lo, i + 1])
        return longest


def runs(w: Words, a: Automaton) -> Iterator[tuple[int, int]]:
    """(first, end) numbers of words between which a window can lie: each pair of neighbours occurs in an item."""
    if not len(w.hash):
        return
    if a.least == 1:
        at, _ = a.grams.find(w.hash)
        more = 0
    else:
        at, _ = a.grams.find(mix(mix(w.hash[:-1]) + w.hash[1:]))
        at = at[w.doc[at] == w.doc[at + 1]]
        more = 1
    if not len(at):
        return
    cut = np.flatnonzero((np.diff(at) != 1) | (w.doc[at[1:]] != w.doc[at[:-1]])) + 1
    lo = at[np.concatenate([[0], cut])]
    hi = at[np.concatenate([cut - 1, [len(at) - 1]])] + 1 + more
    for i in np.flatnonzero(hi - lo >= a.least):
        yield int(lo[i]), int(hi[i])


def judged(texts: pa.Array, a: Automaton) -> Iterator[tuple[int, int, list[list[int]], list[list[int]], set[int], int]]:
    """For each text: its number, words, hit spans in words, the same in bytes, items, longest match."""
    for lo, hi, data, offsets in chunks(texts):
        w = split(data, offsets)
        low = LOW[data].tobytes()
        found: dict[int, tuple[list[list[int]], set[int], list[int]]] = {}
        for first, end in runs(w, a):
            d = int(w.doc[first])
            spans, items, longest = found.setdefault(d, ([], set(), []))
            words = [low[s:e] for s, e in zip(w.start[first:end].tolist(), w.end[first:end].tolist(), strict=True)]
            longest.append(a.stream(words, first, spans, items))
        for d in range(hi - lo):
            spans, items, longest = found.get(d, ([], set(), []))
            base = int(w.first[d])
            yield (
                lo + d,
                int(w.first[d + 1]) - base,
                [[x - base, y - base] for x, y in spans],
                [[int(w.start[x] - offsets[d]), int(w.end[y - 1] - offsets[d])] for x, y in spans],
                items,
                max(longest, default=0),
            )


def shards(items: DataFrame, item_id: str = "item_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> tuple[int, Callable[[int], Broadcast]]:
    """The number of shards of about shard_bytes of item texts, and what builds and broadcasts the automaton of one."""
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // shard_bytes) or 1

    def built(k: int) -> Broadcast:
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k)
        rows = []
        for r in part.toLocalIterator():
            data = np.frombuffer(r["t"].encode(), np.uint8)
            w = split(data, np.array([0, len(data)]))
            low = LOW[data].tobytes()
            rows.append((r["id"], [low[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)]))
        return items.sparkSession.sparkContext.broadcast(Automaton(sorted(rows), window))

    return n, built


def _spans(got: list[tuple]) -> pa.Array:
    return pa.array([[{"lo": a, "hi": b, "from": c, "to": d} for (a, b), (c, d) in zip(x[2], x[3], strict=True)] for x in got], pa.list_(pa.struct([(k, pa.int64()) for k in ("lo", "hi", "from", "to")])))


def _scan(docs: DataFrame, automaton: Broadcast) -> DataFrame:
    """What one automaton finds; docs: t and other columns, which are kept instead of it."""
    keep = [c for c in docs.columns if c != "t"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton.value
        for b in batches:
            got = list(judged(b.column("t"), a))
            names = [sorted({a.items[k] for k in x[4]}) for x in got]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([x[1] for x in got], pa.int64()), _spans(got), pa.array(names, pa.list_(pa.string())), pa.array([x[5] for x in got], pa.int64())], names=[*keep, "n_words", "spans", "items", "longest"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "t")
    return docs.mapInArrow(trimming(scan), f"{kept}, n_words bigint, spans {_SPANS}, items array<string>, longest bigint")


def _further(docs: DataFrame, n: int, built: Callable[[int], Broadcast]) -> DataFrame | None:
    """k1, k2, s2, i2, l2: what all shards but the first find in each text that they hit; docs: k1, k2 (hashes of the text), t."""
    hits = None
    for k in range(1, n):
        a = built(k)
        found = persisted(_scan(docs, a).where(F.size("spans") > 0).dropDuplicates(["k1", "k2"]))
        a.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return None
    merged = hits.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("s2"), F.flatten(F.collect_list("items")).alias("i2"), F.max("longest").alias("l2"))
    return sized(persisted(merged), 1024)


def _keys(text_col: str) -> list:
    return [F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(7), text_col).alias("k2")]


def overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_hit, items (sorted ids), longest (longest match in words).

    spans holds the hit words as half-open runs of word numbers (lo, hi) and of bytes of the text (from, to).
    """
    n, built = shards(items, item_id, item_text, window, shard_bytes)
    rows = docs.select(F.col(id_col).alias("id"), *_keys(text_col), F.col(text_col).alias("t"))
    more = _further(rows.drop("id"), n, built)
    out = _scan(rows, built(0))
    if more is not None:
        out = out.join(more, ["k1", "k2"], "left").select(
            "id",
            "n_words",
            F.array_sort(F.concat("spans", F.coalesce("s2", F.array().cast(_SPANS)))).alias("spans"),
            F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i2", F.array().cast("array<string>"))))).alias("items"),
            F.greatest("longest", F.coalesce("l2", F.lit(0))).alias("longest"),
        )
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("bigint"), x["hi"] - F.greatest(x["lo"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["hi"]).alias("to"))
    return out.select(F.col("id").alias(id_col), "n_words", F.aggregate("spans", start, step)["n"].alias("n_hit"), "items", "longest", "spans")


def decontaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.8, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """docs with the hit spans cut out of their texts; documents of which more than max_coverage of the words are hit go.

    A cut leaves a line break. An n_chars column follows the text. Spans of all shards are gathered on the original text, and
    coverage is taken and the text cut once, in the first shard's pass. Documents without a hit stay as they are.
    """
    n, built = shards(items, item_id, item_text, window, shard_bytes)
    schema = docs.schema
    more = _further(docs.select(*_keys(text_col), F.col(text_col).alias("t")), n, built)
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_keys(text_col))
    if more is not None:
        rows = rows.join(more.select("k1", "k2", "s2"), ["k1", "k2"], "left")
    else:
        rows = rows.withColumn("s2", F.lit(None).cast(_SPANS))
    rows = rows.select("row.*", F.col("s2").alias("#spans" + "#" * sum(map(len, docs.columns))))  # a name that no column has
    first = built(0)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            earlier = b.column(b.num_columns - 1).to_pylist()
            b = b.remove_column(b.num_columns - 1)
            at = b.schema.get_field_index(text_col)
            texts, keep, changed = b.column(at), np.ones(b.num_rows, bool), {}
            for i, size, spans, where, _, _ in judged(texts, first.value):
                if spans or earlier[i]:
                    cuts = _merged([*([*x, *y] for x, y in zip(spans, where, strict=True)), *([x["lo"], x["hi"], x["from"], x["to"]] for x in earlier[i] or [])])
                    keep[i] = sum(hi - lo for lo, hi, _, _ in cuts) <= max_coverage * size
                    data, parts, last = texts[i].as_py().encode(), [], 0
                    for _, _, lo, hi in cuts:
                        parts.append(data[last:lo])
                        last = hi
                    changed[i] = b"\n".join([*parts, data[last:]]).decode()
            if changed:
                values = texts.to_pylist()
                for i, x in changed.items():
                    values[i] = x
                b = b.set_column(at, b.schema.field(at), pa.array(values, texts.type))
                if (k := b.schema.get_field_index("n_chars")) >= 0:
                    sizes = b.column(k).to_pylist()
                    for i, x in changed.items():
                        sizes[i] = len(x)
                    b = b.set_column(k, b.schema.field(k), pa.array(sizes, b.column(k).type))
            yield b.filter(pa.array(keep))

    return rows.mapInArrow(trimming(clean), schema)


def _merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order, joined where they touch, as one automaton joins them."""
    out: list[list[int]] = []
    for x in sorted(spans):
        if out and out[-1][1] >= x[0]:
            out[-1][1], out[-1][3] = max(out[-1][1], x[1]), max(out[-1][3], x[3])
        else:
            out.append(list(x))
    return out
