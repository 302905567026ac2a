"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses. Words become symbols: insults, verbs of harm, words of intent, targets, negations, verbs of saying; others
are a gap. Five transducers are composed: negation marks what stands in its scope; the threat transducer makes a threat of intent
followed by harm, and drops harm without intent; the insult transducer joins insults in a row; reported speech marks what follows a
verb of saying; the target transducer joins insults and threats with whom they aim at. A clause counts once, as the strongest
event in it, with the weight of all; a negated or reported insult is excused. A logistic model over a text's clauses gives its score.

No insult is written here: insult words, and beginnings of words, are learned from labelled rows. At least STEM_SHARE of the
toxic rows hold one, and LEAST rows, as below that chance alone brings up such stems among the very many there are; and it is
LIFT times as frequent there as elsewhere. SAMPLE_ROWS bounds the labelled rows that are used.

Cases: a null or empty text has no events and gets the score of the intercept; without labelled rows of both kinds there are no insult
stems, and the grammar's own weights decide; equal texts with both labels are one toxic row; repeated rows get equal scores; very
long texts are read whole; ids are only carried along, other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunks, persisted
from graphloom.llm.words import HashIndex, hashed, split

# Words of the grammar, by symbol.
LEXICON = {
    "H": "kill hurt destroy stab shoot strangle beat burn crush hang töten schlagen umbringen vernichten tuer frapper détruire brûler matar golpear destruir quemar",
    "M": "will shall gonna going must should ll werde werden wird soll sollte vais va vont dois doit voy vamos debe debo",
    "Y": "you your yours he him she her they them du dich ihr tu toi vous usted ustedes",
    "N": "not never no nicht kein keine nie pas jamais nunca ni",
    "R": "said says wrote called claimed quoted sagte schrieb dit écrit dijo escribió",
}
SYMBOLS = "IHMYNR_"
#: Words that a negation reaches; words between intent and harm.
SCOPE, REACH = 3, 4
PREFIXES = range(4, 9)
SAMPLE_ROWS = 8000
STEM_SHARE, LEAST, LIFT = 0.02, 6, 20.0
#: Kinds of clauses from the weakest to the strongest.
EVENTS = ("excused", "insult", "threat", "aimed_insult", "aimed_threat")
_U = np.uint64


class Transducer:
    """Deterministic: arcs[state][symbol] = (next state, output symbols, weight). Unlisted symbols pass through unchanged."""

    def __init__(self, arcs: dict) -> None:
        self.arcs = arcs

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get(state, {}).get(symbol, (state, (symbol,), 0.0))

    def then(self, other: Transducer, symbols: str, start=0) -> Transducer:
        """The composition: what this one puts out, the other takes in. Weights add up."""
        arcs, todo = {}, [(start, 0)]
        while todo:
            a, b = pair = todo.pop()
            if pair in arcs:
                continue
            arcs[pair] = {}
            for x in symbols:
                a2, middle, weight = self.step(a, x)
                state, out = b, []
                for y in middle:
                    state, more, w = other.step(state, y)
                    out += more
                    weight += w
                arcs[pair][x] = ((a2, state), tuple(out), weight)
                todo.append((a2, state))
        return Transducer(arcs)


def _negation() -> Transducer:
    arcs = {k: {"N": (SCOPE, (), 0.0), "_": (max(0, k - 1), ("_",), 0.0)} for k in range(SCOPE + 1)}
    for k in range(1, SCOPE + 1):
        arcs[k] |= {"I": (0, ("X",), 0.0), "H": (0, ("_",), 0.0)}
    return Transducer(arcs)


def _threat() -> Transducer:
    """State k: intent was named, and harm may follow within k words."""
    arcs = {0: {"M": (REACH, (), 0.0), "H": (0, ("_",), 0.0)}}
    for k in range(1, REACH + 1):
        arcs[k] = {"M": (REACH, (), 0.0), "H": (0, ("T",), 0.0), "_": (k - 1, ("_",), 0.0)}
    return Transducer(arcs)


def _insult() -> Transducer:
    """Insults in a row are one, of more weight."""
    return Transducer({0: {"I": (1, ("I",), 0.0)}, 1: {"I": (1, (), 0.5), "_": (0, ("_",), 0.0), "Y": (0, ("Y",), 0.0), "T": (0, ("T",), 0.0), "R": (0, ("R",), 0.0)}})


def _report() -> Transducer:
    return Transducer({0: {"R": (1, (), 0.0)}, 1: {"R": (1, (), 0.0), "I": (1, ("X",), 0.0), "T": (1, ("X",), 0.0)}})


def _target() -> Transducer:
    """States: 0 nothing yet, 1 a target was named, 2 an insult waits for its target."""
    free = {"I": (2, ("insult",), 1.0), "T": (0, ("threat",), 1.5), "X": (0, ("excused",), 0.1), "Y": (1, (), 0.0), "_": (0, (), 0.0)}
    aimed = {"I": (1, ("aimed_insult",), 2.0), "T": (1, ("aimed_threat",), 2.5), "X": (1, ("excused",), 0.1), "Y": (1, (), 0.0), "_": (1, (), 0.0)}
    waits = free | {"T": (2, ("threat",), 1.5), "Y": (1, ("aimed_insult",), 1.0), "_": (2, (), 0.0)}
    return Transducer({0: free, 1: aimed, 2: waits})


def grammar() -> Transducer:
    out, start = _negation(), 0
    for t in (_threat(), _insult(), _report(), _target()):
        out, start = out.then(t, SYMBOLS, start), (start, 0)
    return out


#: Of the composed grammar.
START = ((((0, 0), 0), 0), 0)


@dataclass
class Model:
    stems: np.ndarray
    #: intercept; a weight for the log count of each kind of clause, for the log of the whole weight, and for that of 100 words.
    weights: np.ndarray


class Reader:
    def __init__(self, stems: np.ndarray) -> None:
        known = {hashed(w.encode()): s for s, ws in LEXICON.items() for w in ws.split()}
        self.symbol = np.array([known[k] for k in sorted(known)])
        self.words = HashIndex(np.array(sorted(known), _U))
        self.stems = HashIndex(stems.astype(_U))
        self.grammar = grammar()

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, clauses with events) of each text"""
        n = len(offsets) - 1
        counts, total = np.zeros((n, len(EVENTS))), np.zeros(n)
        w = split(data, offsets)
        symbols = np.full(len(w.hash), "", "U1")
        for at in [self.stems.find(w.hash)[0], *(p[self.stems.find(h)[0]] for p, h in (w.prefix(k) for k in PREFIXES))]:
            symbols[at] = "I"
        at, k = self.words.find(w.hash)
        symbols[at] = self.symbol[k]
        hits = np.flatnonzero(symbols != "")
        # Only clauses with an insult or harm can hold an event.
        ends = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".!?;\n|", np.uint8)))])
        clause, doc = ends[w.start[hits]], w.doc[hits]
        number = np.concatenate([[0], np.cumsum((np.diff(clause) != 0) | (np.diff(doc) != 0))]) if len(hits) else np.zeros(0, int)
        strong = np.zeros(int(number[-1]) + 1 if len(number) else 0, bool)
        strong[number[np.isin(symbols[hits], ["I", "H"])]] = True
        some = strong[number] if len(number) else np.zeros(0, bool)
        hits, doc, number = hits[some], doc[some], number[some]
        for part in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(number)) + 1) if len(hits) else []:
            state, last, weight, best = START, hits[part[0]], 0.0, -1
            for i in part:
                for x in "_" * min(max(SCOPE, REACH), int(hits[i] - last - 1)) + symbols[hits[i]] if i != part[0] else symbols[hits[i]]:
                    state, out, more = self.grammar.step(state, x)
                    weight += more
                    best = max([best, *map(EVENTS.index, out)])
                last = hits[i]
            if best >= 0:
                counts[doc[part[0]], best] += 1
                total[doc[part[0]]] += weight
        return np.log1p(np.column_stack([counts, total, 100 * total / np.maximum(np.diff(w.first), 1)])), counts.sum(1).astype(np.int64)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method."""
    prior = np.array([-2.0, *[0.0] * len(EVENTS), 4.0, 0.0])
    if not len(y) or y.min() == y.max():
        return prior
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + ridge * w * (np.arange(len(w)) > 0)
        move = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), slope)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def learned(train: DataFrame, text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, total: int | None = None) -> Model:
    """A model from labelled rows: at most about so many of them, taken by the hash of their text; total: their number, if known."""
    train = train.where(F.col(label_col).isNotNull())
    share = min(1.0, rows / max(1, train.count() if total is None else total))
    sample = train.select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y")).where(F.col("t").isNotNull())
    if share < 1:
        sample = sample.where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = persisted(sample.groupBy("t").agg(F.max("y").alias("y")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def made() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in held] or [np.zeros(0, _U)])
            c = np.concatenate([x for _, x in held] or [np.zeros((0, 2), np.int64)])
            keys, back = np.unique(h, return_inverse=True)
            sums = [np.bincount(back, c[:, k], len(keys)).astype(np.int64) for k in (0, 1)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, sums)], names=["h", "c0", "c1"])

        for b in batches:
            y = np.array(b.column("y").to_pylist(), np.int64)
            for lo, hi, data, offsets in chunks(b.column("t")):
                w = split(data, offsets)
                h, doc = [w.hash], [w.doc]
                for k in PREFIXES:
                    at, p = w.prefix(k)
                    h.append(p)
                    doc.append(w.doc[at])
                h, doc = np.concatenate(h), np.concatenate(doc)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, own = h[new], y[lo:hi][doc[new]]
                keys, back = np.unique(h, return_inverse=True)
                held.append((keys, np.column_stack([np.bincount(back, own == k, len(keys)) for k in (0, 1)]).astype(np.int64)))
                size += len(keys)
                if size > 1 << 20:
                    yield made()
                    size = 0
        yield made()

    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    stems = np.zeros(0, _U)
    if n.get(0) and n.get(1):
        c = sample.mapInArrow(count, "h bigint, c0 bigint, c1 bigint").groupBy("h").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        c = c.where((F.col("c1") >= max(LEAST, STEM_SHARE * n[1])) & (F.col("c1") * n[0] >= LIFT * (F.col("c0") + 0.5) * n[1]))
        stems = c.select("h").toArrow().column(0).to_numpy().astype(np.int64).view(_U)
    got = _events(sample, stems, "y int", ["y"]).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(EVENTS) + 2)
    return Model(np.sort(stems), fitted(x, got.column("y").to_numpy().astype(float)))


def _events(rows: DataFrame, stems: np.ndarray, kept: str, names: list[str]) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stems)
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column("t")):
                x, clauses = reader.features(data, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), flat, pa.array(clauses)], names=[*names, "x", "clauses"])

    return rows.mapInArrow(read, f"{kept}, x array<double>, clauses bigint")


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, score (0 to 1), clauses (clauses with events)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = _events(rows, model.stems, f"id {rows.schema['id'].dataType.simpleString()}", ["id"])
    line = F.lit(float(model.weights[0]))
    for i, w in enumerate(model.weights[1:]):
        line = line + F.col("x")[i] * float(w)
    return out.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-line))).alias("score"), "clauses")
