"""Quality classifier from weak labels.

Heuristic labellers vote good, poor or nothing on each text. Texts with the same votes are one row of a table of at most
3 ** labellers rows, counted over all documents. Expectation-maximisation on that table estimates each labeller's rates and
the share of good texts. The posterior of a bounded sample (SAMPLE_ROWS) trains a linear scorer on hashed byte trigrams and on how
much of a text repeats itself.

Cases: a null or empty text is poor: score 0; a table of nothing but such texts, or an empty one, is all 0; texts without words are
judged by their characters alone; repeated rows get equal scores, and very long texts are read whole; ids are only carried along,
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunks
from graphloom.llm.words import WORD, split

BUCKETS = 2048
SAMPLE_ROWS = 4000
#: Features: hashed trigrams; words that repeat the one before; words that stand earlier in the text.
WIDTH = BUCKETS + 2
LABELLERS = ("symbols", "capitals", "word_length", "lines", "stops", "bars", "exclamations", "repeats", "variety", "plain", "marks")
_U = np.uint64


@dataclass
class Model:
    prior: float
    #: rates[k, labeller, vote]: chance of the vote (poor, good) for poor and for good texts, of those it votes on; no vote says nothing: 1.
    rates: np.ndarray
    weights: np.ndarray


def repeated(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of words that repeat the one before, share of words that stand earlier in the text, words) of each text."""
    w = split(data, offsets)
    n = len(offsets) - 1
    words = np.diff(w.first)
    some = np.maximum(words, 1)
    same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    again = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    return np.bincount(w.doc[1:][same], minlength=n) / some, np.bincount(d[1:][again], minlength=n) / some, words


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0 nothing, 1 poor, 2 good: one column for each labeller."""
    w = split(data, offsets)
    size = np.maximum(np.diff(offsets), 1)
    words = np.maximum(np.diff(w.first), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    odd = share(np.isin(data, np.frombuffer(b"#$%&*<>{}[]\\^~=_@", np.uint8))) / size
    capital = share((data >= 65) & (data <= 90)) / size
    chars = np.bincount(w.doc, w.end - w.start, len(size)) / words
    breaks = share(data == 10)
    stops = share(np.isin(data, np.frombuffer(b".!?", np.uint8))) / words
    bars = share(data == 124) / words
    shouts = share(data == 33) / words
    ordinary = WORD[data] | np.isin(data, np.frombuffer(b" \n\t.,;:?'\"()-", np.uint8))
    plain = share(ordinary) / size
    begins = ~ordinary
    begins[1:] &= ordinary[:-1]
    runs = share(begins) / words
    before, earlier, count = repeated(data, offsets)
    out = np.zeros((len(size), len(LABELLERS)), np.int8)

    def rule(k: int, poor: np.ndarray, good: np.ndarray) -> None:
        out[:, k] = np.where(poor, 1, np.where(good, 2, 0))

    rule(0, odd > 0.05, odd < 0.01)
    rule(1, capital > 0.3, capital < 0.1)
    rule(2, (chars < 2) | (chars > 14), (chars > 3) & (chars < 9))
    rule(3, breaks > words / 3, breaks < words / 8)
    rule(4, stops > 0.5, (stops > 0.02) & (stops < 0.3))
    rule(5, bars > 0.2, bars == 0)
    rule(6, shouts > 0.3, shouts < 0.1)
    rule(7, before > 0.2, before < 0.05)
    # These two overlap with the labellers of single marks, so that agreement can be seen.
    rule(9, plain < 0.9, plain > 0.95)
    rule(10, runs > 0.2, runs < 0.05)
    # Short texts say little about variety.
    rule(8, (earlier > 0.7) & (count >= 30), (earlier < 0.55) & (count >= 30))
    return out


def estimated(table: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(share of good texts, rates) by expectation-maximisation; rows of table are patterns of votes that occur n times.

    It starts from the votes weighed by how rare they are: a vote that most texts get says little.
    """
    start = np.zeros(len(table))
    for j in range(table.shape[1]):
        share = (np.bincount(table[:, j], n, 3) + 0.5) / (n.sum() + 1.5)
        start += np.where(table[:, j] == 2, -np.log(share[2]), np.where(table[:, j] == 1, np.log(share[1]), 0.0))
    good = 1 / (1 + np.exp(-np.clip(start, -30, 30)))
    prior = 0.5
    rates = np.ones((2, table.shape[1], 3))
    for _ in range(rounds):
        for k, p in enumerate((1 - good, good)):
            for j in range(table.shape[1]):
                voted = np.bincount(table[:, j], n * p, 3)[1:] + 0.5
                rates[k, j, 1:] = voted / voted.sum()
        new = float((n * good).sum() / max(1, n.sum()))
        good = posterior(table, new, rates)
        if abs(new - prior) < 1e-9:
            break
        prior = new
    return prior, rates


def posterior(table: np.ndarray, prior: float, rates: np.ndarray) -> np.ndarray:
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    log = np.log(prior / (1 - prior)) + sum((np.log(rates[1, j, table[:, j]] / rates[0, j, table[:, j]]) for j in range(table.shape[1])), np.zeros(len(table)))
    return 1 / (1 + np.exp(-np.clip(log, -30, 30)))


def hashed_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams and of repeated words: texts x WIDTH."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    before, earlier, _ = repeated(data, offsets)
    out[:, BUCKETS], out[:, BUCKETS + 1] = np.sqrt(before), np.sqrt(earlier)
    if len(data) < 3:
        return out
    x = data.astype(np.uint32)
    h = ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS - 1).bit_length())
    for i in range(n):
        part = h[offsets[i] : max(offsets[i], offsets[i + 1] - 2)]
        if len(part):
            out[i, :BUCKETS] = np.sqrt(np.bincount(part, minlength=BUCKETS) / len(part))
    return out


def learned(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Rates from the votes on all rows; the scorer from the posteriors of about so many distinct texts."""
    texts = docs.select(F.col(text_col).alias("t")).where(F.octet_length("t") > 0)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for b in batches:
            for _, _, data, offsets in chunks(b.column("t")):
                for p in votes(data, offsets):
                    held[p.tobytes()] = held.get(p.tobytes(), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["p", "n"])

    got = texts.mapInArrow(vote, "p binary, n bigint").groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").toArrow()
    table = np.frombuffer(b"".join(got.column("p").to_pylist()), np.int8).reshape(-1, len(LABELLERS))
    n = got.column("n").to_numpy().astype(float)
    prior, rates = estimated(table, n)
    share = min(1.0, rows / max(1.0, n.sum()))
    sample = texts if share >= 1 else texts.where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column("t")):
                p = posterior(votes(data, offsets), prior, rates)
                x = hashed_features(data, offsets).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array([r.tobytes() for r in x], pa.binary())], names=["p", "x"])

    got = sample.groupBy("t").agg(F.count("*").alias("n")).select("t").mapInArrow(describe, "p double, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return Model(prior, rates, trained(x, got.column("p").to_numpy()))


def trained(x: np.ndarray, p: np.ndarray, rounds: int = 300, rate: float = 4.0, ridge: float = 1e-4) -> np.ndarray:
    """Logistic scorer of soft labels by gradient descent with momentum; the intercept comes last."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    if not len(x):
        return w
    p, before = p.astype(np.float32), w
    for k in range(rounds):
        ahead = w + (w - before) * np.float32(k / (k + 3))
        q = 1 / (1 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -30, 30)))
        slope = np.append(x.T @ (q - p) / np.float32(len(p)) + np.float32(ridge) * ahead[:-1], (q - p).mean())
        before, w = w, ahead - np.float32(rate) * slope.astype(np.float32)
    return w


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, posterior (of the votes), score (of the linear scorer), keep (score >= 0.5)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column("t")):
                some = np.diff(offsets) > 0
                p = np.where(some, posterior(votes(data, offsets), model.prior, model.rates), 0.0)
                q = np.zeros(hi - lo)
                for i in range(0, hi - lo, 512):
                    at = offsets[i : min(i + 512, hi - lo) + 1]
                    x = hashed_features(data[at[0] : at[-1]], at - at[0])
                    q[i : i + 512] = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
                q = np.where(some, q, 0.0)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array(p), pa.array(q), pa.array(q >= 0.5)], names=["id", "posterior", "score", "keep"])

    return rows.mapInArrow(score, f"id {kind}, posterior double, score double, keep boolean").withColumnRenamed("id", id_col)
