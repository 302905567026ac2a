"""Language identification by interpolated Kneser-Ney character models, one for each language.

Training counts 5-grams of all training rows in the tasks and adds them up by key; lower orders follow from the distinct
higher ones. For each order, a sorted array of 64-bit hashes of all languages' n-grams, with an index over the hashes' first
bits, has the log-probability in each language beside it. Every 5-gram of the training rows is in the model, so it grows with
the number of distinct ones.

It is therefore fitted and kept in shards. The symbols third and second from the end of an n-gram name its shard, so that a shard
has all that orders 3 to 5 need at a place of a text: the n-grams, their contexts and the counts they continue. Tasks fit one shard
each. The driver holds one at a time, on its way to a file in the shared folder that executors map into memory (see shared_file).
Orders 1 and 2, the head, are broadcast: their size is bounded by the square of the alphabet, whatever the corpus.

A text is lower-cased and its letters are kept; other characters are one space. The language of the lowest cross-entropy per
character wins. A text is rejected if that cross-entropy lies far above what training texts of its length have; the
border is calibrated on all training rows.

The score is the chance of the language among those known, for a text of its cross-entropies and of 64 characters at most: longer
texts would all have a score of 1.

Cases: a null text or one without letters is `und` with score 0 and is rejected; ties go to the language first in sorted order;
without training rows everything is `und`; repeated rows are counted and judged as often as they come; very long texts are read whole;
a kept column of the name of a result gives way to it; an empty table gives no rows.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from graphloom.llm.common import chunks, fetched, persisted, shared_file, trim
from graphloom.llm.words import mix

ORDER = 5
#: Orders that are kept in shards, down to the lowest.
UPPER = range(ORDER, 2, -1)
#: Distinct 5-grams of languages in a shard, about. Measured with four languages: 52 bytes each in the file, 255 while it is fitted.
SHARD_GRAMS = 500_000
MIN_SHARDS = 8
#: Symbols of a text that its score counts at most.
EVIDENCE = 64
#: Bytes of text that are judged at once: each takes about 100 bytes of arrays.
CHUNK = 1 << 18
#: Distinct n-grams of a task after which what it holds is merged.
MERGE = 1 << 19
#: Columns that identified() adds.
RESULTS = ("lang_pred", "score", "entropy", "n_symbols", "rejected")
#: Ranges that values are counted in when one of a given rank is sought, and values that are collected for it at most.
RANGES = 4096
RANKED = 1 << 16
_U = np.uint64
_SPACE = 32
_table: np.ndarray | None = None


def _symbols() -> np.ndarray:
    """Lower-case letter, or space, for each code point of the first plane; letters of other planes stay as they are."""
    global _table
    if _table is None:
        _table = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else _SPACE for c in range(0x10000)], np.uint32)
    return _table


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, start of each text in them with the end, letters of each text). Each text begins with ORDER - 1 spaces."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    at = before[offsets]
    s = _symbols()[np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        far = points > 0xFFFF
        values, back = np.unique(points[far], return_inverse=True)
        s[far] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else _SPACE for c in values], np.uint32)[back]
    letter = s != _SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    edges = at[:-1][at[:-1] < len(s)]
    keep[edges] = letter[edges]
    kept = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    letters = np.zeros(len(s) + 1, np.int64)
    np.cumsum(letter, out=letters[1:])
    sizes = np.diff(kept[at])
    pad = ORDER - 1
    starts = np.zeros(len(at), np.int64)
    np.cumsum(sizes + pad, out=starts[1:])
    out = np.full(int(starts[-1]), _SPACE, np.uint32)
    place = np.arange(int(kept[-1])) + np.repeat(pad * (np.arange(len(sizes)) + 1), sizes)
    out[place] = s[keep]
    return out, starts, np.diff(letters[at])


def hashes(grams: np.ndarray) -> np.ndarray:
    """Hashes of n-grams in rows; columns are symbols."""
    h = np.full(len(grams), grams.shape[1], _U)
    for i in range(grams.shape[1]):
        h = h * _U(0x9E3779B97F4A7C15) + grams[:, i].astype(_U) + _U(1)
    return mix(h)


def rolling(s: np.ndarray, at: np.ndarray, order: int, back: int = 0) -> np.ndarray:
    """Hashes of the n-grams of this order that end `back` symbols before the positions."""
    h = np.full(len(at), order, _U)
    for i in range(order - 1, -1, -1):
        h = h * _U(0x9E3779B97F4A7C15) + s[at - i - back].astype(_U) + _U(1)
    return mix(h)


class SortedHashes:
    """A sorted hash array with the first place of each leading bit pattern."""

    def __init__(self, keys: np.ndarray, first: np.ndarray | None = None) -> None:
        self.keys = keys
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        if first is None:
            head = (keys >> _U(64 - self.bits)).astype(np.int64)
            first = np.searchsorted(head, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.first = first

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        head = (h >> _U(64 - self.bits)).astype(np.int64)
        place, end = self.first[head], self.first[head + 1]
        left = np.flatnonzero(place < end)
        place, end, h = place[left], end[left], h[left]
        while len(left):
            k = self.keys[place]
            same = k == h
            out[left[same]] = place[same]
            place = place + 1
            go = ~same & (k < h) & (place < end)
            left, place, end, h = left[go], place[go], end[go], h[go]
        return out


class Level(NamedTuple):
    """One order: n-grams with their log-probabilities, contexts with the log of the weight left to the lower order."""

    grams: SortedHashes
    values: np.ndarray
    contexts: SortedHashes
    rests: np.ndarray

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.grams.keys, self.grams.first, self.values, self.contexts.keys, self.contexts.first, self.rests


def packed(levels: dict[int, Level]) -> bytes:
    """The levels of a shard as bytes: sizes of the arrays, then the arrays, each at a multiple of 8."""
    arrays = [np.ascontiguousarray(x) for k in UPPER for x in levels[k].arrays()]
    head = np.array([len(x) for x in arrays] + [levels[ORDER].values.shape[1]], "<i8")
    return b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in (head, *arrays))


def unpacked(raw: bytes | mmap.mmap) -> dict[int, Level]:
    """What packed() packed, as views of the bytes."""
    kinds = ((_U, 1), (np.int32, 1), (np.float32, 0), (_U, 1), (np.int32, 1), (np.float32, 0))
    *sizes, languages = np.frombuffer(raw, "<i8", len(kinds) * len(UPPER) + 1).tolist()
    at = 8 * (len(sizes) + 1)
    levels = {}
    for j, k in enumerate(UPPER):
        views = []
        for (kind, flat), n in zip(kinds, sizes[j * len(kinds) : (j + 1) * len(kinds)], strict=True):
            x = np.frombuffer(raw, kind, n if flat else n * languages, at)
            at += x.nbytes + -x.nbytes % 8
            views.append(x if flat else x.reshape(n, languages))
        levels[k] = Level(SortedHashes(*views[:2]), views[2], SortedHashes(*views[3:5]), views[5])
    return levels


@lru_cache(256)
def _opened(path: str) -> dict[int, Level]:
    with open(path, "rb") as f:
        return unpacked(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def share_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What decides, modulo the number of shards, on the shard of an n-gram whose last symbol comes after a and b."""
    return (mix(a.astype(_U) * _U(0x9E3779B97F4A7C15) + b.astype(_U)) >> _U(40)).astype(np.int32)


def _sum_found(levels: dict[int, Level], s: np.ndarray, at: np.ndarray, left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Adds to total what these levels say of the places at[left]; returns those whose n-gram is in none."""
    for k in sorted(levels, reverse=True):
        level = levels[k]
        p = at[left]
        place = level.grams.find(rolling(s, p, k))
        hit = place >= 0
        total[left[hit]] += level.values[place[hit]]
        left, p = left[~hit], p[~hit]
        if not len(left):
            break
        if k > 1:
            place = level.contexts.find(rolling(s, p, k - 1, 1))
            hit = place >= 0
            total[left[hit]] += level.rests[place[hit]]
    return left


@dataclass
class Model:
    """head: orders 1 and 2; shards: the other orders, or names of files with them; None stands for a shard without n-grams."""

    languages: list[str]
    head: dict[int, Level]
    floor: np.ndarray
    shards: list[dict[int, Level] | str | None]
    #: Usual cross-entropy and its variances: of texts, and of characters; border in standard deviations.
    usual: tuple[float, float, float, float] = (0.0, 1.0, 1.0, np.inf)

    def shard(self, i: int) -> dict[int, Level]:
        x = self.shards[i]
        return _opened(fetched(x)) if isinstance(x, str) else x or {}

    def entropy(self, s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nats per symbol of each text in each language, symbols of each text)."""
        inside = np.ones(len(s), bool)
        for i in range(ORDER - 1):
            inside[starts[:-1] + i] = False
        at = np.flatnonzero(inside)
        total = np.zeros((len(at), len(self.languages)), np.float32)
        which = share_of(s[at - 2], s[at - 1]) % len(self.shards)
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(len(self.shards) + 1))
        left = [_sum_found(self.shard(i), s, at, order[lo:hi], total) for i, (lo, hi) in enumerate(pairwise(edges.tolist())) if lo < hi]
        rest = _sum_found(self.head, s, at, np.concatenate(left) if left else np.zeros(0, np.int64), total)
        total[rest] += self.floor
        n = np.diff(starts) - (ORDER - 1)
        doc = np.repeat(np.arange(len(n)), n)
        sums = np.stack([np.bincount(doc, total[:, j], len(n)) for j in range(len(self.languages))], 1)
        return -sums / np.maximum(n, 1)[:, None], n

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the language or -1, score, cross-entropy, symbols, rejected) of each text."""
        s, starts, letters = symbols(data, offsets)
        if not self.languages:
            none = np.full(len(letters), -1)
            return none, np.zeros(len(letters)), np.zeros(len(letters)), np.diff(starts) - (ORDER - 1), np.ones(len(letters), bool)
        each, n = self.entropy(s, starts)
        best = each.argmin(1)
        low = each.min(1)
        score = 1 / np.exp(-(each - low[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(1)
        mean, between, within, border = self.usual
        rejected = (low - mean) > border * np.sqrt(between + within / np.maximum(n, 1))
        none = letters == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, 0.0, low), n, rejected | none


def _orders(number: int, owner: np.ndarray, g: np.ndarray, c: np.ndarray, last: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order down to the last: hashes, rows and counts in each language. Lower orders have continuation counts: in how
    many distinct n-grams of a language the shorter one follows."""
    orders = {}
    for k in range(g.shape[1], last - 1, -1):
        h = hashes(g)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        table = np.zeros((len(keys), number))
        np.add.at(table, (back, owner), c)
        orders[k] = (keys, g[first], table)
        if k > last:
            _, one = np.unique(back * number + owner, return_index=True)
            g, owner = g[one][:, 1:], owner[one]
            c = np.ones(len(g))
    return orders


def discount(ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
    """What is taken from each count of an order, by the numbers of n-grams that were counted once and twice in each language."""
    return np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)


def _level(keys: np.ndarray, rows: np.ndarray, table: np.ndarray, less: np.ndarray, base: np.ndarray) -> tuple[Level, np.ndarray]:
    """A level and its probabilities, from the counts, the discounts and the lower order's probabilities."""
    context = hashes(rows[:, :-1]) if rows.shape[1] > 1 else np.zeros(len(rows), _U)
    heads, back = np.unique(context, return_inverse=True)
    total, kinds = np.zeros((len(heads), table.shape[1])), np.zeros((len(heads), table.shape[1]))
    np.add.at(total, back, table)
    np.add.at(kinds, back, table > 0)
    rest = np.where(total > 0, less * kinds / np.maximum(total, 1e-9), 1.0)
    p = np.maximum(table - less, 0) * (table > 0) / np.maximum(total[back], 1e-9) + rest[back] * base
    return Level(SortedHashes(keys), np.log(p).astype(np.float32), SortedHashes(heads), np.log(rest).astype(np.float32)), p


def fitted_head(number: int, owner: np.ndarray, g: np.ndarray, c: np.ndarray, spare: int = 1000) -> tuple[dict[int, Level], np.ndarray]:
    """(orders 1 and 2, log-probabilities of an unseen symbol), from all pairs of symbols with their continuation counts."""
    orders = _orders(number, owner, g, c, 1)
    keys, rows, table = orders[1]
    lower = np.full(number, 1.0 / (len(keys) + spare))
    less = {k: discount((x[2] == 1).sum(0), (x[2] == 2).sum(0)) for k, x in orders.items()}
    one, p = _level(keys, rows, table, less[1], np.broadcast_to(lower, table.shape))
    floor = np.log(lower).astype(np.float32) + (one.rests[0] if len(one.rests) else 0)
    two, _ = _level(*orders[2], less[2], p[np.searchsorted(keys, hashes(orders[2][1][:, 1:]))])
    return {1: one, 2: two}, floor.astype(np.float32)


def fitted_shard(number: int, owner: np.ndarray, g: np.ndarray, c: np.ndarray, less: dict[int, np.ndarray], head: dict[int, Level]) -> dict[int, Level]:
    """Orders 3 to ORDER from all 5-grams of a shard, with the discounts of the whole corpus."""
    levels = {}
    for k, (keys, rows, table) in sorted(_orders(number, owner, g, c, UPPER[-1]).items()):
        below = hashes(rows[:, 1:])
        base = np.exp(head[2].values[head[2].grams.find(below)].astype(np.float64)) if k == UPPER[-1] else p[np.searchsorted(known, below)]
        levels[k], p = _level(keys, rows, table, less[k], base)
        known = keys
    return levels


def fitted(languages: list[str], grams: list[np.ndarray], counts: list[np.ndarray], shards: int = 1) -> Model:
    """A model in memory of 5-gram rows and their counts, one pair for each language."""
    number = len(languages)
    owner = np.concatenate([np.full(len(g), i) for i, g in enumerate(grams)]) if grams else np.zeros(0, int)
    g = np.concatenate(grams) if grams else np.zeros((0, ORDER), np.uint32)
    c = np.concatenate(counts).astype(np.float64) if counts else np.zeros(0)
    orders = _orders(number, owner, g, c, 2)
    less = {k: discount((orders[k][2] == 1).sum(0), (orders[k][2] == 2).sum(0)) for k in UPPER}
    _, pairs, table = orders[2]
    row, who = np.nonzero(table)
    head, floor = fitted_head(number, who, pairs[row], table[row, who])
    which = share_of(g[:, 2], g[:, 3]) % shards
    return Model(languages, head, floor, [fitted_shard(number, owner[which == i], g[which == i], c[which == i], less, head) for i in range(shards)])


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", fold: Column | None = None, folds: Sequence[int] = ()) -> DataFrame:
    """lang, gram (the bytes of ORDER symbols of 32 bits), share (see share_of), n: over all rows with a language; and n_k for each k of
    folds: over those whose fold is k, null if there are none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[int, str], int] = {}
        key, gram, lang, n = np.zeros(0, _U), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        new: list[tuple] = []
        size = 0

        def merged() -> None:
            nonlocal key, gram, lang, n, size
            if not new:
                return
            key, first, back = np.unique(np.concatenate([key, *(x[0] for x in new)]), return_index=True, return_inverse=True)
            n = np.bincount(back, np.concatenate([n, *(x[3] for x in new)])).astype(np.int64)
            gram = np.concatenate([gram, *(x[1] for x in new)])[first]
            lang = np.concatenate([lang, *(x[2] for x in new)])[first]
            new.clear()
            size = 0

        for b in batches:
            own = np.array([names.setdefault(x, len(names)) for x in zip(b.column("f").to_pylist(), b.column("l").to_pylist(), strict=True)], np.int64)
            for lo, hi, data, offsets in chunks(b.column("t"), CHUNK):
                s, starts, _ = symbols(data, offsets)
                inside = np.ones(len(s), bool)
                for i in range(ORDER - 1):
                    inside[starts[:-1] + i] = False
                at = np.flatnonzero(inside)
                who = np.repeat(own[lo:hi], np.diff(starts) - (ORDER - 1))
                k, first, times = np.unique(rolling(s, at, ORDER) + mix(who.astype(_U)), return_index=True, return_counts=True)
                p = at[first]
                new.append((k, np.stack([s[p - i] for i in range(ORDER - 1, -1, -1)], 1), who[first], times))
                size += len(k)
                if size > MERGE:
                    merged()
        merged()
        trim()
        folds, labels = np.array([f for f, _ in names], np.int32), np.array([x for _, x in names], object)
        for lo in range(0, len(key), 50_000):
            part = slice(lo, lo + 50_000)
            raw = np.ascontiguousarray(gram[part].astype("<u4")).tobytes()
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * ORDER), len(key[part]), [None, pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(folds[lang[part]]), pa.array(labels[lang[part]], pa.string()), flat.cast(pa.binary()), pa.array(share_of(gram[part][:, 2], gram[part][:, 3])), pa.array(n[part])], names=["fold", "lang", "gram", "share", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select((F.lit(0) if fold is None else fold).cast("int").alias("f"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"))
    return rows.mapInArrow(count, "fold int, lang string, gram binary, share int, n bigint").groupBy("lang", "gram", "share").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("fold") == k, F.col("n"))).alias(f"n_{k}") for k in folds))


def _rows(found: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(languages, n-grams of this size, counts) in the order of the hashes, so that the model doesn't depend on the rows' order."""
    raw = b"".join(found.column("gram").to_pylist())
    g = np.frombuffer(raw, "<u4").reshape(-1, size)
    who, n = found.column("who").to_numpy().astype(np.int64), found.column("n").to_numpy().astype(np.float64)
    order = np.lexsort((who, hashes(g)))
    return who[order], g[order], n[order]


def ranked(values: DataFrame, ranks: list[int], n: int) -> dict[int, float]:
    """The exact values at these ranks, from 0, of the n values in column v. Counts by range come to the driver, then the values of
    the ranges that hold a rank, if these are few; a range of many is divided again."""
    if n <= RANKED:
        every = np.sort(values.toArrow().column("v").to_numpy())
        return {r: float(every[r]) for r in ranks}
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    if lo == hi:
        return dict.fromkeys(ranks, lo)
    place = F.least(F.floor((F.col("v") - lo) / (hi - lo) * RANGES), F.lit(RANGES - 1))
    found, before = {}, 0
    for r in sorted(values.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()):
        inside = [k - before for k in ranks if before <= k < before + r["n"]]
        if inside:
            found |= {before + k: v for k, v in ranked(values.where(F.col("v").between(r["lo"], r["hi"])), inside, r["n"]).items()}
        before += r["n"]
    return found


def quantiles(values: DataFrame, shares: list[float], n: int) -> list[float]:
    """As numpy's, of the n values in column v."""
    at = [(int((n - 1) * q), (n - 1) * q % 1) for q in shares]
    found = ranked(values, sorted({min(k + i, n - 1) for k, _ in at for i in (0, 1)}), n)
    return [found[k] + (found[min(k + 1, n - 1)] - found[k]) * part for k, part in at]


def calibrated(got: DataFrame) -> tuple[float, float, float, float] | None:
    """Model.usual of the cross-entropies (entropy, n_symbols) of all training texts; None if they are under 20."""
    n = got.count()
    if n < 20:
        return None
    e, x = F.col("entropy"), 1 / F.greatest(F.col("n_symbols"), F.lit(1))
    (mean,) = quantiles(got.select(e.alias("v")), [0.5], n)
    off = (e - mean) * (e - mean)
    middle, most = quantiles(got.select(off.alias("v")), [0.5, 0.99], n)
    y = F.least(off, F.lit(most))
    xy, mx, my, spread = got.agg(F.avg(x * y), F.avg(x), F.avg(y), F.var_pop(x)).first()
    within = max((xy - mx * my) / max(1e-12, spread), 1.0) if spread > 0 else 1.0
    between = max(1e-4, middle)
    (far,) = quantiles(got.select(((e - mean) / F.sqrt(between + within * x)).alias("v")), [0.999], n)
    return mean, between, within, max(6.0, 1.5 * far)


def learned(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_grams: int = SHARD_GRAMS) -> Model:
    """A model of all rows of docs that have a language, with a calibrated border of rejection."""
    return _learned(persisted(counted(docs, text_col, lang_col)), docs, text_col, lang_col, shard_grams)


def learned_apart(docs: DataFrame, fold: Column, folds: list[int], text_col: str = "text", lang_col: str = "lang", shard_grams: int = SHARD_GRAMS) -> Iterator[Model]:
    """For each of the folds the model of all rows outside it that have a language, so that no text is judged by a model that has learned
    it. The rows are counted once."""
    counts = persisted(counted(docs, text_col, lang_col, fold, folds))
    for k in folds:
        others = counts.select("lang", "gram", "share", (F.col("n") - F.coalesce(f"n_{k}", F.lit(0))).alias("n")).where("n > 0")
        yield _learned(others, docs.where(fold != k), text_col, lang_col, shard_grams)


def _learned(counts: DataFrame, docs: DataFrame, text_col: str, lang_col: str, shard_grams: int) -> Model:
    """The model of docs, of which these are the counts."""
    sizes = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().toLocalIterator()}
    languages = sorted(sizes)
    if not languages:
        return fitted([], [], [])
    who = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])[F.col("lang")].alias("who")
    level = counts.select(who, "gram", "n")
    tallies = []
    for k in range(ORDER, 1, -1):
        if k < ORDER:
            # Continuation counts: each row of the higher order is one distinct n-gram of its language.
            level = level.groupBy("who", F.substring("gram", 5, 4 * k).alias("gram")).agg(F.count("*").alias("n"))
        if k in UPPER:
            tallies.append(level.groupBy("who").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).select(F.lit(k).alias("k"), "*"))
    number = len(languages)
    ones, twos = np.zeros((ORDER + 1, number)), np.zeros((ORDER + 1, number))
    for r in reduce(DataFrame.unionAll, tallies).collect():
        ones[r["k"], r["who"]], twos[r["k"], r["who"]] = r["ones"], r["twos"]
    less = {k: discount(ones[k], twos[k]) for k in UPPER}
    head, floor = fitted_head(number, *_rows(level.toArrow(), 2))

    spark = docs.sparkSession
    shards = max(MIN_SHARDS, -(-sum(sizes.values()) // shard_grams))
    shared = spark.sparkContext.broadcast((less, head))

    def fit(found: pa.Table) -> pa.Table:
        part = packed(fitted_shard(number, *_rows(found, ORDER), *shared.value))
        return pa.table({"shard": found.column("shard").slice(0, 1), "part": pa.array([part], pa.binary())})

    dealt = counts.select(F.pmod("share", F.lit(shards)).alias("shard"), who, "gram", "n").repartition(2 * shards, "shard")
    fits = persisted(dealt.groupBy("shard").applyInArrow(fit, "shard int, part binary"))
    names: list = [None] * shards
    for r in fits.coalesce(shards).toLocalIterator():
        names[r["shard"]] = shared_file(spark, r["part"])
    model = Model(languages, head, floor, names)
    # Dealt out, as a checkpoint would judge the texts twice.
    got = identified(docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), model, text_col, keep=[])
    usual = calibrated(persisted(got.where("lang_pred != 'und'").select("entropy", "n_symbols").repartition(spark.sparkContext.defaultParallelism)))
    if usual:
        model.usual = usual
    return model


def judged(docs: DataFrame, model: Model, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """kept (a struct of the columns to keep; 0 if there are none), lang_pred, score, entropy (nats per symbol), n_symbols, rejected.

    A text that is kept under its own name goes to the tasks' Python once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = next((i for i, k in enumerate(keep) if isinstance(k, str) and k == text_col), None)
    rows = docs.select(F.struct(*keep).alias("kept") if keep else F.lit(0).alias("kept"), *([F.col(text_col).alias("t")] if place is None else []))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for b in batches:
            parts = []
            for _, _, data, offsets in chunks(b.column("t") if place is None else b.column("kept").field(place), CHUNK):
                parts.append(m.judge(data, offsets))
            who, score, low, n, rejected = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), *(np.zeros(0) for _ in range(2)), np.zeros(0, int), np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(names[who], pa.string()), pa.array(score), pa.array(low), pa.array(n.astype(np.int64)), pa.array(rejected)], names=["kept", "lang_pred", "score", "entropy", "n_symbols", "rejected"])
        trim()

    kinds = dict(zip(RESULTS, (StringType(), DoubleType(), DoubleType(), LongType(), BooleanType()), strict=True))
    return rows.mapInArrow(judge, StructType([StructField("kept", rows.schema["kept"].dataType), *(StructField(k, t) for k, t in kinds.items())]))


def identified(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """docs' kept columns (all, if none are named) with the results of judged()."""
    keep = [c for c in docs.columns if c not in RESULTS] if keep is None else keep
    return judged(docs, model, keep, text_col).select(*(["kept.*"] if keep else []), *RESULTS)
