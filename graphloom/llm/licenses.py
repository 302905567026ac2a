"""License scans: exact phrases, and a bounded-error search for short notices.

Each notice of the list is allowed a number of edits k. It is cut into k + 1 pieces, of which one must occur unchanged
wherever the notice occurs with at most k edits (pigeonhole). One automaton finds the pieces in the lower-cased text; around each, the
regex library matches the whole notice with at most k errors and reports the span.

Cases: null counts as empty; a text without words has n_words 0, no place and score 0; repeated and overlapping finds of one
notice are reported once, leftmost first; equal texts get equal rows. Texts are searched whole, however long; other columns of the
input are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunks
from graphloom.llm.words import LOW, split

# Phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices, lower case: label and text.
NOTICES = [
    ("notice:mit", "released under the mit license"),
    ("notice:mit", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("notice:apache", "licensed under the apache license, version 2.0"),
    ("notice:gpl", "this work is licensed under the gnu general public license"),
    ("notice:gpl", "this program is free software: you can redistribute it and/or modify"),
    ("notice:cc-by", "licensed under cc by"),
    ("notice:cc-by", "licensed under a creative commons attribution"),
    ("notice:bsd", "redistribution and use in source and binary forms, with or without modification"),
    ("notice:mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("notice:unlicense", "this is free and unencumbered software released into the public domain"),
    ("notice:rights", "all rights reserved"),
]
#: One edit is allowed for so many characters of a notice, so that each exact piece keeps about this length.
CHARS_PER_EDIT = 10

_GAP = rb"[^0-9a-z\x80-\xff]+"
_EDGE = rb"[0-9a-z\x80-\xff]"


def _exact(phrase: str) -> re.Pattern[bytes]:
    return re.compile(rb"(?<!" + _EDGE + rb")" + _GAP.join(map(re.escape, phrase.encode().split())) + rb"(?!" + _EDGE + rb")")


class Notices:
    """The seed automaton of a list of notices, and their bounded-error patterns."""

    def __init__(self, notices: list[tuple[str, str]], chars_per_edit: int = CHARS_PER_EDIT) -> None:
        self.notices = [(label, text, max(1, len(text) // chars_per_edit - 1)) for label, text in notices]
        self.patterns = [regex.compile(rf"(?e)(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}") for _, text, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(self.notices):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.setdefault(text[a:b], []).append((i, a))
        for seed, uses in held.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def find(self, low: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) in a lower-cased text, leftmost first, without overlaps of one notice."""
        windows: dict[int, list[list[int]]] = {}
        for end, (n, uses) in self.seeds.iter(low):
            for i, a in uses:
                text, k = self.notices[i][1:]
                lo = max(0, end + 1 - n - a - k)
                hi = min(len(low), end + 1 - n - a + len(text) + k)
                w = windows.setdefault(i, [])
                if w and w[-1][1] >= lo:
                    w[-1][:] = min(w[-1][0], lo), max(w[-1][1], hi)
                else:
                    w.append([lo, hi])
        out = []
        for i, w in windows.items():
            for lo, hi in w:
                for m in self.patterns[i].finditer(low, lo, hi):
                    out.append((m.start(), m.end(), self.notices[i][0], sum(m.fuzzy_counts)))
        return sorted(out)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, notices, score.

    notices: structs of start, end (code points, end exclusive), label and edits. score: 1 where a phrase stands or a notice
    without edits, else 1 less the smallest share of edited characters, 0 without any find.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = docs.schema["id"].dataType.simpleString()
    sizes = {}
    for label, text in notices:
        sizes[label] = min(len(text), sizes.get(label, 1 << 30))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = [(_exact(p), label) for p, label in phrases.items()]
        heads = [p.encode().split()[-1] for p in phrases]
        fuzzy = Notices(notices, chars_per_edit)
        for b in batches:
            rows: list[tuple] = []
            for lo, hi, data, offsets in chunks(b.column("t")):
                w = split(data, offsets)
                low = LOW[data].tobytes()
                for d in range(hi - lo):
                    text = low[offsets[d] : offsets[d + 1]]
                    places, base = [], set()
                    for (pattern, label), head in zip(exact, heads, strict=True):
                        if head in text:
                            for m in pattern.finditer(text):
                                places.append(int(np.searchsorted(w.start, offsets[d] + m.start()) - w.first[d]))
                                base.add(label)
                    found = fuzzy.find(text.decode())
                    score = max([1.0 if base else 0.0, *(max(0.0, 1 - e / sizes[label]) for _, _, label, e in found)])
                    rows.append((int(w.first[d + 1] - w.first[d]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), [{"start": s, "end": e, "label": x, "edits": k} for s, e, x, k in found], score))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64())])), pa.float64()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "notices", "score"]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["id", *names])

    out = docs.mapInArrow(scan, f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, notices array<struct<start:bigint,end:bigint,label:string,edits:bigint>>, score double")
    return out.withColumnRenamed("id", id_col)
