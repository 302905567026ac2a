"""Cost-balanced packing of tokenised documents into sequences of at most 2048 tokens.

Documents are read in groups of about GROUP_TOKENS tokens within a task. In a group, the number of sequences is known
from its tokens: full sequences, and for what is left over one sequence for each power of two in it, as those need no
padding. Documents then go in descending order to the sequence of lowest cost that has room for them, where a piece of n
tokens costs LINEAR * n + n * n: attention runs within a piece. Long documents first give their full sequences. Only a
document for which no sequence has room is cut: it fills the sequence of lowest cost that has any room left, and what remains of it is
placed likewise.

Only the token ids of one group are held at a time, and nothing is shuffled. sequence_id counts upwards within a task and
starts anew from the task's number times 2**40, so that a task that is run again gives the same ids.

Cases: null counts as empty; very long texts are tokenised whole, by one task each; an empty text is the end token alone; repeated documents are packed as often as they come;
ties in length keep the order of reading; an empty table gives no rows; other columns are left out. Texts that hold the string of a special token are
ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import trimming

LENGTH = 2048
END_ID = 1
GROUP_TOKENS = 1 << 20
#: Of a token's other layers, in units of one attention score.
LINEAR = 4096
#: Texts on which both libraries split words alike by construction; all others take the slower one.
PLAIN = re.compile(r"[^\x00-\u024f]|\s{2000}")


def tokenizer(json_path: str, ranks_path: str | None, pattern: str | None) -> Callable[[str], np.ndarray]:
    """Text to ids by a file of the tokenizers library; by the same vocabulary's ranks where that is known to be equal."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    exact.encode_special_tokens = True
    slow = lambda text: np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    if not ranks_path:
        return slow
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow(text) if PLAIN.search(text) else np.array(fast.encode_ordinary(text), np.uint32)


class Rooms:
    """Sequences by their free capacity; finds the one of lowest cost among those with at least so much. Equal costs: the roomier first."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.held: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
        #: tree[size + c]: (cost, -c, sequence) of the cheapest with capacity c; above it the least of two.
        self.tree: list[tuple[int, int, int] | None] = [None] * (2 * self.size)

    def _mend(self, c: int) -> None:
        i = self.size + c
        self.tree[i] = (self.held[c][0][0], -c, self.held[c][0][1]) if self.held[c] else None
        while i > 1:
            i >>= 1
            x, y = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = x if y is None or x is not None and x < y else y

    def put(self, cost: int, free: int, sequence: int) -> None:
        heapq.heappush(self.held[free], (cost, sequence))
        self._mend(free)

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(cost, free, sequence), which is no longer held; None if no sequence has room."""
        best, lo, hi = None, self.size + least, 2 * self.size
        while lo < hi:
            if lo & 1:
                x = self.tree[lo]
                best = x if best is None or x is not None and x < best else best
                lo += 1
            if hi & 1:
                hi -= 1
                x = self.tree[hi]
                best = x if best is None or x is not None and x < best else best
            lo, hi = lo >> 1, hi >> 1
        if best is None:
            return None
        heapq.heappop(self.held[-best[1]])
        self._mend(-best[1])
        return best[0], -best[1], best[2]


def assign(lengths: list[int], length: int = LENGTH, linear: int = LINEAR) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, tokens, sequence, offset) of documents with so many tokens.

    Every token lies in one piece. Each sequence is full or holds a power of two of tokens.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    sequences = 0
    for d, n in enumerate(lengths):
        whole = n // length
        for k in range(whole):
            pieces.append((d, k * length, length, sequences, 0))
            sequences += 1
        if n % length:
            rest.append((n % length, d, whole * length))
    total = sum(n for n, _, _ in rest)
    room = [length] * (total // length) + [1 << k for k in range(length.bit_length() - 1, -1, -1) if (total % length) >> k & 1]
    rooms = Rooms(length)
    for s, n in enumerate(room):
        rooms.put(0, n, s)
    rest.sort(key=lambda x: (-x[0], x[1]))
    for n, d, start in rest:
        while n:
            cost, free, s = rooms.take(n) or rooms.take(1)
            m = min(n, free)
            pieces.append((d, start, m, sequences + s, room[s] - free))
            if free > m:
                rooms.put(cost + linear * m + m * m, free - m, s)
            n, start = n - m, start + m
    return pieces


def packed(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, with_ids: bool = False
) -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = docs.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(json_path, ranks_path, pattern)
        end = np.array([end_id], np.uint32)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        names, ids, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held
            pieces = assign([len(x) for x in ids], length)
            last = 0
            for lo in range(0, len(pieces), 4096):
                part = pieces[lo : lo + 4096]
                cuts = [ids[d][a : a + n] for d, a, n, _, _ in part]
                columns = [
                    pa.concat_arrays([names[d] for d, *_ in part]),
                    pa.array([x[1] for x in part], pa.int64()),
                    pa.array([x[2] for x in part], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cuts], pa.int64()),
                    pa.array([len(ids[x[0]]) for x in part], pa.int64()),
                    pa.array([first + x[3] for x in part], pa.int64()),
                    pa.array([x[4] for x in part], pa.int64()),
                ]
                labels = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in cuts], pa.list_(pa.int32())))
                    labels.append("ids")
                last = max(last, *(x[3] + 1 for x in part))
                yield pa.RecordBatch.from_arrays(columns, names=labels)
            first += last
            names.clear()
            ids.clear()
            held = 0

        for b in batches:
            texts = b.column("t")
            for i in range(b.num_rows):
                text = texts[i].as_py() or ""
                x = np.concatenate([encode(text), end])
                names.append(b.column("id").slice(i, 1))
                ids.append(x)
                held += len(x)
                if held >= group_tokens:
                    yield from flush()
        if ids:
            yield from flush()

    out = docs.mapInArrow(trimming(pack), f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)
