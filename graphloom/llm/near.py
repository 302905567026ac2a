"""N-gram Jaccard join: pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

1. One pass hashes each text's shingle set: a fingerprint of the whole set, and one 64-bit hash for each band of its MinHash
   signature. bands() chooses rows and bands for the recall wanted at the threshold. Texts of equal sets are one class.
2. Classes shuffle on their band hashes. A bucket is kept if it holds at least two classes and no earlier band has a
   bucket of the same classes.
3. A second pass gives the shingle sets of the classes in kept buckets to those buckets. Classes in the same bucket are
   compared on their full sets. A bucket of more than BLOCK classes is dealt into blocks, and each task compares two
   blocks at most. A pair that shares several buckets counts in the first only. What a task returns is one row for each
   class that has links in it: how many, and the least class that they lead to; pairs are never rows.
4. Links are counted by class, and connected components of the links are the groups.

A set is held as sorted 64-bit hashes of its shingles.

A class is known by the 128-bit fingerprint of its set, not by an id, so that repeated and null ids mix nothing up.

Cases: a text of fewer than five words, but not none, has one shingle of all its words; null and empty texts and those
without words have no shingles: each is a group of its own, without links. Repeated rows are exact copies. The group's id is
the least id in it, null if it has none. Rows of one id and different texts are judged apart. Very long texts are hashed whole; one
is a chunk of its own. Other columns of the input are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunks, persisted, sized, trimming
from graphloom.llm.components import components
from graphloom.llm.words import mix, shingles, split

SIZE, THRESHOLD, RECALL = 5, 0.8, 0.9999
BLOCK = 384
#: A class in order of its least id: the id (the largest number for none) and the fingerprint.
_NODE = "struct<rep:bigint,fp1:bigint,fp2:bigint>"
_U = np.uint64


def bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows, for the fewest false candidates, that reach the recall within so many hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        number = next((n for n in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** n >= recall), None)
        if number:
            best = (number, rows)
    return best


def signatures(h: np.ndarray, ends: np.ndarray, number: int, rows: int) -> np.ndarray:
    """Band hashes (sets x bands) of the shingle sets h[ends[i]:ends[i + 1]], none of them empty."""
    out = np.empty((len(ends) - 1, number), _U)
    seeds = mix(np.arange(1, number * rows + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
    for b in range(number):
        band = np.full(len(ends) - 1, b + 1, _U)
        for r in range(rows):
            x = h * seeds[b * rows + r]
            x ^= x >> _U(29)
            x *= _U(0xBF58476D1CE4E5B9)
            band = mix(band + np.minimum.reduceat(x, ends[:-1]))
        out[:, b] = band
    return out


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of each text in turn, ends of the texts)"""
    h, doc = shingles(split(data, offsets), size)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def described(docs: DataFrame, size: int, number: int, rows: int) -> DataFrame:
    """id, key; fp1, fp2 (null without words), n and bands of each row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("t")):
                b = batch.slice(lo, hi - lo)
                h, ends = sets(data, offsets, size)
                n = np.diff(ends)
                some = np.flatnonzero(n)
                fp = np.zeros((2, hi - lo), _U)
                table = np.zeros((hi - lo, number), _U)
                if len(some):
                    at = ends[:-1][some]
                    for k in (0, 1):
                        fp[k, some] = mix(np.add.reduceat(mix(h + _U(0x632BE59BD9B4E019 * (k + 1))), at) + n[some].astype(_U))
                    table[some] = signatures(h, np.append(at, len(h)), number, rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * number), pa.array(table.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), *(pa.array(fp[k].view(np.int64), mask=n == 0) for k in (0, 1)), pa.array(n.astype(np.int64)), flat], names=["id", "key", "fp1", "fp2", "n", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(trimming(describe), f"id {kind}, key bigint, fp1 bigint, fp2 bigint, n bigint, bands array<bigint>")


def linked(sizes: np.ndarray, flat: np.ndarray, ends: np.ndarray, ask: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the asked pairs (rows of two numbers of sets) have the similarity."""
    a, b = ask[:, 0], ask[:, 1]
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    ask = ask[small >= threshold * large - 1e-9]
    if not len(ask):
        return ask
    if len(ask) < 64:
        both = np.array([len(np.intersect1d(flat[ends[x] : ends[x + 1]], flat[ends[y] : ends[y + 1]], assume_unique=True)) for x, y in ask])
    else:
        # Shared shingles by products of 0-1 matrices, some columns at a time.
        _, column, uses = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sizes)), sizes)
        several = uses[column] > 1
        renamed = np.cumsum(uses > 1) - 1
        column, row = renamed[column[several]], row[several]
        width, step = int((uses > 1).sum()), 8192
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        total = np.zeros((len(sizes), len(sizes)), np.float32)
        for lo in range(0, width, step):
            i, j = np.searchsorted(column, [lo, lo + step])
            m = np.zeros((len(sizes), min(step, width - lo)), np.float32)
            m[row[i:j], column[i:j] - lo] = 1
            total += m @ m.T
        both = np.rint(total[ask[:, 0], ask[:, 1]]).astype(np.int64)
    whole = sizes[ask[:, 0]] + sizes[ask[:, 1]] - both
    return ask[both >= threshold * whole - 1e-9]


def compared(keys: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, flat: np.ndarray, buckets: list[np.ndarray], bucket: int, pair: tuple[int, int], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes with links, their numbers of links, the least class that links lead to) within a bucket's blocks: rows of keys."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    n = len(keys)
    # First kept bucket of each pair: buckets are numbered in order, each class has its own in order.
    x, y = np.triu_indices(n, 1)
    if pair[0] != pair[1]:
        cross = blocks[x] != blocks[y]
        x, y = x[cross], y[cross]
    earlier = [np.array(b[: np.searchsorted(b, bucket)]) for b in buckets]
    owners: dict[int, list[int]] = {}
    for i, e in enumerate(earlier):
        for k in e.tolist():
            owners.setdefault(k, []).append(i)
    done = np.zeros((n, n), bool)
    for rows in owners.values():
        if len(rows) > 1:
            done[np.ix_(rows, rows)] = True
    ask = np.stack([x, y], 1)[~done[x, y]]
    hit = linked(sizes, flat, ends, ask, threshold) if len(ask) else ask
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    links = np.bincount(hit.ravel(), minlength=n)
    order = np.lexsort(keys.T[::-1])
    root = np.empty(n, int)
    root[order] = np.arange(n)
    while True:
        low = np.minimum(root[hit[:, 0]], root[hit[:, 1]])
        new = root.copy()
        np.minimum.at(new, hit[:, 0], low)
        np.minimum.at(new, hit[:, 1], low)
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(links)
    return some, links[some], order[root[some]]


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: id_col, class_id, copy_id, n_copies, n_links, key, root.

    class_id: least id of the group of texts that links connect. copy_id and n_copies: least id and number of rows of the same
    shingle set. n_links: other such classes with the similarity. key: xxhash64 of the text. root: what the group is known by, null
    for a text without words. Ids are integers.
    """
    number, rows = bands(threshold, recall)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("t"))
    table = persisted(described(docs, size, number, rows))
    # Rows of one class have the same bands; one of its rows, by id and key, later gives the text.
    classes = persisted(table.where("fp1 is not null").groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min(F.struct("id", "key")).alias("one"), F.any_value("bands").alias("bands")))
    each = persisted(classes.select("fp1", "fp2", F.posexplode("bands").alias("band", "hash")))
    buckets = each.groupBy("band", "hash").agg(F.count("*").alias("members"), F.sum(F.xxhash64("fp1", "fp2").cast("decimal(38,0)")).alias("sum"), F.min("fp1").alias("low")).where("members > 1")
    # Buckets are numbered by their band and hash; of those with the same members the first stays.
    kept = buckets.groupBy("members", "sum", "low").agg(F.min(F.struct("band", "hash")).alias("b")).select(F.col("b.band").alias("band"), F.col("b.hash").alias("hash"), "members", F.shiftleft(F.col("b.band").cast("bigint"), 48).bitwiseOR(F.shiftrightunsigned(F.col("b.hash"), 16)).alias("bucket"))
    places = each.join(kept, ["band", "hash"]).select("fp1", "fp2", F.struct("bucket", "members").alias("p"))
    wanted = places.groupBy("fp1", "fp2").agg(F.array_sort(F.collect_list("p")).alias("places"))
    node = F.struct(F.coalesce("rep", F.lit((1 << 63) - 1)).alias("rep"), "fp1", "fp2")
    wanted = persisted(wanted.join(classes.drop("bands"), ["fp1", "fp2"]).select(node.alias("node"), "one", "places"))
    links = persisted(_links(docs, wanted, size, threshold, block))
    counts = links.groupBy("a").agg(F.sum("links").alias("n_links"))
    roots = components(links.select("a", "b"))
    info = classes.select("fp1", "fp2", "rep", "copies", node.alias("me")).join(counts, F.col("me") == F.col("a"), "left").join(roots, F.col("me") == F.col("node"), "left")
    root = F.coalesce("root", "me")
    info = info.select(F.col("fp1").alias("f1"), F.col("fp2").alias("f2"), root.alias("root"), F.nullif(root["rep"], F.lit((1 << 63) - 1)).alias("class_id"), F.col("rep").alias("copy_id"), F.col("copies").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = table.select("id", "key", "fp1", "fp2").join(info, (F.col("fp1") == F.col("f1")) & (F.col("fp2") == F.col("f2")), "left")
    own = lambda c: F.when(F.col("f1").isNull(), F.col("id")).otherwise(F.col(c)).alias(c)
    return out.select(F.col("id").alias(id_col), own("class_id"), own("copy_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "key", "root")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """docs with one row of each group: that of the least id, null ids last, then of the least hash of its text.

    Rows of one id whose texts are in different groups all stay, as do all rows without words; of rows that share id and text one stays.
    """
    groups = joined(docs, id_col, text_col, **options).where("root is not null").select(F.col(id_col).alias("__id"), F.col("key").alias("__key"), "root")
    rows = persisted(groups.groupBy("__id", "__key").agg(F.any_value("root").alias("root"), F.count("*").alias("n")))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__key").alias("key"))).alias("p")).select(F.col("p.id").alias("pid"), F.col("p.key").alias("pkey"))
    marked = rows.join(first, F.col("__id").eqNullSafe(F.col("pid")) & (F.col("__key") == F.col("pkey")), "left").select("__id", "__key", "n", F.col("pkey").isNotNull().alias("stays"))
    gone = persisted(marked.where("not stays or n > 1"))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__key"))
    # Most rows stay, and most of those stand alone: only the others are looked up, and broadcast if they are few.
    out = docs.join(sized(gone.select("__id", "__key"), 64), same, "left_anti")
    several = docs.join(sized(gone.where("stays").select("__id", "__key"), 64), same).dropDuplicates(["__id", "__key"])
    return out.unionByName(several.select(*docs.columns))


def _links(docs: DataFrame, wanted: DataFrame, size: int, threshold: float, block: int) -> DataFrame:
    """a, links, b: for a class within one pair of blocks of a bucket, its links and the least class that they lead to; wanted: node, one, places."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("t"), 1 << 19):
                h, ends = sets(data, offsets, size)
                b = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("places"), pa.array([h[ends[i] : ends[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], names=["node", "places", "flat"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if len(held) > 1 and (now[1] == now[2] or len({x[1] for x in held}) > 1):
                flat = [np.frombuffer(x[2], _U) for x in held]
                keys = np.array([x[0] for x in held], np.int64)
                some, links, least = compared(keys, np.array([x[1] for x in held]), np.array([len(x) for x in flat]), np.concatenate(flat), [np.array(x[3]) for x in held], now[0], (now[1], now[2]), threshold)
                for column, x in zip(out, (keys[some], links, keys[least]), strict=True):
                    column.append(x)
            held.clear()

        def made() -> pa.RecordBatch:
            a, b = (np.concatenate([np.zeros((0, 3), np.int64), *x]) for x in (out[0], out[2]))
            nodes = [pa.StructArray.from_arrays([pa.array(k) for k in x.T.copy()], names=["rep", "fp1", "fp2"]) for x in (a, b)]
            arrays = [nodes[0], pa.array(np.concatenate([np.zeros(0, np.int64), *out[1]]).astype(np.int64)), nodes[1]]
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["a", "links", "b"])

        for batch in batches:
            nodes = list(zip(*(x.to_pylist() for x in batch.column("node").flatten()), strict=True))
            columns = [batch.column(k).to_pylist() for k in ("bucket", "lo", "hi", "own", "flat", "buckets")]
            for bucket, lo, hi, own, flat, buckets, node in zip(*columns, nodes, strict=True):
                if (bucket, lo, hi) != now:
                    if held:
                        close()
                    now = (bucket, lo, hi)
                held.append((node, own, flat, buckets))
            if sum(map(len, out[0])) > 10_000:
                yield made()
        if held:
            close()
        yield made()

    near = sized(wanted.select("node", "places", F.col("one.id").alias("i"), F.col("one.key").alias("k")), 512)
    rows = docs.select(F.col("id"), "key", "t").join(near, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))).select("node", "places", "t")
    rows = rows.mapInArrow(trimming(spread), f"node {_NODE}, places array<struct<bucket:bigint,members:bigint>>, flat binary")
    # The same row of a repeated document comes twice; the second is dropped with its place.
    rows = rows.select("node", "flat", F.col("places.bucket").alias("buckets"), F.explode("places").alias("p")).select("node", "flat", "buckets", F.col("p.bucket").alias("bucket"), F.greatest(F.lit(1), F.ceil(F.col("p.members") / block)).cast("int").alias("blocks"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "own", "flat", "buckets")
    # All classes of a pair of blocks come to one task; dropDuplicates keeps this partitioning.
    rows = rows.repartition("bucket", "lo", "hi").dropDuplicates(["bucket", "lo", "hi", "node"])
    return rows.sortWithinPartitions("bucket", "lo", "hi").mapInArrow(trimming(compare), f"a {_NODE}, links bigint, b {_NODE}")
