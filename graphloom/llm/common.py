"""What the corpus operators share: table access, checkpoints, size-checked joins, Arrow chunking."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into numpy arrays at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: A join side is broadcast only if its counted rows, at the stated bytes a row, stay within this.
BROADCAST_BYTES = 32 << 20

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, unless PYTHONPATH already leads them to it."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp()
    archive = Path(folder, "graphloom_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "graphloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir of the session. Only a local session where that is unset, as in tests, gets one made here."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def persisted(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back, so that its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_file(spark: SparkSession, data: bytes) -> str:
    """Writes a file to the shared folder; what fetched() takes in a task. A folder of the file system (file:) is read where it is, as the
    executors have it too. From other stores each executor fetches the file before its next tasks; such copies stay on every executor's
    disk, twice, until the session ends."""
    context = spark.sparkContext
    name = f"file-{uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(data)
    out.close()
    where = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if where.getScheme() == "file":
        return where.getPath()
    context.addFile(path.toString())
    return name


def fetched(name: str) -> str:
    """The path of a file of shared_file(), in a task or on the driver."""
    return name if os.path.isabs(name) else SparkFiles.get(name)


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit; otherwise as it is, for a shuffled join."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo a number; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (lo, hi) with their bytes and the offsets of each text in them. Null reads as empty."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: Python workers live on and would keep the most that a task took."""
    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if back:
        back(0)


def trimming(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task of a mapInArrow, followed by trim() when what it held is gone."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        trim()

    return run


def per_doc(counts_at: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=counts_at, minlength=n)
