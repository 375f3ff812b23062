"""Helpers shared by the training-data operators: scratch tables, Arrow text access, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch sent to a Python worker; they bound a worker's memory, not the result.
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="larkspan-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def arrow_limits(spark: SparkSession) -> None:
    """Bound the Arrow batches, since one batch of very long texts must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages start from files that outlive executors."""
    path = f"{shared_dir(df.sparkSession)}/larkspan/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a scratch table that no later plan reads."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent().getParent()
        if "larkspan/" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; a null is an empty text."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: Byte tables: A-Z lowered; ASCII letters, digits and all bytes of other characters; all but ASCII white space.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
BLACK = np.ones(256, bool)
BLACK[[9, 10, 11, 12, 13, 32]] = False

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, (2, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def words(low: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes in table; runs end at a text's end."""
    inside = table[low]
    n = len(low)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1]
    heads = heads[heads < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def hash_words(low: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """One or two independent 64-bit hashes of each word, a slice of about 2 MB of bytes at a time."""
    out = [np.zeros(len(start), np.uint64) for _ in range(lanes)]
    if not len(start):
        return out
    size = end - start
    total = np.cumsum(size)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(total, total[i] + (2 << 20))))
        n = size[i:j]
        head = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(head, n)
        byte = low[np.repeat(start[i:j], n) + place]
        place &= 4095
        for lane in range(lanes):
            h = np.add.reduceat(_BYTE[lane][byte] * _PLACE[lane][place], head)
            out[lane][i:j] = mix(h + n.astype(np.uint64))
        i = j
    return out


def parts(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with at most so many bytes each, or one row."""
    _, at = string_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j
