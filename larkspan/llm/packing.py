"""Best-fit packing of token pieces into sequences, with hierarchical residual rounds.

Each task encodes its texts, cuts those that are too long (the first piece may be shorter) and packs its pieces by
best-fit decreasing. Nearly full sequences are done. Of the others, a task passes on those that may still be combined:
no two sequences that hold over half fit together, so only one that holds at most half is left of a task, and beside
it the task's `fan` emptiest others are passed on, the most that a merge of `fan` tasks can use. Passed-on sequences are items for the
next rounds, in which groups of `fan` tasks merge, until one group is left. What moves is small at any size of input.

A null text is an empty one: each text has at least its end id. Repeated rows are packed each for itself. Columns
other than the id and the text are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoder, tokenizer_path

LENGTH, FAN, SLACK = 2048, 16, 8
#: Pieces that a task packs at a time.
WINDOW = 1 << 18

PIECE = np.dtype([("doc", "<i8"), ("null", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BINS = "level int, part int, number long, done boolean, load int, content binary"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin. A bit of `free` is set for each room that some bin has."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    free = 0
    for i in order:
        n = sizes[i]
        above = free >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            some = by_room[room]
            k = some.pop()
            if not some:
                free &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            by_room.setdefault(left, []).append(k)
            free |= 1 << left
    return bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a text of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _packed(level: int, part: int, number: int, sizes: list[int], content: list[bytes], capacity: int, fan: int, slack: int, last: bool) -> pa.RecordBatch:
    bins = best_fit(sizes, capacity)
    loads = [sum(sizes[i] for i in b) for b in bins]
    open_bins = [k for k, x in enumerate(loads) if capacity - x > slack]
    small = [k for k in open_bins if 2 * loads[k] <= capacity]
    rest = sorted((k for k in open_bins if 2 * loads[k] > capacity), key=lambda k: loads[k])
    passed = set() if last else {*small, *rest[:fan]}
    n = len(bins)
    return pa.RecordBatch.from_arrays(
        [pa.array([level] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(range(number, number + n), pa.int64()), pa.array([k not in passed for k in range(n)]), pa.array(loads, pa.int32()), pa.array([b"".join(content[i] for i in b) for b in bins], pa.binary())],
        names=["level", "part", "number", "done", "load", "content"],
    )


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = LENGTH, fan: int = FAN, slack: int = SLACK) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    C.arrow_limits(spark)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        part, number = TaskContext.get().partitionId(), 0
        sizes: list[int] = []
        content: list[bytes] = []
        for batch in batches:
            for i, j in C.parts(batch.column(1)):
                for doc, x in zip(batch.column(0)[i:j].to_pylist(), enc.encode(batch.column(1).slice(i, j - i)), strict=True):
                    ids = np.append(x, end_id).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(ids), capacity)):
                        sizes.append(n)
                        content.append(np.array([(doc or 0, doc is None, k, s, n, zlib.crc32(ids[s : s + n]))], PIECE).tobytes())
            if len(sizes) >= WINDOW:
                out = _packed(0, part, number, sizes, content, capacity, fan, slack, False)
                number += out.num_rows
                sizes, content = [], []
                yield out
        if sizes:
            yield _packed(0, part, number, sizes, content, capacity, fan, slack, False)

    def again(level: int, last: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes: list[int] = []
            content: list[bytes] = []
            for batch in batches:
                sizes += batch.column(0).to_pylist()
                content += batch.column(1).to_pylist()
            if sizes:
                yield _packed(level, TaskContext.get().partitionId(), 0, sizes, content, capacity, fan, slack, last)

        return merge

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x, PIECE) for x in batch.column(1).to_pylist()]
            if not each:
                continue
            p = np.concatenate(each)
            count = np.array([len(x) for x in each])
            seq = np.repeat(batch.column(0).to_numpy(), count)
            total = np.cumsum(p["length"].astype(np.int64)) - p["length"]
            offset = total - np.repeat(total[np.cumsum(count) - count], count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p["doc"], mask=p["null"].astype(bool)), pa.array(p["piece"]), *(pa.array(x.astype(np.int64)) for x in (p["start"], p["length"], p["crc"], seq, offset))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    level, table = 0, C.scratch(source.mapInArrow(local, BINS), "bins-0")
    done = table.where("done")
    groups = table.select("part").distinct().count()
    while groups:
        level, groups = level + 1, -(-groups // fan)
        merged = table.where("not done").select("load", "content").repartition(groups).mapInArrow(again(level, groups == 1), BINS)
        table = C.scratch(merged, f"bins-{level}")
        done = done.union(table.where("done"))
        if groups == 1:
            break
    number = F.col("level").cast("long") * (1 << 52) + F.col("part").cast("long") * (1 << 30) + F.col("number")
    return done.select(number.alias("sequence_id"), "content").mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
