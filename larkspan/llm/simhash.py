"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprints within `radius` differing bits are linked. For radius r each of the 64 bits gets a nonzero code of r + 1
bits; table v (1 <= v < 2^(r+1)) keeps the bits whose code has odd overlap with v. Whatever r bits differ, their codes
span at most r dimensions, so some v is orthogonal to all of them, and its table maps both fingerprints alike: no pair
is missed. Equal fingerprints are one node. A bucket of at most `most` fingerprints is searched in memory and gives a
spanning forest of its links, not all pairs. Fingerprints of larger buckets are linked through their neighbourhoods instead: two
of them within r share a point within ceil(r / 2) of both, and few fingerprints are that near one point.

Nulls, empty texts and texts without a word have fingerprint zero and are linked like any other. Repeated rows are
copies of each other. Components are connected components of the links; the smallest id stands for each. A null id
sorts before all others. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SHINGLE, RADIUS, SEED, BITS = 4, 4, 42, 64
#: Fingerprints of one bucket that are searched in memory.
MOST = 2048


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        some = hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big") if len(hashes) else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        out = np.zeros(batch.num_rows, np.int64)
        for i, j in C.parts(batch.column(1)):
            raw, at = C.string_bytes(batch.column(1).slice(i, j - i))
            low = C.LOWER[raw]
            start, end, text = C.words(low, at, C.BLACK)
            if not len(start):
                continue
            # The same words with one space between, so that each shingle is one slice.
            size = end - start
            to = np.cumsum(size + 1) - size - 1
            joined = np.full(int(to[-1] + size[-1] + 1), 32, np.uint8)
            inside = np.repeat(to - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            joined[inside] = low[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            line = joined.tobytes()
            counts = np.bincount(text, minlength=j - i)
            head = np.cumsum(counts) - counts
            a, b = to, to + size
            for k in np.flatnonzero(counts):
                n, h = int(counts[k]), int(head[k])
                w = min(n, SHINGLE)
                ends = b[h + w - 1 : h + n]
                h64 = np.fromiter([digest(line[x:y], SEED) for x, y in zip(a[h : h + n - w + 1].tolist(), ends.tolist(), strict=True)], np.uint64, n - w + 1)
                out[i + k] = np.uint64(fingerprint(h64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks over the bits; any pattern of at most radius bits misses one of them."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.column(0)
        flat, offsets = at.flatten().to_numpy().view(np.uint64), np.asarray(at.offsets)
        offsets = offsets - offsets[0]
        n = np.diff(offsets)
        two = offsets[:-1][n == 2]
        x, y = flat[two], flat[two + 1]
        near = np.bitwise_count(x ^ y) <= radius
        a, b = [x[near]], [y[near]]
        for k in np.flatnonzero(n > 2):
            rest = flat[offsets[k] : offsets[k + 1]]
            while len(rest) > 1:
                todo, rest = [rest[0]], rest[1:]
                while todo and len(rest):
                    u = todo.pop()
                    hit = np.bitwise_count(rest ^ u) <= radius
                    if hit.any():
                        v = rest[hit]
                        a.append(np.full(len(v), u))
                        b.append(v)
                        todo.extend(v)
                        rest = rest[~hit]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])


def links(prints: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """prints: distinct long fp. Edges a, b that connect the same fingerprints as all pairs within radius do."""
    tables = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(covering_masks(radius))]
    # A small file is few tasks', but its rows grow by as many as there are tables.
    spread = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = spread.select("fp", F.explode(F.array(*tables)).alias("e")).select("fp", "e.t", "e.key")
    large = C.scratch(rows.groupBy("t", "key").count().where(F.col("count") > most).select("t", "key"), "large")
    hot = None
    if not large.isEmpty():
        hot = C.scratch(rows.join(large, ["t", "key"], "left_semi").select("fp").distinct(), "hot")
        rows = rows.join(large, ["t", "key"], "left_anti")
    small = rows.groupBy("t", "key").agg(F.collect_list("fp").alias("at")).where(F.size("at") > 1).select("at")
    edges = small.mapInArrow(lambda it: _forest(it, radius), "a long, b long")
    if hot is not None:
        half = (radius + 1) // 2
        flips = F.array(*[F.lit(signed(sum(1 << i for i in some))) for k in range(half + 1) for some in combinations(range(BITS), k)])
        near = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
        # Fingerprints within half of one point are few and within radius of each other if radius is even.
        groups = near.groupBy("mid").agg(F.collect_list("fp").alias("at")).where(F.size("at") > 1).select("at")
        edges = edges.union(groups.mapInArrow(lambda it: _forest(it, radius), "a long, b long"))
    return edges


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """A row for each text: doc_id, fp (long), component_id."""
    C.arrow_limits(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _found(source, "doc_id long, fp long", radius, most).select("doc_id", "fp", "component_id")


def _found(source: DataFrame, schema: str, radius: int, most: int) -> DataFrame:
    """source: doc_id, text and others. The columns of schema, which are doc_id, fp and the others, root and component_id."""
    prints = C.scratch(source.mapInArrow(_fingerprints, schema), "prints")
    nodes = C.scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = C.scratch(components(links(nodes.select("fp"), radius, most)).withColumnRenamed("node", "fp").join(nodes, "fp"), "roots")
    least = C.scratch(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    linked = C.scratch(roots.join(least, "root").select("fp", "root", "component_id"), "linked")
    whole = C.scratch(nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "rep").alias("component_id")), "components")
    return prints.join(whole, "fp")


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """One row of docs for each component, that of the least id (null first) and then text hash; all columns stay. A row
    is known by its id and text hash, so rows that share an id but not the text do not go with one another."""
    C.arrow_limits(spark)
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    found = _found(source, "doc_id long, fp long, h long", radius, most).select("root", F.struct("doc_id", "h").alias("row"))
    rows = C.scratch(found.groupBy("root", "row").count(), "rows")
    first = C.scratch(rows.groupBy("root").agg(F.min("row").alias("first")), "first")
    gone = rows.join(first, "root").where("row != first").select(F.col("row.doc_id").alias("_gone"), F.col("row.h").alias("_gone_h"))
    # The names are not looked up in docs, which may have the same.
    hash_of = F.xxhash64(docs[text_col].cast("string"))
    kept = docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_gone"]) & (hash_of == gone["_gone_h"]), "left_anti")
    again = rows.join(first, "root").where("row = first AND count > 1")
    if again.isEmpty():
        return kept
    key = "_h"
    while key in docs.columns:
        key += "_"
    return kept.withColumn(key, F.xxhash64(F.col(text_col).cast("string"))).dropDuplicates([id_col, key]).drop(key)
