"""Quality selection by importance resampling.

Texts are bags of hashed word 1- and 2-grams. Two smoothed generative models over the buckets, of target texts (those
labelled good) and of all texts, give each text the mean log ratio of its n-grams, times a fixed effective length, as
its log importance weight. Gumbel noise keyed by the id is added, and the `share` of texts with the largest sums is
selected: sampling without replacement by weight.

The raw model counts all texts; `sample` bounds the labelled texts that the target model is learned from (in expectation,
by a hash of the id). Null and texts without a word have weight 0 as long as there are models; a very long text counts like
any other. Ties go to the smaller id, null first. Without any labelled text all weights are 0. Rows that share an id share its noise, but are
told apart: exactly the share is selected. An empty table gives an empty table. Columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BUCKETS, SAMPLE, SHARE, LENGTH, SEED = 1 << 14, 20_000, 0.5, 64.0, 11


def buckets(column: pa.Array, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each word 1-gram and 2-gram."""
    raw, at = C.string_bytes(column)
    low = C.LOWER[raw]
    start, end, text = C.words(low, at, C.ALNUM)
    (one,) = C.hash_words(low, start, end)
    if not len(one):
        none = np.zeros(0, np.int64)
        return none, none
    two = C.mix(one[:-1] + C.mix(one[1:]))
    same = text[:-1] == text[1:]
    return np.concatenate([text, text[:-1][same]]), (np.concatenate([one, two[same]]) % np.uint64(n)).astype(np.int64)


def models(spark: SparkSession, docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, n: int = BUCKETS) -> np.ndarray | None:
    """Log ratio of the target model to the raw one by bucket; None without target texts. good: column id."""
    C.arrow_limits(spark)
    ids = good.select(F.col("id").cast("long")).where("id IS NOT NULL").distinct()
    count = ids.count()
    if not count:
        return None
    place = (F.xxhash64(F.col("id"), F.lit("target")) % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    chosen = ids.where(place < min(1.0, sample / count)).withColumn("target", F.lit(True))
    # At most about `sample` ids, whatever the size of the corpus.
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n), np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in C.parts(batch.column(0)):
                text, bucket = buckets(batch.column(0).slice(i, j - i), n)
                sums[0] += np.bincount(bucket, minlength=n)
                sums[1] += np.bincount(bucket[target[i:j][text]], minlength=n)
        seen = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[0][seen]), pa.array(sums[1][seen])], names=["bucket", "raw", "target"])

    rows = source.mapInArrow(tally, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(n), np.ones(n)
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(spark: SparkSession, docs: DataFrame, ratio: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", length: float = LENGTH) -> DataFrame:
    """doc_id, n_features, log_weight of each text."""
    C.arrow_limits(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if ratio is not None:
                for i, j in C.parts(batch.column(1)):
                    text, bucket = buckets(batch.column(1).slice(i, j - i), len(ratio))
                    n[i:j] = np.bincount(text, minlength=j - i)
                    s[i:j] = np.bincount(text, ratio[bucket], minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(length * s / np.maximum(n, 1))], names=["doc_id", "n_features", "log_weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_features long, log_weight double")


def _kth(rows: DataFrame, code: Column, bits: int, k: int, step: int = 12) -> tuple[int, int]:
    """The k-th smallest value of an unsigned code of so many bits, and how many of the k have it: found digit by digit, a
    count by the next digit each time. There are k rows at least."""
    prefix, left = 0, k
    while bits:
        step = min(step, bits)
        bits -= step
        digit = F.shiftrightunsigned(code, bits)
        inside = rows.where(F.shiftrightunsigned(digit, step) == prefix)
        counts = {r["d"]: r["n"] for r in inside.groupBy(digit.bitwiseAND((1 << step) - 1).alias("d")).agg(F.count("*").alias("n")).collect()}
        for d in sorted(counts):
            if counts[d] >= left:
                break
            left -= counts[d]
        prefix = prefix << step | d
    return prefix, left


def largest(rows: DataFrame, k: int, key: str, tie: str, place: str) -> DataFrame:
    """rows (in files) with a boolean `selected`: exactly the k largest by key, ties by the smaller `tie` (null first),
    then by the smaller `place`, which no two rows share; all rows if there are no more than k."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if low is None or k <= 0 or k >= n:
        return rows.withColumn("selected", F.lit(k > 0))
    # Keys of moderate size as integers of 48 bits, the largest first; longs in order as unsigned ones.
    span = max(high - low, 1e-300)
    first = F.floor((F.lit(high) - F.col(key)) / span * float((1 << 48) - 1)).cast("long")
    second = F.coalesce(F.col(tie), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    a, left = _kth(rows, first, 48, k)
    same = rows.where(first == a)
    b, left = _kth(same, second, 64, left)
    b -= (b >> 63) << 64
    same = same.where(second == b)
    c, _ = _kth(same, F.col(place), 63, left)
    # XOR with the sign bit turns the unsigned order of ids into the signed one.
    signed = F.coalesce(F.col(tie), F.lit(-(1 << 63)))
    edge = b ^ -(1 << 63)
    chosen = (first < a) | ((first == a) & ((signed < edge) | ((signed == edge) & (F.col(place) <= c))))
    return rows.withColumn("selected", chosen)


def resample(spark: SparkSession, docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """A row for each text: doc_id, n_features, log_weight, score (0 to 1), gumbel_key, selected."""
    ratio = models(spark, docs, good, id_col, text_col, sample)
    weights = C.scratch(weigh(spark, docs, ratio, id_col, text_col).withColumn("place", F.monotonically_increasing_id()), "weights")
    n = weights.count()
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 12) + 0.5) / float(1 << 52)
    keyed = weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    score = 1 / (1 + F.exp(-F.col("log_weight")))
    return largest(keyed.withColumn("score", score), math.ceil(share * n), "gumbel_key", "doc_id", "place").select("doc_id", "n_features", "log_weight", "score", "gumbel_key", "selected")
