"""Draws by keyed hashes: the same rows at any partitioning, on any rerun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def draw(*keys: str | Column, seed: int) -> Column:
    """A number that is uniform over long values."""
    return F.xxhash64(*keys, F.lit(seed))


def uniform(*keys: str | Column, seed: int) -> Column:
    return (F.shiftrightunsigned(draw(*keys, seed=seed), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def stratified(df: DataFrame, strata: list[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """At most k rows of each stratum, with the stratum's size. A top-k window, which Spark limits before its exchange."""
    top = F.row_number().over(W.partitionBy(*strata).orderBy(draw(key, seed=seed), key))
    sizes = df.groupBy(*strata).agg(F.count("*").alias("population"))
    return df.withColumn("rn", top).where(F.col("rn") <= k).join(sizes, strata)


def first_then_cut(df: DataFrame, buckets: list[str], key: str, each: int, total: int) -> DataFrame:
    """The first rows of each bucket, then a cut of them in order of a digest."""
    first = F.row_number().over(W.partitionBy(*buckets).orderBy(key))
    return df.withColumn("rn", first).where(F.col("rn") <= each).drop("rn").orderBy(F.sha1(F.col(key).cast("string").cast("binary")), key).limit(total)


def group_fold(key: str, k: int, seed: int = 42) -> Column:
    return F.pmod(draw(key, seed=seed), F.lit(k)).cast("int")


def permuted(df: DataFrame, column: str, groups: list[str], key: str, seed: int = 42) -> DataFrame:
    """The column's values shuffled within groups: the natural and the drawn order are numbered and joined."""
    a = df.withColumn("i", F.row_number().over(W.partitionBy(*groups).orderBy(key)))
    b = df.select(*groups, F.col(column).alias(f"{column}_perm"), F.row_number().over(W.partitionBy(*groups).orderBy(draw(key, seed=seed), key)).alias("i"))
    return a.join(b, [*groups, "i"]).drop("i")


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) count by inversion."""
    out, p, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(0, 9):
        total += p
        out = out + F.when(u > total, 1).otherwise(0)
        p /= k + 1
    return out


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, reps: int = 200, seed: int = 42) -> DataFrame:
    """Mean of value and its bootstrap interval, clusters drawn whole: sums of each cluster first, then weights by draw.
    What is multiplied by the repetitions is the table of clusters, not the rows."""
    sums = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    reps_of = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    w = poisson_weight(uniform(cluster, "rep", seed=seed))
    each = reps_of.withColumn("w", w).groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    mean = sums.agg((F.sum("s") / F.sum("n")).alias("mean"))
    return each.agg(F.count("*").alias("reps"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi")).join(F.broadcast(mean))
