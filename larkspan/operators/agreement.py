"""Agreement of two labellings: kappa, precision, recall and shares by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kappa(df: DataFrame, a: str, b: str, certain: float | None = 1.0) -> DataFrame:
    """Cohen's kappa over rows that have both labels; `certain` where chance alone agrees on all. Only the table of
    label pairs, which is small, meets in one task."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    n = pairs.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left = pairs.groupBy(F.col("x").alias("l")).agg(F.sum("n").alias("nx"))
    right = pairs.groupBy(F.col("y").alias("l")).agg(F.sum("n").alias("ny"))
    chance = left.join(right, "l").agg(F.sum(F.col("nx").cast("double") * F.col("ny").cast("double")).alias("c"))
    t = n.join(F.broadcast(chance))
    po, pe = F.col("same").cast("double") / F.col("all").cast("double"), F.coalesce("c", F.lit(0.0)) / (F.col("all").cast("double") * F.col("all").cast("double"))
    return t.select(F.col("all").cast("bigint").alias("n"), F.round(po, 9).alias("observed"), F.round(F.when(pe >= 1, F.lit(certain)).otherwise((po - pe) / (F.lit(1.0) - pe)), 9).alias("kappa"))


def precision_recall(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """By label: support, precision, recall and F1; null where there is nothing to divide by."""
    both = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    long = both.select(F.explode(F.array_distinct(F.array(truth, guess))).alias("label"), F.col(truth).alias("t"), F.col(guess).alias("g"))
    c = lambda cond: F.count(F.when(cond, 1))
    s = long.groupBy("label").agg(c((F.col("t") == F.col("label")) & (F.col("g") == F.col("label"))).alias("tp"), c(F.col("t") == F.col("label")).alias("support"), c(F.col("g") == F.col("label")).alias("guessed"))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("guessed").cast("double")), F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double"))
    return s.select("label", "support", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(F.try_divide(F.lit(2.0) * F.col("tp").cast("double"), (F.col("support") + F.col("guessed")).cast("double")), 9).alias("f1"))


def by_group(df: DataFrame, a: str, b: str, groups: list[str]) -> DataFrame:
    """Agreement over all rows and by each grouping column, in one pass."""
    sets = [[], *[[g] for g in groups]]
    out = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupingSets(sets, *groups).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agree"))
    return out.select(*[F.coalesce(F.col(g).cast("string"), F.lit("(all)")).alias(g) for g in groups], "n", F.round("agree", 9).alias("agree"))
