"""What peers and outcomes did around a cell: peer features, sample timings, clustered slopes, errors and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .events import cell, deltas
from .predict import unit_time

FOLDS = ("A", "B")


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))


def peer_scores(periods: DataFrame, edges: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Of each unit and period: the mean score of its peers, and the share of them whose score rose since the period
    before. Null where no peer has a score (or a score in both)."""
    before = F.when(F.lag("ord").over(unit_time()) == F.col("ord") - 1, F.lag("mean_score").over(unit_time()))
    peer = periods.select(F.col("unit").alias("peer"), "ord", F.col("mean_score").alias("s"), (F.col("mean_score") - before).alias("rise"))
    seen = edges.select("unit", "peer").join(peer, "peer").groupBy("unit", "ord").agg(F.avg("s").alias("peer_score"), F.count("rise").alias("known"), _n(F.col("rise") >= threshold).alias("rising"))
    own = periods.select("unit", "period", "ord").join(seen, ["unit", "ord"], "left")
    return own.select("unit", "period", "peer_score", F.coalesce("known", F.lit(0)).alias("known"), _share("rising", "known").alias("peer_exposure"))


def aspect_exposure(panel: DataFrame, edges: DataFrame, actionable: list[str], threshold: float = 0.15) -> DataFrame:
    """The share of its peers' actionable aspects, measured now and before, whose net rose. Counted by peer first, so
    that the edges meet one row a peer and period."""
    moved = deltas(panel).where(F.col("has") & F.col("prev_has") & F.col("aspect").isin(actionable))
    by_peer = moved.groupBy(F.col("unit").alias("peer"), "ord").agg(F.count("*").alias("known"), _n(F.col("delta") >= threshold).alias("rising"))
    seen = edges.select("unit", "peer").join(by_peer, "peer").groupBy("unit", "ord").agg(F.sum("known").alias("known"), F.sum("rising").alias("rising"))
    return seen.select("unit", "ord", "known", "rising", _share("rising", "known").alias("exposure"))


def unit_levels(periods: DataFrame, fold: str = "B", least: int = 30) -> DataFrame:
    """The mean score of each unit in a fold, weighted by reviews, of units with enough of them."""
    n, mean = F.col(f"n_{fold}"), F.col(f"mean_{fold}")
    sums = periods.where((n > 0) & mean.isNotNull()).groupBy("unit").agg(F.sum(n).alias("n"), F.sum(n.cast("double") * mean).alias("s"))
    return sums.where(F.col("n") >= least).select("unit", "n", _share("s", "n").alias("level"))


def outcomes_around(periods: DataFrame) -> DataFrame:
    """Scores by fold in the period before, in this one and in the next; null where that period is missing."""
    w = unit_time()
    back, ahead = F.lag("ord").over(w) == F.col("ord") - 1, F.lead("ord").over(w) == F.col("ord") + 1
    out = [c for f in FOLDS for c in (F.when(back, F.lag(f"mean_{f}").over(w)).alias(f"before_{f}"), F.col(f"mean_{f}").alias(f"now_{f}"), F.when(ahead, F.lead(f"mean_{f}").over(w)).alias(f"next_{f}"))]
    return periods.select("unit", "period", "ord", *out)


def samples(panel: DataFrame, least: int = 30) -> DataFrame:
    """Pairs of aspect (x) and outcome (y) by fold, for four timings: the change or level of x against the change or level
    of y in the same or the next period. Both folds need a measurement and, at each end of y, enough reviews.

    The panel is dense, so a cell's neighbours carry the outcomes of the periods before and after: no join."""
    w = cell()
    base = panel.select("unit", "aspect", "ord", *[c for f in FOLDS for c in (F.col(f"net_{f}").alias(f"x{f}"), (F.col(f"pos_{f}") + F.col(f"neg_{f}") > 0).alias(f"h{f}"), F.col(f"n_{f}").alias(f"n{f}"), F.col(f"mean_{f}").alias(f"y{f}"))])
    near = base.select("*", F.lag("ord").over(w).alias("ord0"), F.lead("ord").over(w).alias("ord2"), *[F.lag(f"{c}{f}").over(w).alias(f"{c}{f}0") for c in "xhny" for f in FOLDS], *[F.lead(f"{c}{f}").over(w).alias(f"{c}{f}2") for c in "ny" for f in FOLDS])
    both = lambda make: make("A") & make("B")
    enough = lambda at: both(lambda f: F.col(f"n{f}{at}") >= least)
    level = both(lambda f: F.col(f"h{f}"))
    change = (F.col("ord0") == F.col("ord") - 1) & level & both(lambda f: F.col(f"h{f}0"))
    later = F.col("ord2") == F.col("ord") + 1
    moved, now = [F.col(f"x{f}") - F.col(f"x{f}0") for f in FOLDS], [F.col(f"x{f}") for f in FOLDS]
    kinds = [
        ("lagged_change", change & later & enough("") & enough("2"), moved, [F.col(f"y{f}2") - F.col(f"y{f}") for f in FOLDS]),
        ("contemp_change", change & enough("") & enough("0"), moved, [F.col(f"y{f}") - F.col(f"y{f}0") for f in FOLDS]),
        ("lagged_level", level & later & enough("2"), now, [F.col(f"y{f}2") for f in FOLDS]),
        ("contemp_level", level & enough(""), now, [F.col(f"y{f}") for f in FOLDS]),
    ]
    rows = [F.struct(F.lit(k).alias("timing"), F.coalesce(ok, F.lit(False)).alias("ok"), x[0].alias("x_A"), x[1].alias("x_B"), y[0].alias("y_A"), y[1].alias("y_B")) for k, ok, x, y in kinds]
    return near.select("unit", "aspect", "ord", F.explode(F.array(*rows)).alias("s")).where("s.ok").select("unit", "aspect", "ord", "s.timing", "s.x_A", "s.x_B", "s.y_A", "s.y_B")


def cluster_slope(df: DataFrame, y: str, x: str, cluster: str) -> DataFrame:
    """Slope of y on x with an intercept: n, clusters, beta, se; the error is robust within clusters and has no small-sample
    correction. Null without spread in x. The tables of totals have one row each."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(cluster).alias("g"), F.col(x).alias("x"), F.col(y).alias("y"))
    d = d.join(F.broadcast(d.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    fit = d.agg(F.sum(dx * dx).alias("sxx"), F.sum(dx * dy).alias("sxy")).select("sxx", F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).alias("beta"))
    sums = d.join(F.broadcast(fit)).groupBy("g").agg(F.sum(dx * (dy - F.col("beta") * dx)).alias("s"), F.count("*").alias("n"), F.min("beta").alias("beta"), F.min("sxx").alias("sxx"))
    return sums.agg(F.sum("n").cast("bigint").alias("n"), F.count("*").alias("clusters"), F.min("beta").alias("beta"), (F.sqrt(F.sum(F.col("s") * F.col("s"))) / F.nullif(F.min("sxx"), F.lit(0.0))).alias("se"))


def combine_folds(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two fits on separate reviews, each one row of n, clusters, beta and se, as one: equal weights, independent errors."""
    both = one.unionByName(two).agg(F.sum("n").cast("bigint").alias("n"), F.min("clusters").alias("clusters"), F.avg("beta").alias("beta"), (F.sqrt(F.sum(F.col("se") * F.col("se"))) * 0.5).alias("se"))
    return both.withColumn("low", F.col("beta") - 1.959964 * F.col("se")).withColumn("high", F.col("beta") + 1.959964 * F.col("se"))


def errors_by_city(lags: DataFrame, train_until: int) -> DataFrame:
    """Errors of persistence on later rows, by city."""
    e = F.col("y_next") - F.col("y")
    test = lags.where((F.col("ord") > train_until) & F.col("y_next").isNotNull())
    return test.groupBy("city").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def rolling_folds(periods: DataFrame) -> DataFrame:
    """Rolling origins over the periods (period, ord): fold i trains on periods up to i, is validated on i + 1 and tested on
    i + 2. Periods are a dictionary: the window over them runs in one task."""
    rank = periods.select("period", "ord").distinct().withColumn("at", F.row_number().over(W.orderBy("ord")))
    last = rank.agg((F.max("at") - 2).alias("folds")).where("folds > 0")
    fold = rank.join(F.broadcast(last)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.col("folds"))))
    part = F.when(F.col("at") <= F.col("fold"), "train").when(F.col("at") == F.col("fold") + 1, "val").when(F.col("at") == F.col("fold") + 2, "test")
    return fold.withColumn("part", part).where("part IS NOT NULL").select("fold", "period", "part")


def picker_agreement(choices: DataFrame, one: str, two: str) -> DataFrame:
    """Of the units for which both strategies choose: how many, and the share with the same choice."""
    a, b = (choices.where(F.col("strategy") == s).select("unit", F.col("aspect").alias(k)) for s, k in ((one, "a"), (two, "b")))
    return a.join(b, "unit").agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agree"))


def violations(snap: DataFrame, choices: DataFrame, strategies: list[str]) -> DataFrame:
    """By strategy: eligible units, those it chooses for, the share it abstains from, and choices nobody can act on."""
    eligible = snap.where("eligible").select("unit").distinct()
    marked = choices.join(snap.select("unit", "aspect", F.coalesce("actionable", F.lit(False)).alias("actionable")), ["unit", "aspect"])
    made = marked.join(eligible, "unit", "left_semi").groupBy("strategy").agg(F.count("*").alias("chosen"), _n(~F.col("actionable")).alias("violations"))
    asked = eligible.agg(F.count("*").alias("eligible")).select("eligible", F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"))
    out = asked.join(made, "strategy", "left").fillna(0, ["chosen", "violations"])
    return out.select("strategy", "eligible", "chosen", "violations", (F.lit(1.0) - _share("chosen", "eligible")).alias("abstain_rate"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def keyed_sample(df: DataFrame, keys: list[str], k: int, seed: int = 42) -> DataFrame:
    """k rows by a digest of their keys: the same rows for any partitioning."""
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys]))
    return df.withColumn("place", place).orderBy("place", *keys).limit(k).drop("place")


def scaled(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """value between the least and the greatest of its group, 0 where they are equal; null stays null."""
    w = W.partitionBy(*group)
    span = F.max(value).over(w) - F.min(value).over(w)
    return df.withColumn("scaled", F.when(F.col(value).isNotNull(), F.when(span > 0, (F.col(value) - F.min(value).over(w)) / span).otherwise(0.0)))
