"""From mentions to the dense panel of unit, period and aspect, with its coverage, folds and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import period as P
from ..functions import score as S

#: Aspects are a dictionary, written into the plan; more are refused.
MOST_ASPECTS = 1000


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def mention_counts(m: DataFrame) -> DataFrame:
    pos, neg, a = ~F.col("neg"), F.col("neg"), F.col("fold") == "A"
    return m.groupBy("unit", "period", "aspect").agg(
        _n(pos).alias("pos"), _n(neg).alias("neg"), _n(pos & a).alias("pos_A"), _n(neg & a).alias("neg_A"), _n(pos & ~a).alias("pos_B"), _n(neg & ~a).alias("neg_B"))


def unit_periods(m: DataFrame) -> DataFrame:
    """Review counts and mean scores of each unit and period, by fold. m: a row a review; mentions only where each review
    has one."""
    a, b = F.col("fold") == "A", F.col("fold") == "B"
    return m.groupBy("unit", "period").agg(
        F.min("city").alias("city"), F.min("ord").alias("ord"), F.count("*").alias("n_reviews"), _n(a).alias("n_A"), _n(b).alias("n_B"),
        F.avg("score").alias("mean_score"), F.avg(F.when(a, F.col("score"))).alias("mean_A"), F.avg(F.when(b, F.col("score"))).alias("mean_B"))


def aspects_of(part_types: DataFrame) -> list[str]:
    found = [r[0] for r in part_types.distinct().limit(MOST_ASPECTS + 1).collect()]
    if len(found) > MOST_ASPECTS:
        raise ValueError(f"more than {MOST_ASPECTS} aspects")
    return sorted(found)


def dense_panel(m: DataFrame, aspects: list[str], prior: float = S.PRIOR, reviews: DataFrame | None = None) -> DataFrame:
    """A row for each aspect of each unit and period with a review; aspects without a mention have zero counts,
    a null raw net and a smoothed net of 0. reviews: a row a review, if mentions are not that."""
    grid = unit_periods(m if reviews is None else reviews).withColumn("aspect", F.explode(F.array(*[F.lit(a) for a in aspects])))
    names = ["pos", "neg", "pos_A", "neg_A", "pos_B", "neg_B"]
    full = grid.join(mention_counts(m), ["unit", "period", "aspect"], "left").fillna(0, names)
    c = F.col
    full = full.withColumn("total", c("pos") + c("neg")).withColumn("has", c("total") > 0)
    for f in ("A", "B"):
        full = full.withColumn(f"net_{f}", S.smoothed_net(c(f"pos_{f}"), c(f"neg_{f}"), prior))
    return full.withColumn("raw_net", S.raw_net(c("pos"), c("neg"))).withColumn("net", S.smoothed_net(c("pos"), c("neg"), prior)).withColumn("rel", S.reliability(c("total"), prior))


def complete_periods(m: DataFrame, kind: str = "year") -> DataFrame:
    """Periods that lie whole within the days of all data: period, ord, complete."""
    span = m.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    bounds = P.year_bounds if kind == "year" else P.quarter_bounds
    start, end = bounds(F.col("period"))
    periods = m.groupBy("period").agg(F.min("ord").alias("ord"))
    # One row on one side.
    return periods.join(F.broadcast(span)).select("period", "ord", ((F.col("lo") <= start) & (F.col("hi") >= end)).alias("complete"))


def with_complete(panel: DataFrame, m: DataFrame, kind: str = "year") -> DataFrame:
    return panel.join(complete_periods(m, kind).select("period", "complete"), "period")


def period_coverage(m: DataFrame) -> DataFrame:
    return m.groupBy("period").agg(F.countDistinct("d").alias("days"), F.min("d").cast("string").alias("first_day"), F.max("d").cast("string").alias("last_day"), F.count("*").alias("n"))


def coverage(panel: DataFrame, by: str) -> DataFrame:
    return panel.groupBy(by).agg(
        F.count("*").alias("cells"), _n(F.col("has")).alias("measured"), F.countDistinct("unit").alias("units"), F.sum("total").alias("mentions"), F.median("total").alias("median_mentions"))


def prior_sensitivity(panel: DataFrame, priors: tuple[float, ...] = (5.0, 10.0, 20.0)) -> DataFrame:
    """Mean, deviation and correlation with the main prior of the nets under other priors."""
    each = panel.where("has").withColumn("prior", F.explode(F.array(*[F.lit(p) for p in priors])))
    other = S.smoothed_net(F.col("pos"), F.col("neg"), F.col("prior"))
    return each.withColumn("other", other).groupBy("prior").agg(F.round(F.avg("other"), 9).alias("mean_net"), F.round(F.stddev_pop("other"), 9).alias("sd_net"), F.round(F.corr("other", "net"), 9).alias("corr_main"))


def first_seen(m: DataFrame, order: str = "d") -> DataFrame:
    """Each unit's name and city in its first review; ties by name."""
    first = F.min(F.struct(order, "unit_name", "city")).alias("f")
    return m.groupBy("unit").agg(first).select("unit", "f.unit_name", "f.city", F.col(f"f.{order}").cast("string").alias("first_day"))


def fold_reconciliation(folds: DataFrame, panel: DataFrame) -> DataFrame:
    """Units and periods on either side alone or on both, and how far counts and means differ."""
    left = folds.select("unit", "period", "n_reviews", "mean_score", F.lit(True).alias("l"))
    right = panel.groupBy("unit", "period").agg(F.min("n_reviews").alias("n2"), F.min("mean_score").alias("m2"), F.lit(True).alias("r"))
    both = left.join(right, ["unit", "period"], "full")
    return both.agg(
        _n(F.col("l") & F.col("r")).alias("both"), _n(F.col("r").isNull()).alias("left_only"), _n(F.col("l").isNull()).alias("right_only"),
        _n(F.col("n_reviews") != F.col("n2")).alias("n_mismatch"), _n(F.abs(F.col("mean_score") - F.col("m2")) >= 1e-6).alias("mean_mismatch"))


def integrity(panel: DataFrame, aspects: list[str]) -> DataFrame:
    """Counts of rows that break a rule of the panel; all are zero in a sound one."""
    c = F.col
    grain = panel.groupBy("unit", "period", "aspect").count().agg(_n(c("count") > 1).alias("repeated"))
    rows = panel.agg(
        F.count("*").alias("n_rows"), _n(~c("aspect").isin(aspects)).alias("unknown_aspect"), _n(~c("period").rlike(r"^\d{4}(Q[1-4])?$")).alias("bad_period"),
        _n((c("pos") < 0) | (c("neg") < 0) | (c("pos") + c("neg") != c("total"))).alias("bad_counts"), _n((c("pos_A") + c("pos_B") != c("pos")) | (c("neg_A") + c("neg_B") != c("neg"))).alias("bad_folds"),
        _n(c("has") != (c("total") > 0)).alias("bad_measured"), _n((c("net").isNull()) | (F.abs("net") > 1) | F.isnan("net")).alias("bad_net"))
    return rows.join(F.broadcast(grain))
