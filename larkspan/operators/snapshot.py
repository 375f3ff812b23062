"""The serving snapshot of one period, in long form: a row for each unit and aspect, with peer statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Evidence gates.
MIN_MENTIONS, MIN_REVIEWS, MIN_RELIABILITY, MIN_PEERS = 5, 10, 0.3, 2
#: Fixed value: the aspect that nobody can act on, whatever is said of it.
IMMUTABLE = "location"


def usable() -> Column:
    """A measured aspect with enough evidence to be a peer's value."""
    return F.col("has") & (F.col("mentions") >= MIN_MENTIONS) & (F.col("rel") >= MIN_RELIABILITY) & F.col("net").isNotNull()


def last_complete(periods: DataFrame) -> str:
    """The label of the last complete period: one value, read by the driver as a parameter."""
    row = periods.where("complete").agg(F.max_by("period", "ord").alias("p")).first()
    if row is None or row["p"] is None:
        raise ValueError("no complete period")
    return row["p"]


def records(panel: DataFrame, period: str) -> DataFrame:
    """Aspect records of one period; values that need a mention are null without."""
    has = F.col("has")
    return panel.where(F.col("period") == period).select(
        "unit", "city", "aspect", "has", F.when(has, F.col("net")).alias("net"), F.when(has, F.col("rel")).alias("rel"), F.col("total").alias("mentions"), F.col("pos").alias("pos_mentions"), F.col("neg").alias("neg_mentions"),
        F.try_divide(F.col("neg").cast("double"), F.col("total").cast("double")).alias("neg_rate"), F.try_divide(F.col("total").cast("double"), F.col("n_reviews").cast("double")).alias("mention_rate"), "n_reviews")


def peers_in_period(edges: DataFrame, rec: DataFrame) -> DataFrame:
    """Edges between different units whose peer has rows in the period, each once."""
    here = rec.select(F.col("unit").alias("peer")).distinct()
    return edges.where("unit != peer").select("unit", "peer", "rank").dropDuplicates(["unit", "peer"]).join(here, "peer", "left_semi")


def weakest(rec: DataFrame) -> DataFrame:
    """The usable aspect of least net, the immutable one included; ties by name."""
    return rec.where(usable()).groupBy("unit").agg(F.min(F.struct("net", "aspect")).alias("w")).select("unit", F.col("w.aspect").alias("weakest"))


def snapshot(panel: DataFrame, edges: DataFrame, places: DataFrame, period: str, actionable: list[str]) -> DataFrame:
    """actionable: the aspects that a unit can act on; any other is not, and location never is."""
    rec = records(panel, period)
    near = peers_in_period(edges, rec)
    peer_nets = rec.where(usable()).select(F.col("unit").alias("peer"), "aspect", F.col("net").alias("peer_net"))
    # Long form: one row a unit, peer and aspect, at most k times the panel.
    joined = near.select("unit", "peer").join(peer_nets, "peer").join(rec.select("unit", "aspect", F.col("net").alias("own")), ["unit", "aspect"])
    n = lambda c: F.count(F.when(c, 1))
    stats = joined.groupBy("unit", "aspect").agg(F.median("peer_net").alias("peer_median"), F.count("*").alias("peer_n"), n(F.col("peer_net") < F.col("own")).alias("below"), n(F.col("peer_net") == F.col("own")).alias("equal"))
    weak = weakest(rec)
    peer_weak = near.join(weak.select(F.col("unit").alias("peer"), "weakest"), "peer")
    # Share of the peers that have a weakest aspect at all.
    share = peer_weak.groupBy("unit").agg(F.count("*").alias("n_weak")), peer_weak.groupBy("unit", F.col("weakest").alias("aspect")).agg(F.count("*").alias("n_this"))
    header = rec.groupBy("unit").agg(F.count(F.when(F.col("has"), 1)).alias("n_measured")).join(near.groupBy("unit").agg(F.count("*").alias("peer_count")), "unit", "left").join(places.select("unit", "lat", "lon"), "unit", "left")
    reason = (
        F.when(F.col("lat").isNull() | F.col("lon").isNull(), "missing_coordinates").when(F.col("n_reviews") < MIN_REVIEWS, "insufficient_reviews")
        .when(F.coalesce("peer_count", F.lit(0)) < MIN_PEERS, "insufficient_peers").when(F.col("n_measured") == 0, "no_measured_aspects")
    )
    full = rec.join(stats, ["unit", "aspect"], "left").join(share[0], "unit", "left").join(share[1], ["unit", "aspect"], "left").join(header, "unit")
    return full.select(
        "unit", "city", "aspect", "has", "net", "rel", "mentions", "pos_mentions", "neg_mentions", "neg_rate", "mention_rate", "n_reviews", F.coalesce("peer_count", F.lit(0)).alias("peer_count"),
        "peer_median", F.coalesce("peer_n", F.lit(0)).alias("peer_n"), (F.col("peer_median") - F.col("net")).alias("gap"),
        F.when(F.col("net").isNotNull(), F.lit(100.0) * (F.coalesce("below", F.lit(0)).cast("double") + F.lit(0.5) * (F.coalesce("equal", F.lit(0)) + 1).cast("double")) / (F.coalesce("peer_n", F.lit(0)) + 1).cast("double")).alias("percentile"),
        F.try_divide(F.coalesce("n_this", F.lit(0)).cast("double"), F.col("n_weak").cast("double")).alias("weak_share"), reason.isNull().alias("eligible"), reason.alias("ineligible_reason"), (F.col("aspect").isin(actionable) & (F.col("aspect") != IMMUTABLE)).alias("actionable"))


def reference_counters(edges: DataFrame, rec: DataFrame) -> DataFrame:
    """Edges given, and those left out: to oneself, repeated, and to units without rows in the period."""
    one = lambda c: F.count(F.when(c, 1))
    here = rec.select(F.col("unit").alias("peer"), F.lit(True).alias("here")).distinct()
    kept = edges.groupBy("unit", "peer").agg(F.count("*").alias("n")).join(here, "peer", "left")
    other, known = F.col("unit") != F.col("peer"), F.col("here").isNotNull()
    return kept.agg(F.sum("n").alias("edges"), F.sum(F.when(~other, F.col("n")).otherwise(0)).alias("self_edges"), F.sum(F.when(other, F.col("n") - 1).otherwise(0)).alias("repeated"), one(other & ~known).alias("absent"), one(other & known).alias("kept"))


def counters(snap: DataFrame) -> DataFrame:
    units = snap.select("unit", "city", "eligible", "ineligible_reason").distinct()
    return units.groupBy(F.coalesce("ineligible_reason", F.lit("eligible")).alias("status")).agg(F.count("*").alias("units"), F.countDistinct("city").alias("cities"))


def documents(snap: DataFrame) -> DataFrame:
    """One nested row a unit, for a document sink."""
    fields = [c for c in snap.columns if c not in ("unit", "city", "n_reviews", "peer_count", "eligible", "ineligible_reason")]
    entry = F.struct("aspect", F.struct(*fields[1:]))
    return snap.groupBy("unit", "city", "n_reviews", "peer_count", "eligible", "ineligible_reason").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("aspects"))


def pick(scored: DataFrame, by: str = "score", keys: tuple[str, ...] = ("unit",)) -> DataFrame:
    """The aspect of largest score in each group; ties by name."""
    w = W.partitionBy(*keys).orderBy(F.desc(by), "aspect")
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
