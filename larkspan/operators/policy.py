"""Which aspect to improve first: evidence gates, scores, picks with abstention, and the evaluation of policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .snapshot import MIN_MENTIONS, MIN_PEERS, MIN_RELIABILITY, pick

#: Weights of gap, criticism and unreliability, and their variants.
WEIGHT_GRIDS = {
    "current-default": (0.45, 0.35, 0.2), "gap-dominant": (0.7, 0.2, 0.1), "criticism-dominant": (0.2, 0.7, 0.1),
    "reliability-conservative": (0.3, 0.2, 0.5), "equal-weight": (0.333333, 0.333333, 0.333334),
}
CROWDING = 0.5


def actionable() -> Column:
    """Unknown is no."""
    return F.coalesce(F.col("actionable"), F.lit(False))


def gate(actionable_only: bool = True, peers: bool = False, neg_mentions: bool = False, neg_rate: bool = False, crowding: bool = False) -> Column:
    """The first reason that speaks against an aspect; null if none does."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c))
    c = F.col
    reason = F.when(~c("eligible"), "unit_ineligible").when(~F.coalesce(c("has"), F.lit(False)), "no_measurement").when(~finite("net"), "nonfinite_net").when(c("mentions") < MIN_MENTIONS, "insufficient_mentions")
    reason = reason.when((c("pos_mentions") < 0) | (c("neg_mentions") < 0) | (c("neg_mentions") > c("mentions")), "invalid_counts").when(F.coalesce(c("rel"), F.lit(0.0)) < MIN_RELIABILITY, "insufficient_reliability")
    if actionable_only:
        reason = reason.when(~actionable(), "not_actionable")
    if neg_mentions:
        reason = reason.when(c("neg_mentions").isNull(), "invalid_neg_mentions")
    if neg_rate:
        reason = reason.when(~F.coalesce(c("neg_rate").between(0, 1), F.lit(False)), "invalid_neg_rate")
    if peers:
        reason = reason.when(~finite("gap"), "nonfinite_gap").when(c("peer_n") < MIN_PEERS, "insufficient_peers")
    if crowding:
        reason = reason.when(~F.coalesce(c("weak_share").between(0, 1), F.lit(False)), "crowding_unavailable")
    return reason


def gate_reasons(snap: DataFrame) -> DataFrame:
    return snap.select("unit", "aspect", F.coalesce(gate(peers=True, neg_rate=True), F.lit("eligible")).alias("reason"))


def _choice(scored: DataFrame, strategy: str) -> DataFrame:
    return pick(scored).select("unit", F.lit(strategy).alias("strategy"), "aspect", "score")


def fix_weakest(snap: DataFrame) -> DataFrame:
    return _choice(snap.where(gate().isNull()).withColumn("score", -F.col("net")), "fix_weakest")


def largest_gap(snap: DataFrame) -> DataFrame:
    return _choice(snap.where(gate(peers=True).isNull()).withColumn("score", F.col("gap")), "largest_peer_gap")


def most_criticised(snap: DataFrame) -> DataFrame:
    return _choice(snap.where(gate(neg_mentions=True).isNull()).withColumn("score", F.col("neg_mentions").cast("double")), "most_criticised")


def reliability_aware(snap: DataFrame) -> DataFrame:
    return _choice(snap.where(gate().isNull()).withColumn("score", -F.col("net") * F.col("rel")), "reliability_aware")


def diagnostic_gap(snap: DataFrame) -> DataFrame:
    """The largest gap of all aspects, those that nobody can act on included."""
    return _choice(snap.where(gate(actionable_only=False, peers=True).isNull()).withColumn("score", F.col("gap")), "diagnostic_largest_gap")


def _minmax(c: str, ok: Column, w) -> Column:
    """Scaled within the unit's candidates; 0 where they do not differ."""
    x = F.when(ok, F.col(c))
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi - lo > 0, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))


def peer_relative_score(weights: tuple[float, float, float] = WEIGHT_GRIDS["current-default"], intensity: float = 0.0) -> Column:
    """Gap and negative rate are scaled within the unit's own candidates, so gates come before scaling; null for others."""
    intensity = min(1.0, max(0.0, intensity))
    ok = gate(peers=True, neg_rate=True, crowding=intensity > 0).isNull()
    w = W.partitionBy("unit")
    score = F.lit(weights[0]) * _minmax("gap", ok, w) + F.lit(weights[1]) * _minmax("neg_rate", ok, w) - F.lit(weights[2]) * (F.lit(1.0) - F.col("rel"))
    if intensity > 0:
        score = score - F.lit(intensity) * F.lit(CROWDING) * F.col("weak_share")
    return F.when(ok, score)


def peer_relative_scores(snap: DataFrame, weights: tuple[float, float, float] = WEIGHT_GRIDS["current-default"], intensity: float = 0.0) -> DataFrame:
    return snap.withColumn("score", peer_relative_score(weights, intensity)).where("score IS NOT NULL")


def peer_relative(snap: DataFrame, weights: tuple[float, float, float] = WEIGHT_GRIDS["current-default"], intensity: float = 0.0) -> DataFrame:
    return _choice(peer_relative_scores(snap, weights, intensity), "peer_relative")


#: Another name of the same policy.
competition_aware = peer_relative


def ranking(snap: DataFrame, intensity: float) -> DataFrame:
    scored = peer_relative_scores(snap, intensity=intensity)
    return scored.select("unit", "aspect", "score", F.row_number().over(W.partitionBy("unit").orderBy(F.desc("score"), "aspect")).alias("rank"))


def value_aware(snap: DataFrame, value: dict[str, float], weights: tuple[float, float, float] = WEIGHT_GRIDS["current-default"]) -> DataFrame:
    """Deficits times values; penalties stay. value: by aspect, negative ones count 0, scaled to mean 1 (all 1 if all are 0)."""
    kept = {a: max(0.0, v) for a, v in value.items()}
    mean = sum(kept.values()) / max(1, len(kept))
    scaled = {a: v / mean if mean > 0 else 1.0 for a, v in kept.items()}
    ok = gate(peers=True, neg_rate=True).isNull()
    w = W.partitionBy("unit")
    v = F.coalesce(*[F.when(F.col("aspect") == a, F.lit(x)) for a, x in sorted(scaled.items())], F.lit(1.0))
    deficit = F.lit(weights[0]) * _minmax("gap", ok, w) + F.lit(weights[1]) * _minmax("neg_rate", ok, w)
    return _choice(snap.where(ok).withColumn("score", v * deficit - F.lit(weights[2]) * (F.lit(1.0) - F.col("rel"))), "value_aware")


def abstention(snap: DataFrame, choices: DataFrame) -> DataFrame:
    """Eligible units without a choice of a strategy, with the reason."""
    units = snap.where("eligible").select("unit").distinct()
    return units.join(choices, "unit", "left_anti").select("unit", F.lit("no_eligible_aspects").alias("reason"))


STRATEGIES = ["fix_weakest", "largest_peer_gap", "most_criticised", "reliability_aware", "peer_relative"]


def _scores() -> dict[str, Column]:
    """The score of each strategy; null where the aspect does not pass its gates."""
    plain = gate().isNull()
    return {
        "fix_weakest": F.when(plain, -F.col("net")), "largest_peer_gap": F.when(gate(peers=True).isNull(), F.col("gap")),
        "most_criticised": F.when(gate(neg_mentions=True).isNull(), F.col("neg_mentions").cast("double")),
        "reliability_aware": F.when(plain, -F.col("net") * F.col("rel")), "peer_relative": peer_relative_score(),
    }


def all_policies(snap: DataFrame) -> DataFrame:
    """A row for each unit and strategy that chooses. All scores come from one pass over a unit's rows."""
    each = F.array(*[F.struct(F.lit(k).alias("strategy"), c.alias("score")) for k, c in _scores().items()])
    long = snap.withColumn("each", each).select("unit", "aspect", F.explode("each").alias("e")).select("unit", "aspect", "e.strategy", "e.score").where("score IS NOT NULL")
    return pick(long, keys=("unit", "strategy")).select("unit", "strategy", "aspect", "score")


def evidence(snap: DataFrame, choices: DataFrame) -> DataFrame:
    """Choices with the evidence for them: mentions, reliability, gap, reference sets and candidates."""
    w = W.partitionBy("unit")
    facts = snap.withColumn("candidates", F.count(F.when(gate().isNull(), 1)).over(w))
    return choices.join(facts.select("unit", "aspect", "net", "rel", "mentions", "neg_mentions", "neg_rate", "gap", "peer_n", "percentile", "candidates"), ["unit", "aspect"])


def grid_choices(snap: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.lit(name).alias("grid"), peer_relative_score(w).alias("score")) for name, w in WEIGHT_GRIDS.items()])
    long = snap.withColumn("each", each).select("unit", "aspect", F.explode("each").alias("e")).select("unit", "aspect", "e.grid", "e.score").where("score IS NOT NULL")
    return pick(long, keys=("unit", "grid")).select("unit", "grid", "aspect")


def action_against_diagnosis(snap: DataFrame) -> DataFrame:
    """Where the largest gap, of any aspect, is not the one to act on: the peer-relative choice is."""
    scored = snap.withColumn("d", F.when(gate(actionable_only=False, peers=True).isNull(), F.col("gap"))).withColumn("a", peer_relative_score())
    best = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("s"), F.col("aspect")))).getField("aspect")
    both = scored.groupBy("unit").agg(best("d").alias("diagnosis"), best("a").alias("action")).where("diagnosis IS NOT NULL")
    return both.select("unit", "diagnosis", "action", (~F.col("diagnosis").eqNullSafe(F.col("action"))).alias("differs"))


def coverage(snap: DataFrame, choices: DataFrame) -> DataFrame:
    """By strategy, and by strategy and city: recommendations, and their share of eligible and of all units."""
    units = snap.select("unit", "city", "eligible").distinct()
    names = choices.select("strategy").distinct()
    grid = units.join(F.broadcast(names))  # a handful of strategies
    full = grid.join(choices.select("unit", "strategy", "aspect"), ["unit", "strategy"], "left")
    chosen = F.col("aspect").isNotNull() & F.col("eligible")
    one = lambda c: F.count(F.when(c, 1))
    out = full.groupingSets([["strategy"], ["strategy", "city"]], "strategy", "city").agg(one(chosen).alias("recommended"), one(F.col("eligible") & F.col("aspect").isNull()).alias("abstained"), one(F.col("eligible")).alias("eligible"), F.count("*").alias("units"))
    return out.select("strategy", F.coalesce("city", F.lit("(all)")).alias("city"), "recommended", "abstained", F.try_divide(F.col("recommended").cast("double"), F.col("eligible").cast("double")).alias("of_eligible"), F.try_divide(F.col("recommended").cast("double"), F.col("units").cast("double")).alias("of_all"))


def agreement(choices: DataFrame) -> DataFrame:
    """How often two strategies choose alike, over units where all of them choose."""
    n = choices.select("strategy").distinct().count()
    wide = choices.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("strategy", "aspect"))).alias("m")).where(F.size("m") == n)
    a = wide.select("unit", F.explode("m").alias("s1", "a1"), "m")
    both = a.select("unit", "s1", "a1", F.explode("m").alias("s2", "a2")).where("s1 < s2")
    return both.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.avg((F.col("a1") == F.col("a2")).cast("double")).alias("rate"))


def shares(choices: DataFrame) -> DataFrame:
    counts = choices.groupBy("strategy", "aspect").agg(F.count("*").alias("n"))
    return counts.select("strategy", "aspect", "n", (F.col("n").cast("double") / F.sum("n").over(W.partitionBy("strategy")).cast("double")).alias("share"))


def audit(snap: DataFrame, choices: DataFrame) -> DataFrame:
    """Choices that break a rule: no choice of a sound policy does."""
    full = choices.join(snap.select("unit", "aspect", "mentions", "rel", "actionable"), ["unit", "aspect"])
    one = lambda c: F.count(F.when(c, 1))
    return full.groupBy("strategy").agg(F.count("*").alias("choices"), one(~actionable()).alias("not_actionable"), one(F.col("actionable").isNull()).alias("unknown_actionability"), one((F.col("mentions") < MIN_MENTIONS) | (F.col("rel") < MIN_RELIABILITY)).alias("low_evidence"))
