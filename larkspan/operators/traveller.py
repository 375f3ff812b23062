"""Ranking units for a traveller, and simulated improvements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import score as S
from .policy import gate, peer_relative_score


#: Weights of made-up travellers.
PERSONAS = {
    "balanced": {"location": 3, "cleanliness": 3, "breakfast": 3, "service": 3, "noise": 3, "room": 3, "value": 3},
    "business": {"location": 5, "cleanliness": 4, "breakfast": 2, "service": 4, "noise": 4, "room": 3, "value": 1},
    "family": {"location": 3, "cleanliness": 5, "breakfast": 4, "service": 3, "noise": 3, "room": 5, "value": 3},
    "budget": {"location": 4, "cleanliness": 3, "breakfast": 1, "service": 1, "noise": 2, "room": 1, "value": 5},
    "couple": {"location": 4, "cleanliness": 3, "breakfast": 3, "service": 4, "noise": 5, "room": 4, "value": 2},
}
#: Rating points for a balance of 1, and percent of revenue for a rating point.
POINTS, REVENUE = 2.5, 5.0


def persona_of(weights: dict[str, float]) -> str | None:
    """The traveller with these weights and no others; absent weights are 0."""
    given = {a: float(w) for a, w in weights.items() if w}
    return next((name for name, own in PERSONAS.items() if given == {a: float(w) for a, w in own.items() if w}), None)


def checked_weights(weights: dict[str, float], aspects: list[str]) -> dict[str, float]:
    """Weights of all aspects, absent ones 0; unknown, negative and all-zero weights are refused."""
    if unknown := set(weights) - set(aspects):
        raise ValueError(f"unknown aspects {sorted(unknown)}")
    full = {a: float(weights.get(a, 0.0)) for a in aspects}
    if any(not w >= 0 or w == float("inf") for w in full.values()):
        raise ValueError("weights are finite and not negative")
    if not any(full.values()):
        raise ValueError("one weight at least is positive")
    return full


def _weight(weights: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(F.col("aspect") == a, F.lit(w)) for a, w in sorted(weights.items())], F.lit(0.0))


def match_scores(snap: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of weight, reliability and net over the sum of weight and reliability, over measured aspects. Peer gaps play no part."""
    w = snap.withColumn("w", _weight(weights))
    ok = F.col("has") & F.col("net").isNotNull() & F.col("rel").between(0, 1) & (F.col("w") * F.col("rel") > 0)
    sums = w.groupBy("unit", "city").agg(F.sum(F.when(ok, F.col("w") * F.col("rel") * F.col("net"))).alias("num"), F.sum(F.when(ok, F.col("w") * F.col("rel"))).alias("den"), F.sum(F.when(ok, F.col("w"))).alias("used"), F.sum("w").alias("all"), F.bool_and("eligible").alias("eligible"))
    return sums.select("unit", "city", "eligible", F.try_divide("num", "den").alias("score"), F.coalesce(F.try_divide("used", "all"), F.lit(0.0)).alias("coverage"))


def contributions(snap: DataFrame, weights: dict[str, float]) -> DataFrame:
    """What each aspect adds to the score; they sum to it."""
    w = snap.withColumn("w", _weight(weights)).where(F.col("has") & F.col("net").isNotNull()).where(F.col("w") * F.col("rel") > 0)
    e = F.col("w") * F.col("rel")
    return w.select("unit", "aspect", (e * F.col("net") / F.sum(e).over(W.partitionBy("unit"))).alias("part"))


def city_ranking(scores: DataFrame, names: DataFrame | None = None, steps: int = 1000) -> DataFrame:
    """Eligible units of each city, best first, ties by name, then by unit; those without a score come last, with no
    rank. place: the place in that order. names: unit, unit_name.

    Units are placed among those of their city with about the same score, so no city is sorted in one task."""
    ok = scores.where("eligible").select("city", "unit", F.round("score", 9).alias("score"))
    ok = ok.join(names.select("unit", "unit_name"), "unit", "left") if names is not None else ok.withColumn("unit_name", F.lit(""))
    ok = ok.withColumn("unit_name", F.coalesce("unit_name", F.lit(""))).withColumn("step", F.coalesce(F.floor((F.lit(1.0) - F.col("score")) * steps).cast("int"), F.lit(2 * steps + 1)))
    before = ok.groupBy("city", "step").agg(F.count("*").alias("n"))
    before = before.select("city", "step", (F.sum("n").over(W.partitionBy("city").orderBy("step")) - F.col("n")).alias("ahead"))
    w = W.partitionBy("city", "step").orderBy(F.desc("score"), "unit_name", "unit")
    placed = ok.withColumn("near", F.row_number().over(w)).join(before, ["city", "step"]).withColumn("place", F.col("ahead") + F.col("near"))
    return placed.select("city", "unit", "unit_name", "place", F.when(F.col("score").isNotNull(), F.col("place")).alias("rank"), "score")


def _flips(share: float) -> Column:
    return F.bround(F.lit(float(share)) * F.col("neg_mentions").cast("double")).cast("bigint")


def _checked(share: float) -> float:
    if not 0 <= share <= 1:
        raise ValueError("the share that turns is from 0 to 1")
    return float(share)


def improve(snap: DataFrame, share: float, prior: float = S.PRIOR) -> DataFrame:
    """Each aspect with `share` of its negative mentions turned positive (half to even), peers unchanged."""
    f = snap.where("has").withColumn("flips", _flips(_checked(share)))
    new = S.smoothed_net(F.col("pos_mentions") + F.col("flips"), F.col("neg_mentions") - F.col("flips"), prior)
    return f.select("unit", "city", "aspect", "flips", F.col("net").alias("before"), new.alias("after"), (new - F.col("net")).alias("gain"), (F.col("peer_median") - new).alias("gap_after"), "mentions", "net", "rel", "eligible", "has")


def improved(snap: DataFrame, choices: DataFrame, share: float, prior: float = S.PRIOR) -> DataFrame:
    """The snapshot after each unit has improved its aspect in choices (unit, aspect): counts, net, negative rate and gap."""
    mark = choices.select("unit", "aspect", F.lit(True).alias("_chosen"))
    return _moved(snap.join(mark, ["unit", "aspect"], "left").withColumn("_chosen", F.coalesce("_chosen", F.lit(False)) & F.col("has")), F.col("_chosen"), _checked(share), prior).select(*snap.columns)


def _moved(state: DataFrame, chosen: Column, share: float, prior: float = S.PRIOR) -> DataFrame:
    """The chosen rows improved; _flips has the number of mentions that turned."""
    state = state.withColumn("_flips", F.when(chosen, _flips(share)).otherwise(F.lit(0).cast("bigint")))
    state = state.withColumns({"pos_mentions": F.col("pos_mentions") + F.col("_flips"), "neg_mentions": F.col("neg_mentions") - F.col("_flips")})
    turned = F.col("_flips") > 0
    net = F.when(turned, S.smoothed_net(F.col("pos_mentions"), F.col("neg_mentions"), prior)).otherwise(F.col("net"))
    rate = F.when(turned, F.try_divide(F.col("neg_mentions").cast("double"), F.col("mentions").cast("double"))).otherwise(F.col("neg_rate"))
    return state.withColumns({"net": net, "neg_rate": rate}).withColumn("gap", F.when(F.col("_flips") > 0, F.col("peer_median") - F.col("net")).otherwise(F.col("gap")))


def _balance() -> Column:
    """Mention-weighted mean net of a unit's measured aspects."""
    w, has = W.partitionBy("unit"), F.col("has") & F.col("net").isNotNull()
    return F.try_divide(F.sum(F.when(has, F.col("mentions").cast("double") * F.col("net"))).over(w), F.sum(F.when(has, F.col("mentions").cast("double"))).over(w))


def balance(snap: DataFrame) -> DataFrame:
    """Mention-weighted mean net of a unit."""
    return snap.where("has").groupBy("unit").agg(F.round(F.try_divide(F.sum(F.col("mentions").cast("double") * F.col("net")), F.sum(F.col("mentions").cast("double"))), 9).alias("balance"))


def _outcome(before: Column, after: Column, points: float, revenue: float) -> list[Column]:
    gain = F.coalesce(after - before, F.lit(0.0))
    each = (("balance_before", before), ("balance_after", after), ("balance_gain", gain), ("rating_points", gain * F.lit(points)), ("revenue_pct", gain * F.lit(points) * F.lit(revenue)))
    return [F.round(c, 9).alias(name) for name, c in each]


def outcomes(snap: DataFrame, share: float, points_per_net: float = POINTS, revenue_per_point: float = REVENUE) -> DataFrame:
    """Balance before and after, and with its change those of rating and revenue under stated assumptions, if one aspect
    improves."""
    total = snap.where("has").groupBy("unit").agg(F.sum("mentions").alias("m"), F.try_divide(F.sum(F.col("mentions").cast("double") * F.col("net")), F.sum(F.col("mentions").cast("double"))).alias("b"))
    moved = improve(snap, share).join(total, "unit")
    after = F.col("b") + F.col("mentions").cast("double") * F.col("gain") / F.col("m").cast("double")
    return moved.select("unit", "aspect", "flips", *_outcome(F.col("b"), after, points_per_net, revenue_per_point))


def compare_actions(snap: DataFrame, share: float) -> DataFrame:
    """Candidate aspects of a unit by gain, ties by name, with a mark on the recommended one."""
    score = peer_relative_score()
    best = F.row_number().over(W.partitionBy("unit").orderBy(F.desc_nulls_last("score"), "aspect")) == 1
    ok = snap.withColumn("score", score).withColumn("recommended", best & F.col("score").isNotNull()).where(gate().isNull()).select("unit", "city", "aspect", "net", "recommended")
    ranked = outcomes(snap, share).join(ok, ["unit", "aspect"])
    rank = F.row_number().over(W.partitionBy("unit").orderBy(F.desc("rating_points"), "aspect"))
    return ranked.select("unit", "city", "aspect", "net", "recommended", "flips", "balance_before", "balance_after", "balance_gain", "rating_points", "revenue_pct", rank.alias("rank"))


def follow(snap: DataFrame, share: float, rounds: int = 3, points_per_net: float = POINTS, revenue_per_point: float = REVENUE) -> DataFrame:
    """Each round a unit improves what is recommended on its measures as they are then. A round without a recommendation
    has a null aspect; one in which nothing turns is stalled; either ends the unit's rounds. Outcomes are against the start.

    The plan holds all rounds; each is a window over a unit's rows, which stay where they are."""
    w = W.partitionBy("unit")
    share = _checked(share)
    state = snap.withColumn("_start", _balance()).withColumn("_on", F.lit(True))
    out = None
    for i in range(1, rounds + 1):
        state = state.withColumn("_score", peer_relative_score())
        state = state.withColumn("_first", F.row_number().over(w.orderBy(F.desc_nulls_last("_score"), "aspect")) == 1)
        state = _moved(state, F.col("_first") & F.col("_score").isNotNull() & F.col("_on"), share).withColumn("_now", _balance())
        chose = F.col("_score").isNotNull()
        results = [F.when(chose, c).alias(n) for n, c in zip(("balance_before", "balance_after", "balance_gain", "rating_points", "revenue_pct"), _outcome(F.col("_start"), F.col("_now"), points_per_net, revenue_per_point), strict=True)]
        step = state.where("_first AND _on").select("unit", F.lit(i).alias("round"), F.when(chose, F.col("aspect")).alias("aspect"), F.col("_flips").alias("flips"), (chose & (F.col("_flips") == 0)).alias("stalled"), *results)
        out = step if out is None else out.unionByName(step)
        state = state.withColumn("_on", F.max(F.when(F.col("_flips") > 0, 1).otherwise(0)).over(w) == 1)
    return out


def city_experiment(snap: DataFrame, share: float) -> DataFrame:
    """Mean rating gains in a city if its eligible units improve the recommended, a random, the best-liked or the best
    candidate. Units without a recommendation are counted and left out."""
    gains = compare_actions(snap, share)
    each = gains.groupBy("unit", "city").agg(
        F.max(F.when(F.col("recommended"), F.col("rating_points"))).alias("rec"), F.avg("rating_points").alias("rnd"), F.max_by("rating_points", F.struct("net", "aspect")).alias("lik"), F.max("rating_points").alias("top"))
    units = snap.where("eligible").select("unit", "city").distinct().join(each, ["unit", "city"], "left")
    m = lambda c: F.round(F.avg(F.when(F.col("rec").isNotNull(), F.col(c))), 8)
    part = lambda c: F.avg(F.when(F.col("rec").isNotNull(), (F.col("rec") >= F.col(c) - F.lit(1e-9)).cast("double")))
    return units.groupBy("city").agg(
        F.count("rec").alias("units"), F.count(F.when(F.col("rec").isNull(), 1)).alias("abstained"), m("rec").alias("recommended"), m("rnd").alias("random"), m("lik").alias("best_liked"), m("top").alias("oracle"),
        F.round(part("rnd"), 9).alias("beats_random"), F.round(part("top"), 9).alias("is_best"))


def rank_change(snap: DataFrame, weights: dict[str, float], changed: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Ranks and scores of units before and after each unit in changed (rows of a snapshot, one unit a city) takes the
    place of the one of that name."""
    before = city_ranking(match_scores(snap, weights), names)
    swapped = snap.join(changed.select("unit").distinct(), "unit", "left_anti").unionByName(changed)
    after = city_ranking(match_scores(swapped, weights), names)
    both = before.select("city", "unit", F.col("rank").alias("rank_before"), F.col("score").alias("score_before")).join(after.select("unit", F.col("rank").alias("rank_after"), F.col("score").alias("score_after")), "unit")
    mark = changed.select("unit", F.lit(True).alias("changed")).distinct()
    return both.join(mark, "unit", "left").select("city", "unit", F.coalesce("changed", F.lit(False)).alias("changed"), "rank_before", "rank_after", (F.col("rank_after") - F.col("rank_before")).alias("change"), "score_before", "score_after")


def mention_records(snap: DataFrame, seed: int = 0) -> DataFrame:
    """Synthetic mentions with the counts of the snapshot: unit, aspect, number, review, neg. A review is drawn by a keyed
    hash from as many as the unit has; no text is made."""
    rows = snap.where("has AND pos_mentions + neg_mentions > 0").select("unit", "aspect", "pos_mentions", "n_reviews", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pos_mentions") + F.col("neg_mentions"))).alias("number"))
    review = F.pmod(F.xxhash64("unit", "aspect", "number", F.lit(seed)), F.greatest(F.col("n_reviews"), F.lit(1))) + 1
    return rows.select("unit", "aspect", "number", review.alias("review"), (F.col("number") > F.col("pos_mentions")).alias("neg"))


def improve_records(records: DataFrame, choices: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Of each chosen aspect's negative mentions `share` (half to even), drawn by a keyed hash, become positive; `turned` marks them."""
    mark = choices.select("unit", "aspect", F.lit(True).alias("chosen"))
    w = W.partitionBy("unit", "aspect", "neg")
    draw = F.row_number().over(w.orderBy(F.xxhash64("unit", "aspect", "number", F.lit(seed), F.lit("flip")), "number"))
    n = F.bround(F.lit(_checked(share)) * F.count("*").over(w).cast("double")).cast("bigint")
    rows = records.join(mark, ["unit", "aspect"], "left").withColumn("turned", F.col("neg") & F.coalesce("chosen", F.lit(False)) & (draw <= n))
    return rows.select("unit", "aspect", "number", "review", (F.col("neg") & ~F.col("turned")).alias("neg"), "turned")


def from_records(records: DataFrame, prior: float = S.PRIOR) -> DataFrame:
    """Counts and nets of mentions."""
    one = lambda c: F.count(F.when(c, 1))
    return records.groupBy("unit", "aspect").agg(one(~F.col("neg")).alias("pos_mentions"), one(F.col("neg")).alias("neg_mentions")).withColumn("net", S.smoothed_net(F.col("pos_mentions"), F.col("neg_mentions"), prior))


def radar(snap: DataFrame, intensity: float) -> DataFrame:
    """Nets moved towards the peers' median."""
    return snap.where("has AND gap IS NOT NULL").select("unit", "aspect", S.clip(F.col("net") + F.lit(float(intensity)) * F.greatest(F.lit(0.0), F.col("gap")), -1.0, 1.0).alias("net"))


def strongest_and_weakest(snap: DataFrame, weights: dict[str, float], order: list[str]) -> DataFrame:
    """Of the aspects that enter a unit's score: the one of largest net, the first in order of configuration of equal
    ones, and that of least net, the last of equal ones; null if it is the same."""
    place = F.array_position(F.array(*[F.lit(a) for a in order]), F.col("aspect"))
    used = snap.withColumn("w", _weight(weights)).where(F.col("has") & F.col("net").isNotNull() & F.col("rel").between(0, 1) & (F.col("w") * F.col("rel") > 0))
    both = used.groupBy("unit").agg(F.max_by("aspect", F.struct(F.col("net"), -place)).alias("strongest"), F.min_by("aspect", F.struct(F.col("net"), -place)).alias("weakest"))
    return both.select("unit", "strongest", F.when(F.col("weakest") != F.col("strongest"), F.col("weakest")).alias("weakest"))
