"""Changes over time: deltas, permissive, strict and persistent events, exposure, cooldown, controls and matching."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def cell():
    """A unit's aspect in order of time."""
    return W.partitionBy("unit", "aspect").orderBy("ord")


def deltas(panel: DataFrame) -> DataFrame:
    """Change of the net since the period before, where that one is there."""
    d = panel.withColumn("prev_ord", F.lag("ord").over(cell())).withColumn("prev_net", F.lag("net").over(cell())).withColumn("prev_total", F.lag("total").over(cell())).withColumn("prev_has", F.lag("has").over(cell()))
    return d.where("prev_ord = ord - 1").withColumn("delta", F.col("net") - F.col("prev_net"))


def _around(panel: DataFrame) -> DataFrame:
    """Rows of the same cell before and after."""
    w = W.partitionBy("unit", "aspect")
    return panel.withColumn("before", F.row_number().over(cell()) - 1).withColumn("n_rows", F.count("*").over(w)).withColumn("after", F.col("n_rows") - F.col("before") - 1)


def permissive_events(panel: DataFrame, threshold: float = 0.15, mentions: int = 5, pre: int = 2, post: int = 2) -> DataFrame:
    """A rise of the net on neighbouring periods, with enough mentions now, and rows before and after."""
    return deltas(_around(panel)).where((F.col("delta") >= threshold) & (F.col("total") >= mentions) & (F.col("before") >= pre) & (F.col("after") >= post)).select("unit", "city", "aspect", "period", "ord", "delta", "total")


def exposure(events: DataFrame, edges: DataFrame, moves: DataFrame, threshold: float = 0.15, least: int = 1, measured: bool = False) -> DataFrame:
    """Of each event's peers with a change of the same aspect in the same period: how many, and the share that rose."""
    m = moves.where("has AND prev_has") if measured else moves
    peer = m.select(F.col("unit").alias("peer"), "aspect", "ord", F.col("delta").alias("peer_delta"))
    joined = events.join(edges.select("unit", "peer"), "unit").join(peer, ["peer", "aspect", "ord"])
    stats = joined.groupBy("unit", "aspect", "ord").agg(F.count("*").alias("known"), F.count(F.when(F.col("peer_delta") >= threshold, 1)).alias("improving"), F.round(F.max("peer_delta"), 9).alias("max_peer_delta"))
    return events.join(stats, ["unit", "aspect", "ord"]).where(F.col("known") >= least).withColumn("exposure", F.col("improving").cast("double") / F.col("known").cast("double"))


def _log_gammas(x: float, n: int) -> np.ndarray:
    """log of the gamma function at x, x + 1, ..., x + n - 1."""
    return math.lgamma(x) + np.concatenate([[0.0], np.cumsum(np.log(x + np.arange(n - 1)))])


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)


def beta_greater(a1: float, b1: float, a0: float, b0: float) -> float:
    """P(X1 > X0) of two beta variables: a finite sum for whole a1, quadrature otherwise."""
    if a1 == int(a1) and a1 <= 100_000:
        n = int(a1)
        over = _log_gammas(a0, n) + math.lgamma(b0 + b1) - _log_gammas(a0 + b0 + b1, n)
        under = _log_gammas(1.0, n) + math.lgamma(b1) - _log_gammas(1.0 + b1, n)
        return float(min(1.0, max(0.0, np.exp(over - np.log(b1 + np.arange(n)) - under - _log_beta(a0, b0)).sum())))
    x = (_NODES + 1) / 2
    log = lambda a, b: (a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - _log_beta(a, b)
    one, zero = np.exp(log(a1, b1)), np.exp(log(a0, b0))
    fine = np.linspace(0, 1, 4097)[1:-1]
    below = np.interp(x, fine, np.cumsum(np.exp((a0 - 1) * np.log(fine) + (b0 - 1) * np.log1p(-fine) - _log_beta(a0, b0))) / 4096)
    return float(min(1.0, max(0.0, (one * below * _WEIGHTS / 2).sum()))) if zero.size else 0.0


def with_posterior(df: DataFrame, prior: float = 10.0) -> DataFrame:
    """Adds p_rise: how likely the share of positive mentions rose, from counts pos, neg, prev_pos and prev_neg. Each
    different set of counts is worked out once a batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, counts = prior / 2, ["pos", "neg", "prev_pos", "prev_neg"]
        for f in frames:
            sets, which = np.unique(f[counts].to_numpy(), axis=0, return_inverse=True)
            f["p_rise"] = np.array([beta_greater(*(x + h for x in row)) for row in sets.tolist()])[which.reshape(-1)] if len(f) else []
            yield f

    return df.mapInPandas(run, df.schema.simpleString()[7:-1] + ",p_rise:double")


def strict_candidates(panel: DataFrame, threshold: float = 0.15, now: int = 5, before: int = 5, earlier: int = 3, immutable: str | None = None, fold: str | None = None) -> DataFrame:
    """Rises in complete periods with two complete ones on either side, measured and with enough mentions; no posterior yet.
    fold: A or B takes nets and counts of that half of the reviews, None of all. around: whether the cell is measured in the
    two periods before and the two after."""
    full = panel.where("complete")
    if fold is not None:
        pos, neg = F.col(f"pos_{fold}"), F.col(f"neg_{fold}")
        full = full.withColumns({"pos": pos, "neg": neg, "total": pos + neg, "has": pos + neg > 0, "net": F.col(f"net_{fold}")})
    span = full.agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    lag2 = F.when(F.lag("ord", 2).over(cell()) == F.col("ord") - 2, F.lag("total", 2).over(cell()))
    at = lambda f, k: F.when(f("ord", abs(k)).over(cell()) == F.col("ord") + k, f("has", abs(k)).over(cell()))
    whole = at(F.lag, -2) & at(F.lag, -1) & at(F.lead, 1) & at(F.lead, 2)
    rows = full.withColumn("pre2", F.coalesce(lag2, F.lit(0))).withColumn("prev_pos", F.lag("pos").over(cell())).withColumn("prev_neg", F.lag("neg").over(cell())).withColumn("around", F.coalesce(whole, F.lit(False)))
    d = deltas(rows).join(F.broadcast(span)).where("ord - lo >= 2 AND hi - ord >= 2")  # one row
    kept = d.where(F.col("has") & F.col("prev_has") & (F.col("total") >= now) & (F.col("prev_total") >= before) & (F.col("pre2") >= earlier) & (F.col("delta") >= threshold))
    if immutable is not None:
        kept = kept.where(F.col("aspect") != immutable)
    return kept.select("unit", "city", "aspect", "period", "ord", "delta", "total", "pos", "neg", "prev_pos", "prev_neg", "around")


def cooldown(events: DataFrame, periods: int = 2, keys: tuple[str, ...] = ("unit", "aspect")) -> DataFrame:
    """Of each unit and aspect, events more than `periods` after the last one kept. A fold over the cell's sorted events,
    which are at most one a period."""
    zero = F.struct(F.lit(-(10**9)).alias("last"), F.array().cast("array<int>").alias("kept"))
    step = lambda s, o: F.when(o - s["last"] > periods, F.struct(o.alias("last"), F.concat(s["kept"], F.array(o)).alias("kept"))).otherwise(s)
    kept = events.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("ord").cast("int"))).alias("o")).select(*keys, F.explode(F.aggregate("o", zero, step)["kept"]).alias("ord"))
    return events.join(kept, [*keys, "ord"], "left_semi")


def strict_events(panel: DataFrame, edges: DataFrame, threshold: float = 0.15, p: float = 0.9, prior: float = 10.0, peers: int = 5, rest: int = 2, immutable: str | None = None, fold: str | None = None) -> DataFrame:
    """fold: A or B detects in that half of the reviews; None in all."""
    likely = with_posterior(strict_candidates(panel, threshold, immutable=immutable, fold=fold), prior).where(F.col("p_rise") >= p)
    moves = panel.where("complete")
    if fold is not None:
        moves = moves.withColumns({"net": F.col(f"net_{fold}"), "has": F.col(f"pos_{fold}") + F.col(f"neg_{fold}") > 0})
    return cooldown(exposure(likely, edges, deltas(moves), threshold, peers, measured=True), rest)


def strict_run(panel: DataFrame, edges: DataFrame, immutable: str, **options) -> DataFrame:
    """Events of both halves of the reviews and of all, and those of the aspect that nobody acts on as a control: a row for
    each with its set: A, B, ALL or CONTROL."""
    parts = [strict_events(panel, edges, immutable=immutable, fold=f, **options).withColumn("set", F.lit(f or "ALL")) for f in ("A", "B", None)]
    control = strict_events(panel.where(F.col("aspect") == immutable), edges, **options).withColumn("set", F.lit("CONTROL"))
    out = control
    for part in parts:
        out = out.unionByName(part)
    return out


#: What an exploratory verdict needs, and an associational one.
EXPLORATORY = {"events": 300, "units": 200, "cities": 4, "aspects": 4, "exposed": 100, "unexposed": 100, "around": 0.7}
ASSOCIATIONAL = {"events": 50, "units": 30}


def strict_verdict(run: DataFrame, green: dict[str, float] = EXPLORATORY, amber: dict[str, float] = ASSOCIATIONAL) -> DataFrame:
    """Counts over the events of both halves, and the verdict: GREEN_EXPLORATORY if all floors are met and both halves have
    events, AMBER_ASSOCIATIONAL if one half has none or the lower floors are met, else RED_MEASUREMENT."""
    n = lambda c: F.count(F.when(c, 1))
    e = run.where(F.col("set").isin("A", "B")).agg(
        F.count("*").alias("events"), F.countDistinct("unit").alias("units"), F.countDistinct("city").alias("cities"), F.countDistinct("aspect").alias("aspects"), n(F.col("exposure") > 0).alias("exposed"), n(F.col("exposure") == 0).alias("unexposed"),
        F.coalesce(F.avg(F.col("around").cast("double")), F.lit(0.0)).alias("around"), F.countDistinct("set").alias("halves"))
    meets = lambda floors: F.least(F.lit(1), *[(F.col(c) >= x).cast("int") for c, x in floors.items()]) == 1
    verdict = F.when(meets(green) & (F.col("halves") == 2), "GREEN_EXPLORATORY").when(meets(green) | meets(amber), "AMBER_ASSOCIATIONAL").otherwise("RED_MEASUREMENT")
    return e.withColumn("verdict", verdict)


def strict_grid(panel: DataFrame, edges: DataFrame, thresholds: tuple[float, ...] = (0.1, 0.15, 0.2), priors: tuple[float, ...] = (5.0, 10.0, 20.0), ks: tuple[int, ...] = (5, 10, 20), p: float = 0.9, peers: int = 5, rest: int = 2, immutable: str | None = None) -> DataFrame:
    """Strict events under each threshold, prior of the posterior and number of nearest peers: counts of events and units.
    edges: ranked, with the largest number of peers. Candidates, posteriors and peers are worked out once for all cells of the grid."""
    found = strict_candidates(panel, min(thresholds), immutable=immutable)
    for i, prior in enumerate(priors):
        found = with_posterior(found, prior).withColumnRenamed("p_rise", f"p{i}")
    moved = deltas(panel.where("complete")).where("has AND prev_has").select(F.col("unit").alias("peer"), "aspect", "ord", F.lit(True).alias("m"))
    known = found.select("unit", "aspect", "ord").join(edges.select("unit", "peer", "rank"), "unit").join(moved, ["peer", "aspect", "ord"])
    known = known.groupBy("unit", "aspect", "ord").agg(*[F.count(F.when(F.col("rank") <= k, 1)).alias(f"k{k}") for k in ks])
    grid = [F.when((F.col("delta") >= t) & (F.col(f"p{i}") >= p) & (F.col(f"k{k}") >= peers), F.struct(F.lit(t).alias("threshold"), F.lit(prior).alias("prior"), F.lit(k).alias("k"))) for t in thresholds for i, prior in enumerate(priors) for k in ks]
    each = found.join(known, ["unit", "aspect", "ord"]).select("unit", "aspect", "ord", F.explode(F.filter(F.array(*grid), lambda g: g.isNotNull())).alias("g")).select("unit", "aspect", "ord", "g.*")
    kept = cooldown(each, rest, ("threshold", "prior", "k", "unit", "aspect")).groupBy("threshold", "prior", "k").agg(F.count("*").alias("events"), F.countDistinct("unit").alias("units"))
    cells = panel.sparkSession.createDataFrame([(t, q, k) for t in thresholds for q in priors for k in ks], "threshold double, prior double, k int")
    return cells.join(kept, ["threshold", "prior", "k"], "left").fillna(0, ["events", "units"])


def cells(panel: DataFrame) -> DataFrame:
    """Each cell with its neighbours before and after."""
    out = panel
    for c in ("net", "rel", "has", "ord", "mean_score", "complete"):
        out = out.withColumn(f"{c}_0", F.lag(c).over(cell())).withColumn(f"{c}_2", F.lead(c).over(cell()))
    return out.where("ord_0 = ord - 1 AND ord_2 = ord + 1")


def persistent_events(around: DataFrame, tau: float = 0.25, keep: float = 0.5, reliability: float = 0.3, sign: int = 1) -> DataFrame:
    """A jump (or drop) of at least tau of which at least a part is there one period later."""
    s = F.lit(float(sign))
    jump, stay = s * (F.col("net") - F.col("net_0")), s * (F.col("net_2") - F.col("net_0"))
    ok = (F.col("rel_0") >= reliability) & (F.col("rel") >= reliability) & (F.col("rel_2") >= reliability) & F.col("has") & F.col("complete_2")
    return around.where((jump >= tau) & (stay >= tau * keep) & ok).select("unit", "city", "aspect", "period", "ord", F.round(jump, 9).alias("jump"), F.round(stay, 9).alias("stay"))


def control_pool(events: DataFrame, panel: DataFrame, window: int = 2) -> DataFrame:
    """For each event, units of its city with the same aspect and period, measured the period before, that have no event
    of that aspect within the window."""
    prev = W.partitionBy("unit", "aspect").orderBy("ord")
    state = panel.withColumn("had", F.lag("has").over(prev)).withColumn("po", F.lag("ord").over(prev)).withColumn("q1", F.lag("net").over(prev)).withColumn("q2", F.lag("net", 2).over(prev))
    state = state.where("po = ord - 1 AND had").select(F.col("unit").alias("control"), "city", "aspect", "ord", "q1", F.coalesce(F.col("q1") - F.col("q2"), F.lit(0.0)).alias("trend"))
    near = events.select(F.col("unit").alias("control"), "aspect", F.explode(F.sequence(F.col("ord") - window, F.col("ord") + window)).alias("ord")).distinct()
    free = state.join(near, ["control", "aspect", "ord"], "left_anti")
    own = events.select("unit", "city", "aspect", "ord")
    mine = state.select(F.col("control").alias("unit"), "aspect", "ord", F.col("q1").alias("e1"), F.col("trend").alias("et"))
    both = own.join(mine, ["unit", "aspect", "ord"]).join(free, ["city", "aspect", "ord"]).where("unit != control")
    gap = (F.col("q1") - F.col("e1")) * (F.col("q1") - F.col("e1")) + (F.col("trend") - F.col("et")) * (F.col("trend") - F.col("et"))
    return both.select("city", "aspect", "ord", "unit", "control", gap.alias("distance"))


def match(pool: DataFrame) -> DataFrame:
    """Each event's nearest free control, events in order of unit; a control serves once in a city, aspect and period.
    What is used in one such group never matters in another, so groups run side by side."""

    def greedy(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["unit", "distance", "control"], kind="stable")
        used, rows = set(), []
        for unit, g in f.groupby("unit", sort=True):
            free = g[~g["control"].isin(used)]
            if len(free):
                first = free.iloc[0]
                used.add(first["control"])
                rows.append((first["city"], first["aspect"], int(first["ord"]), int(unit), int(first["control"]), float(first["distance"])))
        return pd.DataFrame(rows, columns=["city", "aspect", "ord", "unit", "control", "distance"])

    return pool.groupBy("city", "aspect", "ord").applyInPandas(greedy, "city string, aspect string, ord int, unit long, control long, distance double")


def event_means(matches: DataFrame, panel: DataFrame, reach: int = 2) -> DataFrame:
    """Mean difference of event and control units by time since the event, less that one period before it."""
    times = matches.select("unit", "control", "aspect", "ord", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("k")).withColumn("at", F.col("ord") + F.col("k"))
    net = panel.select("unit", "aspect", F.col("ord").alias("at"), "net")
    both = times.join(net, ["unit", "aspect", "at"]).join(net.select(F.col("unit").alias("control"), "aspect", "at", F.col("net").alias("net_c")), ["control", "aspect", "at"])
    d = both.withColumn("d", F.col("net") - F.col("net_c"))
    base = d.where("k = -1").select("unit", "control", "aspect", "ord", F.col("d").alias("base"))
    return d.join(base, ["unit", "control", "aspect", "ord"]).groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg(F.col("d") - F.col("base")), 9).alias("mean"))


def inventory(events: DataFrame) -> DataFrame:
    return events.groupBy("aspect").agg(F.count("*").alias("n"), F.countDistinct("unit").alias("units"), F.countDistinct("city").alias("cities"))


#: What a study needs to go ahead.
GREEN = {"units": 20, "events": 50, "cities": 4, "aspects": 4}


def feasibility(events: DataFrame, panel: DataFrame, green: dict[str, int] = GREEN) -> DataFrame:
    """GREEN if all floors are met, AMBER if half of units and events are, else RED."""
    e = events.agg(F.count("*").alias("events"), F.countDistinct("city").alias("cities"), F.countDistinct("aspect").alias("aspects"), F.countDistinct("unit").alias("units"))
    ok = lambda c, part=1.0: F.col(c) >= green[c] * part
    whole: Column = ok("units") & ok("events") & ok("cities") & ok("aspects")
    return e.select("events", "units", "cities", "aspects", F.when(whole, "GREEN").when(ok("units", 0.5) & ok("events", 0.5), "AMBER").otherwise("RED").alias("verdict"))


def specificity(around: DataFrame, events: DataFrame) -> DataFrame:
    """Whether the aspect of an event moved more than the unit's others: mean and standard error of the difference."""
    moved = around.withColumn("move", F.col("net") - F.col("net_0"))
    w = W.partitionBy("unit", "ord")
    others = (F.sum("move").over(w) - F.col("move")) / F.nullif(F.count("move").over(w) - 1, F.lit(0))
    own = moved.withColumn("diff", F.col("move") - others).join(events.select("unit", "aspect", "ord"), ["unit", "aspect", "ord"], "left_semi")
    return own.groupBy("aspect").agg(F.count("diff").alias("n"), F.round(F.avg("diff"), 9).alias("mean"), F.round(F.stddev_samp("diff") / F.sqrt(F.count("diff").cast("double")), 9).alias("se"))
