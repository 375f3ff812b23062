"""Reference sets: nearest units of one city, within a radius, mutual, drawn at random; and measures of such graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import score as S
from .shared import settled


#: Units of a city of which all pairs are looked at; larger cities are divided by a grid.
DENSE = 2000


def _valid(places: DataFrame) -> DataFrame:
    return places.where(S.valid_coordinates(F.col("lat"), F.col("lon")))


def _measured(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Distances of the pairs of a (unit, la, lo) and b (peer, pa, po) that share a key."""
    near = S.haversine_km(F.col("la"), F.col("lo"), F.col("pa"), F.col("po"))
    return a.join(b, on).where("unit != peer").select("city", "unit", "peer", near.alias("km"))


def _own(ok: DataFrame, *more: str) -> DataFrame:
    return ok.select("city", "unit", F.col("lat").alias("la"), F.col("lon").alias("lo"), *more)


def _other(ok: DataFrame, *more: str) -> DataFrame:
    return ok.select("city", F.col("unit").alias("peer"), F.col("lat").alias("pa"), F.col("lon").alias("po"), *more)


def _boxes(ok: DataFrame) -> DataFrame:
    """Each city's size, corner and extent, and the cosine of its latitude farthest from the equator."""
    box = ok.groupBy("city").agg(F.count("*").alias("n"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.max(F.abs("lat")).alias("high"))
    return box.withColumn("cosine", F.greatest(F.cos(F.radians("high")), F.lit(1e-9)))


def _ring(cells: DataFrame) -> DataFrame:
    """Rows of cells (cx, cy) repeated for the cells around."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    return cells.withColumn("o", F.explode(offsets)).withColumn("cx", F.col("cx") + F.col("o.dx")).withColumn("cy", F.col("cy") + F.col("o.dy")).drop("o")


def _celled(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows with the cell of their place; boxes have dlat and dlon, the sides of a cell in degrees."""
    full = rows.join(boxes.select("city", "lat0", "lon0", "dlat", "dlon"), "city")
    return full.withColumn("cx", F.floor((F.col("lon") - F.col("lon0")) / F.col("dlon"))).withColumn("cy", F.floor((F.col("lat") - F.col("lat0")) / F.col("dlat"))).drop("lat0", "lon0", "dlat", "dlon")


def _ranked(pairs: DataFrame, *order: Column) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("unit").orderBy(*order)))


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    return _ranked(pairs, F.col("km"), F.col("peer")).where(F.col("rank") <= k)


def _grid_knn(ok: DataFrame, boxes: DataFrame, k: int) -> DataFrame:
    """The k nearest by cells that hold about k units: a unit is done if its k-th is nearer than whatever lies beyond the
    ring of cells around its own, and is asked again with cells twice as wide if not."""
    # Of units at one place the first k + 1 are all that can be among anyone's k nearest.
    there = W.partitionBy("city", "lat", "lon").orderBy("unit")
    peers = settled(ok.withColumn("i", F.row_number().over(there)).where(F.col("i") <= k + 1).drop("i"))
    span = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(1e-9))
    side = F.sqrt(F.lit(float(k)) / F.col("n"))
    boxes = settled(boxes.withColumn("dlat", span("lat1", "lat0") * side).withColumn("dlon", span("lon1", "lon0") * side))
    asked, done = settled(ok), None
    while True:
        # What is outside the ring differs by a side at least, in latitude or in longitude.
        border = F.least(F.radians("dlat") * S.EARTH_KM, F.lit(2 * S.EARTH_KM) * F.asin(F.col("cosine") * F.sin(F.radians(F.least("dlon", F.lit(180.0))) / 2)))
        whole = (F.col("dlat") > F.col("lat1") - F.col("lat0")) & (F.col("dlon") > F.col("lon1") - F.col("lon0"))
        found = _nearest(_measured(_own(_ring(_celled(asked, boxes)), "cx", "cy"), _other(_celled(peers, boxes), "cx", "cy"), ["city", "cx", "cy"]), k)
        found = settled(found.join(boxes.select("city", border.alias("border"), whole.alias("whole")), "city"))
        sure = found.groupBy("unit").agg(F.count("*").alias("n"), F.max("km").alias("far"), F.first("border").alias("border"), F.first("whole").alias("whole")).where((F.col("whole")) | ((F.col("n") == k) & (F.col("far") < F.col("border")))).select("unit")
        sure = settled(sure)
        some = found.join(sure, "unit", "left_semi").select("city", "unit", "peer", "km", "rank")
        done = some if done is None else done.unionByName(some)
        asked = settled(asked.join(sure, "unit", "left_anti"))
        if asked.isEmpty():
            return done
        boxes = settled(boxes.withColumn("dlat", F.col("dlat") * 2).withColumn("dlon", F.col("dlon") * 2))
        asked = asked.join(boxes.where((F.col("dlat") <= 4 * span("lat1", "lat0")) | (F.col("dlon") <= 4 * span("lon1", "lon0"))).select("city"), "city", "left_semi")


def knn(places: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest units of the same city; ties by number. In cities of up to DENSE units all pairs are ranked; Spark
    prunes each task's rows before the exchange."""
    ok = _valid(places)
    boxes = _boxes(ok)
    large = boxes.where((F.col("n") > DENSE) & (F.col("lon1") - F.col("lon0") < 180))
    if large.isEmpty():
        return _nearest(_measured(_own(ok), _other(ok), ["city"]), k)
    few, many = ok.join(large.select("city"), "city", "left_anti"), ok.join(large.select("city"), "city", "left_semi")
    return _nearest(_measured(_own(few), _other(few), ["city"]), k).unionByName(_grid_knn(many, large, k))


def within_radius(places: DataFrame, km: float = 1.5) -> DataFrame:
    """All units of the same city within a distance: each is in the ring of cells of that width."""
    ok = _valid(places)
    reach = F.sin(F.lit(min(km / S.EARTH_KM / 2, 1.57))) / F.col("cosine")
    wide = F.when(reach < 1, F.degrees(2 * F.asin(F.least(reach, F.lit(1.0))))).otherwise(360.0) * 1.000001
    boxes = _boxes(ok).withColumn("dlat", F.degrees(F.lit(km / S.EARTH_KM)) * 1.000001).withColumn("dlon", F.when(F.col("lon1") - F.col("lon0") < 180, wide).otherwise(360.0))
    cells = _celled(ok, boxes)
    pairs = _measured(_own(_ring(cells), "cx", "cy"), _other(cells, "cx", "cy"), ["city", "cx", "cy"])
    return _ranked(pairs.where(F.col("km") <= km), F.col("km"), F.col("peer"))


def mutual(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("peer").alias("unit"), F.col("unit").alias("peer"))
    return edges.join(back, ["unit", "peer"], "left_semi")


def random_peers(places: DataFrame, k: int = 10, seed: int = 42, local: bool = True) -> DataFrame:
    """k units drawn without replacement by a keyed hash: of the same city, or of the next city in order of name."""
    a = places.select("city", "unit")
    b = places.select("city", F.col("unit").alias("peer"))
    if local:
        pairs = a.join(b, "city").where("unit != peer")
    else:
        names = places.select("city").distinct()
        n = F.count("*").over(W.partitionBy())
        at = names.withColumn("i", F.row_number().over(W.orderBy("city"))).withColumn("n", n)
        to = at.select(F.col("city").alias("other"), F.col("i").alias("j"))
        next_city = at.join(to, F.col("j") == F.col("i") % F.col("n") + 1).where("n > 1").select("city", "other")
        pairs = a.join(next_city, "city").join(b.withColumnRenamed("city", "other"), "other").select("city", "unit", "peer")
    draw = F.xxhash64("unit", "peer", F.lit(seed))
    return _ranked(pairs.withColumn("draw", draw), F.col("draw"), F.col("peer")).where(F.col("rank") <= k).drop("draw")


def graph_metrics(edges: DataFrame, places: DataFrame) -> DataFrame:
    city = places.select(F.col("unit").alias("peer"), F.col("city").alias("peer_city"))
    full = edges.join(city, "peer", "left")
    return full.agg(
        F.count("*").alias("edges"), F.countDistinct("unit").alias("units"), F.count(F.when(F.col("unit") == F.col("peer"), 1)).alias("self_edges"), F.count(F.when(F.col("city") != F.col("peer_city"), 1)).alias("cross_city"),
        F.round(F.median("km"), 6).alias("median_km"), F.round(F.percentile("km", 0.9), 6).alias("p90_km"))


def distance_bins(edges: DataFrame, edges_km: tuple[float, ...] = (0.0, 50.0, 100.0, 200.0, 400.0, 800.0)) -> DataFrame:
    """Counts in fixed bins, closed on the right; empty bins count zero."""
    bins = edges.sparkSession.createDataFrame([(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(edges_km, [*edges_km[1:], 1e9], strict=True))], "bin int, lo double, hi double")
    own = sum((F.when(F.col("km") > lo, 1).otherwise(0) for lo in edges_km), F.lit(0)) - 1
    counts = edges.where(F.col("km") > edges_km[0]).groupBy(own.alias("bin")).count()
    return bins.join(counts, "bin", "left").select("bin", "lo", F.coalesce("count", F.lit(0)).alias("n"))


def top1_stability(one: DataFrame, two: DataFrame) -> DataFrame:
    a = one.where("rank = 1").select("unit", F.col("peer").alias("p1"))
    b = two.where("rank = 1").select("unit", F.col("peer").alias("p2"))
    return a.join(b, "unit").agg(F.count("*").alias("n"), F.avg((F.col("p1") == F.col("p2")).cast("double")).alias("share"))


def integrity(edges: DataFrame, places: DataFrame) -> DataFrame:
    city = places.select("unit", F.col("city").alias("own_city"))
    full = edges.join(city, "unit", "left").join(places.select(F.col("unit").alias("peer"), F.col("city").alias("peer_city")), "peer", "left")
    grain = edges.groupBy("unit", "peer").count().agg(F.count(F.when(F.col("count") > 1, 1)).alias("repeated"))
    rows = full.agg(F.count("*").alias("n_edges"), F.count(F.when(F.col("unit") == F.col("peer"), 1)).alias("self_edges"), F.count(F.when(~F.col("own_city").eqNullSafe(F.col("peer_city")), 1)).alias("cross_city"))
    return rows.join(F.broadcast(grain))


def pair_similarity(edges: DataFrame, panel: DataFrame) -> DataFrame:
    """Mean over edges of the mean difference of the measured nets of both ends."""
    nets = panel.where("has").select("unit", "aspect", "net")
    own = edges.select("unit", "peer").join(nets, "unit")
    both = own.join(nets.select(F.col("unit").alias("peer"), "aspect", F.col("net").alias("net2")), ["peer", "aspect"])
    each = both.groupBy("unit", "peer").agg(F.avg(F.abs(F.col("net") - F.col("net2"))).alias("diff"))
    return each.agg(F.count("*").alias("edges"), F.round(F.avg("diff"), 9).alias("mean_diff"))


def pair_score_difference(edges: DataFrame, panel: DataFrame) -> DataFrame:
    """Mean over edges of the difference of the mean scores of both ends, which have one each in a panel of one period."""
    scores = panel.groupBy("unit").agg(F.first("mean_score", ignorenulls=True).alias("score"))
    own = edges.select("unit", "peer").join(scores, "unit")
    both = own.join(scores.select(F.col("unit").alias("peer"), F.col("score").alias("score2")), "peer")
    return both.agg(F.round(F.avg(F.abs(F.col("score") - F.col("score2"))), 9).alias("mean_score_diff"))


def delta_correlation(edges: DataFrame, deltas: DataFrame, least: int = 20) -> DataFrame:
    """Correlation of changes of both ends of an edge, by aspect; null below a number of rows."""
    own = edges.select("unit", "peer").join(deltas.select("unit", "period", "aspect", "delta"), "unit")
    both = own.join(deltas.select(F.col("unit").alias("peer"), "period", "aspect", F.col("delta").alias("delta2")), ["peer", "period", "aspect"])
    return both.groupBy("aspect").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.round(F.corr("delta", "delta2"), 9)).alias("corr"))
