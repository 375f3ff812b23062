"""Lags, features, baselines and estimators. Sums run in Spark; only small dense systems are solved by the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def unit_time():
    return W.partitionBy("unit").orderBy("ord")


def score_lags(periods: DataFrame) -> DataFrame:
    """Rows before and after, whether or not a period lies between."""
    l1, l2 = F.lag("mean_score").over(unit_time()), F.lag("mean_score", 2).over(unit_time())
    return periods.select("unit", "city", "period", "ord", "n_reviews", F.col("mean_score").alias("y"), l1.alias("lag1"), l2.alias("lag2"), (F.col("mean_score") - l1).alias("trend"), F.lead("mean_score").over(unit_time()).alias("y_next"), (F.lag("ord").over(unit_time()) == F.col("ord") - 1).alias("contiguous"))


def features(panel: DataFrame, periods: DataFrame, aspects: list[str]) -> DataFrame:
    """One row a unit and period: nets and missing flags of all aspects, lags and log volume."""
    wide = panel.groupBy("unit", "period").agg(*[F.max(F.when((F.col("aspect") == a) & F.col("has"), F.col("net"))).alias(f"net_{a}") for a in aspects])
    full = score_lags(periods).join(wide, ["unit", "period"])
    for a in aspects:
        full = full.withColumn(f"miss_{a}", F.col(f"net_{a}").isNull().cast("double"))
    return full.withColumn("volume", F.log1p(F.col("n_reviews").cast("double")))


def baselines(lags: DataFrame, train_until: int) -> DataFrame:
    """Errors on later rows of persistence, own trend and the city's mean of the rows before, the global one where it has none."""
    train, test = lags.where((F.col("ord") <= train_until) & F.col("y_next").isNotNull()), lags.where((F.col("ord") > train_until) & F.col("y_next").isNotNull())
    city = train.groupBy("city").agg(F.avg("y_next").alias("city_mean"))
    whole = train.agg(F.avg("y_next").alias("global_mean"))
    t = test.join(city, "city", "left").join(F.broadcast(whole))  # one row
    err = {"persistence": F.col("y"), "trend": F.coalesce(F.col("y") + F.col("trend"), F.col("y")), "city_mean": F.coalesce("city_mean", "global_mean")}
    return t.agg(F.count("*").alias("n"), *[F.round(F.avg(F.abs(F.col("y_next") - e)), 9).alias(f"mae_{k}") for k, e in err.items()], *[F.round(F.sqrt(F.avg((F.col("y_next") - e) * (F.col("y_next") - e))), 9).alias(f"rmse_{k}") for k, e in err.items()])


def demeaned(panel: DataFrame) -> DataFrame:
    """Nets less their mean over the cell's periods."""
    return panel.where("has").select("unit", "aspect", "period", F.round(F.col("net") - F.avg("net").over(W.partitionBy("unit", "aspect")), 9).alias("within"))


def leave_one_out(panel: DataFrame) -> DataFrame:
    """The mean of a unit's other aspects in the same period."""
    w = W.partitionBy("unit", "period")
    return panel.where("has").select("unit", "aspect", "period", F.round((F.sum("net").over(w) - F.col("net")) / F.nullif(F.count("net").over(w) - 1, F.lit(0)), 9).alias("others"))


def cluster_mean(df: DataFrame, y: str, cluster: str) -> DataFrame:
    """Mean with a standard error that is robust to correlation within clusters."""
    total = df.where(F.col(y).isNotNull()).agg(F.avg(y).alias("m"))
    sums = df.where(F.col(y).isNotNull()).join(F.broadcast(total)).groupBy(cluster).agg(F.sum(F.col(y) - F.col("m")).alias("s"), F.count("*").alias("n"), F.min("m").alias("m"))
    g = F.count("*").cast("double")
    return sums.agg(F.count("*").alias("clusters"), F.sum("n").alias("n"), F.round(F.min("m"), 9).alias("mean"), F.round(F.sqrt(g / (g - 1)) * F.sqrt(F.sum(F.col("s") * F.col("s"))) / F.sum("n").cast("double"), 9).alias("se"))


def median_rise(moves: DataFrame) -> DataFrame:
    return moves.where("delta > 0").groupBy("aspect").agg(F.count("*").alias("n"), F.round(F.median("delta"), 9).alias("median_rise"))


def gram(df: DataFrame, x: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and the row count, with a constant first: one aggregate, a row of sums to the driver."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    t = F.col(y).cast("double")
    n = len(cols)
    sums = [F.sum(cols[i] * cols[j]) for i in range(n) for j in range(i, n)] + [F.sum(c * t) for c in cols] + [F.sum(t * t), F.count("*")]
    row = df.na.drop(subset=[*x, y]).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    v = [0.0 if z is None else float(z) for z in row]
    a = np.zeros((n, n))
    a[np.triu_indices(n)] = v[: n * (n + 1) // 2]
    a = a + np.triu(a, 1).T
    return a, np.array(v[n * (n + 1) // 2 : -2]), v[-2], int(v[-1])


def ridge(df: DataFrame, x: list[str], y: str, alpha: float) -> np.ndarray:
    """Coefficients, the constant first and not penalised; least squares where the system is singular."""
    a, b, _, _ = gram(df, x, y)
    return solve(a, b, alpha)


def solve(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    penalty = alpha * np.eye(len(b))
    penalty[0, 0] = 0.0
    try:
        return np.linalg.solve(a + penalty, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a + penalty, b, rcond=None)[0]


def linear(constant: float, coefficients: dict[str, float]) -> Column:
    out = F.lit(float(constant))
    for c, b in coefficients.items():
        out = out + F.lit(float(b)) * F.col(c)
    return out


def fitted(train: DataFrame, val: DataFrame, test: DataFrame, x: list[str], y: str, alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """Impute by train medians, scale by train means and deviations, choose alpha by validation error; errors on test."""
    stats = train.agg(*[F.median(c).alias(f"m{i}") for i, c in enumerate(x)], F.avg(y).alias("y")).first()
    med = {c: 0.0 if stats[f"m{i}"] is None else stats[f"m{i}"] for i, c in enumerate(x)}
    fill = lambda d: d.select(y, *[F.coalesce(F.col(c), F.lit(med[c])).alias(c) for c in x])
    s = fill(train).agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(x)], *[F.stddev_samp(c).alias(f"d{i}") for i, c in enumerate(x)]).first()
    scale = {c: (s[f"a{i}"] or 0.0, s[f"d{i}"] or 1.0) for i, c in enumerate(x)}
    z = lambda d: fill(d).select(y, *[((F.col(c) - F.lit(scale[c][0])) / F.lit(scale[c][1])).alias(c) for c in x])
    # Alpha enters on the driver only: one pass gives the sums, one the errors of all alphas.
    a, b, _, _ = gram(z(train), x, y)
    made = [linear(c[0], dict(zip(x, c[1:], strict=True))) for c in (solve(a, b, alpha) for alpha in alphas)]
    errors = z(val).agg(*[F.avg(F.abs(F.col(y) - p)).alias(f"e{i}") for i, p in enumerate(made)]).first()
    best = None
    for alpha, p, mae in zip(alphas, made, errors, strict=True):
        if mae is not None and np.isfinite(mae) and (best is None or mae < best[0]):
            best = (mae, alpha, p)
    p = best[2] if best else F.lit(stats["y"])
    e = F.col(y) - p
    return z(test).agg(F.count("*").alias("n"), F.lit(best[1] if best else None).cast("double").alias("alpha"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def fixed_effects(df: DataFrame, y: str, x: list[str], cell: list[str], period: str, cluster: str, least: int = 50) -> DataFrame:
    """Least squares with cell effects taken out by demeaning and period dummies, clustered errors (G/(G-1) and degrees
    of freedom corrected). Sums by cluster run in Spark; a row of each cluster's scores is summed there, too."""
    d = df.na.drop(subset=[y, *x, *cell, period, cluster])
    levels = sorted(r[0] for r in d.select(period).distinct().collect())[1:]
    dummies = [f"p{i}" for i in range(len(levels))]
    d = d.select(cluster, *cell, F.col(y).alias("y"), *x, *[(F.col(period) == v).cast("double").alias(n) for v, n in zip(levels, dummies, strict=True)])
    w = W.partitionBy(*cell)
    names = [*x, *dummies]
    d = d.select(cluster, *cell, *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in ["y", *names]])
    k = len(names)
    cross = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    row = d.agg(*cross, *[F.sum(F.col(c) * F.col("y")).alias(f"b{i}") for i, c in enumerate(names)], F.count("*").alias("n"), F.countDistinct(*cell).alias("cells"), F.countDistinct(cluster).alias("clusters")).first()
    n, cells, g = row["n"], row["cells"], row["clusters"]
    if n < least:
        raise ValueError(f"{n} rows; {least} are needed")
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"g{i}_{j}"]
    inv = np.linalg.pinv(a)
    beta = inv @ np.array([row[f"b{i}"] for i in range(k)])
    resid = F.col("y") - linear(0.0, dict(zip(names, beta, strict=True)))
    scores = d.groupBy(cluster).agg(*[F.sum(F.col(c) * resid).alias(f"s{i}") for i, c in enumerate(names)])
    meat_row = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = meat_row[f"m{i}_{j}"]
    v = inv @ meat @ inv * (g / (g - 1)) * ((n - 1) / (n - k - cells))
    rows = [(c, float(beta[i]), float(np.sqrt(max(0.0, v[i, i]))), float(beta[i] - 1.959964 * np.sqrt(max(0.0, v[i, i]))), float(beta[i] + 1.959964 * np.sqrt(max(0.0, v[i, i]))), int(n), int(g)) for i, c in enumerate(x)]
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double, lo double, hi double, n long, clusters long")


def did(units: DataFrame, events: DataFrame, least: int = 5) -> DataFrame:
    """By aspect, the mean change of the outcome of units with an event less that of units with none. units: unit, ord, dy."""
    any_event = events.select("unit", "ord").distinct()
    control = units.where("dy IS NOT NULL").join(any_event, ["unit", "ord"], "left_anti").agg(F.avg("dy").alias("cm"), F.var_samp("dy").alias("cv"), F.count("*").alias("cn"))
    treated = units.where("dy IS NOT NULL").join(events.select("unit", "ord", "aspect").distinct(), ["unit", "ord"]).groupBy("aspect").agg(F.avg("dy").alias("tm"), F.var_samp("dy").alias("tv"), F.count("*").alias("n"))
    return treated.where(F.col("n") >= least).join(F.broadcast(control)).select("aspect", "n", F.col("cn").alias("controls"), F.round(F.col("tm") - F.col("cm"), 9).alias("att"), F.round(F.sqrt(F.col("tv") / F.col("n") + F.col("cv") / F.col("cn")), 9).alias("se"))
