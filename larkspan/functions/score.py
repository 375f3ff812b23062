"""Column functions on counts and scores. Operations keep their order, as equal scores are told apart bit by bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIOR = 10.0
EARTH_KM = 6371.0
#: Normal quantiles of a two-sided 5 % test and of 80 % power.
Z_ALPHA, Z_POWER = 1.959964, 0.841621


def finite(x: Column) -> Column:
    """Null for what is no finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def raw_net(pos: Column, neg: Column) -> Column:
    return F.try_divide((pos - neg).cast("double"), (pos + neg).cast("double"))


def smoothed_net(pos: Column, neg: Column, prior: float | Column = PRIOR) -> Column:
    """Posterior mean of a symmetric beta prior, on the scale -1 to 1; 0 without mentions."""
    k = F.lit(prior) if not isinstance(prior, Column) else prior
    n = (pos + neg).cast("double")
    return F.lit(2.0) * ((pos.cast("double") + k / F.lit(2.0)) / (n + k)) - F.lit(1.0)


def reliability(mentions: Column, prior: float | Column = PRIOR) -> Column:
    m = F.greatest(mentions, F.lit(0)).cast("double")
    return m / (m + (F.lit(prior) if not isinstance(prior, Column) else prior))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    u, v = F.sin((b - a) / F.lit(2.0)), F.sin((F.radians(lon2) - F.radians(lon1)) / F.lit(2.0))
    h = u * u + F.cos(a) * F.cos(b) * v * v
    return F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(finite(lat).between(-90, 90) & finite(lon).between(-180, 180), F.lit(False))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def mde(sigma: Column, treated: Column, control: Column) -> Column:
    """The least effect that a two-sided 5 % test finds with 80 % power."""
    return F.lit(Z_ALPHA + Z_POWER) * sigma * F.sqrt(F.lit(1.0) / treated + F.lit(1.0) / control)


def required_n(delta: Column, sigma: Column) -> Column:
    x = F.lit(Z_ALPHA + Z_POWER) * sigma / delta
    return F.ceil(F.lit(2.0) * x * x)
