"""Scalars derived from a cluster feature (n, ls, ss, lst, sst) and decay algebra."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions import vec
from tidepool.functions.normal import normal_quantile
from tidepool.session import MAX_FLOAT

# Variances in (FLAT_LOW, 0] are rounding noise and read as FLAT_VARIANCE.
FLAT_LOW = -5e-5
FLAT_VARIANCE = 1e-50


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def centroid(n="n", ls="ls") -> Column:
    n, ls = _c(n), _c(ls)
    return F.when(n > 0, F.transform(ls, lambda v: v / n)).otherwise(ls)


def variances(n="n", ls="ls", ss="ss") -> Column:
    n = _c(n)
    return F.zip_with(_c(ss), _c(ls), lambda q, s: q / n - (s / n) * (s / n))


def spread_radius(n="n", ls="ls", ss="ss", factor: float = 2.0) -> Column:
    """factor * sqrt(sum of variances); a single point has no spread and reads as infinite."""
    steady = F.transform(
        variances(n, ls, ss),
        lambda v: F.when((v <= 0) & (v > FLAT_LOW), F.lit(FLAT_VARIANCE)).otherwise(v))
    return F.when(_c(n) > 1, F.lit(factor) * F.sqrt(vec.total(steady))).otherwise(F.lit(MAX_FLOAT))


def widest_radius(w="w", ls="ls", ss="ss", factor: float = 1.0) -> Column:
    """factor * sqrt(largest variance, at least 0); infinite up to weight 1."""
    widest = F.greatest(F.array_max(variances(w, ls, ss)), F.lit(0.0))
    return F.when(_c(w) > 1, F.lit(factor) * F.sqrt(widest)).otherwise(F.lit(MAX_FLOAT))


def rmse(n="n", ls="ls", ss="ss") -> Column:
    """Root mean squared distance of the members from their centroid."""
    n = _c(n)
    c = centroid(n, ls)
    parts = F.zip_with(
        _c(ss), F.arrays_zip(_c(ls).alias("s"), c.alias("c")),
        lambda q, e: q + n * e["c"] * e["c"] - F.lit(2.0) * e["s"] * e["c"])
    return F.when(n > 1, F.sqrt(F.greatest(vec.total(parts), F.lit(0.0)) / n)).otherwise(F.lit(MAX_FLOAT))


def sphere_radius(n="n", ls="ls", ss="ss") -> Column:
    """Radius used for scoring: sqrt(sum of non-negative variances)."""
    return F.sqrt(vec.total(F.transform(variances(n, ls, ss), lambda v: F.greatest(v, F.lit(0.0)))))


# ---- time -------------------------------------------------------------------------------


def mean_time(n="n", lst="lst") -> Column:
    return _c(lst) / _c(n)


def time_deviation(n="n", lst="lst", sst="sst") -> Column:
    mu = mean_time(n, lst)
    return F.sqrt(F.greatest(_c(sst) / _c(n) - mu * mu, F.lit(0.0)))


def relevance_stamp(m: float, n="n", lst="lst", sst="sst") -> Column:
    """Approximate mean arrival of the last m members, by a normal model of arrival times."""
    n = _c(n)
    mu = mean_time(n, lst)
    late = mu + time_deviation(n, lst, sst) * normal_quantile(F.lit(1.0) - F.lit(float(m)) / (2.0 * n))
    return F.when(n < 2 * m, mu).otherwise(late)


def deletable(m: float, now: Column, horizon: float, n="n", lst="lst", sst="sst") -> Column:
    n = _c(n)
    return (n == 0) | F.coalesce(relevance_stamp(m, n, lst, sst) < now - F.lit(float(horizon)), F.lit(False))


# ---- exponential decay --------------------------------------------------------------------


def decay(dt, lam: float) -> Column:
    """2 ** (-lam * dt); a late row (dt < 0) gives a factor above 1, which later decay undoes."""
    return F.pow(F.lit(2.0), F.lit(-float(lam)) * _c(dt))


def decayed(value, dt, lam: float) -> Column:
    return _c(value) * decay(dt, lam)


def decayed_vector(a, dt, lam: float) -> Column:
    return vec.scale(a, decay(dt, lam))


def check_period(lam: float, beta: float, mu: float) -> int:
    """Ticks between prunes: the shortest time in which a bare p-cluster can fade below beta*mu."""
    if beta * mu <= 1:
        raise ValueError("beta * mu must exceed 1")
    return round(1 / lam * math.log(beta * mu / (beta * mu - 1))) + 1


def outlier_floor(t, t0, lam: float, period: float) -> Column:
    """Least weight an o-cluster born at t0 must have at t to stay."""
    age = (_c(t) - _c(t0) + F.lit(float(period))).cast("double")
    return (F.pow(F.lit(2.0), F.lit(-lam) * age) - 1.0) / F.lit(2.0 ** (-lam * period) - 1.0)
