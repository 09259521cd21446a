"""Intervals and sample sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """struct(point, lo, hi, n) of the Wilson score interval; without observations point is NULL and the interval [0, 1]."""
    n_ = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes.cast("double") / n_
    scale = 1 + z * z / n_
    mid = (p + z * z / (2 * n_)) / scale
    arm = z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_)) / scale
    return F.struct(p.alias("point"), F.coalesce(F.greatest(F.lit(0.0), mid - arm), F.lit(0.0)).alias("lo"), F.coalesce(F.least(F.lit(1.0), mid + arm), F.lit(1.0)).alias("hi"), n.cast("bigint").alias("n"))


def half_width(interval: Column) -> Column:
    return (interval["hi"] - interval["lo"]) / 2


def required_n(p: Column, half: Column, z: float = Z95) -> Column:
    """Observations for a half-width at an assumed rate, which is held within [1e-6, 1 - 1e-6]."""
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ceil(z * z * q * (1 - q) / (half * half))


def power_branch(half: Column) -> Column:
    """What a half-width allows to be reported."""
    return F.when(half <= 0.05, "ranking").when(half <= 0.10, "intervals_only").otherwise("cannot_separate")


def affordable_n(budget: Column, cost: Column) -> Column:
    """Observations that a budget pays for; the ratio is rounded to nine places first, so that 0.3 / 0.1 is 3."""
    return F.floor(F.round(F.try_divide(budget, cost), 9))


def net_of(interval: Column, bound: Column) -> Column:
    """Both limits less an upper bound of contamination, not below 0."""
    return F.struct(F.greatest(F.lit(0.0), interval["lo"] - bound).alias("lo"), F.greatest(F.lit(0.0), interval["hi"] - bound).alias("hi"))


def excludes_zero(lo: Column, hi: Column) -> Column:
    return (lo > 0) | (hi < 0)
