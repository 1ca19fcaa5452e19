"""Corrections, vector and angle conversions and limits as column expressions; nulls stay null."""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wind speed ratio to the 10-minute mean at 10 m, a row a height (m), a column an averaging time (s).
RATIO_TIMES = (3, 5, 15, 60, 600, 3600)
RATIOS = {
    1: (0.934, 0.910, 0.858, 0.793, 0.685, 0.600),
    5: (1.154, 1.130, 1.078, 1.013, 0.905, 0.821),
    10: (1.249, 1.225, 1.173, 1.108, 1.000, 0.916),
    20: (1.344, 1.320, 1.268, 1.203, 1.095, 1.011),
    30: (1.399, 1.375, 1.324, 1.259, 1.151, 1.066),
    40: (1.439, 1.415, 1.363, 1.298, 1.190, 1.106),
    50: (1.469, 1.445, 1.394, 1.329, 1.220, 1.136),
    100: (1.564, 1.540, 1.489, 1.424, 1.315, 1.231),
}

# Steepness below the lower and above the upper period (s), by kind of period.
STEEPNESS = {"tp": (1 / 15, 8.0, 1 / 25, 15.0), "tz": (1 / 10, 6.0, 1 / 15, 12.0)}


def strong_wind(u: Column) -> Column:
    """Speeds over 15 m/s raised by a tenth of what exceeds 15."""
    return F.when(u > 15, u + 0.1 * (u - 15)).otherwise(u)


def air_temperature(t: Column) -> Column:
    """Frost made 7 % colder, warmth over 15 degrees raised by 0.3 of what exceeds 15."""
    return F.when(t < 0, 1.07 * t).when(t > 15, t + 0.3 * (t - 15)).otherwise(t)


def spread_period(tp: Column, noise: Column) -> Column:
    """Peak periods of a logarithmic model grid moved within their grid step; noise is uniform in -0.5 to 0.5."""
    step = F.log(tp / 3.244) / 0.09525
    return F.when(tp >= 3.2, F.round(3.244 * F.exp(0.09525 * (step - noise)), 1)).otherwise(tp)


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column) -> Column:
    """Minutes and seconds go away from zero; degrees of 0 count as negative."""
    part = minutes / 60 + seconds / 3600
    return F.when(degrees <= 0, degrees - part).otherwise(degrees + part)


def magnitude(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def towards(u: Column, v: Column) -> Column:
    """Compass direction that (east, north) goes to, to two decimals; 0 where both are 0."""
    return F.when((u == 0) & (v == 0), F.lit(0.0)).otherwise(F.round(F.pmod(F.degrees(F.atan2(u, v)) + 360, F.lit(360.0)), 2))


def steepness_limit(period: Column, kind: str = "tp", g: float = 9.81) -> Column:
    """Greatest height at a period: constant steepness at both ends, a straight line in height between."""
    low, t1, high, t2 = STEEPNESS[kind]
    unit = g / (2 * math.pi)
    h1, h2 = low * unit * t1**2, high * unit * t2**2
    middle = h1 + (period - t1) * ((h2 - h1) / (t2 - t1))
    return F.when(period <= t1, low * unit * period * period).when(period >= t2, high * unit * period * period).otherwise(middle)


def _line(xs, ys, x: float) -> float:
    """Straight lines between points, the outer ones carried on."""
    i = min(max(bisect_right(xs, x) - 1, 0), len(xs) - 2)
    return ys[i] + (ys[i + 1] - ys[i]) * (x - xs[i]) / (xs[i + 1] - xs[i])


def wind_ratio(height: float, seconds: float) -> float:
    return _line(list(RATIOS), [_line(RATIO_TIMES, row, seconds) for row in RATIOS.values()], height)


def wind_at(u: Column, height: float, seconds: float, to_height: float, to_seconds: float) -> Column:
    """Wind speed at another height and averaging time."""
    return u * (wind_ratio(to_height, to_seconds) / wind_ratio(height, seconds))
