"""Wave and wind formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

G = 9.80665


def jonswap_gamma(hs: Column, tp: Column) -> Column:
    inner = F.lit(0.036) - 0.0056 * tp / F.sqrt(hs)
    return F.least(F.exp(3.484 * (1 - 0.1975 * inner * tp**4 / hs**2)), F.lit(5.0))


def jonswap(f: Column, hs: Column, tp: Column, g: float = 9.82) -> Column:
    """Spectral density at frequency f; 0 where it isn't defined."""
    gamma = jonswap_gamma(hs, tp)
    alpha = 5.061 * hs**2 / tp**4 * (1 - 0.287 * F.log(gamma))
    sigma = F.when(f <= 1 / tp, 0.07).otherwise(0.09)
    peak = F.pow(gamma, F.exp(-0.5 * F.pow((f * tp - 1) / sigma, 2)))
    s = alpha * g**2 * (2 * math.pi) ** -4 * F.pow(f, -5.0) * F.exp(-1.25 * F.pow(f * tp, -4.0)) * peak
    return F.coalesce(F.nanvl(F.when((f > 0) & (hs > 0) & (tp > 0), s), F.lit(0.0)), F.lit(0.0))


def zero_crossing_period(tp: Column, gamma: float = 2.5) -> Column:
    return tp * (0.6673 + 0.05037 * gamma - 0.00623 * gamma**2 + 0.0003341 * gamma**3)


def mean_period(tp: Column, gamma: float = 2.5) -> Column:
    return tp * (0.7303 + 0.04936 * gamma - 0.006556 * gamma**2 + 0.000361 * gamma**3)


def steepness(hs: Column, tz: Column, g: float = 9.81) -> Column:
    return 2 * math.pi * hs / (g * tz * tz)


def highest_wave(hs: Column, tp: Column, hours: float = 3.0) -> Column:
    n = hours * 3600 / zero_crossing_period(tp)
    return hs * (F.sqrt(F.log(n) / 2) + 0.2886 / F.sqrt(2 * F.log(n)))


def wave_number(period: Column, depth: float, g: float = 9.82) -> Column:
    """Linear dispersion, from Newton steps on tanh that start in deep water."""
    w2 = F.pow(2 * math.pi / period, 2.0)
    k = w2 / g / F.sqrt(F.tanh(w2 * depth / g))
    for _ in range(3):
        t = F.tanh(k * depth)
        k = k - (g * k * t - w2) / (g * t + g * k * depth * (1 - t * t))
    return k


def crest(hs: Column, t1: Column, depth: float, sea_state: str = "short", hours: float = 3.0, tz: Column | None = None) -> Column:
    """Crest height with probability 0.85 not to be exceeded in `hours`, for short- or long-crested sea."""
    s1 = 2 * math.pi / 9.81 * hs / (t1 * t1)
    k1 = wave_number(t1, depth)
    ur = hs / (k1 * k1 * depth**3)
    if sea_state == "short":
        a, b = 0.3536 + 0.2568 * s1 + 0.08 * ur, 2 - 1.7912 * s1 - 0.5302 * ur + 0.284 * ur * ur
    else:
        a, b = 0.3536 + 0.2892 * s1 + 0.106 * ur, 2 - 2.1597 * s1 + 0.0969 * ur * ur
    n = hours * 3600 / (t1 if tz is None else tz)
    return a * hs * F.pow(-F.log(1 - F.pow(F.lit(0.85), 1 / n)), 1 / b)


def gust(u: Column, z: float = 10.0, factor: float = 0.41) -> Column:
    """10-minute mean from an hourly mean; factor 0.59 for the 90 % quantile."""
    turbulence = 0.06 * (1 + 0.43 * u / 10) * (z / 10) ** -0.22
    return u * (1 - factor * turbulence * math.log(10 / 60))


def shear_exponent(u1: Column, u2: Column, z1: float, z2: float) -> Column:
    return F.log(u2 / u1) / math.log(z2 / z1)


def pressure_surge(p: Column, mean: Column) -> Column:
    return F.lit(-0.01) * (p - mean)


def angle_between(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def math_direction(d: Column) -> Column:
    """Compass to mathematical direction and back."""
    return F.pmod(F.lit(450.0) - d, F.lit(360.0))


#: Fixed values of the double-peaked spectrum: the limiting period's factor, its lower and upper bound's, and the shares and widths of both seas.
FETCH, LOWER, UPPER = 6.6, 2.0, 25.0
WIND_SHARE, WIND_WIDTH, SWELL_SHARE, SWELL_WIDTH, PEAK, PEAK_RISE, SWELL_LAG, NORM = 0.7, 0.5, 0.6, 0.3, 35.0, 6.0, 2.0, 3.26


def torsethaugen(f: Column, hs: Column, tp: Column, g: float = 9.81) -> Column:
    """Density of the simplified double-peaked spectrum of a wind sea with swell; 0 where it isn't defined."""
    limit = FETCH * F.cbrt(hs)
    wind = tp <= limit
    low = (limit - tp) / (limit - LOWER * F.sqrt(hs))
    high = (tp - limit) / (UPPER - limit)
    share = F.when(wind, (1 - WIND_SHARE) * F.exp(-F.pow(low / WIND_WIDTH, 2.0)) + WIND_SHARE).otherwise((1 - SWELL_SHARE) * F.exp(-F.pow(high / SWELL_WIDTH, 2.0)) + SWELL_SHARE)
    main, rest = share * hs, F.sqrt(F.greatest(1 - share * share, F.lit(0.0))) * hs
    second = F.when(wind, limit + SWELL_LAG).otherwise(FETCH * F.cbrt(rest))
    steep = F.when(wind, 2 * math.pi / g * main / (tp * tp)).otherwise(2 * math.pi / g * hs / (limit * limit))
    gamma = F.greatest(PEAK * F.pow(steep, 6 / 7) * F.when(wind, 1.0).otherwise(1 + PEAK_RISE * high), F.lit(1.0))

    def peak(period: Column) -> Column:
        n = F.pow(f * period, -4.0)
        return NORM * n * F.exp(-n)

    scaled = f * tp
    sigma = F.when(scaled > 1, 0.09).otherwise(0.07)
    sharpened = peak(tp) * (1 + 1.1 * F.pow(F.log(gamma), 1.19)) / gamma * F.pow(gamma, F.exp(-F.pow(scaled - 1, 2.0) / (2 * sigma * sigma)))
    s = main * main * tp / 16 * sharpened + F.when(rest > 0, rest * rest * second / 16 * peak(second)).otherwise(0.0)
    return F.coalesce(F.nanvl(F.when((f > 0) & (hs > 0) & (tp > 0), s), F.lit(0.0)), F.lit(0.0))


#: Coefficients of the rational approximation of the dispersion relation.
DISPERSION = (0.66667, 0.35550, 0.16084, 0.06320, 0.02174, 0.00654, 0.00171, 0.00039, 0.00011)


def wave_number_rational(period: Column, depth: Column | float, g: float = 9.82) -> Column:
    """Wave number by a rational approximation, without iteration; 0 for a negative depth."""
    depth = depth if isinstance(depth, Column) else F.lit(float(depth))
    omega = 2 * math.pi / period
    y = omega * omega * depth / g
    x = F.lit(DISPERSION[-1])
    for a in reversed(DISPERSION[:-1]):
        x = a + y * x
    return F.when(depth < 0, 0.0).otherwise(omega / F.sqrt(g * depth / (y + 1 / (1 + y * x))))


def velocity_density(f: Column, s: Column, k: Column, depth: float, z: Column) -> Column:
    """Density of the horizontal velocity z metres below the surface, from that of the elevation and the wave number."""
    transfer = 2 * math.pi * f * F.exp(-k * z) * (1 + F.exp(-2 * k * (depth - z))) / (1 - F.exp(-2 * k * depth))
    return F.coalesce(s * transfer * transfer, F.lit(0.0))


CREST_MARGIN = 1.135  # of the greatest crest over the one with probability 0.85 (fixed value)


def greatest_crest(hs: Column, tm: Column, depth: float, sea_state: str = "long") -> Column:
    """Greatest crest in three hours, with the margin that model tests show."""
    return CREST_MARGIN * crest(hs, tm, depth, sea_state)


def weibull_exceedance(x: Column, shape: float, loc: float, scale: float) -> Column:
    """Chance that a Weibull variable exceeds x; 1 up to the location."""
    return F.when(x <= loc, F.lit(1.0)).otherwise(F.exp(-F.pow((x - loc) / scale, F.lit(float(shape)))))


def period_given_height(hs: Column, a: tuple[float, float, float], b: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """Lognormal period at a height: the mean less 1.645 deviations, the mean, and the mean plus 1.645 deviations.

    Its logarithm has the mean a1 + a2 hs ** a3 and the variance b1 + b2 exp(-b3 hs).
    """
    mu, var = a[0] + a[1] * F.pow(hs, F.lit(float(a[2]))), b[0] + b[1] * F.exp(-b[2] * hs)
    mean = F.exp(mu + var / 2)
    std = mean * F.sqrt(F.expm1(var))
    return mean - 1.645 * std, mean, mean + 1.645 * std
