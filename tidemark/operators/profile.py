"""Vertical profiles in wide columns, one a level."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import takewhile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import clean, grouped


def long_form(df: DataFrame, keep: Sequence[str], levels: dict[float, str]) -> DataFrame:
    """keep, level, value: a row a level."""
    pairs = F.explode(F.array(*(F.struct(F.lit(float(z)).alias("level"), F.col(f"`{c}`").cast("double").alias("value")) for z, c in levels.items())))
    return df.select(*keep, pairs.alias("p")).select(*keep, "p.level", "p.value")


def profile_statistics(df: DataFrame, levels: dict[float, str], stats: Sequence[str]) -> DataFrame:
    return grouped(clean(long_form(df, [], levels), "value"), [["level"]], "value", stats)


def profile_maxima(df: DataFrame, ts: str, levels: dict[float, str], directions: dict[float, str] | None = None) -> DataFrame:
    """level, value, at (time of the greatest value, the first of equal ones) and dir (the direction then; null without)."""
    turn = lambda z: F.col(directions[z]).cast("double") if directions else F.lit(None).cast("double")
    pairs = F.explode(F.array(*(F.struct(F.lit(float(z)).alias("level"), F.col(c).cast("double").alias("value"), turn(z).alias("dir")) for z, c in levels.items())))
    rows = clean(df.select(F.col(ts).alias("at"), pairs.alias("p")).select("at", "p.*"), "value").where("value is not null")
    best = F.max(F.struct(F.col("value"), (-F.unix_micros(F.col("at").cast("timestamp"))).alias("o"), F.col("at"), F.col("dir")))
    return rows.groupBy("level").agg(best.alias("b")).select("level", "b.value", "b.at", "b.dir")


def monthly_profile(df: DataFrame, ts: str, levels: dict[float, str], stats: Sequence[str] = ("mean",)) -> DataFrame:
    """Statistics by level and month, and by level over all (null month)."""
    keyed = long_form(df.withColumn("month", F.month(ts)), ["month"], levels)
    return grouped(clean(keyed, "value"), [["level", "month"], ["level"]], "value", stats, 9)


def conditional_profiles(df: DataFrame, levels: dict[float, str], worst: dict[float, float]) -> DataFrame:
    """For a return value at one level d, the expected value at each level j, capped at j's own:
    mean_j + corr(j, d) std_j (worst_d - mean_d) / std_d, with population moments. One scan for all pairs."""
    cols, zs = list(levels.values()), list(levels)
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols))]
    aggs = [F.corr(cols[i], cols[j]).alias(f"r_{i}_{j}") for i, j in pairs if i < j]
    row = clean(df, *cols).agg(*aggs, *(F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)), *(F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)))

    def cell(j: int, d: int):
        w = F.lit(float(worst[zs[d]]))
        r = F.lit(1.0) if j == d else F.col(f"r_{min(j, d)}_{max(j, d)}")
        v = F.col(f"m_{j}") + r * F.col(f"s_{j}") * (w - F.col(f"m_{d}")) / F.col(f"s_{d}")
        return F.struct(F.lit(zs[d]).alias("worst_level"), F.lit(zs[j]).alias("level"), F.round(w if j == d else F.least(v, F.lit(float(worst[zs[j]]))), 6).alias("value"))

    return row.select(F.explode(F.array(*(cell(j, d) for d, j in pairs))).alias("c")).select("c.*")


def worst_by_percentile(df: DataFrame, levels: dict[float, str], percentile: float) -> dict[float, float]:
    """The percentile of every level; levels from the first one without values on are left out. One scan."""
    row = clean(df, *levels.values()).agg(*(F.percentile(c, percentile / 100).alias(f"p{i}") for i, c in enumerate(levels.values()))).first()
    return dict(takewhile(lambda p: p[1] is not None, zip(levels, row)))


def conditional_table(df: DataFrame, ts: str, levels: dict[float, str], percentile: float | None = None, return_period: float | None = None, month: int | None = None, distribution: str = "GUM", method: str = "default", threshold: str | float = "default") -> DataFrame:
    """conditional_profiles() where the worst case of each level is its percentile or its return value, with the worst case itself
    under a null worst_level. month: rows of that month only."""
    from tidemark.operators.return_tables import by_level

    if (percentile is None) == (return_period is None):
        raise ValueError("give a percentile or a return period")
    rows = df if month is None else df.where(F.month(ts) == month)
    if percentile is not None:
        worst = worst_by_percentile(rows, levels, percentile)
    else:
        found = {r["level"]: r["value"] for r in by_level(rows, ts, levels, (float(return_period),), distribution, method, threshold).collect()}  # a row a level
        worst = dict(takewhile(lambda p: p[1] is not None, ((z, found.get(float(z))) for z in levels)))
    kept = {z: c for z, c in levels.items() if z in worst}
    own = df.sparkSession.createDataFrame([(None, float(z), round(float(v), 6)) for z, v in worst.items()], "worst_level double, level double, value double")
    return conditional_profiles(rows, kept, worst).unionByName(own)


def polynomial(z: Sequence[float], speeds: Sequence[float], degree: int = 4) -> np.ndarray:
    """Coefficients, highest power first, of the least-squares polynomial; its degree is at most the levels less one."""
    return np.polyfit(np.asarray(z, float), np.asarray(speeds, float), min(degree, len(z) - 1))


def spline(z: Sequence[float], speeds: Sequence[float]):
    """The natural cubic spline through the levels, as a function; straight beyond them."""
    order = np.argsort(z)
    x, y = np.asarray(z, float)[order], np.asarray(speeds, float)[order]
    n, h = len(x), np.diff(x)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b) if n > 2 else np.zeros(n)

    def at(v) -> np.ndarray:
        v = np.asarray(v, float)
        k = np.clip(np.searchsorted(x, v, side="right") - 1, 0, max(0, n - 2))
        t = np.clip(v, x[0], x[-1])
        left, right, w = t - x[k], x[k + 1] - t, h[k]
        inside = (m[k] * right**3 + m[k + 1] * left**3) / (6 * w) + (y[k] / w - m[k] * w / 6) * right + (y[k + 1] / w - m[k + 1] * w / 6) * left
        slope = (m[k + 1] * left**2 - m[k] * right**2) / (2 * w) + (y[k + 1] - y[k]) / w - (m[k + 1] - m[k]) * w / 6
        return inside + slope * (v - t)

    return at


def scaled(model, z: Sequence[float], target: float, target_z: float) -> np.ndarray:
    """A fitted profile at levels z, multiplied so that it is `target` at target_z."""
    f = model if callable(model) else lambda v: np.polyval(model, v)
    base = float(np.asarray(f(np.array([target_z])))[0])
    return np.asarray(f(np.asarray(z, float))) * (target / base if base else np.nan)


def extreme_profiles(df: DataFrame, ts: str, levels: dict[float, str], periods: Sequence[float] = (1, 10, 100), percentile: float = 95, method: str = "polynomial", distribution: str = "Weibull3P") -> DataFrame:
    """period, at_level, level, value: the mean profile of the rows in which at_level exceeds its percentile, fitted (a polynomial of
    degree 5 or a spline) and scaled to at_level's return value. Two scans, for the percentiles and for all mean profiles."""
    from tidemark.operators.return_tables import by_level

    zs, cols = list(map(float, levels)), list(levels.values())
    rows = clean(df, *cols)
    q = rows.agg(*(F.percentile(c, percentile / 100).alias(f"q{i}") for i, c in enumerate(cols))).first()
    means = rows.agg(*(F.avg(F.when(F.col(a) > F.lit(q[i]), F.col(b))).alias(f"m_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols))).first()
    found = {(r["level"], r["period"]): r["value"] for r in by_level(df, ts, levels, periods, distribution).collect()}  # levels times periods
    out = []
    for t in map(float, periods):
        for i, z in enumerate(zs):
            profile, target = [means[f"m_{i}_{j}"] for j in range(len(zs))], found.get((z, t))
            if target is None or any(v is None for v in profile):
                continue
            model = polynomial(zs, profile, 5) if method == "polynomial" else spline(zs, profile)
            out += [(t, z, level, round(float(v), 6)) for level, v in zip(zs, scaled(model, zs, target, z))]
    return df.sparkSession.createDataFrame(out, "period double, at_level double, level double, value double")


def shear(df: DataFrame, low: tuple[float, str], high: tuple[float, str], percentiles: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """Median and percentiles of the power-law exponent between two levels; rows without two positive speeds don't count."""
    (z1, a), (z2, b) = low, high
    alpha = F.when((F.col(a) > 0) & (F.col(b) > 0), F.log(F.col(b) / F.col(a)) / F.lit(math.log(z2 / z1)))
    wanted = {"median": 0.5} | {f"p{100 * p:g}": p for p in percentiles}
    return clean(df, a, b).select(alpha.alias("alpha")).agg(F.count("alpha").alias("n"), *(F.round(F.percentile("alpha", p), 6).alias(n) for n, p in wanted.items()))
