"""Trends of yearly statistics: least squares, Theil-Sen slope and Kendall's tau."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.distributions import normal_quantile
from tidemark.functions.series import clean, grouped, label, statistic
from tidemark.operators.profile import long_form


def yearly(df: DataFrame, ts: str, value: str) -> DataFrame:
    return clean(df, value).groupBy(F.year(ts).alias("year")).agg(F.avg(value).alias("mean"))


def linear_trend(df: DataFrame, ts: str, value: str) -> DataFrame:
    x, y = F.col("year").cast("double"), F.col("mean")
    return yearly(df, ts, value).agg(*(F.round(c, 6).alias(n) for n, c in (("slope", F.regr_slope(y, x)), ("intercept", F.regr_intercept(y, x)), ("r2", F.regr_r2(y, x)))))


def pair_trend(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Median slope of all pairs of years, and tau; the pairs are of years, not of rows."""
    a, b = yearly(df, ts, value).alias("a"), yearly(df, ts, value).alias("b")
    pairs = a.join(F.broadcast(b), F.col("a.year") < F.col("b.year"))
    rise = F.col("b.mean") - F.col("a.mean")
    slope = rise / (F.col("b.year") - F.col("a.year"))
    return pairs.agg(F.round(F.percentile(slope, 0.5), 6).alias("theil_sen"), F.round(F.avg(F.signum(rise)), 6).alias("kendall_tau"))


def yearly_statistics(df: DataFrame, ts: str, value: str, stat: str = "mean") -> DataFrame:
    """month, year, y: one statistic of each month of each year, and of each year (null month)."""
    keyed = clean(df, value).where(F.col(value).isNotNull()).withColumns({"month": F.month(ts), "year": F.year(ts)})
    return keyed.groupingSets([[F.col("month"), F.col("year")], [F.col("year")]], F.col("month"), F.col("year")).agg(statistic(stat, F.col(value)).alias("y"))


def theil_sen(x: np.ndarray, y: np.ndarray, confidence: float = 0.95) -> tuple[float, float, float, float]:
    """Median slope of all pairs, intercept through the medians, and the slope's bounds by the normal form of Kendall's statistic."""
    i, j = np.triu_indices(len(x), 1)
    apart = x[j] != x[i]
    slopes = np.sort((y[j] - y[i])[apart] / (x[j] - x[i])[apart])
    if not len(slopes):
        return (np.nan,) * 4
    n, middle = len(x), float(np.median(slopes))
    ties = lambda v: sum(k * (k - 1) * (2 * k + 5) for k in np.unique(v, return_counts=True)[1].tolist())
    sigma = math.sqrt(max(0.0, (n * (n - 1) * (2 * n + 5) - ties(x) - ties(y)) / 18))
    z = float(normal_quantile(np.array([1 - (1 - confidence) / 2]))[0])
    low, high = int(round((len(slopes) - z * sigma) / 2)) - 1, int(round((len(slopes) + z * sigma) / 2))
    return middle, float(np.median(y) - middle * np.median(x)), float(slopes[max(low, 0)]), float(slopes[min(high, len(slopes) - 1)])


def kendall(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Tau (b) and the two-sided chance of it: exact without ties and up to 33 rows, else by the normal approximation."""
    n = len(x)
    i, j = np.triu_indices(n, 1)
    product = np.sign(x[j] - x[i]) * np.sign(y[j] - y[i])
    agree, against, pairs = int((product > 0).sum()), int((product < 0).sum()), n * (n - 1) // 2
    counts = [np.unique(v, return_counts=True)[1] for v in (x, y)]
    tied = [int((c * (c - 1) // 2).sum()) for c in counts]
    if pairs in tied or n < 2:
        return math.nan, math.nan
    tau = max(-1.0, min(1.0, (agree - against) / math.sqrt((pairs - tied[0]) * (pairs - tied[1]))))
    if not any(tied) and (n <= 33 or min(against, pairs - against) <= 1):
        few = min(against, pairs - against)
        if 4 * few == n * (n - 1):
            return tau, 1.0
        ways = [1]  # orders of k rows by their number of pairs that go against
        for k in range(2, n + 1):
            total = [0, *accumulate(ways)]
            ways = [total[min(m + 1, len(ways))] - total[max(0, m - k + 1)] for m in range(min(few, k * (k - 1) // 2) + 1)]
        return tau, min(1.0, 2.0 * sum(ways[: few + 1]) / math.factorial(n))
    m = n * (n - 1.0)
    x0, y0 = (float((c * (c - 1.0) * (c - 2)).sum()) for c in counts)
    x1, y1 = (float((c * (c - 1.0) * (2 * c + 5)).sum()) for c in counts)
    var = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * tied[0] * tied[1] / m + x0 * y0 / (9 * m * (n - 2))
    return tau, math.erfc(abs(agree - against) / math.sqrt(var) / math.sqrt(2))


def regression_table(df: DataFrame, ts: str, value: str, stat: str = "mean", confidence: float = 0.95) -> DataFrame:
    """month (null: the year), slope, intercept, r2 (least squares), ts_slope, ts_intercept, ts_low, ts_high (Theil and Sen), tau and
    p (Kendall) of the statistic over the years. A task holds the years of one month."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("year")
        x, y = rows["year"].to_numpy(float), rows["y"].to_numpy(float)
        month = None if pd.isna(rows["month"].iloc[0]) else int(rows["month"].iloc[0])
        if len(x) < 2:
            found = [None] * 9
        else:
            dx, dy = x - x.mean(), y - y.mean()
            slope = float((dx * dy).sum() / (dx * dx).sum())
            r2 = float((dx * dy).sum() ** 2 / ((dx * dx).sum() * (dy * dy).sum())) if dy.any() else 0.0
            found = [slope, float(y.mean() - slope * x.mean()), r2, *theil_sen(x, y, confidence), *kendall(x, y)]
        names = ("slope", "intercept", "r2", "ts_slope", "ts_intercept", "ts_low", "ts_high", "tau", "p")
        return pd.DataFrame({"month": pd.array([month], "Int32"), **{n: pd.array([None if v is None or math.isnan(v) else round(v, 9)], "Float64") for n, v in zip(names, found)}})

    schema = "month int, slope double, intercept double, r2 double, ts_slope double, ts_intercept double, ts_low double, ts_high double, tau double, p double"
    return yearly_statistics(df, ts, value, stat).groupBy("month").applyInPandas(fit, schema)


def yearly_by_level(df: DataFrame, ts: str, levels: dict[float, str], stat: str = "mean") -> DataFrame:
    """year (null: all), level, value: one statistic of every level's column; levels without values in some year are left out."""
    rows = clean(long_form(df.withColumn("year", F.year(ts)), ["year"], levels), "value")
    found = grouped(rows, [["year", "level"], ["level"]], "value", (stat,), 9).withColumnRenamed(label(stat), "value")
    whole = found.groupBy("level").agg(F.bool_and(F.col("value").isNotNull()).alias("whole")).where("whole").select("level")
    return found.join(F.broadcast(whole), "level").select("year", "level", "value")
