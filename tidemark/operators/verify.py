"""Model against observation, and regression lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import bin_right, clean


def _metrics(x: Column, y: Column, digits: int = 6) -> list[Column]:
    rmse = F.sqrt(F.avg(F.pow(y - x, 2.0)))
    found = {"bias": F.avg(y - x), "mae": F.avg(F.abs(y - x)), "rmse": rmse, "si": F.try_divide(rmse, F.avg(x)), "corr": F.corr(x, y)}
    return [F.count(x).alias("n"), *(F.round(c, digits).alias(n) for n, c in found.items())]


def error_metrics(df: DataFrame, observed: str, modelled: str, by: list[str] | None = None) -> DataFrame:
    df = clean(df, observed, modelled).where(F.col(observed).isNotNull() & F.col(modelled).isNotNull())
    return df.groupBy(*(by or [])).agg(*_metrics(F.col(observed), F.col(modelled)))


def error_metrics_of_columns(df: DataFrame, observed: str, columns: list[str]) -> DataFrame:
    """variable and its metrics against the observation: a row a column, in one scan."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("_y")) for c in columns)))
    rows = df.select(F.col(observed).alias("_x"), pairs.alias("p")).select("_x", "p.*")
    return error_metrics(rows, "_x", "_y", ["variable"])


def binned_error_metrics(df: DataFrame, observed: str, modelled: str, size: float) -> DataFrame:
    """Metrics by classes (a, b] of the observation; `centre` is a class's middle."""
    keyed = clean(df, observed, modelled).where(f"{observed} is not null and {modelled} is not null")
    keyed = keyed.withColumn("centre", (bin_right(F.col(observed), size) + 0.5) * size)
    return keyed.groupBy("centre").agg(*_metrics(F.col(observed), F.col(modelled)))


def taylor(df: DataFrame, observed: str, modelled: str) -> DataFrame:
    x, y = F.col(observed), F.col(modelled)
    centred = F.sqrt(F.var_pop(x) + F.var_pop(y) - 2 * F.covar_pop(x, y))
    return clean(df, observed, modelled).agg(*(F.round(c, 6).alias(n) for n, c in (("std_obs", F.stddev_pop(x)), ("std_mod", F.stddev_pop(y)), ("corr", F.corr(x, y)), ("crms", centred))))


def quantile_pairs(df: DataFrame, observed: str, modelled: str) -> DataFrame:
    at = [i / 100 for i in range(1, 100)]
    q = clean(df, observed, modelled).agg(F.percentile(observed, at).alias("x"), F.percentile(modelled, at).alias("y"))
    return q.select(F.posexplode(F.arrays_zip("x", "y")).alias("k", "v")).select((F.col("k") + 1).alias("percentile"), F.round("v.x", 6).alias("observed"), F.round("v.y", 6).alias("modelled"))


def regression_lines(df: DataFrame, x: str, y: str, sx: float = 1.0, sy: float = 1.0) -> DataFrame:
    """Least squares, ratio of means, and the line through the centre with effective-variance slope."""
    a, b = F.col(x), F.col(y)
    sxx, syy, sxy = F.var_pop(a), F.var_pop(b), F.covar_pop(a, b)
    p, q = sx * sx, sy * sy
    root = F.sqrt(F.pow(q * sxx, 2.0) - 2 * sxx * syy * p * q + F.pow(p * syy, 2.0) + 4 * F.pow(sxy, 2.0) * p * q)
    slope = (p * syy - q * sxx + root) / (2 * sxy * p)
    found = {"slope": F.regr_slope(b, a), "intercept": F.regr_intercept(b, a), "r2": F.regr_r2(b, a), "mean_slope": F.avg(b) / F.avg(a), "ev_slope": slope, "ev_intercept": F.avg(b) - slope * F.avg(a)}
    return clean(df, x, y).agg(*(F.round(c, 6).alias(n) for n, c in found.items()))
