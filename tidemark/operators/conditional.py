"""One variable given classes of another: observed statistics by class and the curves fitted to them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.moments import curve
from tidemark.functions.series import clean

#: Curves with the values that their fits start from (fixed values).
CURVES = {
    "height_on_wind": (lambda u, a, b, c, d: a + b * u ** (c + d * u), [1.0, 0.032, 1.6, 0.003]),
    "current_on_wind": (lambda u, a, b, c, d: a + b * u ** (c + d * u), [13.5, 0.005, 2.0, 0.003]),
    "current_on_height": (lambda h, a, b, c: a + b * h**c, [14.5, 0.60, 1.8]),
    "surge_on_height": (lambda h, a, b, c: a + b * h + c * np.log(h), [0.0, 1.0, 1.0]),
}


def given_classes(df: DataFrame, value: str, by: str, width: float, top: float, least: int = 10) -> DataFrame:
    """Statistics of value for by in [k width, (k + 1) width) up to top; null where a class has `least` rows or fewer."""
    count = math.ceil(top / width)
    df = clean(df, value, by).where(F.col(by).between(0, count * width) & F.col(value).isNotNull())
    found = df.groupBy(F.floor(F.col(by) / width).cast("int").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile(value, 0.05).alias("p5"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, 0.95).alias("p95")
    )
    spine = df.sparkSession.range(count).select(F.col("id").cast("int").alias("k"))
    enough = [F.when(F.col("n") > least, F.round(c, 6)).alias(c) for c in ("p5", "mean", "std", "p95")]
    return spine.join(F.broadcast(found), "k", "left").select("k", ((F.col("k") + 0.5) * width).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"), *enough)


def with_curve(classes: DataFrame, name: str) -> DataFrame:
    """classes (one row a class, so a small table) with the fitted mean, deviation and 5 and 95 % values."""
    f, start = CURVES[name]
    table = classes.orderBy("k").toPandas()
    used = table.dropna(subset=["mean", "std"])
    at = table["centre"].to_numpy(float)
    for c in ("mean", "std"):
        enough = len(used) >= len(start)
        fit = curve(f, used["centre"].to_numpy(float), used[c].to_numpy(float), start) if enough else None
        table[f"{c}_model"] = f(at, *fit) if enough else math.nan
    table["p5_model"] = table["mean_model"] - 1.65 * table["std_model"]
    table["p95_model"] = table["mean_model"] + 1.65 * table["std_model"]
    added = [c for c in table.columns if c.endswith("_model")]
    rows = [tuple([int(k)] + [None if pd.isna(v) else float(v) for v in vs]) for k, *vs in table[["k", *added]].itertuples(index=False)]
    return classes.join(F.broadcast(classes.sparkSession.createDataFrame(rows, "k int, " + ", ".join(f"{c} double" for c in added))), "k", "left")


def coefficients(classes: DataFrame, name: str) -> dict[str, list[float] | None]:
    """Coefficients of the curve `name` for each statistic of given_classes(); None where too few classes have rows enough."""
    f, start = CURVES[name]
    used = classes.where("mean is not null and std is not null").orderBy("k").toPandas()  # a row a class
    fit = lambda c: curve(f, used["centre"].to_numpy(float), used[c].to_numpy(float), start).tolist() if len(used) >= len(start) else None
    return {c: fit(c) for c in ("mean", "std", "p5", "p95")}


def coefficient_table(classes: DataFrame, name: str) -> DataFrame:
    """statistic, a, b, c (and d): a row a statistic."""
    found, letters = coefficients(classes, name), "abcd"[: len(CURVES[name][1])]
    rows = [(s, *(map(float, v) if v else [None] * len(letters))) for s, v in found.items()]
    return classes.sparkSession.createDataFrame(rows, "statistic string, " + ", ".join(f"{x} double" for x in letters))


def _expression(name: str, x: Column, p: list[float]) -> Column:
    if name in ("height_on_wind", "current_on_wind"):
        return p[0] + p[1] * F.pow(x, p[2] + p[3] * x)
    return p[0] + p[1] * F.pow(x, F.lit(p[2])) if name == "current_on_height" else p[0] + p[1] * x + p[2] * F.log(x)


def with_model(rows: DataFrame, x: str, found: dict[str, list[float] | None], name: str, least: float | None = None) -> DataFrame:
    """rows with mean, std, p5 and p95 of the curve at column x, none below `least`."""
    if not found["mean"]:
        return rows.withColumns({c: F.lit(None).cast("double") for c in ("mean", "std", "p5", "p95")})
    mean, std = (_expression(name, F.col(x), found[c]) for c in ("mean", "std"))
    at = {"mean": mean, "std": std, "p5": mean - 1.65 * std, "p95": mean + 1.65 * std}
    return rows.withColumns({c: v if least is None else F.greatest(v, F.lit(least)) for c, v in at.items()})


def at_return_values(df: DataFrame, ts: str, value: str, by: str, name: str, width: float, top: float, periods: Sequence[float] = (1, 10, 100, 10000), least: float | None = None) -> DataFrame:
    """period, by (its return value, Weibull by moments of all rows), p5, mean, p95 of `value` by the curve fitted to its classes."""
    from tidemark.operators.return_tables import return_table

    whole = return_table(df, ts, by, F.lit(0), "_one", periods).where("_one is null")
    pairs = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("period"), F.col(f"rv_{t:g}").alias(by)) for t in periods)))
    rows = whole.select(pairs.alias("p")).select("p.*")
    return with_model(rows, by, coefficients(given_classes(df, value, by, width, top), name), name, least).select("period", by, "p5", "mean", "p95")
