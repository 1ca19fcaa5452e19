"""Return values by month or direction sector: from all rows, yearly maxima, peaks over a threshold, or monthly extremes.

Each group's sample reaches one task, and it is small whatever the number of rows: maxima and peaks are few, and all rows
are first counted in CLASSES classes between the least and the greatest value, whose means and numbers are what is fitted (fits
take weights). Fits by sums alone (EXP, Weibull3P_MOM) from all rows need no classes and take one pass of moments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import distributions
from tidemark.functions.moments import weibull
from tidemark.functions.series import by_brackets, clean, estimated_bytes, sector
from tidemark.operators.extremes import peaks_over_threshold

YEAR_HOURS = 365.2422 * 24
ONE_YEAR = 1.5873  # what a period of one year given as a float stands for
CLASSES = 8192
SMALL = 32 << 20  # estimated bytes up to which the percentile of all rows may stand in one task's buffer
METHODS = ("default", "AM", "POT", "minimum", "maximum")


def _seconds(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def _both(df: DataFrame, name: str) -> DataFrame:
    """Rows once for their group and once, with a null key, for the whole."""
    return df.withColumn("_g", F.explode(F.array(F.struct(F.col(name).alias("k"), F.lit(False).alias("whole")), F.struct(F.lit(None).cast("int").alias("k"), F.lit(True).alias("whole"))))).withColumn(name, F.col("_g.k")).withColumn("_whole", F.col("_g.whole")).drop("_g")


def _bounds(df: DataFrame, name: str, ts: str, value: str) -> DataFrame:
    """A row a group and one for the whole: rows, days, and moments."""
    x, days = F.col(value), F.floor((F.max(_seconds(ts)) - F.min(_seconds(ts))) / 86400)
    aggs = [F.count(F.lit(1)).alias("n"), (days + 1).alias("days"), F.min(x).alias("least"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.skewness(x).alias("skew")]
    return df.groupingSets([[F.col(name)], []], F.col(name)).agg(*aggs)


def _samples(df: DataFrame, name: str, ts: str, value: str, method: str, thresholds: DataFrame | None) -> DataFrame:
    """name (null for the whole), x, w: what is fitted."""
    if method == "default":
        ends = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
        k = F.least(F.floor((F.col(value) - F.col("_a")) / ((F.col("_b") - F.col("_a")) / CLASSES)), F.lit(CLASSES - 1))
        cells = df.crossJoin(F.broadcast(ends)).groupBy(name, F.coalesce(k, F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("w"), F.avg(value).alias("x"))
        whole = cells.groupBy("k").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), F.sum("w").alias("w"))
        return cells.select(name, "x", "w").unionByName(whole.select(F.lit(None).cast("int").alias(name), "x", "w"))
    if method in ("minimum", "maximum"):
        f = F.min if method == "minimum" else F.max
        own = df.groupBy(name, F.year(ts).alias("y"), F.month(ts).alias("m")).agg(f(value).alias("x"))
        whole = df.groupBy(F.year(ts).alias("y")).agg(f(value).alias("x"))
    elif method == "AM":
        own = df.groupBy(name, F.year(ts).alias("y")).agg(F.max(value).alias("x"))
        whole = own.groupBy("y").agg(F.max("x").alias("x"))
    else:
        over = _both(df.select(name, ts, value), name).join(F.broadcast(thresholds), F.col(name).eqNullSafe(F.col("_k")), "inner").drop("_k")
        peaks = peaks_over_threshold(over, ts, value, F.col("threshold"), 48, [name])
        return peaks.select(name, F.col("value").alias("x"), F.lit(1).cast("long").alias("w"))
    return own.select(name, "x").unionByName(whole.select(F.lit(None).cast("int").alias(name), "x")).withColumn("w", F.lit(1).cast("long"))


def _thresholds(df: DataFrame, name: str, ts: str, value: str, threshold: str | float) -> DataFrame:
    """_k, threshold, events (rows a year that reach it, infinite where all rows are of one day; null unless it is a percentile):
    the least yearly maximum, a percentile such as 'P95', or a number."""
    rows = _both(df, name)
    if threshold == "default":
        found = rows.groupBy(name, F.year(ts)).agg(F.max(value).alias("x")).groupBy(name).agg(F.min("x").alias("threshold"))
    elif isinstance(threshold, str) and threshold.startswith("P") and estimated_bytes(df) > SMALL:
        found = by_brackets(df, [[name], []], value, {"threshold": float(threshold[1:]) / 100}, None)
    elif isinstance(threshold, str) and threshold.startswith("P"):
        found = rows.groupBy(name).agg(F.percentile(value, float(threshold[1:]) / 100).alias("threshold"))
    else:
        found = rows.groupBy(name).agg(F.lit(float(threshold)).alias("threshold"))
    found = found.withColumnRenamed(name, "_k")
    if not (isinstance(threshold, str) and threshold.startswith("P")):
        return found.withColumn("events", F.lit(None).cast("double"))
    years = F.floor((F.max(_seconds(ts)) - F.min(_seconds(ts))) / 86400) / 365.25
    reached = rows.join(F.broadcast(found), F.col(name).eqNullSafe(F.col("_k")))
    events = reached.groupBy("_k").agg(F.coalesce(F.try_divide(F.count_if(F.col(value) >= F.col("threshold")), years), F.when(years == 0, math.inf)).alias("events"))
    return found.alias("f").join(F.broadcast(events.alias("e")), F.col("f._k").eqNullSafe(F.col("e._k"))).select("f._k", "threshold", "events")


def return_table(df: DataFrame, ts: str, value: str, key: Column, name: str, periods: Sequence[float] = (1, 10, 100, 10000), distribution: str = "Weibull3P_MOM", method: str = "default", threshold: str | float = "default", factor: float = 1.0, groups: int | None = None, cap: bool = True) -> DataFrame:
    """A row a group and one for the whole (null key): share of rows in percent, shape, loc, scale, threshold, events a year over
    it, and a column rv_<period> a period.

    The probability is 1 / N with N the number of steps (of the group's rows, whatever the method) in the period, which is
    `factor` times as long for groups. Values of groups don't exceed those of the whole, but for method 'minimum'. With
    groups = (first, count) given, groups without rows get a row of nulls. A period of one year as a float means 1.5873.
    """
    if distribution not in distributions.FITS:
        raise ValueError(f"unknown distribution {distribution!r}")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    df = clean(df, value).where(F.col(value).isNotNull()).withColumn(name, key.cast("int")).select(name, ts, value)
    bounds = _bounds(df, name, ts, value)
    if method in ("minimum", "maximum"):
        f = F.min if method == "minimum" else F.max
        series = df.groupBy(name, F.last_day(F.col(ts)).alias("_t")).agg(f(value).alias("x"))
        yearly = df.groupBy(F.make_date(F.year(ts), F.lit(12), F.lit(31)).alias("_t")).agg(f(value).alias("x")).withColumn(name, F.lit(None).cast("int"))
        steps = series.unionByName(yearly).groupBy(name).agg((F.datediff(F.max("_t"), F.min("_t")) + 1).alias("_days"), F.count(F.lit(1)).alias("_n"))
    else:
        steps = bounds.select(name, F.col("days").alias("_days"), F.col("n").alias("_n"))
    thresholds = _thresholds(df, name, ts, value, threshold) if method == "POT" or threshold != "default" else None
    by_sums = method == "default" and distribution in ("EXP", "Weibull3P_MOM")
    if by_sums:
        given = bounds.withColumns({"xs": F.lit(None).cast("array<double>"), "ws": F.lit(None).cast("array<long>")})
    else:
        found = _samples(df, name, ts, value, method, thresholds).groupBy(name).agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("s"))
        given = bounds.alias("b").join(found.alias("f"), F.col(f"b.{name}").eqNullSafe(F.col(f"f.{name}")), "left").select("b.*", F.col("s.x").alias("xs"), F.col("s.w").alias("ws"))
    given = given.alias("g").join(F.broadcast(steps.alias("t")), F.col(f"g.{name}").eqNullSafe(F.col(f"t.{name}"))).select("g.*", "_days", "_n")
    values = [f"rv_{t:g}" for t in periods]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                whole = pd.isna(r[name])
                years = np.array([(ONE_YEAR if isinstance(t, float) and t == 1 else t) * (1.0 if whole else factor) for t in periods])
                found = _fitted(r, distribution, YEAR_HOURS * years / (r["_days"] * 24 / r["_n"]), by_sums)
                out.append((None if whole else int(r[name]), int(r["n"]), *found))
            yield pd.DataFrame(out, columns=[name, "n", "shape", "loc", "scale", *values]).astype({name: "Int32"})

    schema = f"{name} int, n long, shape double, loc double, scale double, " + ", ".join(f"{v} double" for v in values)
    rows = given.mapInPandas(fit, schema)
    whole = rows.where(F.col(name).isNull()).select(F.col("n").alias("_all"), *(F.col(v).alias(f"_{v}") for v in values))
    out = rows.crossJoin(F.broadcast(whole))
    limit = (lambda v: F.least(v, f"_{v}")) if cap and method != "minimum" else F.col
    out = out.select(name, F.round(100 * F.col("n") / F.col("_all"), 6).alias("share"), *(F.round(c, 6).alias(c) for c in ("shape", "loc", "scale")), *(F.round(limit(v), 6).alias(v) for v in values))
    if thresholds is None:
        out = out.withColumns({"threshold": F.lit(None).cast("double"), "events": F.lit(None).cast("double")})
    else:
        more = thresholds.select("_k", F.round("threshold", 6).alias("threshold"), F.round("events", 6).alias("events"))
        out = out.join(F.broadcast(more), F.col(name).eqNullSafe(F.col("_k")), "left").drop("_k")
    out = out.select(name, "share", "shape", "loc", "scale", "threshold", "events", *values)
    if groups is not None:
        every = df.sparkSession.range(groups).select(F.col("id").cast("int").alias(name))
        missing = every.join(out.where(F.col(name).isNotNull()).select(name), name, "left_anti").withColumn("share", F.lit(0.0))
        out = out.unionByName(missing, allowMissingColumns=True)
    return out


def _fitted(r: dict, distribution: str, samples: np.ndarray, by_sums: bool) -> list[float | None]:
    """shape, loc, scale and the values; nulls where there are too few rows or no spread.

    EXP has a closed form, so one row or no spread will do (scale 0), and its line goes on below loc for periods under a step.
    """
    nothing, exponential = [None] * (3 + len(samples)), distribution == "EXP"
    with np.errstate(all="ignore"):
        if by_sums:
            if not exponential and (r["n"] < 3 or not r["var"] or not r["var"] > 0):
                return nothing
            fit = (None, r["least"], max(0.0, r["mean"] - r["least"])) if exponential else weibull(float(r["mean"]), float(r["var"]), float(r["skew"]))
        else:
            if r["xs"] is None:  # no row over the threshold
                return nothing
            x, w = np.asarray(r["xs"], float), np.asarray(r["ws"], float)
            if not exponential and (w.sum() < 3 or not x.max() > x.min()):
                return nothing
            fit = distributions.FITS[distribution](x, w)
        values = distributions.exceeded(distribution, fit, np.where(exponential | (samples > 1), 1 / np.maximum(samples, 1e-9), np.nan))
    return [None if c is None else float(c) for c in fit] + [float(v) if math.isfinite(v) else None for v in values]


def monthly(df: DataFrame, ts: str, value: str, periods: Sequence[float] = (1, 10, 100, 10000), distribution: str = "Weibull3P_MOM", method: str = "default", threshold: str | float = "default") -> DataFrame:
    """return_table() by month; the null month is the year."""
    return return_table(df, ts, value, F.month(ts), "month", periods, distribution, method, threshold)


def directional(df: DataFrame, ts: str, value: str, direction: str, periods: Sequence[float] = (1, 10, 100, 10000), distribution: str = "Weibull3P_MOM", norsok: bool = True, method: str = "default", threshold: str | float = "default") -> DataFrame:
    """return_table() by sector of 30 degrees, all twelve; the null sector is all rows. NORSOK periods of sectors are six times as long."""
    return return_table(df, ts, value, sector(F.col(direction)), "sector", periods, distribution, method, threshold, 6.0 if norsok else 1.0, 12)


def by_level(df: DataFrame, ts: str, levels: dict[float, str], periods: Sequence[float] = (1, 10, 100, 10000), distribution: str = "Weibull3P", method: str = "default", threshold: str | float = "default") -> DataFrame:
    """level, period, value: return values of each level's column; a period of one year stands for 1.5873."""
    out = None
    for z, c in levels.items():
        found = return_table(df, ts, c, F.lit(0), "_one", [float(t) for t in periods], distribution, method, threshold).where("_one is null")
        pairs = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("period"), F.col(f"rv_{t:g}").alias("value")) for t in periods)))
        rows = found.select(F.lit(float(z)).alias("level"), pairs.alias("p")).select("level", "p.*")
        out = rows if out is None else out.unionByName(rows)
    return out
