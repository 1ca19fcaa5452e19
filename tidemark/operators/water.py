"""Tides: harmonic amplitudes of the main constituents and the type of tide; a series without its trend."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import clean

#: Periods in hours and class limits of the form factor (fixed values).
CONSTITUENTS = {"m2": "12.42", "s2": "12", "k1": "23.934", "o1": "25.82"}
TYPES = ((0.25, "semi-diurnal"), (1.5, "mixed, mainly semi-diurnal"), (3.0, "mixed, mainly diurnal"))


def _with(df: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with the columns of rows, which has one row a site, or one in all."""
    return df.join(rows, list(by)) if by else df.crossJoin(F.broadcast(rows))


def _indexed(df: DataFrame, ts: str, value: str, hours: float, by: Sequence[str]) -> DataFrame:
    """_k (steps since the first row), _x (value less its mean) and _n (steps in all), by site, without a sort."""
    df = clean(df, value).where(F.col(value).isNotNull())
    bounds = df.groupBy(*by).agg(F.min(F.unix_timestamp(F.col(ts).cast("timestamp"))).alias("_t0"), F.max(F.unix_timestamp(F.col(ts).cast("timestamp"))).alias("_t1"), F.avg(value).alias("_m"))
    df = _with(df, bounds, by)
    step = hours * 3600
    return df.withColumns({
        "_k": F.round((F.unix_timestamp(F.col(ts).cast("timestamp")) - F.col("_t0")) / step).cast("long"),
        "_x": F.col(value) - F.col("_m"),
        "_n": F.round((F.col("_t1") - F.col("_t0")) / step).cast("long") + 1,
    }).drop("_t0", "_t1", "_m")


def tide_type(df: DataFrame, ts: str, value: str, hours: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """By site, amplitude of each constituent over the longest whole number of its periods that ends on a step, form factor, type."""
    rows = _indexed(df, ts, value, hours, by)
    sums = []
    for name, period in CONSTITUENTS.items():
        whole = Fraction(period).numerator  # steps after which the period and the step meet again
        last = F.floor((F.col("_n") - 1) / whole) * whole
        angle = F.col("_k") * (2 * math.pi / float(period))
        for part, f in (("a", F.cos), ("b", F.sin)):
            sums.append(F.sum(F.when(F.col("_k") <= last, F.col("_x") * f(angle))).alias(f"{name}_{part}"))
        sums.append(F.max(last).alias(f"{name}_n"))
    out = rows.groupBy(*by).agg(*sums)
    out = out.select(*by, *(F.when(F.col(f"{c}_n") > 0, 2 / F.col(f"{c}_n") * F.hypot(f"{c}_a", f"{c}_b")).otherwise(0.0).alias(c) for c in CONSTITUENTS))
    form = F.try_divide(F.col("k1") + F.col("o1"), F.col("m2") + F.col("s2"))
    kind = F.lit("diurnal")
    for most, name in reversed(TYPES):
        kind = F.when(form < most, name).otherwise(kind)
    return out.select(*by, *(F.round(c, 6).alias(c) for c in CONSTITUENTS), F.round(form, 6).alias("form_factor"), F.when(form.isNotNull(), kind).alias("type"))


def without_trend(df: DataFrame, ts: str, value: str, hours: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Adds `detrended`: value less the least-squares line over the steps, by site."""
    rows = _indexed(df, ts, value, hours, by)
    line = rows.groupBy(*by).agg(F.regr_slope(value, "_k").alias("_b"), F.regr_intercept(value, "_k").alias("_a"))
    return _with(rows, line, by).withColumn("detrended", F.round(F.col(value) - F.col("_a") - F.col("_b") * F.col("_k"), 6)).drop("_a", "_b", "_k", "_x", "_n")


def water_levels(df: DataFrame, components: dict[str, str], pressure: str) -> DataFrame:
    """component, least, greatest: extremes of each water-level column, and of the surge that air pressure (hPa) alone makes."""
    cols = list(components.values())
    row = clean(df, *cols, pressure).agg(*(f(c).alias(f"{n}_{a}") for a, c in components.items() for n, f in (("lo", F.min), ("hi", F.max))), F.min(pressure).alias("p0"), F.avg(pressure).alias("pm"), F.max(pressure).alias("p1"))
    cells = [(a, F.col(f"lo_{a}"), F.col(f"hi_{a}")) for a in components] + [("pressure surge", -0.01 * (F.col("p1") - F.col("pm")), -0.01 * (F.col("p0") - F.col("pm")))]
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("component"), F.round(lo, 6).alias("least"), F.round(hi, 6).alias("greatest")) for a, lo, hi in cells)))
    return row.select(pairs.alias("p")).select("p.*")
