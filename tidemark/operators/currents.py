"""Wave-induced velocity below the surface, from JONSWAP spectra, row by row without a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import physics

STEP, STEPS = 0.01, 99  # frequencies 0.01 to 0.99 Hz; at 0 the density is 0


def wave_number(f: float, depth: float, g: float = 9.82) -> float:
    """Linear dispersion by Newton steps."""
    w2 = (2 * math.pi * f) ** 2
    k = w2 / g / math.sqrt(math.tanh(w2 * depth / g))
    for _ in range(20):
        t = math.tanh(k * depth)
        k -= (g * k * t - w2) / (g * t + g * k * depth * (1 - t * t))
    return k


def _frequencies(depth: float) -> Column:
    """The grid as one array: frequency, wave number and trapezoid weight depend on no row."""
    cells = ((i * STEP, wave_number(i * STEP, depth), STEP / 2 if i == STEPS else STEP) for i in range(1, STEPS + 1))
    return F.array(*(F.struct(F.lit(f).alias("f"), F.lit(k).alias("k"), F.lit(w).alias("w")) for f, k, w in cells))


def _with_spectrum(df: DataFrame, hs: str, tp: str, depth: float) -> DataFrame:
    """Adds _s: frequency, wave number and weighted density of each step, which don't depend on the level."""
    cell = lambda c: F.struct(c["f"].alias("f"), c["k"].alias("k"), (physics.jonswap(c["f"], F.col(hs), F.col(tp)) * c["w"]).alias("s"))
    return df.withColumn("_s", F.transform(_frequencies(depth), cell))


def _with_velocity(df: DataFrame, depth: float, z: str) -> DataFrame:
    def cell(c: Column) -> Column:
        f, k = c["f"], c["k"]
        velocity = 2 * math.pi * f * F.exp(-k * F.col(z)) * (1 + F.exp(-2 * k * (depth - F.col(z)))) / (1 - F.exp(-2 * k * depth))
        s = F.coalesce(c["s"] * velocity * velocity, F.lit(0.0))
        return F.struct(s.alias("m0"), (s * f * f).alias("m2"))

    zero = F.struct(F.lit(0.0).alias("m0"), F.lit(0.0).alias("m2"))
    moments = F.aggregate(F.transform("_s", cell), zero, lambda a, b: F.struct((a["m0"] + b["m0"]).alias("m0"), (a["m2"] + b["m2"]).alias("m2")))
    out = df.withColumn("_m", moments)
    return out.withColumns({"us": 2 * F.sqrt("_m.m0"), "tu": F.sqrt(F.try_divide("_m.m0", "_m.m2"))}).drop("_m", "_s")


def with_wave_current(df: DataFrame, hs: str, tp: str, depth: float, z: str) -> DataFrame:
    """Adds us (significant velocity, 2 sqrt(m0)) and tu (its period, sqrt(m0 / m2)) at column z metres below the surface.

    Moments are trapezoids over the frequencies. A null or zero height or period, or a null z, gives us 0 and a null tu.
    """
    return _with_velocity(_with_spectrum(df, hs, tp, depth), depth, z)


def depth_of_influence(df: DataFrame, key: list[str], hs: str, tp: str, depth: float, least: float = 0.01, step: float = 0.5) -> DataFrame:
    """key, depth_m: the deepest multiple of `step` down to the bottom at which us exceeds `least`; null if none does.

    A row's spectrum is made once, before the row is spread over the levels.
    """
    levels = F.transform(F.sequence(F.lit(0), F.lit(int(depth / step))), lambda i: i * F.lit(step))
    cells = _with_spectrum(df.select(*key, F.col(hs).alias("_hs"), F.col(tp).alias("_tp")), "_hs", "_tp", depth).withColumn("_z", F.explode(levels))
    return _with_velocity(cells, depth, "_z").groupBy(*key).agg(F.max(F.when(F.col("us") > least, F.col("_z"))).alias("depth_m"))
