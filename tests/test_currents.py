"""Wave-induced velocity against numpy; conversions at their edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import corrections
from tidemark.operators import currents, extremes, profile, windows


def velocity(hs, tp, depth, z):
    f = np.arange(1, 100) * 0.01
    gamma = min(math.exp(3.484 * (1 - 0.1975 * (0.036 - 0.0056 * tp / math.sqrt(hs)) * tp**4 / hs**2)), 5.0)
    alpha = 5.061 * hs**2 / tp**4 * (1 - 0.287 * math.log(gamma))
    sigma = np.where(f <= 1 / tp, 0.07, 0.09)
    s = alpha * 9.82**2 * (2 * np.pi) ** -4 * f**-5.0 * np.exp(-1.25 * (f * tp) ** -4.0) * gamma ** np.exp(-0.5 * ((f * tp - 1) / sigma) ** 2)
    k = np.array([currents.wave_number(x, depth) for x in f])
    u = s * (2 * np.pi * f * np.cosh(k * (depth - z)) / np.sinh(k * depth)) ** 2
    u = np.concatenate(([0.0], u))
    f = np.concatenate(([0.0], f))
    m0, m2 = np.trapezoid(u, f), np.trapezoid(u * f * f, f)
    return 2 * math.sqrt(m0), math.sqrt(m0 / m2)


def test_wave_number_solves_dispersion():
    for f in (0.01, 0.1, 0.5):
        for depth in (5.0, 100.0):
            k = currents.wave_number(f, depth)
            assert 9.82 * k * math.tanh(k * depth) == pytest.approx((2 * math.pi * f) ** 2, rel=1e-9)


@pytest.mark.parametrize("case", [(2.0, 7.0, 60.0, 0.0), (8.0, 12.0, 60.0, 20.0), (8.0, 12.0, 60.0, 60.0)])
def test_wave_current_equals_numpy(spark, case):
    hs, tp, depth, z = case
    row = currents.with_wave_current(spark.createDataFrame([(hs, tp, z)], "hs double, tp double, z double"), "hs", "tp", depth, "z").first()
    assert (row.us, row.tu) == pytest.approx(velocity(*case), rel=1e-9)


def test_wave_current_without_waves_and_influence(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, None, 5.0), (3, 2.0, 7.0)], "id int, hs double, tp double")
    rows = currents.with_wave_current(df.withColumn("z", F.lit(1.0)), "hs", "tp", 50.0, "z").orderBy("id").collect()
    assert [r.us for r in rows[:2]] == [0.0, 0.0] and [r.tu for r in rows[:2]] == [None, None]
    deep = {r.id: r.depth_m for r in currents.depth_of_influence(df, ["id"], "hs", "tp", 50.0).collect()}
    assert deep[1] is None and deep[2] is None
    want = max(z for z in np.arange(0, 50.5, 0.5) if velocity(2.0, 7.0, 50.0, z)[0] > 0.01)
    assert deep[3] == want


def test_ratios_and_limits(spark):
    assert corrections.wind_ratio(10, 600) == 1.0
    assert corrections.wind_ratio(15, 600) == pytest.approx((1.0 + 1.095) / 2)
    assert corrections.wind_ratio(120, 600) == pytest.approx(1.315 + (1.315 - 1.220) * 20 / 50)
    row = spark.range(1).select(corrections.towards(F.lit(0.0), F.lit(0.0)).alias("a"), corrections.towards(F.lit(-1.0), F.lit(0.0)).alias("b"), corrections.decimal_degrees(F.lit(-3), F.lit(30), F.lit(0)).alias("c"), corrections.strong_wind(F.lit(15.0)).alias("d"), corrections.air_temperature(F.lit(None).cast("double")).alias("e")).first()
    assert tuple(row) == (0.0, 270.0, -3.5, 15.0, None)


def test_small_tables(spark):
    empty = spark.createDataFrame([], "ts timestamp_ntz, x double")
    assert windows.threshold_table(empty, "ts", "x", (1,), (2,), 1.0).count() == 0
    assert extremes.threshold_sensitivity(empty, "ts", "x", (1,), 10.0).count() == 0
    one = spark.createDataFrame([(0.0, 2.0), (None, 3.0), (2.0, 8.0)], "a double, b double")
    row = profile.shear(one, (10.0, "a"), (100.0, "b")).first()
    assert row.n == 1 and row.median == pytest.approx(math.log10(4), abs=1e-6)
