"""Joint models, conditional curves and tides against series with known parameters."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import moments
from tidemark.operators import conditional, hierarchical, return_tables, water

RNG = np.random.default_rng(9)


def test_moments_recover_parameters():
    x = 1 + 2 * RNG.weibull(1.5, 200_000)
    skew = float(((x - x.mean()) ** 3).mean() / x.std() ** 3)
    assert moments.weibull(x.mean(), x.var(), skew) == pytest.approx((1.5, 1, 2), abs=0.06)
    y = 3 * RNG.weibull(2.2, 200_000)
    assert moments.weibull_at_zero(y.mean(), y.var()) == pytest.approx((2.2, 3), abs=0.03)
    t = RNG.vonmises(0, 4.0, 200_000)
    assert moments.von_mises_kappa(math.hypot(np.cos(t).mean(), np.sin(t).mean())) == pytest.approx(4.0, rel=0.03)


def test_curve_recovers_parameters():
    x = np.linspace(1, 20, 15)
    f, start = conditional.CURVES["height_on_wind"]
    want = [0.8, 0.05, 1.4, 0.004]
    assert f(x, *moments.curve(f, x, f(x, *want), start)) == pytest.approx(f(x, *want), rel=1e-3)


@pytest.fixture(scope="module")
def sea(spark):
    u = 9 * RNG.weibull(2.0, 30_000)
    hs = (1 + 0.02 * u**1.5) * RNG.weibull(2.5, len(u)) + 0.01
    tp = np.exp(np.log(4 + 3 * np.sqrt(hs)) + (0.05 + 0.2 * np.exp(-0.3 * hs)) * RNG.standard_normal(len(u)))
    turn = np.degrees(RNG.vonmises(0, 1 + 3 / (1 + np.exp(-(u - 9)))))
    return spark.createDataFrame(pd.DataFrame({"u": u, "hs": hs, "tp": tp, "turn": turn}))


def test_joint_model(spark, sea):
    model = hierarchical.fit(sea, ["hs", "tp"])
    mid = model.quantile(1, np.array([0.5, 0.5]), np.array([1.0, 3.0]))
    assert mid == pytest.approx([4 + 3, 4 + 3 * math.sqrt(3)], rel=0.03)
    inner = hierarchical.contour(spark, model, 1.0, 1.0).toPandas()
    outer = hierarchical.contour(spark, model, 1.0, 1.0, method="ISORM").toPandas()
    assert len(inner) == 180 and inner.hs.max() < outer.hs.max()
    top = model.quantile(0, np.array([1 - 1 / (365.2422 * 24)]))[0]
    assert inner.hs.max() == pytest.approx(top, rel=1e-6)
    assert hierarchical.parameters(spark, model).count() == 3 + 2 + 3


def test_joint_models_of_other_kinds(spark, sea):
    got = hierarchical.contour(spark, hierarchical.fit(sea, ["u", "hs", "tp"], "u_hs_tp"), 10.0, 1.0, points=400).toPandas()
    assert len(got) == 400 and np.isfinite(got.to_numpy()).all()
    turned = hierarchical.contour(spark, hierarchical.fit(sea, ["u", "turn"], "u_misalignment"), 1.0, 1.0).toPandas()
    assert turned.turn.between(-200, 200).all()
    with pytest.raises(ValueError):
        hierarchical.fit(sea, ["u"], "hs_tp")


def test_radius():
    assert hierarchical.radius(0.025, 2) == pytest.approx(1.959964, abs=1e-5)
    assert hierarchical.radius(0.05, 2, "ISORM") == pytest.approx(math.sqrt(5.991465), abs=1e-5)
    assert hierarchical.radius(0.05, 3, "ISORM") == pytest.approx(math.sqrt(7.814728), abs=1e-5)


def test_tide(spark):
    k = np.arange(12_000)
    x = 1.2 * np.cos(2 * math.pi * k / 12.42 - 0.4) + 0.4 * np.cos(2 * math.pi * k / 12) + 0.3 * np.sin(2 * math.pi * k / 23.934) + 0.2 * np.cos(2 * math.pi * k / 25.82)
    df = spark.createDataFrame(pd.DataFrame({"ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(k, "h"), "x": x}))
    got = water.tide_type(df, "ts", "x").first()
    assert (got.m2, got.s2, got.k1, got.o1) == pytest.approx((1.2, 0.4, 0.3, 0.2), abs=0.01)
    assert got.type == "mixed, mainly semi-diurnal"
    assert water.tide_type(df.limit(0), "ts", "x").first().type is None


def test_return_table_caps_sectors(spark):
    n = 8766
    df = spark.createDataFrame(pd.DataFrame({"ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n), "h"), "x": 2 * RNG.weibull(1.5, n), "d": RNG.uniform(0, 360, n)}))
    got = return_tables.directional(df, "ts", "x", "d", (10, 100)).toPandas()
    top = got[got.sector.isna()].iloc[0]
    assert len(got) == 13 and (got.rv_10 <= top.rv_10 + 1e-9).all() and (got.rv_100 <= top.rv_100 + 1e-9).all()
    assert got.share.sum() == pytest.approx(200, abs=1e-3)
    assert top.rv_100 == pytest.approx(2 * math.log(100 * 365.2422 * 24 * n / 8784) ** (1 / 1.5), rel=0.12)
