"""Fits, joint models, contours, regression, grids and spectra against known parameters, plain versions and identities."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distributions as dist
from tidemark.functions import moments, physics, quadrature, spliced
from tidemark.operators import contours, crests, grids, hierarchical, lonowe, profile, relational, return_tables, spectra, trend

RNG = np.random.default_rng(21)
U = RNG.random(20_000)


def likelihood(name, x, fit):
    c, loc, scale = fit
    z = (x - loc) / scale
    with np.errstate(all="ignore"):
        if name == "LoNo":
            return float((-np.log(z) - math.log(c * scale) - np.log(z) ** 2 / (2 * c * c)).sum())
        if name == "Weibull3P":
            return float((math.log(c / scale) + (c - 1) * np.log(z) - z**c).sum())
        return float((-math.log(scale) - (1 + 1 / c) * np.log1p(c * z)).sum())


@pytest.mark.parametrize("name,x,true", [
    ("LoNo", 1.5 + 2 * np.exp(0.6 * dist.normal_quantile(U)), (0.6, 1.5, 2.0)),
    ("Weibull3P", 1.0 + 2 * (-np.log(U)) ** (1 / 1.6), (1.6, 1.0, 2.0)),
    ("GP", 0.5 + 2 / 0.15 * (U**-0.15 - 1), (0.15, 0.5, 2.0)),
])
def test_three_parameter_fits(name, x, true):
    fit = dist.FITS[name](x)
    assert fit == pytest.approx(true, abs=0.1)
    best = likelihood(name, x, fit)
    for i, step in itertools.product(range(3), (-0.01, 0.01)):
        other = list(fit)
        other[i] += step
        value = likelihood(name, x, other)
        assert not value > best + 1e-6 or (name == "GP" and i == 1)  # a Pareto location is the least value
    assert dist.exceeded(name, true, np.array([0.3])) == pytest.approx(np.quantile(x, 0.7), rel=0.05)


def test_weights_are_repetitions():
    x = RNG.gamma(3, 2, 60) + 1
    w = RNG.integers(1, 4, 60)
    for name in ("EXP", "GUM", "GUM_L", "GEV", "LoNo", "Weibull2P", "Weibull3P_MOM", "GP"):
        a, b = dist.FITS[name](x, w), dist.FITS[name](np.repeat(x, w))
        assert [v for v in a if v is not None] == pytest.approx([v for v in b if v is not None], rel=2e-3, abs=2e-3)


def test_other_families():
    shape, loc, scale = 1.4, 0.3, 0.8
    g = RNG.gamma(1 / shape, 1, 40_000) ** (1 / shape) * np.sign(RNG.random(40_000) - 0.5)
    assert dist.fit_gennorm(loc + scale * g) == pytest.approx((shape, loc, scale), abs=0.06)
    e = 3 * (-np.log1p(-(U ** (1 / 2.0)))) ** (1 / 1.5)
    assert dist.fit_exponentiated_weibull(e) == pytest.approx((2.0, 1.5, 3.0), rel=0.2)
    assert dist.fit_exponentiated_weibull(e, delta=2.0)[1:] == pytest.approx((1.5, 3.0), rel=0.04)


def test_spliced_distribution():
    s = spliced.Spliced(0.7, 0.5, 1.6, 0.2, 2.4, 3.0)
    x = np.linspace(0.1, 12, 2000)
    assert (np.diff(s.cdf(x)[x <= 3]) > 0).all() and s.pdf(x).min() >= 0
    p = np.array([0.05, 0.3, 0.99])
    assert s.cdf(s.icdf(p)) == pytest.approx(p, abs=1e-6)
    sample = s.draw(50_000)
    share = float(s.cdf(3.0))
    assert (sample <= 3).mean() == pytest.approx(share, abs=0.002) and len(sample) == 50_000
    found = spliced.fit(np.exp(0.7 + 0.5 * RNG.standard_normal(30_000)))
    assert (found.mu, found.sigma) == pytest.approx((0.7, 0.5), abs=0.02)
    part = found.cut / np.exp(0.7 + 0.5 * 3.7)
    assert 0.2 < part < 1.2


def test_quadrature():
    x = np.sort(RNG.uniform(0, 3, 9))
    assert np.dot(quadrature.simpson(x), x**2) == pytest.approx((x[-1] ** 3 - x[0] ** 3) / 3)
    even = np.linspace(0, 2, 8)
    assert np.dot(quadrature.simpson(even), even**2) == pytest.approx(8 / 3)
    assert np.dot(quadrature.trapezoid(x), 2 * x + 1) == pytest.approx(x[-1] ** 2 + x[-1] - x[0] ** 2 - x[0])
    assert quadrature.widths([0.0, 1.0, 4.0]) == [1.0, 2.0, 3.0]


@pytest.fixture(scope="module")
def sea(spark):
    n = 40_000
    hs = 0.4 + 2.0 * RNG.weibull(1.4, n)
    tp = np.exp(1.2 + 0.5 * hs**0.36 + np.sqrt(0.005 + 0.1 * np.exp(-0.3 * hs)) * RNG.standard_normal(n))
    ts = pd.Timestamp("1990-01-01") + pd.to_timedelta(np.arange(n) * 6, "h")
    return spark.createDataFrame(pd.DataFrame({"ts": ts, "hs": hs, "tp": tp, "dir": RNG.uniform(0, 360, n), "surge": 0.1 * hs + 0.05 * RNG.standard_normal(n), "tide": RNG.uniform(-1, 1, n)})).cache()


def test_lonowe_recovers_the_period(sea):
    m = lonowe.fit(sea, "ts", "hs", "tp", spread=False)[None]
    assert (m.a1, m.a2) == pytest.approx((1.2, 0.5), abs=0.08) and (m.b2, m.b3) == pytest.approx((0.1, 0.3), abs=0.06)
    assert m.tail == pytest.approx((1.4, 0.4, 2.0), abs=0.12)
    assert m.return_height(100) == pytest.approx(0.4 + 2 * math.log(100 * 365.2422 * 4) ** (1 / 1.4), rel=0.06)
    h, low, high = m.contour(100)
    level = lambda x, t: m.density()[np.abs(m.grid() - x).argmin()] * np.exp(-((np.log(t) - m.period_log(x)[0]) ** 2) / (2 * m.period_log(x)[1])) / (t * np.sqrt(2 * math.pi * m.period_log(x)[1]))
    found = [level(x, t) for x, a, b in list(zip(h, low, high))[:: len(h) // 7] for t in (a, b)]
    assert found == pytest.approx([found[0]] * len(found), rel=1e-6)  # one density all along
    assert h.max() >= m.return_height(100) - 0.05
    p5, mean, p95 = m.period_given(np.array([3.0]))
    assert p5 < mean < p95 and m.period_quantile(np.array([3.0]), 0.5)[0] == pytest.approx(math.exp(m.period_log(np.array([3.0]))[0][0]))


def test_joint_tables(sea):
    months = lonowe.return_values(sea, "ts", "hs", "tp", (10, 100)).toPandas()
    assert len(months) == 26 and months.share[months.month.notna()].unique().tolist() == [8.33]
    turns = lonowe.return_values(sea, "ts", "hs", "tp", (10, 100), "dir").toPandas()
    top = turns[turns.sector.isna()].set_index("period")
    assert len(turns) == 26 and (turns.hs <= turns.period.map(top.hs) + 1e-9).all() and (turns.tp <= turns.period.map(top.tp) + 1e-9).all()
    assert lonowe.parameters(sea, "ts", "hs", "tp").count() == 13 and lonowe.parameters(sea.limit(20), "ts", "hs", "tp", "dir").where("a1 is null").count() == 13
    steps = lonowe.low_and_high_periods(sea, "ts", "hs", "tp").toPandas()
    assert len(steps) == 40 and (steps.tp_low <= steps.tp_high).all()
    waves = crests.return_crests(sea, "ts", "hs", "tp").toPandas()
    assert (waves.hmax > waves.hs).all() and (waves.crest < waves.hmax).all() and waves.hs.is_monotonic_increasing
    levels = crests.total_water_levels(sea, "ts", "hs", "tp", "surge", "tide").toPandas()
    assert levels.total.to_numpy() == pytest.approx((levels.surge + levels.tide + levels.crest).to_numpy())
    turned = crests.directional_highest_waves(sea, "ts", "hs", "tp", "dir", (10,)).toPandas()
    assert (turned.hmax <= turned[turned.sector.isna()].hmax.iloc[0] + 1e-9).all()


@pytest.mark.parametrize("method,name", [("AM", "GUM"), ("POT", "Weibull3P"), ("minimum", "GUM"), ("maximum", "Weibull3P"), ("default", "GUM")])
def test_return_tables_by_method(sea, method, name):
    got = return_tables.monthly(sea, "ts", "hs", (10, 100), name, method, "P90" if method == "POT" else "default").toPandas()
    assert len(got) == 13 and got.scale.gt(0).all() and (got.rv_10 < got.rv_100 + 1e-9).all()
    year = got[got.month.isna()].iloc[0]
    if method != "minimum":
        assert (got.rv_100 <= year.rv_100 + 1e-9).all()
    assert got.threshold.notna().all() == (method == "POT") == got.events.notna().all()


def test_classes_don_t_change_fits(sea):
    x = np.array([r.hs for r in sea.select("hs").collect()])
    got = return_tables.monthly(sea, "ts", "hs", (100,), "Weibull3P").where("month is null").first()
    assert (got["shape"], got["loc"], got["scale"]) == pytest.approx(dist.FITS["Weibull3P"](x), rel=1e-3)


@pytest.fixture(scope="module")
def model(sea):
    return hierarchical.fit(sea, ["hs", "tp"])


def test_contour_tables_lie_on_the_sphere(spark, sea, model):
    r = hierarchical.radius(contours.chance(50, 1.0), 2)
    for row in contours.contour_table(spark, model, 50.0).collect():
        u0 = dist.normal_quantile(model.cumulated(0, np.array([row.along])))[0]
        for t in (row.low, row.high):
            u1 = dist.normal_quantile(model.cumulated(1, np.array([t]), np.array([row.along])))[0]
            assert u0**2 + u1**2 == pytest.approx(r * r, rel=1e-3)
    best = contours.contour_maximum(spark, model, 50.0).first()
    assert best.hs == pytest.approx(model.quantile(0, np.array([1 - contours.chance(50, 1.0)]))[0], rel=1e-3)
    assert tuple(best) == pytest.approx(tuple(contours.greatest(model, 50.0)))
    by_period = contours.contour_table(spark, model, 50.0, along=1, values=[8.0], points=50_000, width=0.02).first()
    assert by_period.low < by_period.high


def test_densities(spark, model):
    x = np.linspace(0, 40, 40_001)
    assert np.trapezoid(model.density(0, x), x) == pytest.approx(1, abs=1e-3)
    given = np.full(len(x), 2.0)
    assert np.trapezoid(model.density(1, x, given), x) == pytest.approx(1, abs=1e-3)
    row = contours.isodensity_table(spark, model, points=[3.0], values=[3.0]).first()
    f = lambda t: model.joint_density(np.array([[3.0, t]]))[0]
    median = float(model.quantile(1, np.array([0.5]), np.array([3.0]))[0])
    assert row.high == pytest.approx(median, rel=5e-3) or row.low == pytest.approx(median, rel=5e-3)
    assert f(row.low) == pytest.approx(row.level, rel=0.02) and f(row.high) == pytest.approx(row.level, rel=0.02)
    hdc = contours.highest_density(spark, model, 0.01, 1.0, 300).toPandas()
    sample = contours.draws(spark, model, 100_000).toPandas()
    at = np.searchsorted(hdc.along, sample.hs).clip(0, len(hdc) - 1)
    inside = (sample.tp >= hdc.low.to_numpy()[at]) & (sample.tp <= hdc.high.to_numpy()[at])
    assert 1 - inside.mean() == pytest.approx(contours.chance(0.01, 1.0), abs=0.01)


def test_exceedance_contours(spark, model):
    sample = contours.draws(spark, model, 200_000, 5).toPandas()
    years = 1 / (0.01 * contours.HOURS)  # a chance of 1 %
    for kind in ("and", "or"):
        rows = contours.exceedance(spark, model, years, kind=kind, points=9, grid=800).toPandas()
        for r in rows.iloc[2:7].itertuples():
            a, b = sample.hs > r.hs, sample.tp > r.tp
            assert ((a & b) if kind == "and" else (a | b)).mean() == pytest.approx(0.01, abs=0.002) or (kind == "or" and a.mean() > 0.0095) or (kind == "and" and a.mean() < 0.0105)
    sampled = contours.direct_sampling(spark, model, years, n=200_000, points=24).toPandas()
    assert sampled.hs.max() == pytest.approx(np.quantile(sample.hs, 0.99), rel=0.1)


def test_contour_shapes():
    angle = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    circle = np.stack([3 + np.cos(angle), 5 + np.sin(angle)], 1)
    shuffled = circle[RNG.permutation(40)]
    loop = contours.ordered(shuffled)
    assert len(loop) == 41 and np.allclose(np.linalg.norm(np.diff(loop, axis=0), axis=1), 2 * np.sin(np.pi / 40))
    low, high = contours.sides(loop)
    assert low[:, 1].mean() < 5 < high[:, 1].mean() and (np.diff(low[:, 0]) >= 0).all()
    grid = contours.sphere_grid(5, 8, 1)
    assert np.allclose(np.linalg.norm(grid, axis=1), 1) and grid[0, 1] == 1
    assert np.allclose(np.linalg.norm(contours.sphere_random(4, 100), axis=1), 1)


@pytest.mark.parametrize("preset", ["omae2020", "lonowe", "hs_u", "ct_hs_tp", "u_hs_tp", "v_hs_tz"])
def test_presets_fit(spark, sea, preset):
    rows = sea.withColumns({"c": F.randn(3) * 0.4, "u": 6 * F.sqrt("hs") + 0.5 * F.rand(4)})
    names = {2: ["hs", "tp"], 3: ["c", "hs", "tp"] if preset == "ct_hs_tp" else ["u", "hs", "tp"]}[len(hierarchical.PRESETS[preset])]
    found = hierarchical.fit(rows, names, preset)
    assert len(found.parameter_rows()) >= 4 and len(hierarchical.semantics(preset)) == len(names)
    p = found.points(np.zeros((1, len(names))))[0]
    medians = rows.agg(*(F.percentile(n, 0.5) for n in names)).first()
    assert p == pytest.approx(list(medians), rel=0.25, abs=0.15)
    assert np.isfinite(found.joint_density(p[None, :])).all() and contours.dependent_given(spark, found, [1.0, 2.0]).count() == 2


def test_three_variables_in_a_slice(spark, sea):
    rows = sea.withColumn("u", 6 * F.sqrt("hs") + 0.5 * F.rand(4))
    found = hierarchical.fit(rows, ["u", "hs", "tp"], "u_hs_tp")
    table = contours.contour_table(spark, found, 10.0, slice_dim=0, slice_value=10.0).toPandas()
    assert len(table) and (table.low < table.high).all()
    with pytest.raises(ValueError):
        contours.contour_table(spark, found, 10.0)
    assert contours.isodensity_table(spark, found, points=[3.0], slice_value=10.0, step=1.0).count() > 0


def test_kendall_and_theil_sen():
    def plain_p(x, y):
        pairs = list(itertools.combinations(range(len(x)), 2))
        against = lambda v: sum((x[i] - x[j]) * (v[i] - v[j]) < 0 for i, j in pairs)
        few = min(against(y), len(pairs) - against(y))
        orders = list(itertools.permutations(y))
        return sum(min(against(o), len(pairs) - against(o)) <= few for o in orders) / len(orders)

    for _ in range(4):
        x, y = np.arange(6.0), RNG.permutation(6).astype(float)
        assert trend.kendall(x, y)[1] == pytest.approx(min(1.0, plain_p(x, y)))
    x = np.arange(60.0)
    y = 0.3 * x + RNG.standard_normal(60)
    slope, intercept, low, high = trend.theil_sen(x, y)
    assert low < slope < high and slope == pytest.approx(0.3, abs=0.05) and low < 0.3 < high
    assert trend.kendall(x, y)[1] < 1e-6 and trend.kendall(x, np.ones(60))[0] != trend.kendall(x, np.ones(60))[0]


def test_profiles():
    z, v = [10, 20, 50, 100], [1.0, 1.4, 1.9, 2.2]
    f = profile.spline(z, v)
    assert f(z) == pytest.approx(v) and f(10) - f(9) == pytest.approx(f(9) - f(8)) and f(14.999) == pytest.approx(float(f(15.001)), abs=1e-3)
    assert profile.scaled(f, z, 3.8, 50) == pytest.approx([2.0, 2.8, 3.8, 4.4])
    assert np.polyval(profile.polynomial(z, v, 9), z) == pytest.approx(v)
    assert profile.scaled(profile.polynomial(z, v), z, 2.2, 100) == pytest.approx(v)


def test_gaussian_filter(spark):
    e = RNG.random((7, 5))
    e[2, 3] = np.nan
    rows = [(i + 3, j, None if np.isnan(e[i, j]) else float(e[i, j])) for i in range(7) for j in range(5)]
    got = {(r.i, r.j): r.e for r in grids.gaussian_filter(spark.createDataFrame(rows, "i int, j int, e double"), "i", "j", "e", 1.5).collect()}
    r = 6
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / 1.5) ** 2)
    kernel /= kernel.sum()
    def smooth(a):
        for axis in (0, 1):
            padded = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], "symmetric")
            a = sum(w * np.take(padded, range(k, k + a.shape[axis]), axis) for k, w in enumerate(kernel))
        return a

    want = smooth(np.nan_to_num(e)) / smooth((~np.isnan(e)).astype(float))
    assert all(got[i + 3, j] == pytest.approx(want[i, j]) for i in range(7) for j in range(5))


def test_projections_and_depths(spark):
    one = spark.range(1)
    at = lambda c: one.select(*c).first()
    lon, lat = at(grids.from_rotated_pole(F.lit(0.0), F.lit(90.0), -140.0, 22.0))
    assert (lon, lat) == pytest.approx((-140.0, 22.0), abs=1e-6)
    assert at(grids.from_rotated_pole(F.lit(0.0), F.lit(0.0), -140.0, 22.0)) == pytest.approx((40.0, 68.0), abs=1e-6)
    assert at(grids.from_lambert(F.lit(0.0), F.lit(0.0), 15.0, 63.0, [63.0, 63.0])) == pytest.approx((15.0, 63.0))
    lon, lat = at(grids.from_lambert(F.lit(1e5), F.lit(2e5), 15.0, 63.0, [60.0, 66.0]))
    assert 16 < lon < 18 and 64 < lat < 66
    df = spark.createDataFrame([(1, 3.0, 4.0, None, 2.0)], "t long, u_0m double, v_0m double, `u_2.5m` double, `v_2.5m` double")
    assert grids.depth_names(df) == ["0m", "2.5m"]
    assert {r.level: r.value for r in grids.variable_by_depth(df, "t", "magnitude").collect()} == {0.0: 5.0, 2.5: 2.0}
    assert {r.level: r.value for r in grids.variable_by_depth(df, "t", "u").collect()} == {0.0: 3.0, 2.5: 0.0}


def test_spectra_functions(spark):
    f = [0.01 * i for i in range(1, 60)]
    rows = spark.createDataFrame([(4.0, t, x) for t in (6.0, 14.0) for x in f], "hs double, tp double, f double")
    got = rows.withColumn("s", physics.torsethaugen(F.col("f"), F.col("hs"), F.col("tp"))).toPandas()
    for _, part in got.groupby("tp"):
        assert 4 * math.sqrt(np.trapezoid(part.s, part.f)) == pytest.approx(4.0, rel=0.05)
    k = spark.range(1).select(physics.wave_number_rational(F.lit(9.0), 30.0).alias("a"), physics.wave_number(F.lit(9.0), 30.0).alias("b")).first()
    assert k.a == pytest.approx(k.b, rel=1e-3)
    e = RNG.random(24).tolist()
    df = spark.createDataFrame([(1, e)], "id int, e array<double>")
    same = spectra.interpolated(df, ["id"], "e", [0.1, 0.2, 0.3], [45.0 * d for d in range(8)], [0.1, 0.2, 0.3], [45.0 * d for d in range(8)]).first()
    assert same.e == pytest.approx(e)
    middle = spectra.interpolated(df, ["id"], "e", [0.1, 0.2, 0.3], [45.0 * d for d in range(8)], [0.15], [337.5]).first()
    assert middle.e[0] == pytest.approx((e[7] + e[0] + e[15] + e[8]) / 4)
    assert spectra.interpolated_line(df, ["id"], "e", 47).first().e[::2] == pytest.approx(e)
    cells = spectra.cells(spark.createDataFrame([(1, [1.0, -2.0, float("nan"), 0.0])], "id int, e array<double>"), ["id"], "e", 4)
    assert sorted(r.e for r in cells.collect()) == [0.0, 0.0, 0.0, 1.0]
    angle = spectra.mean_direction(cells, ["id"], [0.1], [0.0, 90.0, 180.0, 270.0]).first().angle
    assert angle == pytest.approx(math.pi / 2)  # from north is 90 degrees against the clock from east


def test_relational_helpers(spark):
    rows = spark.createDataFrame([(i, float(v), "x") for i, v in enumerate([1, 3, 3, 2, 5, 4, 4, 6])], "t long, v double, Wind_10m string")
    assert [r.t for r in relational.local_extrema(rows, "t", "v").orderBy("t").collect()] == [1, 4]
    assert [r.t for r in relational.local_extrema(rows, "t", "v", least=True).orderBy("t").collect()] == [3, 5]
    assert relational.columns_like(rows, contains="wind", keep=["t"]).columns == ["t", "Wind_10m"]
    assert relational.month_number("Feb") == relational.month_number("February") == 2
    total = relational.with_total(rows.select("Wind_10m", "v"), "Wind_10m", "all", {"v": F.max("v")})
    assert total.where("Wind_10m = 'all'").first().v == 6.0
    dated = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2020-01-01", "2020-06-01", "2021-01-01"]), "v": [1, 2, 3]}))
    assert relational.time_slice(dated, "ts", [2020]).count() == 2 and relational.time_slice(dated, "ts", ["2020-06-01", None]).count() == 2
    assert relational.time_slice(dated, "ts", ["2020-06-01"]).count() == 1 and relational.time_slice(dated, "ts", None).count() == 3
    with pytest.raises(ValueError):
        relational.time_slice(dated, "ts", ["2019-01-01", None])
    draws = relational.fitted_draws(spark.createDataFrame([(float(x),) for x in 2 * RNG.weibull(1.5, 3000)], "x double"), "x", 20_000).toPandas()
    assert draws.value.mean() == pytest.approx(2 * math.gamma(1 + 1 / 1.5), rel=0.05)
    shape, loc, scale = moments.weibull(*(lambda v: (v.mean(), v.var(), float(((v - v.mean()) ** 3).mean() / v.std() ** 3)))(draws.value.to_numpy()))
    assert shape == pytest.approx(1.5, abs=0.1)


def test_percentiles_by_brackets(spark):
    from tidemark.functions import series

    n = 30_000
    x = np.where(RNG.random(n) < 0.3, 2.5, np.round(RNG.lognormal(0, 2, n), 3))
    df = spark.createDataFrame(pd.DataFrame({"m": RNG.integers(0, 3, n), "x": x})).withColumn("m", F.when(F.col("m") > 0, F.col("m")).cast("int")).repartition(5)
    at = {"p1": 0.01, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    want = {r["m"] if r["g"] == 0 else "all": tuple(r["q"]) for r in df.groupingSets([["m"], []], "m").agg(F.grouping("m").alias("g"), F.percentile("x", list(at.values())).alias("q")).collect()}
    for accuracy in (500, 100_000):  # brackets of a part, and of whole groups
        got = series.by_brackets(df, [["m"], []], "x", at, 9, accuracy).collect()
        assert sorted(tuple(round(v, 6) for v in r[1:]) for r in got) == sorted(tuple(round(v, 6) for v in q) for q in want.values())
    stats = ("count", "mean", "5%", "median", "max")
    few = [sorted(map(str, series.grouped(df, [["m"], []], "x", stats, small=small).collect())) for small in (0, 1 << 40)]
    assert few[0] == few[1]


def test_sites_are_apart(spark):
    from tidemark.operators import extremes, joins, water, windows

    t = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(3000), "h")
    frames = [pd.DataFrame({"site": s, "ts": t, "x": np.cos(2 * np.pi * np.arange(3000) / 12.42) * a + RNG.random(3000)}) for s, a in (("a", 1.0), ("b", 3.0))]
    both = spark.createDataFrame(pd.concat(frames))
    for make in (lambda d, by: water.tide_type(d, "ts", "x", by=by), lambda d, by: windows.threshold_table(d, "ts", "x", (0.5, 1.5), (2, 6), 1.0, by), lambda d, by: extremes.threshold_sensitivity(d, "ts", "x", (1.0, 1.3), 10.0, by=by)):
        got = make(both, ["site"]).toPandas()
        for s in "ab":
            alone = make(both.where(F.col("site") == s), []).toPandas()
            own = got[got.site == s].drop(columns="site")
            by = list(alone.columns[:2])
            pd.testing.assert_frame_equal(own.sort_values(by).reset_index(drop=True), alone.sort_values(by).reset_index(drop=True))
    a = both.where("x > 0.9").select("site", "ts")
    b = both.where("x < -0.3")
    found = [sorted(map(str, joins.next_at_or_after(a, b, "ts", "x", "site", days).collect())) for days in (0.2, 3, 10_000)]
    assert found[0] == found[1] == found[2]


def test_sources_and_sinks(spark, tmp_path):
    from tidemark.sources import text

    rows = text.grid_rows(spark, {"t": [1, 2], "f": [0.1, 0.2, 0.3]}, {"e": np.arange(6).reshape(2, 3), "wind": [7.0, 8.0]})
    assert sorted(map(tuple, rows.collect())) == [(t, f, 3 * i + j, w) for i, (t, w) in enumerate(((1, 7.0), (2, 8.0))) for j, f in enumerate((0.1, 0.2, 0.3))]
    for comment in (None, "heights"):
        path = str(tmp_path / str(comment))
        text.write_csv(spark.createDataFrame([(1, 2.345, "a"), (2, None, "b")], "k int, x double, s string").coalesce(1), path, comment, "%.2f")
        lines = sorted(r.value for r in spark.read.text(path).collect())
        assert "1,2.35,a" in lines or "1,2.34,a" in lines


def test_more_formulas(spark, sea):
    m = lonowe.fit(sea, "ts", "hs", "tp", spread=False)[None]
    row = spark.range(1).select(*physics.period_given_height(F.lit(3.0), (m.a1, m.a2, m.a3), (m.b1, m.b2, m.b3)), physics.weibull_exceedance(F.lit(3.0), 1.5, 1.0, 2.0)).first()
    assert tuple(row)[:3] == pytest.approx([float(v[0]) for v in m.period_given(np.array([3.0]))]) and row[3] == pytest.approx(math.exp(-1))
    currents = crests.wave_induced_currents(sea, "ts", "hs", "tp", 10.0).toPandas()
    assert len(currents) == 10 and (currents.us_p5 <= currents.us_p95).all()
    assert lonowe.steepness_curve(sea, "ts", "hs", "tp", 100).agg(F.max("hs")).first()[0] <= m.return_height(100) + 0.5
    assert dist.fit_generalised_gamma(2 * RNG.gamma(2.0, 1, 30_000) ** (1 / 1.5))[1:] == pytest.approx((1.5, 2.0), rel=0.3)
    ranks, draws = relational.fitted_non_exceedance(sea, "hs", draws=1000)
    assert ranks.agg(F.max("rank")).first()[0] == 100.0 and draws.count() == 1000
    model = hierarchical.fit(sea, ["hs", "tp"], lambda: hierarchical.PRESETS["hs_tp"])
    assert model.parameter_rows() == hierarchical.fit(sea, ["hs", "tp"]).parameter_rows()
