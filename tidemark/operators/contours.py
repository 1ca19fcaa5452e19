"""Contours of joint models: their greatest points, tables along a variable, density levels, and exceedance contours.

Where the last variable is the free one its two values follow from the others in closed form: in standard normal space the
contour is a sphere, so the last coordinate is the root of what the others leave of the squared radius. Other tables are read off
points that spark.range() spreads, by their least and greatest value in thin slices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.distributions import normal_quantile
from tidemark.functions.series import clean, sector
from tidemark.operators import hierarchical
from tidemark.operators.hierarchical import JointModel, radius

HOURS = 365.25 * 24  # of a year, for the chance of a state


def chance(years: float, hours: float) -> float:
    """Chance that a state of `hours` exceeds a contour of the return period."""
    return hours / (years * HOURS)


def dependent_given(spark: SparkSession, model: JointModel, given: Sequence[float], percentile: float = 0.5, dim: int = 1) -> DataFrame:
    """given, value: a percentile (0 to 1) of variable dim for values of the variable that it depends on."""
    if not 0 < percentile < 1:
        raise ValueError("the percentile must be between 0 and 1")
    x = np.asarray(given, float)
    values = model.quantile(dim, np.full(len(x), percentile), x)
    return spark.createDataFrame(list(zip(x.tolist(), map(float, values))), "given double, value double")


def contour_maximum(spark: SparkSession, model: JointModel, years: float, hours: float = 1.0, dim: int = 0, points: int = 1000, method: str = "IFORM") -> DataFrame:
    """One row: the contour's point with the greatest value of variable dim."""
    found = hierarchical.contour(spark, model, years * HOURS / (365.2422 * 24), hours, points, method)
    best = F.max(F.struct(F.col(model.names[dim]).alias("_m"), -F.col("point"), F.struct(*model.names).alias("p")))
    return found.agg(best.alias("b")).select("b.p.*")


def greatest(model: JointModel, years: float, hours: float = 1.0, points: int = 1000) -> np.ndarray:
    """contour_maximum() of the first variable of a model of two, on the driver: for tables of a few dozen models."""
    angle = 2 * math.pi * np.arange(points) / points
    u = radius(chance(years, hours), 2) * np.stack([np.cos(angle), np.sin(angle)], 1)
    found = model.points(u)
    return found[int(np.argmax(found[:, 0]))]


def contour_table(spark: SparkSession, model: JointModel, years: float, hours: float = 1.0, values: Sequence[float] | None = None, step: float = 0.5, along: int | None = None, slice_dim: int = 0, slice_value: float | None = None, method: str = "IFORM", points: int = 100_000, width: float = 0.01, least: int = 10) -> DataFrame:
    """along (the variable's value), low, high: of the free variable on the contour, for a model of three in the slice of another variable.

    along is the variable before the last, unless given. Values are multiples of step within the contour, unless given; those
    outside the contour, or (read off points) with fewer than `least` points near them, have no row.
    """
    dims = len(model.names)
    along = dims - 2 if along is None else along
    free = [i for i in range(dims) if i != along and (dims == 2 or i != slice_dim)]
    if len(free) != 1 or (dims == 3 and (slice_value is None or slice_dim == along)):
        raise ValueError("a table needs one free variable")
    r = radius(chance(years, hours), dims, method)
    if free[0] == dims - 1:
        return _closed(spark, model, r, values, step, along, slice_dim, slice_value)
    found = hierarchical.contour(spark, model, years * HOURS / (365.2422 * 24), hours, points, method)
    if dims == 3:
        found = found.where(F.abs(F.col(model.names[slice_dim]) - slice_value) < width)
    x, y = F.col(model.names[along]), F.col(model.names[free[0]])
    if values is None:
        near = found.withColumn("v", F.round(x / step) * step)
    else:
        near = found.withColumn("v", F.explode(F.array(*(F.lit(float(v)) for v in values))))
    near = near.where(F.abs(x - F.col("v")) < width).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min(y).alias("low"), F.max(y).alias("high"))
    return near.where(F.col("n") >= least).select(F.col("v").alias("along"), "low", "high")


def _closed(spark, model: JointModel, r: float, values, step: float, along: int, slice_dim: int, slice_value: float | None) -> DataFrame:
    dims = len(model.names)
    ends = [0.0]
    if values is None:
        u = np.zeros((721, dims))
        angle = np.linspace(0, 2 * math.pi, 721)
        u[:, 0], u[:, 1] = r * np.cos(angle), r * np.sin(angle)
        reached = model.points(u)[:, along]
        values = np.arange(math.ceil(reached.min() / step) * step, reached.max(), step)
    v = np.asarray(values, float)
    known: dict[int, np.ndarray] = {along: v}
    if dims == 3:
        known[slice_dim] = np.full(len(v), float(slice_value))
    rest = np.full(len(v), r * r)
    for i in sorted(known):
        g = model.dimensions[i].given
        rest -= normal_quantile(model.cumulated(i, known[i], None if g is None else known[g])) ** 2
    on = rest > 0
    last, g = dims - 1, model.dimensions[dims - 1].given
    given = None if g is None else known[g][on]
    root = np.sqrt(rest[on])
    low, high = (model.quantile(last, hierarchical._normal_cdf(sign * root), given) for sign in (-1, 1))
    return spark.createDataFrame([tuple(map(float, t)) for t in zip(v[on], low, high)] or [], "along double, low double, high double") if on.any() else spark.createDataFrame([], "along double, low double, high double")


def isodensity_table(spark: SparkSession, model: JointModel, levels: Sequence[float] | None = None, points: Sequence[float] | None = None, values: Sequence[float] | None = None, step: float = 0.5, slice_value: float | None = None, grid: int = 720) -> DataFrame:
    """level, along, low, high: where the joint density has a level, along the variable before the last (for a model of three, at
    slice_value of the first). Levels are given, or taken at `points` of the variable and the median of the last there."""
    dims = len(model.names)
    if (levels is None) == (points is None):
        raise ValueError("give levels or points")
    if dims == 3 and slice_value is None:
        raise ValueError("a model of three variables needs a slice")
    along, last = dims - 2, dims - 1
    fixed = [] if dims == 2 else [np.array([float(slice_value)])]

    def density(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return model.joint_density(np.stack([*(np.full(len(x), f[0]) for f in fixed), x, y], 1))

    def of_last(p: float, x: np.ndarray) -> np.ndarray:
        g = model.dimensions[last].given
        return model.quantile(last, np.full(len(x), p), None if g is None else x if g == along else np.full(len(x), fixed[0][0]))

    if levels is None:
        x = np.asarray(points, float)
        levels = density(x, of_last(0.5, x)).tolist()
    g = model.dimensions[along].given
    spread = lambda p: float(model.quantile(along, np.array([p]), None if g is None else fixed[0])[0])
    if values is None:
        values = np.arange(math.ceil(spread(1e-12) / step) * step, spread(1 - 1e-12), step)
    rows = []
    for v in np.asarray(values, float):
        one = np.array([v])
        y = np.linspace(float(of_last(1e-12, one)[0]), float(of_last(1 - 1e-12, one)[0]), grid)
        f = density(np.full(grid, v), y)
        for level in levels:
            over = np.flatnonzero(f >= level)
            if len(over):
                a, b = over[0], over[-1]
                low = y[a] if a == 0 else np.interp(level, [f[a - 1], f[a]], [y[a - 1], y[a]])
                high = y[b] if b == grid - 1 else np.interp(-level, [-f[b], -f[b + 1]], [y[b], y[b + 1]])
                rows.append((float(level), float(v), float(low), float(high)))
    return spark.createDataFrame(rows, "level double, along double, low double, high double")


def highest_density(spark: SparkSession, model: JointModel, years: float, hours: float = 1.0, grid: int = 400) -> DataFrame:
    """along, low, high: the region of highest density that holds all but the contour's chance, for a model of two on a grid."""
    x, y, f = _grid(model, grid)
    cell = f * (x[1] - x[0]) * (y[1] - y[0])
    order = np.argsort(-cell.ravel())
    total = np.cumsum(cell.ravel()[order]) / cell.sum()
    level = cell.ravel()[order][min(len(order) - 1, int(np.searchsorted(total, 1 - chance(years, hours))))]
    rows = [(float(x[i]), float(y[at[0]]), float(y[at[-1]])) for i in range(len(x)) if len(at := np.flatnonzero(cell[i] >= level))]
    return spark.createDataFrame(rows, "along double, low double, high double")


def _grid(model: JointModel, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.array([1e-9, 1 - 1e-9])
    x = np.linspace(*model.quantile(0, ends), n)
    given = model.dimensions[1].given
    side = [model.quantile(1, np.full(n, p), None if given is None else x) for p in (1e-9, 1 - 1e-9)]
    y = np.linspace(float(min(side[0])), float(max(side[1])), n)
    points = np.stack([np.repeat(x, n), np.tile(y, n)], 1)
    return x, y, model.joint_density(points).reshape(n, n)


def exceedance(spark: SparkSession, model: JointModel, years: float, hours: float = 1.0, kind: str = "and", points: int = 100, grid: int = 1000) -> DataFrame:
    """x, y (named as the variables): places that both variables exceed together (kind 'and'), or that one or the other exceeds
    ('or'), with the contour's chance; for a model of two. Integrals over the first variable run on `grid` of its quantiles."""
    if kind not in ("and", "or"):
        raise ValueError(f"unknown kind {kind!r}")
    alpha = chance(years, hours)
    p = 1 - np.geomspace(1 - 1e-12, alpha * 1e-4, grid)
    u, dp = model.quantile(0, (p[1:] + p[:-1]) / 2), np.diff(p)  # the first variable by slices of its own chance
    given = None if model.dimensions[1].given is None else u
    top = 1 - alpha * (1 + 1e-6)
    xs = np.linspace(float(model.quantile(0, np.array([1e-4]))[0]), float(model.quantile(0, np.array([top]))[0]), points)
    low = np.full(points, float(np.min(model.quantile(1, np.full(len(u), 1e-9), given))))
    high = np.full(points, float(np.max(model.quantile(1, np.full(len(u), 1 - 1e-13), given))))
    for _ in range(45):
        mid = (low + high) / 2
        reached = np.array([(dp * np.where(u > x, 1.0 if kind == "or" else _over(model, y, u, given), _over(model, y, u, given) if kind == "or" else 0.0)).sum() for x, y in zip(xs, mid)])
        low, high = np.where(reached > alpha, mid, low), np.where(reached > alpha, high, mid)
    rows = [(float(a), float(b)) for a, b in zip(xs, (low + high) / 2)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in model.names))


def _over(model: JointModel, y: float, u: np.ndarray, given: np.ndarray | None) -> np.ndarray:
    return 1 - model.cumulated(1, np.full(len(u), y), given)


def draws(spark: SparkSession, model: JointModel, n: int, seed: int = 1) -> DataFrame:
    """n draws of the variables; each task makes its own from spark.range()."""
    dims = len(model.names)

    def run(batches):
        import pandas as pd

        for batch in batches:
            u = batch[[f"u{i}" for i in range(dims)]].to_numpy(float)
            yield pd.DataFrame(model.points(u), columns=list(model.names))

    normal = spark.range(n).select(*(F.randn(seed + i).alias(f"u{i}") for i in range(dims)))
    return normal.mapInPandas(run, ", ".join(f"{n} double" for n in model.names))


def direct_sampling(spark: SparkSession, model: JointModel, years: float, hours: float = 1.0, n: int = 1_000_000, points: int = 72, seed: int = 1) -> DataFrame:
    """point and the two variables: corners of the lines that the draws exceed in each direction with the contour's chance. One
    aggregation finds the quantiles of all directions."""
    found = draws(spark, model, n, seed)
    x, y = (F.col(c) for c in model.names)
    angle = [2 * math.pi * i / points for i in range(points)]
    row = found.agg(*(F.percentile_approx(x * math.cos(t) + y * math.sin(t), 1 - chance(years, hours), 100_000).alias(f"r{i}") for i, t in enumerate(angle))).first()
    rows = []
    for i, t in enumerate(angle):
        j = (i + 1) % points
        s, a, b = angle[j], row[i], row[j]
        d = math.sin(s - t)
        rows.append((i, (a * math.sin(s) - b * math.sin(t)) / d, (b * math.cos(t) - a * math.cos(s)) / d))
    return spark.createDataFrame(rows, f"point int, {model.names[0]} double, {model.names[1]} double")


def sphere_grid(poles: int, around: int, dim: int = 2) -> np.ndarray:
    """Points of the unit sphere on circles about the axis `dim`: an array of poles * around rows."""
    phi, theta = (a.ravel() for a in np.meshgrid(np.linspace(0, math.pi, poles), np.linspace(0, 2 * math.pi, around), indexing="ij"))
    out = np.empty((poles * around, 3))
    others = [i for i in range(3) if i != dim]
    out[:, dim], out[:, others[0]], out[:, others[1]] = np.cos(phi), np.sin(phi) * np.cos(theta), np.sin(phi) * np.sin(theta)
    return out


def sphere_random(dims: int, n: int, seed: int = 43) -> np.ndarray:
    """Evenly spread random points of the unit sphere."""
    x = np.random.default_rng(seed).standard_normal((n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def ordered(points: np.ndarray) -> np.ndarray:
    """Points of a closed contour one after the other, each next to the nearest one left, the first again at the end."""
    left, out = list(range(1, len(points))), [0]
    while left:
        distance = ((points[left] - points[out[-1]]) ** 2).sum(axis=1)
        out.append(left.pop(int(distance.argmin())))
    return points[[*out, 0]]


def sides(points: np.ndarray, split: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of an ordered contour between its lowest and highest point in the other coordinate, that with the lesser
    mean of coordinate `split` first, each from low to high."""
    by = 1 - split
    closed = points[:-1] if len(points) > 1 and np.array_equal(points[0], points[-1]) else points
    turned = np.roll(closed, -int(closed[:, by].argmin()), axis=0)
    top = int(turned[:, by].argmax())
    halves = [turned[: top + 1], np.concatenate([turned[top:], turned[:1]])]
    halves.sort(key=lambda h: float(h[:, split].mean()))
    return tuple(h[np.argsort(h[:, by], kind="stable")] for h in halves)


def _models(df: DataFrame, names: list[str], model: str, key: Column, count: range) -> tuple[dict, dict, int]:
    """Models of groups (and of all rows under None; None where one can't be fitted), rows of groups, and of all."""
    df = clean(df.withColumn("_g", key.cast("int")), *names)
    rows = {r["_g"]: r["n"] for r in df.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a group

    def fitted(part: DataFrame) -> JointModel | None:
        try:
            return hierarchical.fit(part, names, model)
        except (ValueError, ZeroDivisionError, TypeError, np.linalg.LinAlgError):  # too few rows in the group
            return None

    return {None: fitted(df)} | {g: fitted(df.where(F.col("_g") == g)) for g in count if g in rows}, rows, sum(rows.values())


def monthly_return_values(df: DataFrame, ts: str, names: list[str], periods: Sequence[float] = (1, 10, 100, 10000), model: str = "hs_tp") -> DataFrame:
    """month (null: the year), period and the variables at the contour's greatest height; a month's period is its share of the year."""
    models, _, _ = _models(df, names, model, F.month(ts), range(1, 13))
    days = (31, 28.2425, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    rows = []
    for g in (*range(1, 13), None):
        m = models.get(g)
        for t in periods:
            at = greatest(m, t * (1 if g is None else days[g - 1] / 365.25)) if m else [None, None]
            rows.append((g, float(t), *(None if v is None else float(v) for v in at)))
    return df.sparkSession.createDataFrame(rows, f"month int, period double, {names[0]} double, {names[1]} double")


def directional_return_values(df: DataFrame, names: list[str], direction: str, periods: Sequence[float] = (1, 10, 100, 10000), model: str = "hs_tp", norsok: bool = False, sectors: int = 12, capped: bool = True, by_share: bool = True) -> DataFrame:
    """sector (null: all rows), share, period and the variables at the contour's greatest height. A sector's period is its share of
    the rows (or an equal one) of the period, by NORSOK times half the sectors; capped: values don't exceed those of all rows."""
    models, n, total = _models(df, names, model, sector(F.col(direction), sectors), range(sectors))
    top = {t: greatest(models[None], t) if models[None] else None for t in periods}
    rows = []
    for g in (*range(sectors), None):
        m, share = models.get(g), 1.0 if g is None else n.get(g, 0) / total if total else 0.0
        for t in periods:
            factor = 1.0 if g is None else (share if by_share else 1 / sectors) * (sectors / 2 if norsok else 1)
            at = greatest(m, t * factor) if m and t * factor * HOURS > 1 else None
            if at is not None and capped and top[t] is not None:
                at = np.minimum(at, top[t])
            rows.append((g, round(100 * share, 6), float(t), *((None, None) if at is None else map(float, at))))
    return df.sparkSession.createDataFrame(rows, f"sector int, share double, period double, {names[0]} double, {names[1]} double")


def group_parameters(df: DataFrame, names: list[str], key: Column, groups: range, model: str = "hs_tp") -> DataFrame:
    """group (null: all rows), variable, parameter, form, place, value of the model of each group that can be fitted."""
    models, _, _ = _models(df, names, model, key, groups)
    rows = [(g, *r) for g, m in models.items() if m for r in m.parameter_rows()]
    return df.sparkSession.createDataFrame(rows, "group int, variable string, parameter string, form string, place int, value double")
