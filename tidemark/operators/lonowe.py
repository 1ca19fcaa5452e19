"""Wave height and period by a lognormal body with a Weibull tail, and a lognormal period given the height.

One pass of moments and one of interval sums reach the driver (some tens of rows a group, however long the series); what
follows is closed form. A contour is the line of constant joint density through the most likely period at the height of
the return period: with the period's logarithm normal, the two periods at a height solve a quadratic equation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import moments
from tidemark.functions.corrections import spread_period, steepness_limit
from tidemark.functions.series import clean, sector

YEAR_HOURS, ONE_YEAR = 365.2422 * 24, 1.5873
#: Fixed values of the model: exponent of the mean, floor of the variance, limits of the height's mean logarithm.
A3, B1, LOG_LIMITS = 0.36, 0.005, (0.0, 5.0)
#: Width of the height's intervals by its greatest value (fixed values), and rows that an interval must exceed.
WIDTHS, LEAST = ((2.0, 0.05), (3.0, 0.1), (4.0, 0.2), (10.0, 0.5), (math.inf, 1.0)), 15
GRID = 1500


@dataclass(frozen=True)
class LoNoWe:
    """A fitted group: body (mu, sigma, location), tail (shape, location, scale), cut, period coefficients, hours a row."""

    body: tuple[float, float, float]
    tail: tuple[float, float, float]
    low: float
    high: float
    top: float
    a1: float
    a2: float
    b2: float
    b3: float
    hours: float
    rows: int
    a3: float = A3
    b1: float = B1

    def grid(self) -> np.ndarray:
        return np.linspace(0.01, math.ceil(self.top * math.sqrt(math.pi)), GRID)

    def body_density(self, h: np.ndarray) -> np.ndarray:
        mu, sigma, loc = self.body
        x = np.maximum(h - loc, 1e-12)
        return np.where(h > loc, np.exp(-((np.log(x) - mu) ** 2) / (2 * sigma**2)) / (math.sqrt(2 * math.pi) * sigma * x), 0.0)

    def tail_density(self, h: np.ndarray) -> np.ndarray:
        c, loc, scale = self.tail
        z = np.maximum((h - loc) / scale, 1e-12)
        return np.where(h > loc, c / scale * z ** (c - 1) * np.exp(-(z**c)), 0.0)

    def cut(self) -> float:
        """Where the tail takes over: of the places between P60 and P99 where the densities come nearest the second, else the
        first, else the nearest of all."""
        h = self.grid()
        first, last = (int(np.flatnonzero(np.abs(h - v) < 0.1).max(initial=int(np.abs(h - v).argmin()))) for v in (self.low, self.high))
        part = h[first : max(last, first + 1)]
        off = np.abs(self.body_density(part) - self.tail_density(part))
        dips = np.flatnonzero((off[1:-1] < off[:-2]) & (off[1:-1] < off[2:])) + 1
        return float(part[dips[1] if len(dips) > 1 else dips[0] if len(dips) else off.argmin()])

    def density(self, h: np.ndarray | None = None) -> np.ndarray:
        """Of the height, on grid() smoothed by 20 points within 0.5 of the cut; at other heights as they are."""
        at, own = self.cut(), self.grid() if h is None else h
        found = np.where(own < at, self.body_density(own), self.tail_density(own))
        if h is None:
            for i in np.flatnonzero(np.abs(own - at) < 0.5):  # each mean sees those before it
                found[i] = found[max(0, i - 10) : i + 10].mean()
        return found

    def period_log(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of the period's logarithm."""
        return self.a1 + self.a2 * h**self.a3, np.maximum(self.b1 + self.b2 * np.exp(-self.b3 * h), 1e-9)

    def period_given(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Period at 5 %, in the mean and at 95 %: the mean less and plus 1.645 deviations."""
        mu, var = self.period_log(np.asarray(h, float))
        mean = np.exp(mu + var / 2)
        std = mean * np.sqrt(np.expm1(var))
        return mean - 1.645 * std, mean, mean + 1.645 * std

    def period_quantile(self, h: np.ndarray, p: float) -> np.ndarray:
        from tidemark.functions.distributions import normal_quantile

        mu, var = self.period_log(np.asarray(h, float))
        return np.exp(mu + np.sqrt(var) * normal_quantile(np.array([p]))[0])

    def return_height(self, years: float) -> float:
        """Height of the return period under the tail's distribution; one year stands for 1.5873."""
        c, loc, scale = self.tail
        n = (ONE_YEAR if years == 1 else years) * YEAR_HOURS / self.hours
        return loc + scale * math.log(n) ** (1 / c) if n > 1 else math.nan

    def contour(self, years: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Heights of the grid on the contour and the lower and upper period there."""
        h, f = self.grid(), self.density()
        k = int(np.abs(h - self.return_height(years)).argmin()) if not math.isnan(self.return_height(years)) else 0
        mu, var = self.period_log(h)
        log_peak = -mu[k] + var[k] / 2 - 0.5 * math.log(2 * math.pi * var[k])  # at the mode exp(mu - var)
        with np.errstate(all="ignore"):
            log_c = math.log(max(f[k], 1e-300)) + log_peak - np.log(f)  # the period's density that is needed at each height
            inside = var - 2 * mu - 2 * (log_c + 0.5 * np.log(2 * math.pi * var))
        on = np.flatnonzero((inside > 0) & (f > 0))
        root = np.sqrt(var[on] * inside[on])
        return h[on], np.exp(mu[on] - var[on] - root), np.exp(mu[on] - var[on] + root)

    def highest(self, years: float) -> tuple[float, float]:
        """The greatest height of the contour and the upper period there."""
        h, _, high = self.contour(years)
        return (float(h[-1]), float(high[-1])) if len(h) else (math.nan, math.nan)


def _width(top: float) -> float:
    return next(w for most, w in WIDTHS if top < most)


def corrected(period: Column, ts: str) -> Column:
    """The period with its classes spread out, by noise that the time stamp fixes."""
    return spread_period(period, F.pmod(F.xxhash64(F.col(ts)), F.lit(1_000_003)) / 1_000_003 - 0.5)


def fit(df: DataFrame, ts: str, hs: str, tp: str, key: Column | None = None, least_rows: int = 50, spread: bool = True) -> dict[int | None, LoNoWe | None]:
    """The model of each group of `key` (an integer; a handful of groups) and, under None, of all rows; None where it can't be fitted."""
    df = clean(df, hs, tp).where(F.col(hs).isNotNull() & F.col(tp).isNotNull() & (F.col(hs) > 0) & (F.col(tp) > 0))
    df = df.select((F.lit(None).cast("int") if key is None else key.cast("int")).alias("g"), F.col(ts).alias("t"), F.col(hs).alias("h"), (corrected(F.col(tp), ts) if spread else F.col(tp)).alias("p"))
    seconds, h, logs = F.unix_timestamp(F.col("t").cast("timestamp")), F.col("h"), F.log("h")
    aggs = [
        F.count(F.lit(1)).alias("n"), (F.floor((F.max(seconds) - F.min(seconds)) / 86400) + 1).alias("days"), F.avg(logs).alias("mu"), F.stddev_pop(logs).alias("sigma"), F.avg(h).alias("mean"),
        F.var_pop(h).alias("var"), F.skewness(h).alias("skew"), F.min(h).alias("least"), F.max(h).alias("top"), F.percentile(h, [0.6, 0.99]).alias("q"),
    ]
    whole = df.agg(*aggs).withColumn("g", F.lit(None).cast("int"))
    rows = whole.collect() + (df.where("g is not null").groupBy("g").agg(*aggs).select(*whole.columns).collect() if key is not None else [])
    widths = {r["g"]: _width(r["top"]) for r in rows if r["top"] is not None}
    if not widths:
        return {None: None}
    width = F.create_map(*(x for g, w in widths.items() if g is not None for x in (F.lit(g), F.lit(w)))) if len(widths) > 1 else None
    sums = [F.count(F.lit(1)).alias("n"), F.avg("h").alias("h"), F.avg(F.log("p")).alias("mu"), F.var_pop(F.log("p")).alias("var")]
    bins = df.groupBy(F.floor(h / widths[None]).alias("k")).agg(*sums).withColumn("g", F.lit(None).cast("int"))
    if width is not None:
        bins = bins.unionByName(df.where("g is not null").groupBy("g", F.floor(h / width[F.col("g")]).alias("k")).agg(*sums))
    intervals: dict = {}
    for b in bins.where(F.col("n") > LEAST).orderBy("k").collect():  # at most some hundred a group
        intervals.setdefault(b["g"], []).append(b)
    return {r["g"]: _fitted(r, intervals.get(r["g"], []), least_rows) for r in rows}


def _fitted(r, bins: list, least_rows: int) -> LoNoWe | None:
    if r["n"] < least_rows or len(bins) < 4 or not r["var"] or not r["sigma"]:
        return None
    tail = moments.weibull(r["mean"] + 1e-4, r["var"], r["skew"])
    body = (r["mu"], r["sigma"], 0.0)
    if not LOG_LIMITS[0] < r["mu"] < LOG_LIMITS[1]:
        body = moments.lognormal(r["mean"], r["var"], r["skew"])
    x, n = np.array([b["h"] for b in bins]), np.array([b["mu"] for b in bins])
    a2, a1 = np.polyfit(x**A3, n, 1)
    var = np.array([b["var"] for b in bins])
    b2, b3 = moments.curve(lambda h, p, q: B1 + p * np.exp(-q * h), x[1:], var[1:], [0.1, 0.3])
    return LoNoWe(body, tail, r["q"][0], r["q"][1], r["top"], float(a1), float(a2), float(b2), float(b3), r["days"] * 24 / r["n"], int(r["n"]))


def _key(ts: str, direction: str | None, sectors: int) -> tuple[Column, str, int, int]:
    """Group column, its name, first group and number of groups."""
    return (F.month(ts), "month", 1, 12) if direction is None else (sector(F.col(direction), sectors), "sector", 0, sectors)


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    plain = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    return spark.createDataFrame(plain, schema)


def parameters(df: DataFrame, ts: str, hs: str, tp: str, direction: str | None = None, sectors: int = 12) -> DataFrame:
    """month (or sector; null for all rows), a1, a2, a3, b1, b2, b3; null where a group can't be fitted."""
    key, name, first, count = _key(ts, direction, sectors)
    found = fit(df, ts, hs, tp, key)
    rows = [(g, *((m.a1, m.a2, m.a3, m.b1, m.b2, m.b3) if (m := found.get(g)) else [None] * 6)) for g in (*range(first, first + count), None)]
    return _frame(df.sparkSession, rows, f"{name} int, a1 double, a2 double, a3 double, b1 double, b2 double, b3 double")


def return_values(df: DataFrame, ts: str, hs: str, tp: str, periods: Sequence[float] = (1, 10, 100, 10000), direction: str | None = None, norsok: bool = True, least_rows: int = 160) -> DataFrame:
    """month (or sector), share of rows, period, hs, tp: the contour's highest point. Sectors of least_rows rows or fewer have nulls
    and, with NORSOK, periods six times as long; neither height nor period of a sector exceeds that of all rows."""
    key, name, first, count = _key(ts, direction, 12)
    found = fit(df, ts, hs, tp, key)
    total = found[None].rows if found[None] else 0
    rows = []
    for t in periods:
        top = found[None].highest(t) if found[None] else (math.nan, math.nan)
        for g in range(first, first + count):
            m = found.get(g)
            share = round(100 / 12, 2) if direction is None else round(100 * m.rows / total, 2) if m else 0.0
            at = (math.nan, math.nan)
            if m and (direction is None or m.rows > least_rows):
                at = m.highest(t * (6 if direction is not None and norsok else 1))
                at = at if direction is None else tuple(map(min, at, top))
            rows.append((g, share, float(t), *(round(v, 2) for v in at)))
        rows.append((None, 100.0, float(t), *(round(v, 2) for v in top)))
    return _frame(df.sparkSession, rows, f"{name} int, share double, period double, hs double, tp double")


def low_and_high_periods(df: DataFrame, ts: str, hs: str, tp: str, periods: Sequence[float] = (1, 10, 100, 10000), steps: int = 10) -> DataFrame:
    """period, step, hs, tp_low, tp_high: the contour at its greatest height and at heights down from it by 1 m a step."""
    model, rows = fit(df, ts, hs, tp)[None], []
    for t in periods if model else ():
        h, low, high = model.contour(t)
        for j in range(steps if len(h) else 0):
            k = int(np.abs(h - (round(float(h[-1]), 1) - j)).argmin())
            rows.append((float(t), j, *(round(float(v), 1) for v in (h[k], low[k], high[k]))))
    return _frame(df.sparkSession, rows, "period double, step int, hs double, tp_low double, tp_high double")


def contour_points(df: DataFrame, ts: str, hs: str, tp: str, periods: Sequence[float] = (1, 10, 100, 10000)) -> DataFrame:
    """period, hs, tp_low, tp_high along each contour."""
    model = fit(df, ts, hs, tp)[None]
    rows = [(float(t), *map(float, p)) for t in periods for p in zip(*model.contour(t))] if model else []
    return _frame(df.sparkSession, rows, "period double, hs double, tp_low double, tp_high double")


def period_given_height(df: DataFrame, ts: str, hs: str, tp: str, width: float | None = None, top: float | None = None, least: int = 10) -> DataFrame:
    """Classes [a, b) of the height from width / 2 up: n, observed 5 %, mean and 95 % of the period (null for `least` rows or fewer),
    and the model's at the class's middle. The width is a twentieth of the greatest height, unless given."""
    model = fit(df, ts, hs, tp)[None]
    df = clean(df, hs, tp).where(F.col(hs).isNotNull() & F.col(tp).isNotNull())
    top = float(math.ceil(df.agg(F.max(hs)).first()[0] or 1)) if top is None else top
    width = top / 20 if width is None else width
    count = max(1, len(np.arange(width / 2, top + width, width)) - 1)
    k = F.floor((F.col(hs) - width / 2) / width).cast("int")
    found = df.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.percentile(tp, 0.05).alias("p5"), F.avg(tp).alias("mean"), F.percentile(tp, 0.95).alias("p95"))
    centres = [(i + 1) * width for i in range(count)]
    at = zip(*(v.tolist() for v in model.period_given(np.array(centres)))) if model else [(None,) * 3] * count
    spine = df.sparkSession.createDataFrame([(i, c, *v) for i, (c, v) in enumerate(zip(centres, at))], "k int, centre double, p5_model double, mean_model double, p95_model double")
    enough = [F.when(F.col("n") > least, F.round(c, 6)).alias(c) for c in ("p5", "mean", "p95")]
    return spine.join(F.broadcast(found), "k", "left").select("k", "centre", F.coalesce("n", F.lit(0)).alias("n"), *enough, "p5_model", "mean_model", "p95_model")


def period_at_return_height(df: DataFrame, ts: str, hs: str, tp: str, periods: Sequence[float] = (1, 10, 1000, 10000)) -> DataFrame:
    """period, hs, p5, mean, p95: the model's period at each contour's greatest height."""
    model, rows = fit(df, ts, hs, tp)[None], []
    for t in periods if model else ():
        h = round(model.highest(t)[0], 2)
        rows.append((float(t), h, *(float(v) for v in model.period_given(np.array(h)))))
    return _frame(df.sparkSession, rows, "period double, hs double, p5 double, mean double, p95 double")


def percentile_curve(df: DataFrame, ts: str, hs: str, tp: str, percentile: float, years: float) -> DataFrame:
    """hs, tp: a percentile of the period given the height, up to the height of the return period."""
    model = fit(df, ts, hs, tp)[None]
    h = model.grid()[model.grid() < model.return_height(years)] if model else np.empty(0)
    rows = list(zip(map(float, h), map(float, model.period_quantile(h, percentile / 100)))) if len(h) else []
    return _frame(df.sparkSession, rows, "hs double, tp double")


def steepness_curve(df: DataFrame, ts: str, hs: str, tp: str, years: float, points: int = 2000, longest: float = 40.0) -> DataFrame:
    """tp, hs: the greatest height at each period by the steepness limit, up to the height of the return period."""
    model = fit(df, ts, hs, tp)[None]
    t = F.lit(0.01) + F.col("id") * F.lit((longest - 0.01) / (points - 1))
    rows = df.sparkSession.range(points).select(t.alias("tp")).withColumn("hs", steepness_limit(F.col("tp"), g=9.80665))
    return rows.where(F.col("hs") <= F.lit(model.return_height(years) if model else math.nan))
