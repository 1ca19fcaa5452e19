"""Directional wave spectra: arrays of energy, frequency-major, as a row a cell; integrals are sums with a rule's weights."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import quadrature


def _at(values: Sequence[float], k: Column) -> Column:
    """values[k] as a column; the list has one number an axis point."""
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), k + 1)


def cells(df: DataFrame, key: list[str], spectrum: str, directions: int) -> DataFrame:
    """key, f, d (indices), e (negative energy counts as none): a row a cell."""
    exploded = df.select(*key, F.posexplode(spectrum).alias("k", "e"))
    e = F.greatest(F.coalesce(F.nanvl(F.col("e").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return exploded.select(*key, F.floor(F.col("k") / directions).cast("int").alias("f"), (F.col("k") % directions).alias("d"), e.alias("e"))


def one_dimensional(found: DataFrame, key: list[str], directions: Sequence[float], digits: int | None = 6) -> DataFrame:
    """Integrated over directions (radians, or any other unit) by trapezoids, not across the gap from the last to the first."""
    e = F.sum(F.col("e") * _at(quadrature.trapezoid(directions), F.col("d")))
    return found.groupBy(*key, "f").agg((e if digits is None else F.round(e, digits)).alias("e"))


def mean_spectrum(found: DataFrame, by: list[str], directions: Sequence[float]) -> DataFrame:
    """Mean one-dimensional spectrum of each group, and over all (null)."""
    e = F.col("e") * _at(quadrature.trapezoid(directions), F.col("d"))
    sums = found.groupingSets([[*map(F.col, by), F.col("f")], [F.col("f")]], *map(F.col, by), F.col("f")).agg(F.sum(e).alias("s"), F.sum(F.when(F.col("d") == 0, 1).otherwise(0)).alias("n"))
    return sums.select(*by, "f", F.round(F.col("s") / F.col("n"), 6).alias("e"))


def parameters(found: DataFrame, key: list[str], frequencies: Sequence[float], degrees: Sequence[float]) -> DataFrame:
    """hm0 and tm01 (Simpson's rule on both axes), mean direction, peak frequency and peak direction (of the first greatest cell).

    degrees: compass directions in ascending order; the mean direction weighs cells by half the distance of their neighbours.
    """
    radians = [math.radians(d) for d in degrees]
    f, d, e = F.col("f"), F.col("d"), F.col("e")
    area = _at(quadrature.simpson(frequencies), f) * _at(quadrature.simpson(radians), d)
    m0, m1 = F.sum(e * area), F.sum(e * area * _at(frequencies, f))
    cell = e * _at(quadrature.widths(frequencies), f) * _at(quadrature.widths(radians), d)
    direction = F.pmod(F.degrees(F.atan2(F.sum(cell * _at([math.sin(r) for r in radians], d)), F.sum(cell * _at([math.cos(r) for r in radians], d)))), F.lit(360.0))
    peak = F.max(F.struct(e.alias("e"), (-f).alias("f"), (-d).alias("d")))
    out = found.groupBy(*key).agg((4 * F.sqrt(F.greatest(m0, F.lit(0.0)))).alias("hm0"), F.try_divide(m0, m1).alias("tm01"), direction.alias("dir"), peak.alias("p"))
    return out.select(*key, *(F.round(c, 5).alias(c) for c in ("hm0", "tm01", "dir")), F.round(_at(frequencies, -F.col("p.f")), 6).alias("fp"), F.round(_at(degrees, -F.col("p.d")), 6).alias("pdir"))


def mean_direction(found: DataFrame, key: list[str], frequencies: Sequence[float], degrees: Sequence[float], of_peaks: bool = False) -> DataFrame:
    """key, angle: mean direction in radians, counted from east against the clock; of_peaks: that of the direction with most energy."""
    turned = [math.radians((450 - d) % 360) for d in degrees]
    if of_peaks:
        lines = found.groupBy(*key, "d").agg(F.sum(F.col("e") * _at(quadrature.trapezoid(frequencies), F.col("f"))).alias("s"))
        best = lines.groupBy(*key).agg(F.max(F.struct("s", (-F.col("d")).alias("d"))).alias("b"))
        return best.select(*key, F.atan2(_at([math.sin(t) for t in turned], -F.col("b.d")), _at([math.cos(t) for t in turned], -F.col("b.d"))).alias("angle"))
    cell = F.col("e") * _at(quadrature.widths(frequencies), F.col("f")) * _at(quadrature.widths([math.radians(d) for d in degrees]), F.col("d"))
    sine, cosine = (F.sum(cell * _at([g(t) for t in turned], F.col("d"))) for g in (math.sin, math.cos))
    return found.groupBy(*key).agg(F.atan2(sine, cosine).alias("angle"))


def highest(params: DataFrame, key: str, by: list[str], k: int = 3) -> DataFrame:
    """The k spectra of each group with the greatest hm0."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("hm0").desc(), key))
    return params.withColumn("rank", rank).where(F.col("rank") <= k)


METHODS = ("mean", "top_1_percent_mean", "hm0_max", "hm0_top3_mean", "hm0_threshold")


def chosen(heights: DataFrame, key: str, by: list[str], method: str, least: float = 1.0) -> DataFrame:
    """The rows of heights (key, by, hm0; a row a spectrum) that a method aggregates, by group; ties of the top ones by key."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "mean":
        return heights
    if method == "hm0_threshold":
        return heights.where(F.col("hm0") > least)
    if method == "top_1_percent_mean":
        limit = heights.groupBy(*by).agg(F.percentile("hm0", 0.99).alias("_p99"))
        joined = heights.join(F.broadcast(limit), by) if by else heights.crossJoin(F.broadcast(limit))
        return joined.where(F.col("hm0") >= F.col("_p99")).drop("_p99")
    return highest(heights, key, by, 1 if method == "hm0_max" else 3).drop("rank")


def aggregate(found: DataFrame, heights: DataFrame, key: str, method: str = "mean", least: float = 1.0) -> DataFrame:
    """f, d, e: the mean over the spectra that the method chooses. found: cells() by key; heights: key, hm0."""
    rows = found if method == "mean" else found.join(chosen(heights, key, [], method, least).select(key), key, "left_semi")
    return rows.groupBy("f", "d").agg(F.round(F.avg("e"), 6).alias("e"))


def period_table(lines: DataFrame, ts: str, key: str, method: str = "mean", month: int | None = None, average_over: str = "month") -> DataFrame:
    """month (or, for one month, year; null for the average), f, e, hm0: one-dimensional spectra aggregated by calendar month, or by
    year for the rows of one month. lines: key, ts, hm0, f, e. The average is that of the rows above, or (average_over
    'whole_dataset') the aggregate of all spectra."""
    name = "month" if month is None else "year"
    rows = lines.withColumn(name, F.month(ts) if month is None else F.year(ts))
    part = rows if month is None else rows.where(F.month(ts) == month)

    def made(rows: DataFrame, by: list[str]) -> DataFrame:
        heights = rows.select(key, *by, "hm0").distinct()
        kept = chosen(heights, key, by, method)
        own = rows.join(kept.select(key, *by), [key, *by], "left_semi") if method != "mean" else rows
        spectra = own.groupBy(*by, "f").agg(F.avg("e").alias("e"))
        means = kept.groupBy(*by).agg(F.avg("hm0").alias("hm0"))
        return spectra.join(F.broadcast(means), by) if by else spectra.crossJoin(F.broadcast(means))

    each = made(part, [name])
    whole = made(lines, []) if average_over == "whole_dataset" else each.groupBy("f").agg(F.avg("e").alias("e"), F.avg("hm0").alias("hm0"))
    out = each.unionByName(whole.withColumn(name, F.lit(None).cast("int")))
    return out.select(name, "f", F.round("e", 5).alias("e"), F.round("hm0", 4).alias("hm0"))


def wind_sea_and_swell(found: DataFrame, key: list[str], speed: str, direction: str, frequencies: Sequence[float], degrees: Sequence[float], beta: float = 1.3, towards: bool = False) -> DataFrame:
    """Height, peak frequency, period and direction and mean direction of the cells that the wind can feed (wind sea) and of the
    others (swell), a row a key.

    A cell is wind sea if beta * speed / phase speed * cos(angle to the wind) exceeds 1; phase speed is that of deep water.
    found: cells() with the wind's columns among the keys; towards: the wind's direction is where it blows to. Integrals are
    trapezoids. A part without energy has height 0 and nulls else.
    """
    f, d, e = F.col("f"), F.col("d"), F.col("e")
    radians = [math.radians(x) for x in degrees]
    angle = F.radians(_at(degrees, d) - F.col(direction) - (180 if towards else 0))
    sea = beta * F.col(speed) * _at(frequencies, f) * (2 * math.pi / 9.81) * F.cos(angle) > 1
    wf, wd = _at(quadrature.trapezoid(frequencies), f), _at(quadrature.trapezoid(radians), d)
    gf, gd = _at(quadrature.widths(frequencies), f), _at(quadrature.widths(radians), d)
    split = found.withColumns({"sea": F.when(sea, e).otherwise(0.0), "swell": F.when(sea, 0.0).otherwise(e)})
    names, out = ("sea", "swell"), None
    by_f = split.groupBy(*key, "f").agg(*(F.sum(F.col(n) * wd).alias(n) for n in names))
    by_d = split.groupBy(*key, "d").agg(*(F.sum(F.col(n) * wf).alias(n) for n in names))
    heights = by_f.groupBy(*key).agg(*(x for n in names for x in (
        (4 * F.sqrt(F.sum(F.col(n) * wf))).alias(f"hm0_{n}"), F.max(F.when(F.col(n) > 0, F.struct(F.col(n).alias("s"), (-f).alias("k")))).alias(f"f_{n}"),
    )))
    peaks = by_d.groupBy(*key).agg(*(F.max(F.when(F.col(n) > 0, F.struct(F.col(n).alias("s"), (-d).alias("k")))).alias(f"d_{n}") for n in names))
    sine, cosine = (_at([g(r) for r in radians], d) for g in (math.sin, math.cos))
    turns = split.groupBy(*key).agg(*(F.when(F.max(n) > 0, F.pmod(F.degrees(F.atan2(F.sum(F.col(n) * gf * gd * sine), F.sum(F.col(n) * gf * gd * cosine))), F.lit(360.0))).alias(f"dir_{n}") for n in names))
    out = heights.join(peaks, key).join(turns, key)
    columns = []
    for n in names:
        fp = F.when(F.col(f"f_{n}").isNotNull(), _at(frequencies, -F.col(f"f_{n}.k")))
        pdir = F.when(F.col(f"d_{n}").isNotNull(), _at(degrees, -F.col(f"d_{n}.k")))
        columns += [F.round(f"hm0_{n}", 5).alias(f"hm0_{n}"), F.round(fp, 6).alias(f"fp_{n}"), F.round(1 / fp, 6).alias(f"tp_{n}"), F.round(pdir, 6).alias(f"pdir_{n}"), F.round(f"dir_{n}", 4).alias(f"dir_{n}")]
    return out.select(*key, *columns)


def wrapped(found: DataFrame, key: list[str], degrees: Sequence[float]) -> DataFrame:
    """key, f, direction (0 to below 360, and the first once more 360 higher), e: spectra closed around the circle."""
    turned = [d % 360 for d in degrees]
    rows = found.select(*key, "f", _at(turned, F.col("d")).alias("direction"), "e")
    first = min(turned)
    return rows.unionByName(rows.where(F.col("direction") == first).withColumn("direction", F.col("direction") + 360))


def interpolated_line(df: DataFrame, key: list[str], values: str, n: int, method: str = "linear") -> DataFrame:
    """key, values: an array resampled to n points evenly spread from its first to its last (linear, or a cubic spline)."""
    return _each(df, key, values, lambda v: _resample(np.linspace(0, len(v) - 1, n), np.arange(len(v)), v, method))


def interpolated(df: DataFrame, key: list[str], spectrum: str, frequencies: Sequence[float], degrees: Sequence[float], new_frequencies: Sequence[float] | int = 20, new_degrees: Sequence[float] | int = 20, method: str = "linear") -> DataFrame:
    """key, spectrum: each array of energy on new axes (lists, or numbers of points over the old ones' extent); directions are closed
    around the circle, frequencies outside the old ones give 0."""
    order = np.argsort(np.asarray(degrees, float) % 360)
    old_f, old_d = np.asarray(frequencies, float), (np.asarray(degrees, float) % 360)[order]
    new_f = np.linspace(old_f[0], old_f[-1], new_frequencies) if isinstance(new_frequencies, int) else np.asarray(new_frequencies, float)
    new_d = np.linspace(0, 360, new_degrees, endpoint=False) if isinstance(new_degrees, int) else np.asarray(new_degrees, float)
    around = np.concatenate([old_d[-1:] - 360, old_d, old_d[:1] + 360])

    def make(v: np.ndarray) -> np.ndarray:
        e = v.reshape(len(old_f), -1)[:, order]
        e = np.concatenate([e[:, -1:], e, e[:, :1]], 1)
        rows = np.stack([_resample(new_d % 360, around, line, method) for line in e])
        out = np.stack([_resample(new_f, old_f, line, method) for line in rows.T], 1)
        out[(new_f < old_f[0]) | (new_f > old_f[-1])] = 0.0
        return np.maximum(out, 0.0).ravel()

    return _each(df, key, spectrum, make)


def _resample(at: np.ndarray, x: np.ndarray, y: np.ndarray, method: str) -> np.ndarray:
    if method == "linear":
        return np.interp(at, x, y)
    if method != "cubic":
        raise ValueError(f"unknown method {method!r}")
    from tidemark.operators.profile import spline

    return spline(x, y)(at)


def _each(df: DataFrame, key: list[str], values: str, make) -> DataFrame:
    """key and the array column `values`, each array replaced by make(array); a row at a time, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[values] = [None if v is None else make(np.asarray(v, float)) for v in batch[values]]
            yield batch

    given = df.select(*key, F.col(values).cast("array<double>").alias(values))
    return given.mapInPandas(run, given.schema)


def standard_names(df: DataFrame, product: str = "ww3") -> DataFrame:
    """The columns of a product whose name begins with ww3 under the usual names."""
    return df.withColumnsRenamed({"frequency": "freq", "efth": "SPEC"}) if product.startswith("ww3") else df
