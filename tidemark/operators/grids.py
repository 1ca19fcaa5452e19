"""Gridded fields in long form: a row a cell, addressed by whole numbers or by coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import long_form
from tidemark.operators.relational import levels_of


def gaussian_filter(df: DataFrame, row: str, column: str, value: str, sigma: float = 1.5, by: Sequence[str] = (), truncate: float = 4.0) -> DataFrame:
    """by, row, column, value: the mean around each cell of the grid, weighted by a Gaussian of `sigma` cells; missing values have no weight.

    Rows and columns run without gaps, the edge is mirrored. The two axes are filtered one after the other, each cell going to
    2 r + 1 places with partial sums, so the cost grows with r and not with its square.
    """
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    kernel = [w / sum(raw) for w in raw]
    ends = df.groupBy(*by).agg(*(f(c).cast("long").alias(f"_{n}_{c}") for c in (row, column) for n, f in (("a", F.min), ("b", F.max)))) if by else df.agg(*(f(c).cast("long").alias(f"_{n}_{c}") for c in (row, column) for n, f in (("a", F.min), ("b", F.max))))
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    cells = df.select(*by, F.col(row).cast("long").alias(row), F.col(column).cast("long").alias(column), F.coalesce(v, F.lit(0.0)).alias("s"), F.when(v.isNotNull(), 1.0).otherwise(0.0).alias("w"))
    cells = cells.join(F.broadcast(ends), list(by)) if by else cells.crossJoin(F.broadcast(ends))
    steps = F.array(*(F.struct(F.lit(k - r).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(kernel)))
    keep = [*by, row, column, *(f"_{n}_{c}" for c in (row, column) for n in "ab")]
    for axis in (row, column):
        low, n = F.col(f"_a_{axis}"), F.col(f"_b_{axis}") - F.col(f"_a_{axis}") + 1
        # a target takes from the places around it; places beyond an edge are mirrored back, so a cell may count several times
        spread = cells.withColumn("_k", F.explode(steps))
        place, turns = F.col(axis) - low, F.ceil((r + n) / (2 * n)).cast("int")
        images = F.flatten(F.transform(F.sequence(-turns, turns), lambda m: F.array(place + m * 2 * n, -1 - place + m * 2 * n)))
        spread = spread.withColumn("_p", F.explode(images)).withColumn("_to", F.col("_p") + F.col("_k.k")).where((F.col("_to") >= 0) & (F.col("_to") < n))
        moved = spread.withColumn(axis, low + F.col("_to"))
        cells = moved.groupBy(*keep).agg(F.sum(F.col("s") * F.col("_k.w")).alias("s"), F.sum(F.col("w") * F.col("_k.w")).alias("w"))
    return cells.select(*by, row, column, F.when(F.col("w") > 1e-300, F.col("s") / F.col("w")).alias(value))


def depth_names(df: DataFrame) -> list[str]:
    """The distinct depths, such as 2.5m, that column names end in, ascending."""
    return [f"{c.rsplit('_', 1)[-1]}" for c in dict(sorted({float(n.rsplit("_", 1)[-1][:-1]): n for n in levels_of(df).values()}.items())).values()]


UNITS = {"salinity": "ppt", "temperature": "celsius", "u": "m/s", "v": "m/s", "magnitude": "m/s"}


def variable_by_depth(df: DataFrame, ts: str, variable: str) -> DataFrame:
    """ts, level, value: a variable (salinity, temperature, u, v, or magnitude of u and v) at all depths; missing values are 0."""
    if variable not in UNITS:
        raise ValueError(f"unknown variable {variable!r}")
    zero = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0))
    if variable != "magnitude":
        return long_form(df, [ts], levels_of(df, f"{variable}_")).withColumn("value", zero("value"))
    u, v = levels_of(df, "u_"), levels_of(df, "v_")
    speeds = df.select(ts, *(F.hypot(zero(u[z]), zero(v[z])).alias(f"m{i}") for i, z in enumerate(u) if z in v))
    return long_form(speeds, [ts], {z: f"m{i}" for i, z in enumerate(u) if z in v})


def nearest_index(df: DataFrame, row: str, column: str, lat: str, lon: str, at: tuple[float, float], decimals: int = 2, tolerance: float = 0.005) -> DataFrame:
    """row, column: the first cell (by row, then column) whose rounded coordinates are within the tolerance of a place; none if no cell is."""
    near = lambda c, x: F.abs(F.bround(c, decimals) - x) <= tolerance + 1e-12
    return df.where(near(lat, at[0]) & near(lon, at[1])).select(row, column).orderBy(row, column).limit(1)


def from_rotated_pole(lon: Column, lat: Column, pole_lon: float, pole_lat: float) -> tuple[Column, Column]:
    """Geographic longitude and latitude of coordinates on a grid whose north pole stands at (pole_lon, pole_lat)."""
    a, b, p = F.radians(lon), F.radians(lat), math.radians(pole_lat)
    x, y, z = F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)
    up = z * math.sin(p) + x * math.cos(p)
    turned = F.atan2(y, x * math.sin(p) - z * math.cos(p))
    return F.pmod(F.degrees(turned) + 180 + pole_lon + 180, F.lit(360.0)) - 180, F.degrees(F.asin(F.greatest(F.least(up, F.lit(1.0)), F.lit(-1.0))))


def from_lambert(x: Column, y: Column, lon0: float, lat0: float, parallels: Sequence[float], radius: float = 6371000.0) -> tuple[Column, Column]:
    """Longitude and latitude of coordinates in metres of a conformal conic projection of the sphere."""
    first, last = math.radians(parallels[0]), math.radians(parallels[-1])
    half = lambda a: math.tan(math.pi / 4 + a / 2)
    n = math.sin(first) if abs(first - last) < 1e-12 else math.log(math.cos(first) / math.cos(last)) / math.log(half(last) / half(first))
    f = math.cos(first) * half(first) ** n / n
    rho0 = radius * f / half(math.radians(lat0)) ** n
    sign = 1.0 if n > 0 else -1.0
    rho = sign * F.hypot(x, rho0 - y)
    lon = lon0 + F.degrees(F.atan2(sign * x, sign * (rho0 - y))) / n
    return lon, F.degrees(2 * F.atan(F.pow(radius * f / rho, F.lit(1 / n))) - math.pi / 2)
