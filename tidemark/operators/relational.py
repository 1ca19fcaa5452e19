"""Plain relational helpers: columns by name, time slices, joins by time stamps, wide and long forms, series statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.moments import weibull
from tidemark.functions.series import clean

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def columns_like(df: DataFrame, prefix: str | None = None, contains: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """keep and the columns that begin with a prefix, or contain a text (in any case)."""
    hit = lambda c: (prefix is not None and c.startswith(prefix)) or (contains is not None and contains.lower() in c.lower())
    return df.select(*keep, *(c for c in df.columns if hit(c) and c not in keep))


def levels_of(df: DataFrame, prefix: str = "") -> dict[float, str]:
    """Level -> column, ascending, of columns such as current_speed_2.5m."""
    found = {float(m[1]): c for c in df.columns if c.startswith(prefix) and (m := re.search(r"(\d+\.?\d*)m$", c))}
    return dict(sorted(found.items()))


def month_label(month: Column, short: bool = True) -> Column:
    """Month name, or its first three letters; null stays null."""
    return F.element_at(F.array(*(F.lit(m[:3] if short else m) for m in MONTHS)), month.cast("int"))


def month_number(name: str) -> int:
    found = [i for i, m in enumerate(MONTHS, 1) if name in (m, m[:3])]
    if not found:
        raise ValueError(f"unknown month {name!r}")
    return found[0]


def time_slice(df: DataFrame, ts: str, period: Sequence[str | int | None] | None) -> DataFrame:
    """Rows from the first to the second time, both included; one time alone is that time, a year (four digits) that year, None at
    either place leaves that side open. A period outside the series is refused."""
    if period is None:
        return df
    if len(period) == 1 and re.fullmatch(r"\d{4}", str(period[0])):
        return df.where(F.year(ts) == int(period[0]))
    start, end = (period[0], period[0]) if len(period) == 1 else (period[0], period[1])
    kind = df.schema[ts].dataType.simpleString()
    low, high = (None if t is None else F.lit(str(t)).cast(kind) for t in (start, end))
    first, last = F.min(ts), F.max(ts)
    bad = [c for c in (None if low is None else low < first, None if high is None else high > last) if c is not None]
    if bad and df.agg(*(c.alias(f"b{i}") for i, c in enumerate(bad))).select(F.array_contains(F.array("*"), True)).first()[0]:
        raise ValueError(f"the period {start} to {end} is outside the series")
    rows = df if low is None else df.where(F.col(ts) >= low)
    return rows if high is None else rows.where(F.col(ts) <= high)


def full_outer(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows of both, joined where the columns `on` agree; b's other columns that a has too get the suffix _1."""
    other = b.withColumnsRenamed({c: f"{c}_1" for c in b.columns if c in a.columns and c not in on})
    return a.join(other, list(on), "full")


def with_match(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), list(on), "left_semi")


def without_match(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def wide(df: DataFrame, key: Sequence[str], name: str, value: str, values: Sequence) -> DataFrame:
    """A column for each of the given values of `name`, so that no pass looks for them; the first value in each cell."""
    return df.groupBy(*key).pivot(name, list(values)).agg(F.first(value, ignorenulls=True))


def long(df: DataFrame, key: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(key), [c for c in df.columns if c not in key], name, value)


def with_total(df: DataFrame, name: str, label: str, aggregates: dict[str, Column]) -> DataFrame:
    """df and one more row: `label` under name, and the aggregates; columns without one are null."""
    total = df.agg(*(c.alias(n) for n, c in aggregates.items())).withColumn(name, F.lit(label))
    return df.unionByName(total, allowMissingColumns=True)


def moving_mean(df: DataFrame, ts: str, value: str, rows: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds `mean`: of the `rows` rows centred on each (one more before than after if even), null where some are missing."""
    before = rows // 2
    frame = Window.partitionBy(*by).orderBy(ts).rowsBetween(-before, rows - 1 - before)
    return df.withColumn("mean", F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame)))


def local_extrema(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), least: bool = False) -> DataFrame:
    """Rows whose value is greater (or less) than both neighbours'; of a flat top the first row. Ends are none."""
    order = Window.partitionBy(*by).orderBy(ts)
    v = -F.col(value) if least else F.col(value)
    change = df.withColumn("_v", v).withColumn("_up", F.col("_v") > F.lag("_v").over(order)).withColumn("_new", F.coalesce(F.col("_v") != F.lag("_v").over(order), F.lit(True)))
    tops = change.where("_new").withColumn("_down", F.lead("_v").over(order) < F.col("_v"))  # runs of equal values count once
    return tops.where("_up and _down").drop("_v", "_up", "_new", "_down")


def percentile_rank(df: DataFrame, value: str, at: Sequence[float]) -> DataFrame:
    """at, rank: percent of rows below each value, those equal to it counting half (and half a row for it). One scan for all."""
    df = clean(df, value).where(F.col(value).isNotNull())
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(value) < x).alias(f"l{i}") for i, x in enumerate(at)), *(F.count_if(F.col(value) <= x).alias(f"r{i}") for i, x in enumerate(at)))
    rank = lambda i: (F.col(f"l{i}") + F.col(f"r{i}") + F.when(F.col(f"r{i}") > F.col(f"l{i}"), 1).otherwise(0)) * 50.0 / F.col("n")
    pairs = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("at"), F.round(rank(i), 6).alias("rank")) for i, x in enumerate(at))))
    return counts.select(pairs.alias("p")).select("p.*")


def fitted_draws(df: DataFrame, value: str, draws: int = 1_000_000, seed: int = 1) -> DataFrame:
    """value, non_exceedance: draws from the Weibull distribution with the column's moments, made where they are used."""
    m = clean(df, value).agg(F.avg(value), F.var_pop(value), F.skewness(value)).first()
    shape, loc, scale = weibull(float(m[0]), float(m[1]), float(m[2]))
    u = df.sparkSession.range(draws).select(F.rand(seed).alias("non_exceedance"))
    return u.select((loc + scale * F.pow(-F.log(1 - F.col("non_exceedance")), F.lit(1 / shape))).alias("value"), "non_exceedance")


def runs(df: DataFrame, number: str, by: Sequence[str] = ()) -> DataFrame:
    """by, first, last, members: groups of consecutive integers."""
    rows = df.select(*by, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*by).orderBy(number))
    found = rows.withColumn("_i", island).groupBy(*by, "_i").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.sort_array(F.collect_list(number)).alias("members"))
    return found.drop("_i")


def fitted_non_exceedance(df: DataFrame, value: str, step: float = 0.5, draws: int = 1_000_000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The percentile ranks of multiples of step up to the greatest value, and draws of the fitted Weibull distribution with their
    own non-exceedance."""
    top = clean(df, value).agg(F.max(value)).first()[0] or 0.0
    grid = [i * step for i in range(int(top / step) + 2)]
    return percentile_rank(df, value, grid), fitted_draws(df, value, draws, seed)
