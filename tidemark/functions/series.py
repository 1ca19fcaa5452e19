"""Column expressions shared by the operators: bins, sectors, calendar keys and grouped statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """NaN counts as missing, so statistics skip it."""
    return df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns})


def sector(direction: Column, n: int = 12) -> Column:
    """Sector number 0..n-1; sector 0 is centred on north."""
    return F.floor(F.pmod(direction + F.lit(180.0 / n), F.lit(360.0)) / F.lit(360.0 / n)).cast("int")


def bin_left(x: Column, step: float, origin: Column | float = 0.0) -> Column:
    """k with origin + k step <= x < origin + (k + 1) step."""
    return F.floor((x - origin) / F.lit(float(step))).cast("int")


def bin_right(x: Column, step: float, origin: Column | float = 0.0) -> Column:
    """k with origin + k step < x <= origin + (k + 1) step."""
    return (F.ceil((x - origin) / F.lit(float(step))) - 1).cast("int")


def statistic(name: str, x: Column) -> Column:
    """'min', 'mean', 'max', 'std', 'count', 'median', or a percentile as '5%', 'P5' or 'p5'."""
    plain = {"min": F.min, "mean": F.avg, "max": F.max, "std": F.stddev_samp, "count": F.count, "median": lambda c: F.percentile(c, 0.5)}
    if name.lower() in plain:
        return plain[name.lower()](x)
    m = re.fullmatch(r"[pP]?(\d+(?:\.\d+)?)%?", name)
    if not m:
        raise ValueError(f"unknown statistic {name!r}")
    return F.percentile(x, float(m[1]) / 100)


def label(name: str) -> str:
    return name.lower().replace("%", "").join(("p", "")) if name[0].isdigit() else name.lower()


#: Estimated bytes up to which a group's distinct values may stand in one task's buffer (Spark's own percentile); ACCURACY of the
#: brackets beyond.
SMALL, ACCURACY = 4 << 30, 100_000


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of df, from file sizes and statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _percent(name: str) -> float | None:
    if name.lower() == "median":
        return 0.5
    m = re.fullmatch(r"[pP]?(\d+(?:\.\d+)?)%?", name)
    return float(m[1]) / 100 if m else None


def grouped(df: DataFrame, sets: Sequence[Sequence[str]], value: str, stats: Sequence[str], digits: int = 6, small: int = SMALL) -> DataFrame:
    """Statistics of value for each grouping set; a column that a set leaves out is null.

    One scan, if df has at most about `small` bytes. Beyond, exact percentiles come from a second one, so that no task
    holds a group: see by_brackets().
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    plain = [s for s in stats if _percent(s) is None]
    if len(plain) < len(stats) and estimated_bytes(df) > small:
        found = by_brackets(df, sets, value, {label(s): p for s in stats if (p := _percent(s)) is not None}, digits)
        rest = grouped(df, sets, value, [*(s for s in plain if s != "count"), "count"], digits).withColumnRenamed("count", "_count")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        joined = rest.alias("a").join(found.alias("b"), reduce(and_, [*same, F.lit(True)]))
        names = {label(s): F.col(f"a.{'_count' if s == 'count' else label(s)}") for s in plain}
        return joined.select(*(F.col(f"a.{k}") for k in keys), *(names.get(label(s), F.col(f"b.{label(s)}") if _percent(s) is not None else None).alias(label(s)) for s in stats))
    aggs = [(F.round(statistic(s, F.col(value)), digits) if s != "count" else F.count(value)).alias(label(s)) for s in plain]
    ranks = [p for s in stats if (p := _percent(s)) is not None]
    if ranks:  # all of them from one buffer of distinct values
        aggs.append(F.percentile(value, ranks).alias("_q"))
    found = df.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys)).agg(*aggs)
    at = iter(range(len(ranks)))
    return found.select(*map(F.col, keys), *(F.col(label(s)) if _percent(s) is None else F.round(F.col("_q")[next(at)], digits).alias(label(s)) for s in stats))


def by_brackets(df: DataFrame, sets: Sequence[Sequence[str]], value: str, percentiles: dict[str, float], digits: int | None = 6, accuracy: int = ACCURACY) -> DataFrame:
    """Exact percentiles of groups of any size, interpolated like percentile().

    A first pass finds, by a mergeable sketch whose rank error is bounded, a bracket of values that surely holds each percentile;
    groups of `accuracy` rows or fewer are their own bracket. A second pass counts the rows below each bracket, and the rows
    of each value within it, which are some hundred-thousandths of the group. Only these are ranked together.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    kinds = {k: df.schema[k].dataType for k in keys}
    at = list(percentiles.values())
    margin = 4.0 / accuracy
    edges = [q for p in at for q in (max(0.0, p - margin), min(1.0, p + margin))]
    group = lambda s: F.struct(F.lit(list(map(tuple, sets)).index(tuple(s))).alias("set"), *((F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys))
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    every = df.where(F.col(value).isNotNull()).select(F.explode(F.array(*map(group, sets))).alias("g"), F.col(value).alias("_v"))
    sketch = every.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b"), F.percentile_approx("_v", edges, accuracy).alias("q"))
    whole = F.col("n") <= accuracy
    brackets = F.array(*(F.struct(F.lit(i).alias("i"), F.when(whole, F.col("a")).otherwise(F.col("q")[2 * i]).alias("low"), F.when(whole, F.col("b")).otherwise(F.col("q")[2 * i + 1]).alias("high")) for i in range(len(at))))
    wanted = sketch.select("g", "n", F.explode(brackets).alias("k")).select("g", "n", "k.*")
    cells = rows.select(F.explode(F.array(*map(group, sets))).alias("g"), "_v", "_n").join(wanted, "g").where(F.col("_v") <= F.col("high"))
    inside = cells.groupBy("g", "n", "i", F.when(F.col("_v") >= F.col("low"), F.col("_v")).alias("_v")).agg(F.sum("_n").alias("_n"))  # null: below
    upto = F.sum("_n").over(Window.partitionBy("g", "i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    p = F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1)
    ranked = inside.withColumn("_upto", upto).withColumn("_rank", p * (F.col("n") - 1)).where("_v is not null")
    first = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))  # noqa: E731  the value at a rank from 0
    found = ranked.groupBy("g", "i").agg(first(F.floor("_rank")).alias("x"), first(F.ceil("_rank")).alias("y"), F.first(F.col("_rank") - F.floor("_rank")).alias("w"))
    exact = F.col("x") + (F.col("y") - F.col("x")) * F.col("w")
    out = found.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, exact if digits is None else F.round(exact, digits))).alias(n) for i, n in enumerate(percentiles)))
    return out.select(*(F.col(f"g.{k}") for k in keys), *percentiles)


def with_extent(df: DataFrame, **columns: str) -> DataFrame:
    """Adds name_min and name_max of each column: one row of bounds, joined to every row."""
    bounds = df.agg(*(f(c).alias(f"{n}_{a}") for n, c in columns.items() for a, f in (("min", F.min), ("max", F.max))))
    return df.crossJoin(F.broadcast(bounds))
