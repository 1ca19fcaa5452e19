"""Cumulative tables, levels and hours below thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.series import bin_right, clean, grouped, sector, with_extent


def _cumulated(counted: DataFrame, key: str, total) -> DataFrame:
    """counted: key, bin, n. Adds empty bins, then the cumulated share of `total` in percent."""
    spine = counted.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).select(F.explode(F.sequence("a", "b")).alias("bin"))
    full = counted.select(key).distinct().crossJoin(F.broadcast(spine)).join(counted, [key, "bin"], "left")
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(key).orderBy("bin"))
    return full.withColumn("pct", 100 * so_far / total)


def monthly_non_exceedance(df: DataFrame, ts: str, value: str, step: float) -> DataFrame:
    """Percent of the month's rows up to each level; a null month is the plain mean over months. Bins are (a, b] from int(min)."""
    df = with_extent(clean(df, value), v=value)
    origin = F.col("v_min").cast("long")  # towards 0
    keyed = df.select(F.month(ts).alias("month"), F.greatest(bin_right(F.col(value), step, origin), F.lit(0)).alias("bin"), origin.alias("origin"))
    counted = keyed.groupBy("month", "bin", "origin").agg(F.count(F.lit(1)).alias("n"))
    first = counted.agg(F.min("origin").alias("o"))
    whole = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("month"))
    shares = _cumulated(counted.drop("origin"), "month", whole).crossJoin(F.broadcast(first)).withColumn("level", (F.col("o") + (F.col("bin") + 1) * step).cast("double"))
    return shares.groupingSets([[F.col("month"), F.col("level")], [F.col("level")]], F.col("month"), F.col("level")).agg(F.round(F.avg("pct"), 6).alias("pct"))


def directional_non_exceedance(df: DataFrame, value: str, direction: str, step: float, sectors: int = 12) -> DataFrame:
    """Percent of all rows that are in the sector and up to each level; a null sector is the sum. Bins are (a, b] from 0."""
    df = clean(df, value).where(F.col(value).isNotNull())
    counted = df.groupBy(sector(F.col(direction), sectors).alias("sector"), F.greatest(bin_right(F.col(value), step), F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("total", F.sum("n").over(Window.partitionBy()))  # of a few hundred cells
    total = F.max("total").over(Window.partitionBy())
    shares = _cumulated(counted, "sector", total).select("sector", ((F.col("bin") + 1) * step).cast("double").alias("level"), "pct")
    return shares.groupingSets([[F.col("sector"), F.col("level")], [F.col("level")]], F.col("sector"), F.col("level")).agg(F.round(F.sum("pct"), 6).alias("pct"))


def hours_below(df: DataFrame, ts: str, value: str, thresholds: Sequence[float], digits: int = 6) -> DataFrame:
    """Hours a year strictly below each threshold: rows below times the mean step. All thresholds in one scan."""
    df = clean(df, value).where(F.col(value).isNotNull())
    step = (F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))) / (F.count(F.lit(1)) - 1) / 3600
    hours = df.agg(step.alias("step"))
    counted = df.groupBy(F.year(ts).alias("year")).agg(*(F.count_if(F.col(value) < t).alias(f"t{i}") for i, t in enumerate(thresholds)))
    pairs = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds))))
    return counted.select("year", pairs.alias("p")).crossJoin(F.broadcast(hours)).select("year", "p.threshold", F.round(F.col("p.n") * F.col("step"), digits).alias("hours"))


def tidal_levels(df: DataFrame, value: str) -> DataFrame:
    """Highest, mean and lowest level."""
    df = clean(df, value)
    return df.agg(F.max(value).alias("hat"), F.round(F.avg(value), 6).alias("msl"), F.min(value).alias("lat"))


def hours_below_over_years(df: DataFrame, ts: str, value: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, min, mean, max: hours_below() over the years."""
    return hours_below(df, ts, value, thresholds, 12).groupBy("threshold").agg(*(F.round(f("hours"), 6).alias(n) for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))))


def monthly_statistics(df: DataFrame, ts: str, value: str, stats: Sequence[str] = ("min", "5%", "mean", "95%", "max")) -> DataFrame:
    """The rows below a monthly non-exceedance table: statistics by month, and over all rows (null)."""
    return grouped(clean(df, value).withColumn("month", F.month(ts)), [["month"], []], value, stats)


def directional_statistics(df: DataFrame, value: str, direction: str, sectors: int = 12, stats: Sequence[str] = ("mean", "50%", "99%", "max")) -> DataFrame:
    """The rows below a directional non-exceedance table: statistics by sector, and over all rows (null)."""
    return grouped(clean(df, value).withColumn("sector", sector(F.col(direction), sectors)), [["sector"], []], value, stats)
