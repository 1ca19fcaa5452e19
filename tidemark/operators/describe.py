"""Calendar and directional statistics; one scan each, totals by grouping sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.series import bin_left, clean, grouped, sector, with_extent

STATS = ("count", "mean", "std", "min", "5%", "50%", "95%", "99%", "max")


def by_calendar(df: DataFrame, ts: str, value: str, part: str = "month", stats: Sequence[str] = STATS, total: bool = True) -> DataFrame:
    """Statistics by month, year, dayofyear, hour or weekofyear; a row with a null key is over everything."""
    keyed = clean(df, value).withColumn(part, getattr(F, part)(F.col(ts)))
    return grouped(keyed, [[part], []] if total else [[part]], value, stats)


def by_month_and_sector(df: DataFrame, ts: str, value: str, direction: str, stats: Sequence[str], sectors: int = 12) -> DataFrame:
    keyed = clean(df, value).withColumns({"month": F.month(ts), "sector": sector(F.col(direction), sectors)})
    return grouped(keyed, [["month", "sector"], ["month"], ["sector"], []], value, stats)


def with_share(table: DataFrame) -> DataFrame:
    """A month and sector table (with count) and pct, the rows' share of their month's, or of all rows."""
    whole = table.where(F.col("sector").isNull()).select(F.col("month").alias("_m"), F.col("count").alias("_all"))
    out = table.join(F.broadcast(whole), F.col("month").eqNullSafe(F.col("_m"))).withColumn("pct", F.round(100 * F.col("count") / F.col("_all"), 6))
    return out.select("month", "sector", "count", "pct", *(c for c in table.columns if c not in ("month", "sector", "count")))


def by_day_of_month(df: DataFrame, ts: str, value: str, stats: Sequence[str] = STATS) -> DataFrame:
    """Statistics by month and day of the month; the 366th day of a year is left out."""
    keyed = clean(df, value).where(F.dayofyear(ts) < 366).withColumns({"month": F.month(ts), "day": F.dayofmonth(ts)})
    return grouped(keyed, [["month", "day"]], value, stats)


def period_maxima(df: DataFrame, ts: str, value: str, sectors: str | None = None) -> DataFrame:
    """Least, mean and greatest of the maxima of each calendar month over the years, or (sectors) of the yearly maxima of each
    direction sector. The row with a null key is over the yearly maxima of all rows."""
    key, name = (sector(F.col(sectors)), "sector") if sectors else (F.month(ts), "month")
    keyed = clean(df, value).withColumns({"_year": F.year(ts), name: key})
    cells = keyed.groupBy("_year", name).agg(F.max(value).alias("_max"))
    yearly = cells.groupBy("_year").agg(F.max("_max").alias("_max"))
    stats = ("min", "mean", "max")
    return grouped(cells, [[name]], "_max", stats).unionByName(grouped(yearly.withColumn(name, F.lit(None).cast("int")), [[name]], "_max", stats))


def rose(df: DataFrame, value: str, direction: str, cuts: Sequence[float] = (0.4, 0.6, 0.8, 0.99), sectors: int = 12) -> DataFrame:
    """Rows and share by sector and class of value, classes cut at quantiles of all rows."""
    df = clean(df, value)
    edges = df.agg(F.percentile(value, list(cuts)).alias("edges"))
    level = F.size(F.filter("edges", lambda e: e <= F.col(value)))
    counted = df.crossJoin(F.broadcast(edges)).groupBy(sector(F.col(direction), sectors).alias("sector"), level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # of a few hundred cells
    return counted.select("sector", "level", "n", F.round(100 * F.col("n") / total, 6).alias("pct"))


def scatter_diagram(df: DataFrame, x: str, step_x: float, y: str, step_y: float, from_origin: bool = False) -> DataFrame:
    """Two-dimensional histogram with row, column and grand totals (null keys). Bins are [a, b), the last one [a, b]."""
    df = with_extent(clean(df, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()), x=x, y=y)

    def bins(c: str, name: str, step: float):
        origin = F.floor(F.col(f"{name}_min") / step) * step
        if from_origin:
            origin = F.when(F.col(f"{name}_min") > 0, F.lit(0.0)).otherwise(origin)
        n = F.greatest(F.ceil((F.col(f"{name}_max") + step - origin) / step) - 1, F.lit(1))
        return (origin + F.least(bin_left(F.col(c), step, origin), n - 1) * step).cast("double")

    counted = df.select(bins(x, "x", step_x).alias("x_from"), bins(y, "y", step_y).alias("y_from")).cube("x_from", "y_from").agg(F.count(F.lit(1)).alias("n"))
    total = F.max("n").over(Window.partitionBy())  # the cells' own grand total
    return counted.select("x_from", "y_from", "n", F.round(100 * F.col("n") / total, 6).alias("pct"))


def sorted_by_bins(df: DataFrame, value: str, by: str, step: float = 1.0) -> DataFrame:
    """Statistics of value by classes [k step, (k + 1) step) of another variable, and over all rows."""
    keyed = clean(df, value, by).withColumn("class", bin_left(F.col(by), step))
    return grouped(keyed, [["class"], []], value, ("count", "min", "5%", "mean", "95%", "max"))


def monthly_every_year(df: DataFrame, ts: str, value: str, stats: Sequence[str] = ("P25", "mean", "P75", "P99", "max")) -> DataFrame:
    """Statistics of every month from January of the first to December of the last year; null in months without rows."""
    found = grouped(clean(df, value).withColumns({"year": F.year(ts), "month": F.month(ts)}), [["year", "month"]], value, stats)
    years = df.agg(F.min(F.year(ts)).alias("a"), F.max(F.year(ts)).alias("b")).where("a is not null")
    spine = years.select(F.explode(F.sequence("a", "b")).alias("year")).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return spine.join(found, ["year", "month"], "left")
