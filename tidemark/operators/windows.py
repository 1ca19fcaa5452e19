"""Weather windows on a regular series: runs, waiting time, limit sequences, start probability.

Ordered frames over one whole series stand in one task by nature of the data: a site's series is hourly, so a century is
under a million rows. `by` names the columns that tell sites apart; each site is ordered on its own, rows without a time last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _order(ts: str, by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(F.col(ts).asc_nulls_last())


def starts(df: DataFrame, ts: str, ok: Column, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds `start`: whether ok holds on this and the next steps - 1 rows, all present."""
    frame = _order(ts, by).rowsBetween(0, steps - 1)
    return df.withColumn("start", F.sum(F.when(ok, 1).otherwise(0)).over(frame) == steps)


def waiting(df: DataFrame, ts: str, ok: Column, steps: int, hours: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds wait_h: hours to the next start, its own duration included; rows after the last start are dropped."""
    order = _order(ts, by)
    df = starts(df, ts, ok, steps, by).withColumn("_k", F.row_number().over(order))
    # read from the end, as a frame up to the end is worked out anew for each row
    back = Window.partitionBy(*by).orderBy(F.col("_k").desc())
    ahead = F.min(F.when(F.col("start"), F.col("_k"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("wait_h", (ahead - F.col("_k") + steps) * F.lit(float(hours))).where("wait_h is not null").drop("_k")


def window_table(waits: DataFrame, ts: str) -> DataFrame:
    """Mean and quantiles of the days needed, by month of the row and over all; the row over all is there even if no row waits."""
    keyed = waits.select(F.month(ts).alias("month"), (F.col("wait_h") / 24).alias("d"))
    # grouping sets of no rows have no total, so a row that counts nowhere is added
    keyed = keyed.union(waits.sparkSession.range(1).select(F.lit(None).cast("int"), F.lit(None).cast("double")))
    stats = [F.round(c, 6).alias(n) for n, c in (("mean", F.avg("d")), ("p10", F.percentile("d", 0.1)), ("p50", F.percentile("d", 0.5)), ("p90", F.percentile("d", 0.9)), ("p95", F.percentile("d", 0.95)), ("max", F.max("d")))]
    found = keyed.groupingSets([[F.col("month")], []], F.col("month")).agg(F.count("d").alias("n"), *stats, F.grouping("month").alias("_all"))
    return found.where("n > 0 OR _all = 1").drop("_all")


def limit_sequence(df: DataFrame, ts: str, value: str, limits: Sequence[float], by: Sequence[str] = (), upper: bool = True, inclusive: bool = True) -> DataFrame:
    """Adds feasible: the value k rows on keeps limit k for every k; missing rows don't. Equal limits in a row are one frame."""
    runs: list[list] = []
    for k, limit in enumerate(limits):
        if runs and runs[-1][0] == limit:
            runs[-1][2] = k
        else:
            runs.append([limit, k, k])
    all_kept = F.lit(True)
    for limit, a, b in runs:
        v = F.col(value)
        keeps = (v <= limit if inclusive else v < limit) if upper else (v >= limit if inclusive else v > limit)
        kept = F.sum(F.when(keeps, 1).otherwise(0)).over(_order(ts, by).rowsBetween(a, b))
        all_kept = all_kept & (F.coalesce(kept, F.lit(0)) == b - a + 1)
    return df.withColumn("feasible", all_kept)


def start_probability(df: DataFrame, ts: str, ok: str) -> DataFrame:
    """Share of feasible rows by hour of day, and, by month, the mean over years of whether any row was feasible."""
    flag = F.col(ok).cast("int")
    hourly = df.groupBy(F.hour(ts).alias("k")).agg(F.round(F.avg(flag), 6).alias("p")).select(F.lit("hour").alias("part"), "k", "p")
    months = df.groupBy(F.year(ts).alias("y"), F.month(ts).alias("k")).agg(F.max(flag).alias("m")).groupBy("k").agg(F.round(F.avg("m"), 6).alias("p"))
    return hourly.union(months.select(F.lit("month"), "k", "p"))


def threshold_table(df: DataFrame, ts: str, value: str, thresholds: Sequence[float], durations: Sequence[int], hours: float, by: Sequence[str] = ()) -> DataFrame:
    """by, threshold, duration_h, days: mean days to the end of an operation of that length with every value below the threshold.

    Each site (by) and threshold is a partition of its own, and all durations share its one sort. Rows after the last start don't count.
    """
    cells = df.select(*by, ts, value).withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    group = [*by, "threshold"]
    order = _order(ts, group)
    cells = cells.withColumn("_k", F.row_number().over(order)).withColumn("_ok", F.when(F.col(value) < F.col("threshold"), 1).otherwise(0))
    steps = {int(d): max(1, int(d / hours)) for d in durations}
    cells = cells.withColumns({f"_s{d}": F.sum("_ok").over(order.rowsBetween(0, n - 1)) == n for d, n in steps.items()})
    ahead = {f"_w{d}": F.min(F.when(F.col(f"_s{d}"), F.col("_k"))).over(order.rowsBetween(0, Window.unboundedFollowing)) - F.col("_k") + n for d, n in steps.items()}
    means = cells.withColumns(ahead).groupBy(*group).agg(*(F.avg(F.col(f"_w{d}") * F.lit(hours / 24)).alias(f"_w{d}") for d in steps))
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("duration_h"), F.round(f"_w{d}", 6).alias("days")) for d in steps)))
    return means.select(*group, pairs.alias("p")).select(*group, "p.*")
