"""Highest waves, crests and total water levels at return heights: formulas over the few rows of a return table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import physics
from tidemark.functions.series import clean
from tidemark.operators import conditional, currents, lonowe, return_tables

HIGHEST_PERIOD = 0.9  # of the highest wave, as a share of the peak period (fixed value)


def _steps(df: DataFrame, ts: str) -> DataFrame:
    """_hours: whole days of the series over its rows."""
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    return df.agg(((F.floor((F.max(seconds) - F.min(seconds)) / 86400) + 1) * 24 / F.count(F.lit(1))).alias("_hours"))


def return_crests(df: DataFrame, ts: str, hs: str, tp: str, depth: float = 200.0, periods: Sequence[float] = (1, 10, 100, 10000), sea_state: str = "short") -> DataFrame:
    """period, hs, periods of the highest wave (t_p5, t_mean, t_p95), hmax, ratio (of hmax to hs) and crest.

    The crest's window is a step of the series, that of the highest wave three hours.
    """
    rows = lonowe.period_at_return_height(df, ts, hs, tp, periods).crossJoin(F.broadcast(_steps(df, ts)))
    rows = rows.withColumns({f"t_{c}": HIGHEST_PERIOD * F.col(c) for c in ("p5", "mean", "p95")})
    height, period = F.col("hs"), F.col("t_mean")
    crest = physics.crest(height, physics.mean_period(period), depth, sea_state, F.col("_hours"), physics.zero_crossing_period(period))
    rows = rows.withColumns({"hmax": physics.highest_wave(height, period), "crest": crest})
    return rows.withColumn("ratio", F.col("hmax") / height).select("period", "hs", "t_p5", "t_mean", "t_p95", "hmax", "ratio", "crest")


def directional_highest_waves(df: DataFrame, ts: str, hs: str, tp: str, direction: str, periods: Sequence[float] = (1, 10, 100, 10000), norsok: bool = True) -> DataFrame:
    """sector (null: all rows), share, period, hs, tp, hmax, t_p5, t_mean, t_p95; a sector's hmax doesn't exceed that of all rows."""
    rows = lonowe.return_values(df, ts, hs, tp, periods, direction, norsok)
    model = lonowe.fit(df, ts, hs, tp)[None]
    rows = rows.withColumn("hmax", physics.highest_wave(F.col("hs"), F.col("tp")))
    top = rows.where("sector is null").select("period", F.col("hmax").alias("_top"))
    rows = rows.join(F.broadcast(top), "period").withColumn("hmax", F.when(F.col("hmax").isNotNull(), F.least("hmax", "_top"))).drop("_top")
    if model is None:
        return rows.withColumns({f"t_{c}": F.lit(None).cast("double") for c in ("p5", "mean", "p95")})
    found = physics.period_given_height(F.col("hs"), (model.a1, model.a2, model.a3), (model.b1, model.b2, model.b3))
    return rows.withColumns({f"t_{c}": HIGHEST_PERIOD * t for c, t in zip(("p5", "mean", "p95"), found)})


def wave_induced_currents(df: DataFrame, ts: str, hs: str, tp: str, top: float = 20.0, depth: float = 200.0, level: float = 50.0) -> DataFrame:
    """centre (height, in steps of 1 m) and, for the model's period at 5 %, in the mean and at 95 %: tp_, us_ (velocity at the level)
    and tu_ (its period)."""
    rows = lonowe.period_given_height(df, ts, hs, tp, 1.0, top).select("centre", *(F.col(f"{c}_model").alias(f"tp_{c}") for c in ("p5", "mean", "p95"))).withColumn("_z", F.lit(level))
    for c in ("p5", "mean", "p95"):
        rows = currents.with_wave_current(rows, "centre", f"tp_{c}", depth, "_z").withColumnsRenamed({"us": f"us_{c}", "tu": f"tu_{c}"})
    return rows.drop("_z")


def _tide(df: DataFrame, tide: str) -> DataFrame:
    return clean(df, tide).agg(F.max(tide).alias("tide"))


def total_water_levels(df: DataFrame, ts: str, hs: str, tp: str, surge: str, tide: str, depth: float = 200.0, periods: Sequence[float] = (100, 10000), sea_state: str = "short") -> DataFrame:
    """period, surge (generalised extreme values of all rows), tide (the highest), crest and their sum, total."""
    crest = return_crests(df, ts, hs, tp, depth, periods, sea_state).select("period", "crest")
    found = return_tables.by_level(df, ts, {0.0: surge}, periods, "GEV").select("period", F.col("value").alias("surge"))
    rows = crest.join(F.broadcast(found), "period").crossJoin(F.broadcast(_tide(df, tide)))
    return rows.select("period", "surge", "tide", "crest", (F.col("crest") + F.col("surge") + F.col("tide")).alias("total"))


def surge_at_return_heights(df: DataFrame, ts: str, hs: str, tp: str, surge: str, tide: str, depth: float = 200.0, periods: Sequence[float] = (1, 10, 100, 10000)) -> DataFrame:
    """period, hs, crest, tide, surge p5, mean and p95 by the curve of surge on height, and total (with p95)."""
    rows = return_crests(df, ts, hs, tp, depth, periods).select("period", "hs", "crest").crossJoin(F.broadcast(_tide(df, tide)))
    classes = conditional.given_classes(df, surge, hs, 1.0, 20.0)
    rows = conditional.with_model(rows, "hs", conditional.coefficients(classes, "surge_on_height"), "surge_on_height")
    return rows.withColumn("total", F.col("crest") + F.col("p95") + F.col("tide")).select("period", "hs", "crest", "tide", "p5", "mean", "p95", "total")
