"""Online peaks over a threshold: session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_peaks(df: DataFrame, ts: str, value: str, u: float, gap: str = "48 hours", late: str = "6 hours", by: tuple[str, ...] = ()) -> DataFrame:
    """A row a cluster of values over u and site (`by`); works on streams (append mode) and on tables alike."""
    over = df.where(F.col(value) > u).withWatermark(ts, late)
    keys = [F.col(c) for c in by] or [F.isnull(F.col(value)).alias("_one")]  # a stream's sessions need a key beside the window
    out = over.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("w.start").alias("started"), "peak", "n")
