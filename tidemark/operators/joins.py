"""Joins on time and on bands of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.series import estimated_bytes


def time_join(first: DataFrame, *others: DataFrame, on: str) -> DataFrame:
    """Left joins on time; columns of the k-th other table get the suffix _k."""
    out = first
    for k, other in enumerate(others, 1):
        out = out.join(other.select(on, *(F.col(c).alias(f"{c}_{k}") for c in other.columns if c != on)), on, "left")
    return out


def band_join(a: DataFrame, x: str, b: DataFrame, y: str, width: float) -> DataFrame:
    """Pairs with |x - y| < width: the rows of the smaller table (by Spark's estimate) go to their cell and both neighbours, so it is
    an equi-join of cells, whose crowded ones Spark may split."""
    own = lambda c: F.floor(F.col(c) / width)
    around = lambda c: F.explode(F.array(*(own(c) + k for k in (-1, 0, 1))))
    spread_a = estimated_bytes(a) < estimated_bytes(b)
    left = a.withColumn("_cell", around(x) if spread_a else own(x))
    right = b.withColumn("_cell", own(y) if spread_a else around(y))
    return left.join(right, "_cell").where(F.abs(F.col(x) - F.col(y)) < width).drop("_cell")


def next_at_or_after(a: DataFrame, b: DataFrame, ts: str, value: str, by: str, block_days: float = 30) -> DataFrame:
    """For each row of a the first row of b with the same key that isn't earlier.

    Rows are ordered within (key, block of time), so that a key of any number of rows is spread over tasks; where a block has no
    later row, the first one of a later block is carried over, from one row a key and block.
    """
    both = a.select(by, ts, F.lit(1).alias("_a"), F.lit(None).cast("struct<t:timestamp_ntz,v:double>").alias("_b"))
    both = both.unionByName(b.select(by, ts, F.lit(0).alias("_a"), F.struct(F.col(ts).cast("timestamp_ntz").alias("t"), F.col(value).cast("double").alias("v")).alias("_b")))
    both = both.withColumn("_block", F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / (block_days * 86400)))
    later = Window.partitionBy(by).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(by, "_block").agg(F.min("_b").alias("_first")).withColumn("_next", F.last("_first", ignorenulls=True).over(later)).drop("_first")
    frame = Window.partitionBy(by, "_block").orderBy(F.col(ts).desc(), "_a").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_n", F.last("_b", ignorenulls=True).over(frame)).where("_a = 1").join(carried, [by, "_block"])
    return rows.withColumn("_n", F.coalesce("_n", "_next")).select(by, ts, F.col("_n.t").alias("next_at"), F.col("_n.v").alias("next_value"))


def nearest(df: DataFrame, x: str, target: float, order: str) -> DataFrame:
    """The row nearest to a value, the first in order of equal ones."""
    return df.orderBy(F.abs(F.col(x) - target), order).limit(1)
