"""Text sources and sinks of metocean series and tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_time_parts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """White-space text whose data rows start with year, month, day, hour; other lines (titles, headers) are skipped."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d{4}\s+\d{1,2}\s+\d{1,2}\s+\d{1,2}\s"))
    at = F.make_timestamp_ntz(*(F.get(part, i).cast("int") for i in range(4)), F.lit(0), F.lit(0))
    return rows.select(at.alias("ts"), *(F.expr(f"try_cast(get(split(trim(value), '\\\\s+'), {4 + i}) as double)").alias(c) for i, c in enumerate(columns)))


def read_commented_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with # comments whose first column is the time."""
    df = spark.read.csv(path, header=True, comment="#", inferSchema=True)
    return df.withColumnRenamed(df.columns[0], "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def table_to_csv(line: Column) -> Column:
    """A row of a LaTeX table as a row of CSV: & to comma, row ends and rules dropped."""
    plain = F.regexp_replace(F.regexp_replace(line, r"\\\\", ""), r"\\(hline|toprule|midrule|bottomrule)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s*&\s*", ","), r"\\%", "%"))


def write_csv(df: DataFrame, path: str, comment: str | None = None, float_format: str | None = None) -> None:
    """A small result table as one CSV file, with an optional comment line first and a format (such as %.2f) for fractions."""
    fractions = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    cell = lambda c: F.format_string(float_format, F.col(f"`{c}`")) if float_format and c in fractions else F.col(f"`{c}`").cast("string")
    rows = df.select(*(F.when(F.col(f"`{c}`").isNotNull(), cell(c)).alias(c) for c in df.columns)) if float_format else df
    if comment:
        lines = rows.select(F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns)).alias("value"))
        head = df.sparkSession.createDataFrame([(f"# {comment}",), (",".join(df.columns),)], "value string").coalesce(1)
        head.union(lines).coalesce(1).write.text(path)
    else:
        rows.coalesce(1).write.csv(path, header=True)


def grid_rows(spark: SparkSession, axes: dict[str, Sequence], variables: dict[str, object]) -> DataFrame:
    """A gridded dataset in memory as rows: a row a cell, with a column an axis (in order) and one a variable.

    variables: arrays of the shape of all axes, or of the first ones (repeated along the others). What a driver holds in memory
    is bounded by it; larger grids are read from Parquet in this form.
    """
    names = list(axes)
    shape = tuple(len(v) for v in axes.values())
    parts = np.meshgrid(*axes.values(), indexing="ij")
    table = {n: p.ravel() for n, p in zip(names, parts)}
    for name, values in variables.items():
        array = np.asarray(values)
        table[name] = np.broadcast_to(array.reshape(array.shape + (1,) * (len(shape) - array.ndim)), shape).ravel()
    return spark.createDataFrame(pd.DataFrame(table))
