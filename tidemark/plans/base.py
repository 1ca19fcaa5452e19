"""What the registered queries share: the registry, the driver's tables as series, and pieces of SQL.

Series: lineitem and orders by day, events by microsecond; directions are event or order ids times 137.5 degrees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _line(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select("l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "ts", "event_type", "value", F.pmod(F.col("event_id") * F.lit(137.5), F.lit(360.0)).alias("dir"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", F.pmod(F.col("o_orderkey") * F.lit(137.5), F.lit(360.0)).alias("dir"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.max("o_totalprice").alias("x"))


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    # date_trunc goes through the session's time zone, where an hour of spring may be missing
    into = F.make_dt_interval(mins=F.minute("ts"), secs=F.extract(F.lit("SECOND"), "ts"))
    return _t(spark, d, "events").groupBy((F.col("ts") - into).cast("timestamp_ntz").alias("ts")).agg(F.max("value").alias("x"))


def _stats_sql(keys: str, sets: str, table: str, x: str, stats: str) -> str:
    forms = {"count": f"count({x})", "mean": f"round(avg({x}), 6)", "std": f"round(stddev_samp({x}), 6)", "min": f"round(min({x}), 6)", "max": f"round(max({x}), 6)"}
    parts = [f"{forms[s]} AS {s}" if s in forms else f"round(quantile_cont({x}, {int(s[1:]) / 100}), 6) AS {s}" for s in stats.split()]
    return f"SELECT {keys}, {', '.join(parts)} FROM {table} GROUP BY GROUPING SETS ({sets})"


ALL = "count mean std min p5 p50 p95 p99 max"
DAILY = "(SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, max(o_totalprice) AS x FROM orders GROUP BY 1)"
HOURLY = "(SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, max(value) AS x FROM events GROUP BY 1)"
SECTOR = "floor((({d}) + 15.0) % 360.0 / 30.0)::INT"


SEA = "(SELECT l_quantity / 5 AS hs, 4 + 2 * sqrt(l_quantity / 5) + l_discount * 10 AS tp FROM lineitem)"


def _sea(spark, d):
    return _line(spark, d).select((F.col("l_quantity") / 5).alias("hs"), (4 + 2 * F.sqrt(F.col("l_quantity") / 5) + F.col("l_discount") * 10).alias("tp"))
