"""Queries of extremes and weather windows equal their SQL where a table leaves one peak, a few or none."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_registered import rows

from tidemark.operators import windows
from tidemark.plans import registry


def orders(days, n, prices=None, seed=5):
    rng = np.random.default_rng(seed)
    prices = np.round(rng.uniform(1000, 500_000, n), 2) if prices is None else prices
    dates = pd.Timestamp("1995-01-01") + pd.to_timedelta(rng.integers(0, days, n), "D")
    return pd.DataFrame({"o_orderkey": np.arange(n), "o_orderdate": dates.astype("datetime64[us]"), "o_totalprice": prices})


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its SQL on given tables."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, df in tables.items():
            df.to_parquet(tmp_path / f"{table}.parquet", index=False)
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
        return rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()), rows(con.sql(registry.SQL[name]).df())

    return run


@pytest.mark.parametrize("days,n,tied", [(30, 3000, 0), (20, 6000, 0), (2400, 3000, 0), (40, 20, 0), (30, 12, 0), (60, 240, 220)])
def test_peaks_of_sectors_are_capped_by_the_one_peak_of_all(both, days, n, tied):
    df = orders(days, n)
    df.loc[:tied, "o_totalprice"] = 600_000.0  # no row is over the percentile where it is the greatest value
    got, want = both("directional_return_table_peaks", orders=df)
    assert got == want


@pytest.mark.parametrize("days,n,tied", [(30, 3000, 0), (2400, 3000, 0), (60, 240, 220)])
def test_thresholds_of_large_tables_are_exact(both, monkeypatch, days, n, tied):
    monkeypatch.setattr("tidemark.operators.return_tables.SMALL", 0)
    df = orders(days, n)
    df.loc[:tied, "o_totalprice"] = 600_000.0
    got, want = both("directional_return_table_peaks", orders=df)
    assert got == want


@pytest.mark.parametrize("over", [1, 2, 3])
def test_levels_of_a_few_peaks(both, over):
    df = orders(2400, 500, np.linspace(1000, 299_999, 500))
    df.loc[: over - 1, ["o_orderdate", "o_totalprice"]] = [(pd.Timestamp("1996-01-01") + pd.Timedelta(days=100 * i), 400_000.0 + 7000 * i) for i in range(over)]
    got, want = both("peak_return_levels", orders=df)
    assert got == want and not any("~" in r for r in got)


@pytest.mark.parametrize("n", [100, 0])
def test_levels_without_a_peak_are_null(spark, tmp_path, n):
    orders(2400, n, np.linspace(1000, 299_999, n)).to_parquet(tmp_path / "orders.parquet", index=False)
    got = registry.QUERIES["peak_return_levels"](spark, str(tmp_path)).collect()
    assert sorted(r.period for r in got) == [50, 100, 1000] and all(r.value is None and r.non_exceedance is None for r in got)


def events(values):
    ts = pd.Timestamp("2024-01-30") + pd.to_timedelta(np.arange(len(values)), "h")
    return pd.DataFrame({"event_id": np.arange(len(values)), "ts": ts.astype("datetime64[us]"), "value": np.asarray(values, float)})


@pytest.mark.parametrize("values", [[300.0] * 80, [300.0] * 60 + [100.0] * 4 + [300.0] * 16, []])
def test_window_table_without_windows(both, values):
    got, want = both("weather_window", events=events(values))
    assert got == want and len(got) == (3 if 100.0 in values else 1)


@pytest.mark.parametrize("values", [[300.0] * 80, [300.0] * 60 + [100.0] * 4 + [300.0] * 16])
def test_window_percentile_without_windows(both, values):
    got, want = both("weather_window_p95", events=events(values))
    assert got == want and len(got) == (3 if 100.0 in values else 1)


@pytest.mark.parametrize("at", [0, 5, 25, 30])
def test_rows_without_a_time_come_last(both, at):
    df = events([100.0] * 3 + [300.0] * 20 + [100.0] * 3 + [300.0] * 9 + [100.0] * 2)
    df.loc[at, "ts"] = pd.NaT
    got, want = both("weather_window_p95", events=df)
    assert got == want


def test_waiting_takes_one_step_a_row(spark):
    """A frame up to the end is worked out anew for each row, so its time grows with the square of the series."""
    rows = spark.range(9).selectExpr("timestamp_ntz'2024-01-30' + make_dt_interval(0, int(id)) AS ts", "id % 5 AS x")
    waits = windows.waiting(rows, "ts", F.col("x") < 3, 3, 1.0)
    assert "unboundedfollowing" not in waits._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.wait_h for r in waits.orderBy("ts").collect()] == [3, 7, 6, 5, 4, 3]


def test_window_hours_do_not_depend_on_the_time_zone(both, spark):
    df = events(np.where(np.random.default_rng(1).random(3000) < 0.5, 100, 300))  # over the last Sunday of March, when 02:00 is missing
    df["ts"] = (df["ts"] + pd.Timedelta(seconds=59 * 60 + 59.999999)).astype("datetime64[us]")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Oslo")
    try:
        got, want = both("weather_window_p95", events=df)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want
