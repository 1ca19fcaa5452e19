"""Every registered metocean query with SQL equals DuckDB on the smallest tables; the others give rows."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def cell(x):
        if pd.isna(x):
            return "~"
        return str(x) if isinstance(x, (str, bool)) or not hasattr(x, "__float__") else f"{float(x):.8g}"

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


#: Without SQL, and their operators are held against known parameters in test_marine.py: too slow to run twice.
ELSEWHERE = ("lonowe_", "joint_", "return_crests", "directional_highest", "total_water", "surge_", "height_at", "current_at", "wave_induced", "steepness_curve", "extreme_profiles", "conditional_profiles_by_return", "monthly_return_table_", "directional_return_table_weibull", "annual_return_levels_", "peak_return_levels_")
NAMES = [n for n in sorted(registry.QUERIES) if n in registry.SQL or not n.startswith(ELSEWHERE)]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_bootstrap_makes_the_replicates_of_the_reference(spark, monkeypatch):
    given = []
    monkeypatch.setattr(registry.extremes, "return_values", lambda *a, **options: given.append(options))
    registry.QUERIES["return_values_bootstrap"](spark, SF)
    assert given == [{"bootstrap": 1000}]
