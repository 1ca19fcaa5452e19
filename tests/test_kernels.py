"""Numeric kernels against known parameters, sources and streams on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distributions as dist
from tidemark.functions import physics
from tidemark.operators import windows
from tidemark.sources.text import read_commented_csv, read_time_parts, write_csv
from tidemark.streaming.peaks import streaming_peaks

RNG = np.random.default_rng(5)


def test_fits_recover_parameters():
    u = RNG.random(40_000)
    assert dist.fit_gumbel(3 - 2 * np.log(-np.log(u))) == pytest.approx((3, 2), abs=0.08)
    assert dist.fit_weibull2(2 * (-np.log(u)) ** (1 / 1.5)) == pytest.approx((1.5, 2), abs=0.05)
    assert dist.fit_weibull_moments(1 + 2 * (-np.log(u)) ** (1 / 1.5)) == pytest.approx((1.5, 1, 2), abs=0.1)
    assert dist.fit_gev(3 + 2 / 0.1 * (1 - (-np.log(u)) ** 0.1)) == pytest.approx((0.1, 3, 2), abs=0.08)
    assert dist.fit_pareto(2 / 0.1 * (u**-0.1 - 1)) == pytest.approx((0.1, 0, 2), abs=0.08)
    assert dist.normal_quantile(np.array([0.5, 0.975])) == pytest.approx([0, 1.959964], abs=1e-5)


def test_dispersion_and_jonswap(spark):
    row = spark.range(1).select(physics.wave_number(F.lit(8.0), 20.0).alias("k"), physics.jonswap(F.lit(0.0), F.lit(2.0), F.lit(8.0)).alias("s")).first()
    w = 2 * math.pi / 8
    assert 9.82 * row["k"] * math.tanh(row["k"] * 20) == pytest.approx(w * w, rel=1e-6)
    assert row["s"] == 0.0


def test_window_needs_every_row(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 5, 1, 1, 1])], "ts int, v double")
    assert [r["start"] for r in windows.starts(df, "ts", F.col("v") < 2, 2).orderBy("ts").collect()] == [True, False, False, True, True, False]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("title\nmore\nYEAR M D H HS TP\n2020  1  2  3  1.5  7.0\n2020 1 2 6 nanx 8\n")
    rows = read_time_parts(spark, str(tmp_path / "a.txt"), ["hs", "tp"]).orderBy("ts").collect()
    assert [(r["ts"].hour, r["hs"], r["tp"]) for r in rows] == [(3, 1.5, 7.0), (6, None, 8.0)]
    (tmp_path / "b.csv").write_text("# note\ntime,x\n2020-01-02 03:00:00,4\n")
    df = read_commented_csv(spark, str(tmp_path / "b.csv"))
    assert df.first()["x"] == 4 and df.columns[0] == "ts"
    write_csv(df, str(tmp_path / "c"), "units m")
    assert "# units m" in spark.read.text(str(tmp_path / "c")).first()["value"]


def test_streaming_peaks(spark, tmp_path):
    data = [(f"2020-01-{d:02d} 00:00:00", v) for d, v in [(1, 9.0), (2, 12.0), (3, 1.0), (9, 11.0), (20, 15.0)]]
    df = spark.createDataFrame(data, "t string, v double").select(F.to_timestamp("t").alias("ts"), "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming_peaks(stream, "ts", "v", 5).writeStream.format("memory").queryName("peaks").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["peak"] for r in spark.table("peaks").collect()) == [11.0, 12.0]
