"""Joint models: wave height by a Weibull distribution, period given height by a lognormal one; contours by inverse FORM.

Sums come from one distributed pass per interval of height; only some tens of intervals reach the numeric fit.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.distributions import normal_quantile
from tidemark.functions.series import clean


def intervals(df: DataFrame, hs: str, tp: str, width: float, least: int = 10) -> DataFrame:
    """Rows, mean height, mean and deviation of the period's logarithm by interval [k width, (k + 1) width)."""
    df = clean(df, hs, tp).where(f"{hs} > 0 and {tp} > 0")
    out = df.groupBy(F.floor(F.col(hs) / width).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg(hs).alias("hs"), F.avg(F.log(tp)).alias("mu"), F.stddev_pop(F.log(tp)).alias("sigma"))
    return out.where(F.col("n") >= least).select("k", "n", *(F.round(c, 6).alias(c) for c in ("hs", "mu", "sigma")))


def _power(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """a + b x^c by weighted least squares over a grid of c."""
    best = (math.inf, 0.0, 0.0, 1.0)
    for c in np.linspace(0.05, 3.0, 60):
        m = np.stack([np.ones_like(x), x**c], 1) * np.sqrt(w)[:, None]
        coef, *_ = np.linalg.lstsq(m, y * np.sqrt(w), rcond=None)
        loss = float((w * (y - coef[0] - coef[1] * x**c) ** 2).sum())
        best = min(best, (loss, float(coef[0]), float(coef[1]), float(c)))
    return best[1:]


def contour(spark: SparkSession, df: DataFrame, hs: str, tp: str, width: float, years: float, hours: float, points: int = 72) -> DataFrame:
    """hs, tp along the contour of the given return period for sea states of `hours`."""
    rows = intervals(df, hs, tp, width).orderBy("k").toPandas()
    moments = clean(df, hs).agg(F.avg(hs), F.var_pop(hs), F.skewness(hs)).first()
    m, v, skew = (float(x or 0) for x in moments)
    low, high = 0.2, 10.0
    for _ in range(100):
        c = (low + high) / 2
        g1, g2, g3 = (math.gamma(1 + k / c) for k in (1, 2, 3))
        low, high = (c, high) if (g3 - 3 * g1 * g2 + 2 * g1**3) / (g2 - g1**2) ** 1.5 > skew else (low, c)
    scale = math.sqrt(v / (math.gamma(1 + 2 / c) - math.gamma(1 + 1 / c) ** 2))
    loc = m - scale * math.gamma(1 + 1 / c)
    x, w = rows["hs"].to_numpy(float), rows["n"].to_numpy(float)
    mu, sigma = _power(x, rows["mu"].to_numpy(float), w), _power(x, rows["sigma"].to_numpy(float), w)
    beta = float(normal_quantile(np.array([1 - hours / (years * 365.2422 * 24)]))[0])
    angle = np.linspace(0, 2 * math.pi, points, endpoint=False)
    u1, u2 = beta * np.cos(angle), beta * np.sin(angle)
    p = np.clip(0.5 * (1 - np.vectorize(math.erf)(u1 / math.sqrt(2))), 1e-15, 1 - 1e-15)
    h = loc + scale * (-np.log(p)) ** (1 / c)
    t = np.exp(mu[0] + mu[1] * np.maximum(h, 1e-9) ** mu[2] + np.maximum(1e-6, sigma[0] + sigma[1] * np.maximum(h, 1e-9) ** sigma[2]) * u2)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(h, t))], "point int, hs double, tp double")


