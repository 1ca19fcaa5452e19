"""Parameters from moments, so that fits need one distributed pass of sums; curves by Levenberg and Marquardt's method."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def _skewness(c: float) -> float:
    g1, g2, g3 = (math.gamma(1 + k / c) for k in (1, 2, 3))
    return (g3 - 3 * g1 * g2 + 2 * g1**3) / (g2 - g1**2) ** 1.5


def weibull(mean: float, var: float, skew: float) -> tuple[float, float, float]:
    """Shape, location and scale of the Weibull distribution with these moments."""
    low, high = 0.2, 3.5
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if _skewness(c) > abs(skew) else (low, c)
    scale = math.sqrt(var / (math.gamma(1 + 2 / c) - math.gamma(1 + 1 / c) ** 2))
    return c, mean - scale * math.gamma(1 + 1 / c), scale


def lognormal(mean: float, var: float, skew: float) -> tuple[float, float, float]:
    """Mu, sigma and location of the three-parameter lognormal distribution with these moments; skewness counts as 0.01 at least."""
    skew = max(skew, 0.01)
    low, high = 1e-6, 20.0  # w - 1 with (w + 2) sqrt(w - 1) = skewness, w = exp(sigma ** 2)
    for _ in range(200):
        w = (low + high) / 2
        low, high = (w, high) if (w + 3) * math.sqrt(w) < skew else (low, w)
    sigma = math.sqrt(math.log1p(w))
    mu = 0.5 * math.log(var / (w * (1 + w)))
    return mu, sigma, mean - math.exp(mu + sigma**2 / 2)


def weibull_at_zero(mean: float, var: float) -> tuple[float, float]:
    """Shape and scale of the Weibull distribution with location 0."""
    low, high, wanted = 0.2, 60.0, var / mean**2
    for _ in range(200):
        c = (low + high) / 2
        g1 = math.gamma(1 + 1 / c)
        low, high = (c, high) if math.gamma(1 + 2 / c) / g1**2 - 1 > wanted else (low, c)
    return c, mean / math.gamma(1 + 1 / c)


def von_mises_kappa(r: float) -> float:
    """Concentration of directions whose mean resultant has length r: A(kappa) = r, A a ratio of Bessel functions."""
    t = np.linspace(0, math.pi, 2001)
    low, high = 0.0, 700.0
    for _ in range(80):
        k = (low + high) / 2
        w = np.exp(k * (np.cos(t) - 1))
        low, high = (k, high) if float((w * np.cos(t)).sum() / w.sum()) < r else (low, k)
    return (low + high) / 2


def curve(f: Callable[..., np.ndarray], x: np.ndarray, y: np.ndarray, start: list[float], weights: np.ndarray | None = None, steps: int = 500) -> np.ndarray:
    """Parameters of y = f(x, *parameters) by damped least squares with a numeric Jacobian."""
    w = np.ones(len(x)) if weights is None else np.sqrt(np.asarray(weights, float) / np.max(weights))
    p, damping = np.array(start, float), 1e-2

    def off(q: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            r = (y - f(x, *q)) * w
        return np.where(np.isfinite(r), r, 1e9)

    r = off(p)
    for _ in range(steps):
        j = np.empty((len(x), len(p)))
        for i in range(len(p)):
            h = 1e-6 * max(1e-3, abs(p[i]))
            up = p.copy()
            up[i] += h
            j[:, i] = (off(up) - r) / h
        a, g = j.T @ j, j.T @ r
        for _ in range(25):
            step = np.linalg.lstsq(a + damping * np.diag(np.diag(a) + 1e-12), -g, rcond=None)[0]
            trial = off(p + step)
            if trial @ trial < r @ r:
                damping = max(1e-12, damping / 5)
                break
            damping *= 4
        else:
            break
        done = (r @ r - trial @ trial) <= 1e-14 * (r @ r + 1e-300)
        p, r = p + step, trial
        if done:
            break
    return p
