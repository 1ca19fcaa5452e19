"""A lognormal body with a Weibull tail from a cut on, as a distribution of its own."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tidemark.functions import distributions, moments

_erf = np.vectorize(math.erf, otypes=[float])
SEARCHED = (0.5, 0.95)  # shares of the greatest value between which the cut is looked for (fixed values)


@dataclass(frozen=True)
class Spliced:
    mu: float
    sigma: float
    shape: float
    loc: float
    scale: float
    cut: float

    def parameters(self) -> dict[str, float]:
        return {"mu": self.mu, "sigma": self.sigma, "shape": self.shape, "loc": self.loc, "scale": self.scale, "cut": self.cut}

    def _body(self, x: np.ndarray) -> np.ndarray:
        y = np.maximum(x, 1e-300)
        return np.exp(-((np.log(y) - self.mu) ** 2) / (2 * self.sigma**2)) / (y * self.sigma * math.sqrt(2 * math.pi))

    def _tail(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum((x - self.loc) / self.scale, 1e-300)
        return np.where(x > self.loc, self.shape / self.scale * z ** (self.shape - 1) * np.exp(-(z**self.shape)), 0.0)

    def pdf(self, x) -> np.ndarray:
        x = np.asarray(x, float)
        return np.where(x <= self.cut, self._body(x), self._tail(x))

    def cdf(self, x) -> np.ndarray:
        """The lognormal one up to the cut, the Weibull one above."""
        x = np.asarray(x, float)
        body = 0.5 * (1 + _erf((np.log(np.maximum(x, 1e-300)) - self.mu) / (self.sigma * math.sqrt(2))))
        tail = np.where(x > self.loc, -np.expm1(-(np.maximum((x - self.loc) / self.scale, 0.0) ** self.shape)), 0.0)
        return np.where(x <= self.cut, body, tail)

    def icdf(self, p) -> np.ndarray:
        """Of the two quantiles the lognormal one where their mean is at most the cut, else the Weibull one."""
        p = np.asarray(p, float)
        body = np.exp(self.mu + self.sigma * distributions.normal_quantile(p))
        tail = self.loc + self.scale * (-np.log1p(-p)) ** (1 / self.shape)
        return np.where((body + tail) / 2 <= self.cut, body, tail)

    def draw(self, n: int, seed: int = 1) -> np.ndarray:
        """n numbers: the body's share from below the cut, the others from above, each by its own inverse."""
        rng = np.random.default_rng(seed)
        share = float(self.cdf(self.cut))
        below = math.ceil(share * n)
        u = rng.random(below) * share
        body = np.exp(self.mu + self.sigma * distributions.normal_quantile(np.clip(u, 1e-15, 1 - 1e-15)))
        from_tail = -math.expm1(-(max(0.0, (self.cut - self.loc) / self.scale) ** self.shape))
        v = from_tail + rng.random(n - below) * (1 - from_tail)
        tail = self.loc + self.scale * (-np.log1p(-np.minimum(v, 1 - 1e-15))) ** (1 / self.shape)
        out = np.concatenate([body, tail])
        rng.shuffle(out)
        return out


def fit(x: np.ndarray, w: np.ndarray | None = None, method: str = "mom") -> Spliced:
    """Of values x > 0 with weights w, by moments or by maximum likelihood of both parts."""
    x = np.asarray(x, float)
    w = np.full(len(x), 1.0 / len(x)) if w is None else np.asarray(w, float) / np.sum(w)
    logs = np.log(np.maximum(x, 1e-12))
    mean = float((w * x).sum())
    var = float((w * (x - mean) ** 2).sum())
    if method == "mom":
        sigma2 = math.log1p(var / mean**2)
        mu, sigma = math.log(mean) - sigma2 / 2, math.sqrt(sigma2)
        shape, loc, scale = moments.weibull(mean, var, float((w * (x - mean) ** 3).sum()) / var**1.5)
    elif method == "mle":
        mu = float((w * logs).sum())
        sigma = math.sqrt(float((w * (logs - mu) ** 2).sum()))
        shape, loc, scale = distributions.fit_weibull3(x, w)
    else:
        raise ValueError(f"unknown method {method!r}")
    found = Spliced(mu, sigma, shape, loc, scale, 0.0)
    part = np.unique(x[(x > SEARCHED[0] * x.max()) & (x < SEARCHED[1] * x.max())])
    if len(part) < 3:
        return Spliced(mu, sigma, shape, loc, scale, float(part[-1]) if len(part) else float(x.max()))
    off = np.abs(found._tail(part) - found._body(part))
    dips = np.flatnonzero((off[1:-1] < off[:-2]) & (off[1:-1] < off[2:])) + 1
    return Spliced(mu, sigma, shape, loc, scale, float(part[dips[-1] if len(dips) else off.argmin()]))
