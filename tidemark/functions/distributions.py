"""Extreme-value distributions on numpy arrays: fits and return values."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions.moments import weibull

EULER = 0.5772156649015329


def _weights(x: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    return np.full(len(x), 1.0 / len(x)) if w is None else np.asarray(w, float) / np.sum(w)


def _bisect(off, low: float, high: float, steps: int = 200) -> float:
    """Root of a function that rises from below 0 to above."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if off(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit_exponential(x: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float]:
    return float(x.min()), max(0.0, float((x * _weights(x, w)).sum() - x.min()))  # 0, not a rounding error, where all are equal


def fit_gumbel(x: np.ndarray, lower: bool = False, w: np.ndarray | None = None) -> tuple[float, float]:
    """Maximum likelihood: the scale solves a one-dimensional equation, by bisection."""
    if lower:
        loc, scale = fit_gumbel(-x, w=w)
        return -loc, scale
    w = _weights(x, w)
    m, least = float((w * x).sum()), float(x.min())
    s = math.sqrt(max(0.0, float((w * (x - m) ** 2).sum())))
    if s <= 0:
        return m, 1e-12

    def off(b: float) -> float:
        e = w * np.exp(-(x - least) / b)
        return b - m + float((x * e).sum() / e.sum())

    b = _bisect(off, s * 1e-3, s * 10)
    return float(least - b * math.log((w * np.exp(-(x - least) / b)).sum())), float(b)


def fit_weibull2(x: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float]:
    """Maximum likelihood with location 0: shape and scale."""
    w = _weights(x, w)
    x, w = x[x > 0], w[x > 0]
    w = w / w.sum()
    logs = np.log(x / x.max())
    mean = float((w * logs).sum())

    def off(c: float) -> float:
        e = w * np.exp(c * logs)
        return float((logs * e).sum() / e.sum() - 1 / c - mean)

    c = _bisect(off, 1e-3, 500.0)
    return c, float(x.max() * (w * np.exp(c * logs)).sum() ** (1 / c))


def _by_location(x: np.ndarray, inner) -> tuple[float, ...]:
    """The parameters of `inner(loc)` = (log likelihood, parameters) at a local maximum over locations below the least value.

    Three-parameter likelihoods grow without bound as the location nears the least value, so the inner maximum is wanted;
    where there is none, the location furthest below (the limit) is taken.
    """
    least, spread = float(x.min()), float(x.max() - x.min()) or 1.0
    at = least - spread * np.exp(np.linspace(math.log(1e-4), math.log(30.0), 60))  # downwards
    found = [inner(a)[0] for a in at]
    inside = [i for i in range(1, len(at) - 1) if found[i] >= found[i - 1] and found[i] >= found[i + 1]]
    if not inside:
        return inner(float(at[-1]))[1]
    k = max(inside, key=lambda i: found[i])
    low, high = float(at[k + 1]), float(at[k - 1])
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(60):  # golden section
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if inner(a)[0] > inner(b)[0] else (a, high)
    return inner((low + high) / 2)[1]


def fit_weibull3(x: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float, float]:
    """Shape, location and scale by maximum likelihood."""
    w = _weights(x, w)

    def inner(loc: float):
        c, scale = fit_weibull2(x - loc, w)
        z = np.log((x - loc) / scale)
        return float((w * (math.log(c / scale) + (c - 1) * z - np.exp(c * z))).sum()), (c, loc, scale)

    return _by_location(x, inner)


def fit_lognormal3(x: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float, float]:
    """Sigma, location and scale (the exponential of mu) by maximum likelihood."""
    w = _weights(x, w)

    def inner(loc: float):
        y = np.log(x - loc)
        mu = float((w * y).sum())
        s = math.sqrt(max(1e-300, float((w * (y - mu) ** 2).sum())))
        return -mu - math.log(s), (s, loc, math.exp(mu))

    return _by_location(x, inner)


def fit_weibull_moments(x: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float, float]:
    """Shape, location and scale that match mean, variance and skewness."""
    w, x = _weights(x, w), x + 1e-4
    m = float((w * x).sum())
    v = float((w * (x - m) ** 2).sum())
    return weibull(m, v, float((w * (x - m) ** 3).sum()) / v**1.5)


def minimise(f, start: list[float], steps: int = 600) -> np.ndarray:
    """Nelder and Mead's simplex method."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + np.eye(n)[i] * (0.1 * abs(start[i]) or 0.05) for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < 1e-10 * (1 + abs(values[0])):
            break
        middle = np.mean(points[:-1], axis=0)
        for factor in (1.0, 2.0, -0.5, 0.5):
            trial = middle + factor * (middle - points[-1])
            value = f(trial)
            if factor == 1.0:
                first = trial, value
                if values[0] <= value < values[-2]:
                    break
                if value < values[0]:
                    continue
            elif factor == 2.0:
                if first[1] < values[0]:
                    trial, value = (trial, value) if value < first[1] else first
                    break
                continue
            elif value < values[-1]:
                break
        else:
            points = [points[0]] + [points[0] + (p - points[0]) / 2 for p in points[1:]]
            values = [f(p) for p in points]
            continue
        points[-1], values[-1] = trial, value
    return points[int(np.argmin(values))]


def fit_gev(x: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float, float]:
    """Shape c (its sign turned), location and scale by maximum likelihood."""
    w = _weights(x, w)

    def loss(p: np.ndarray) -> float:
        c, loc, scale = p
        if scale <= 0:
            return 1e12
        z = (x - loc) / scale
        if abs(c) < 1e-6:
            return math.log(scale) + float((w * (z + np.exp(-z))).sum())
        t = 1 - c * z
        if (t <= 0).any():
            return 1e12
        return math.log(scale) + float((w * ((1 - 1 / c) * np.log(t) + t ** (1 / c))).sum())

    loc, scale = fit_gumbel(x, w=w)
    return tuple(map(float, minimise(loss, [0.05, loc, scale])))


def fit_pareto(x: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float, float]:
    """Shape, location and scale of the generalised Pareto distribution by maximum likelihood. The likelihood grows with the
    location, so that is the least value."""
    w, loc = _weights(x, w), float(x.min())
    y = x - loc
    top, mean = float(y.max()), float((w * y).sum())

    def loss(p: np.ndarray) -> float:
        c, scale = p
        if scale <= 0 or c < -1 or (c < 0 and scale <= -c * top):
            return 1e12
        return math.log(scale) + (mean / scale if abs(c) < 1e-8 else (1 + 1 / c) * float((w * np.log1p(c * y / scale)).sum()))

    c, scale = minimise(loss, [0.05, max(1e-9, mean)])
    return float(c), loc, float(scale)


def fit_gennorm(x: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float, float]:
    """Shape, location and scale of the generalised normal distribution by maximum likelihood."""
    w = _weights(x, w)
    m = float((w * x).sum())
    s = math.sqrt(float((w * (x - m) ** 2).sum())) or 1e-9

    def loss(p: np.ndarray) -> float:
        b, loc, scale = p
        if b <= 0.05 or b > 60 or scale <= 0:
            return 1e12
        return math.log(2 * scale) + math.lgamma(1 / b) - math.log(b) + float((w * (np.abs(x - loc) / scale) ** b).sum())

    return tuple(map(float, minimise(loss, [2.0, m, s * math.sqrt(2)], 2000)))


def fit_exponentiated_weibull(x: np.ndarray, w: np.ndarray | None = None, delta: float | None = None) -> tuple[float, float, float]:
    """Exponent, shape and scale of F = (1 - exp(-(x / scale) ** shape)) ** exponent by maximum likelihood; delta fixes the exponent."""
    w = _weights(x, w)
    x, w = x[x > 0], w[x > 0]
    c, scale = fit_weibull2(x, w)

    def loss(p: np.ndarray) -> float:
        a, k, s = (delta, *p) if delta else p
        if min(a, k, s) <= 0:
            return 1e12
        z = (x / s) ** k
        return -float((w * (math.log(a * k / s) + (k - 1) * np.log(x / s) - z + (a - 1) * np.log(-np.expm1(-z) + 1e-300))).sum())

    found = minimise(loss, [c, scale] if delta else [1.0, c, scale], 2000)
    return (float(delta), *map(float, found)) if delta else tuple(map(float, found))


def fit_generalised_gamma(x: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float, float]:
    """Exponent a, shape c and scale of the density proportional to x ** (a c - 1) exp(-(x / scale) ** c), by maximum likelihood."""
    w = _weights(x, w)
    x, w = x[x > 0], w[x > 0]
    c, scale = fit_weibull2(x, w)
    logs = float((w * np.log(x)).sum())

    def loss(p: np.ndarray) -> float:
        a, k, s = p
        if min(a, k, s) <= 0 or a > 1e4:
            return 1e12
        return a * k * math.log(s) + math.lgamma(a) - math.log(k) - (a * k - 1) * logs + float((w * (x / s) ** k).sum())

    return tuple(map(float, minimise(loss, [1.0, c, scale], 2000)))


#: name -> (shape, location, scale) of values x with weights w; a shape that a distribution lacks is None.
FITS = {
    "EXP": lambda x, w=None: (None, *fit_exponential(x, w)),
    "GUM": lambda x, w=None: (None, *fit_gumbel(x, w=w)),
    "GUM_L": lambda x, w=None: (None, *fit_gumbel(x, True, w)),
    "GEV": fit_gev,
    "LoNo": fit_lognormal3,
    "Weibull2P": lambda x, w=None: (lambda c, s: (c, 0.0, s))(*fit_weibull2(x, w)),
    "Weibull3P": fit_weibull3,
    "Weibull3P_MOM": fit_weibull_moments,
    "GP": fit_pareto,
}
#: Other names of the same fits: peaks over a threshold and all rows have names of their own.
FITS |= {"Weibull_2P": FITS["Weibull2P"], "Weibull_3P": FITS["Weibull3P_MOM"]}


def exceeded(name: str, fit: tuple, p: np.ndarray) -> np.ndarray:
    """Values exceeded with probability p under a distribution of FITS (not reached with probability p, for GUM_L)."""
    p = np.asarray(p, float)
    c, loc, scale = fit
    if name == "EXP":
        return loc - scale * np.log(p)
    if name in ("GUM", "GUM_L"):
        return loc - scale * np.log(-np.log1p(-p)) if name == "GUM" else loc + scale * np.log(-np.log1p(-p))
    if name == "GEV":
        return loc - scale * np.log(-np.log1p(-p)) if abs(c) < 1e-9 else loc + scale / c * (1 - (-np.log1p(-p)) ** c)
    if name.startswith("Weibull"):
        return loc + scale * (-np.log(p)) ** (1 / c)
    if name == "GP":
        return loc - scale * np.log(p) if abs(c) < 1e-8 else loc + scale / c * (p**-c - 1)
    if name == "LoNo":
        return loc + scale * np.exp(c * normal_quantile(1 - p))
    raise ValueError(f"unknown distribution {name!r}")


def return_value(name: str, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Values exceeded with probability p under the distribution `name` fitted to x."""
    if name not in FITS:
        raise ValueError(f"unknown distribution {name!r}")
    return exceeded(name, FITS[name](x), p)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution by bisection on erf."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    erf = np.vectorize(math.erf, otypes=[float])
    for _ in range(80):
        mid = (low + high) / 2
        less = 0.5 * (1 + erf(mid / math.sqrt(2))) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2
