"""Hierarchical joint models of two or three variables, with contours by inverse FORM and inverse SORM.

Each variable has a distribution whose parameters may depend on an earlier variable. Fitting takes one distributed
aggregation a variable: moments of all rows, or of the rows in intervals of the variable that it depends on; for fits by maximum
likelihood, counts and means of CLASSES classes of each. Only these rows (tens, or some thousands) reach the driver, where
curves are fitted to the interval parameters. Contour points come from spark.range(), so their number is bounded by no task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import distributions, moments, spliced
from tidemark.functions.distributions import normal_quantile
from tidemark.functions.series import clean

#: Forms of dependence with the values that their fits start from.
FORMS = {
    "power3": (lambda x, a, b, c: a + b * x**c, [0.1, 1.0, 0.5]),
    "exp3": (lambda x, a, b, c: a + b * np.exp(c * x), [0.1, 0.1, -0.2]),
    "linear": (lambda x, a, b: a + b * x, [0.0, 1.0]),
    "log_root": (lambda x, a, b: np.log(a + b * np.sqrt(x)), [1.0, 1.0]),
    "logistic4": (lambda x, a, b, c, d: a + b / (1 + np.exp(-c * (x - d))), [1.0, 1.0, 0.5, 5.0]),
}
PARAMETERS = {
    "weibull": ("shape", "loc", "scale"), "weibull0": ("shape", "scale"), "lognormal": ("mu", "sigma"), "normal": ("mu", "sigma"), "vonmises": ("mu", "kappa"),
    "gennorm": ("shape", "loc", "scale"), "expweibull": ("exponent", "shape", "scale"), "spliced": ("mu", "sigma", "shape", "loc", "scale", "cut"),
}
CLASSES = 512


@dataclass(frozen=True)
class Dimension:
    """A variable: its family, the variable that it depends on and the form of each parameter, intervals (their number, or their
    width within `limits`), the rows that one must have, and how it is fitted. fixed: parameters that aren't fitted."""

    family: str
    given: int | None = None
    forms: dict[str, str] = field(default_factory=dict)
    intervals: int = 15
    least: int = 10
    method: str = "mom"
    width: float | None = None
    limits: tuple[float, float] | None = None
    fixed: dict[str, float] = field(default_factory=dict)


_TWO_WEIBULL = {"shape": "power3", "scale": "power3"}
_LOGNORMAL = {"mu": "power3", "sigma": "exp3"}
PRESETS = {
    "hs_tp": (Dimension("weibull"), Dimension("lognormal", 0, {"mu": "log_root", "sigma": "exp3"})),
    "hs_u": (Dimension("weibull"), Dimension("weibull0", 0, _TWO_WEIBULL, 20)),
    "u_hs_tp": (Dimension("weibull0"), Dimension("weibull0", 0, _TWO_WEIBULL, 20, 50, "mle"), Dimension("lognormal", 1, _LOGNORMAL, 15, 50, "mle")),
    "u_misalignment": (Dimension("weibull0"), Dimension("vonmises", 0, {"mu": "linear", "kappa": "logistic4"}, 20, 50, "mle", 1.0, (0.0, 20.0))),
    "u_misalignment_normal": (Dimension("weibull0"), Dimension("normal", 0, {"mu": "logistic4", "sigma": "logistic4"}, 30)),
    "ct_hs_tp": (Dimension("gennorm", method="mle"), Dimension("weibull", 0, {"shape": "linear", "loc": "linear", "scale": "linear"}, 40, 50, "mom", 0.1, (-2.0, 2.0)), Dimension("lognormal", 1, _LOGNORMAL, 15, 20)),
    "omae2020": (Dimension("expweibull", method="mle"), Dimension("lognormal", 0, _LOGNORMAL, 15, 20)),
    "lonowe": (Dimension("spliced"), Dimension("lognormal", 0, _LOGNORMAL, 10)),
    "v_hs_tz": (Dimension("expweibull", method="mle"), Dimension("expweibull", 0, {"shape": "logistic4", "scale": "power3"}, 10, 10, "mle", fixed={"exponent": 5.0}), Dimension("lognormal", 1, {"mu": "log_root", "sigma": "exp3"}, 10)),
}
#: Names, symbols and units of the presets' variables.
SEMANTICS = {
    "hs_tp": (("Significant wave height", "H_s", "m"), ("Peak wave period", "T_p", "s")),
    "hs_u": (("Significant wave height", "H_s", "m"), ("Wind speed", "U", "m/s")),
    "u_hs_tp": (("Wind speed", "U", "m/s"), ("Significant wave height", "H_s", "m"), ("Peak wave period", "T_p", "s")),
    "u_misalignment": (("Wind speed", "U", "m/s"), ("Misalignment", "M", "degrees")),
    "u_misalignment_normal": (("Wind speed", "U", "m/s"), ("Misalignment", "M", "degrees")),
    "ct_hs_tp": (("Surface current along the waves", "C_s", "m/s"), ("Significant wave height", "H_s", "m"), ("Peak wave period", "T_p", "s")),
    "omae2020": (("Significant wave height", "H_s", "m"), ("Wave period", "T_z", "s")),
    "lonowe": (("Significant wave height", "H_s", "m"), ("Peak wave period", "T_p", "s")),
    "v_hs_tz": (("Wind speed", "V", "m/s"), ("Significant wave height", "H_s", "m"), ("Zero-crossing period", "T_z", "s")),
}


def semantics(model: str | tuple[Dimension, ...]) -> list[tuple[str, str, str]]:
    """(name, symbol, unit) of each variable; plain ones for models that aren't presets."""
    return list(SEMANTICS[model]) if isinstance(model, str) else [(f"Variable {i + 1}", f"X_{i + 1}", "-") for i in range(len(model))]


def _sums(x: str) -> list:
    c = F.col(x)
    logs = F.when(c > 0, F.log(c))
    return [
        F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var"), F.skewness(c).alias("skew"), F.avg(logs).alias("log_mean"),
        F.stddev_pop(logs).alias("log_std"), F.avg(F.sin(F.radians(c))).alias("sine"), F.avg(F.cos(F.radians(c))).alias("cosine"),
    ]


def _parameters(family: str, r) -> dict[str, float]:
    if family == "weibull":
        return dict(zip(PARAMETERS[family], moments.weibull(r["mean"], r["var"], r["skew"])))
    if family == "weibull0":
        return dict(zip(PARAMETERS[family], moments.weibull_at_zero(r["mean"], r["var"])))
    if family == "lognormal":
        return {"mu": r["log_mean"], "sigma": r["log_std"]}
    if family == "normal":
        return {"mu": r["mean"], "sigma": math.sqrt(r["var"])}
    if family == "vonmises":
        return {"mu": math.degrees(math.atan2(r["sine"], r["cosine"])), "kappa": moments.von_mises_kappa(math.hypot(r["sine"], r["cosine"]))}
    raise ValueError(f"unknown distribution {family!r}, or not one that moments tell")


def _by_classes(d: Dimension, x: np.ndarray, w: np.ndarray) -> dict[str, float]:
    """Parameters of values (means of classes) with weights (their counts): by maximum likelihood, or those that need values."""
    names = PARAMETERS[d.family]
    if d.family == "spliced":
        return spliced.fit(x, w, d.method).parameters()
    if d.family == "gennorm":
        return dict(zip(names, distributions.fit_gennorm(x, w)))
    if d.family == "expweibull":
        return dict(zip(names, distributions.fit_exponentiated_weibull(x, w, d.fixed.get("exponent"))))
    if d.family == "weibull":
        return dict(zip(names, distributions.fit_weibull3(x, w)))
    if d.family == "weibull0":
        return dict(zip(names, distributions.fit_weibull2(x, w)))
    p = w / w.sum()
    if d.family in ("lognormal", "normal"):
        y = np.log(np.maximum(x, 1e-12)) if d.family == "lognormal" else x
        mu = float((p * y).sum())
        return {"mu": mu, "sigma": math.sqrt(float((p * (y - mu) ** 2).sum()))}
    if d.family == "vonmises":
        sine, cosine = (float((p * g(np.radians(x))).sum()) for g in (np.sin, np.cos))
        return {"mu": math.degrees(math.atan2(sine, cosine)), "kappa": moments.von_mises_kappa(math.hypot(sine, cosine))}
    raise ValueError(f"unknown distribution {d.family!r}")


def _class_rows(df: DataFrame, name: str, k: Column) -> list:
    """k, x, w: counts and means of CLASSES classes of a column by interval k."""
    low, high = df.agg(F.min(name), F.max(name)).first()
    width = (high - low) / CLASSES or 1.0
    c = F.least(F.floor((F.col(name) - low) / width), F.lit(CLASSES - 1))
    return df.groupBy(k.alias("k"), c.alias("c")).agg(F.avg(name).alias("x"), F.count(F.lit(1)).alias("w")).orderBy("k", "c").collect()


_erf = np.vectorize(math.erf, otypes=[float])


def _normal_cdf(u: np.ndarray) -> np.ndarray:
    return np.clip(0.5 * (1 + _erf(u / math.sqrt(2))), 1e-15, 1 - 1e-15)


def _von_mises_quantile(mu: np.ndarray, kappa: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Degrees; by cumulated density, a row at a time."""
    t = np.linspace(-math.pi, math.pi, 4001)
    out = np.empty(len(p))
    for i, (k, q) in enumerate(zip(kappa, p)):
        w = np.exp(max(0.0, k) * (np.cos(t) - 1))
        total = np.concatenate(([0.0], np.cumsum((w[1:] + w[:-1]) / 2)))
        out[i] = np.interp(q * total[-1], total, t)
    return mu + np.degrees(out)


def _gennorm_quantile(shape: float, loc: float, scale: float, p: np.ndarray) -> np.ndarray:
    """By the cumulated density on a fine grid."""
    t = np.linspace(0, 60 ** (1 / shape), 20001)
    f = np.exp(-(t**shape))
    total = np.concatenate(([0.0], np.cumsum((f[1:] + f[:-1]) / 2)))
    side = np.interp(np.abs(2 * np.asarray(p) - 1), total / total[-1], t)
    return loc + np.sign(np.asarray(p) - 0.5) * scale * side


@dataclass(frozen=True)
class JointModel:
    """A fitted model: for each dimension its fixed parameters, or the curve (form, coefficients) of each."""

    dimensions: tuple[Dimension, ...]
    names: tuple[str, ...]
    fixed: tuple[dict[str, float], ...]
    curves: tuple[dict[str, tuple[str, tuple[float, ...]]], ...]

    def at(self, dim: int, given: np.ndarray | None, n: int) -> dict[str, np.ndarray]:
        d = self.dimensions[dim]
        if d.given is None:
            return {k: np.full(n, v) for k, v in self.fixed[dim].items()}
        x = np.asarray(given, float) if all(form == "linear" for form, _ in self.curves[dim].values()) else np.maximum(given, 1e-9)
        found = {k: FORMS[form][0](x, *coef) for k, (form, coef) in self.curves[dim].items()}
        found |= {k: np.full(n, v) for k, v in self.fixed[dim].items()}
        return {k: np.maximum(v, 1e-6) if k in ("shape", "scale", "sigma", "kappa") else v for k, v in found.items()}

    def quantile(self, dim: int, p: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        q, family = self.at(dim, given, len(p)), self.dimensions[dim].family
        if family in ("weibull", "weibull0"):
            return q.get("loc", 0.0) + q["scale"] * (-np.log1p(-p)) ** (1 / q["shape"])
        if family == "expweibull":
            return q["scale"] * (-np.log1p(-(p ** (1 / q["exponent"])))) ** (1 / q["shape"])
        if family == "vonmises":
            return _von_mises_quantile(q["mu"], q["kappa"], p)
        if family == "spliced":
            return spliced.Spliced(**{k: float(v[0]) for k, v in q.items()}).icdf(p)
        if family == "gennorm":
            return _gennorm_quantile(*(float(q[k][0]) for k in ("shape", "loc", "scale")), p)
        z = q["mu"] + q["sigma"] * normal_quantile(p)
        return np.exp(z) if family == "lognormal" else z

    def density(self, dim: int, x: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        x = np.asarray(x, float)
        q, family = self.at(dim, given, len(x)), self.dimensions[dim].family
        with np.errstate(all="ignore"):
            if family in ("weibull", "weibull0", "expweibull"):
                z = np.maximum((x - q.get("loc", 0.0)) / q["scale"], 0.0)
                f = q["shape"] / q["scale"] * z ** (q["shape"] - 1) * np.exp(-(z ** q["shape"]))
                f = f if family != "expweibull" else f * q["exponent"] * (-np.expm1(-(z ** q["shape"]))) ** (q["exponent"] - 1)
                out = np.where(z > 0, f, 0.0)
            elif family == "vonmises":
                t = np.linspace(0, math.pi, 2001)
                norm = np.array([2 * np.trapezoid(np.exp(k * (np.cos(t) - 1)), t) for k in np.maximum(q["kappa"], 0)])
                out = np.exp(np.maximum(q["kappa"], 0) * (np.cos(np.radians(x - q["mu"])) - 1)) / norm * math.pi / 180
            elif family == "spliced":
                out = spliced.Spliced(**{k: float(v[0]) for k, v in q.items()}).pdf(x)
            elif family == "gennorm":
                out = np.exp(-((np.abs(x - q["loc"]) / q["scale"]) ** q["shape"])) * q["shape"] / (2 * q["scale"] * np.vectorize(math.gamma)(1 / q["shape"]))
            else:
                y = np.log(np.maximum(x, 1e-300)) if family == "lognormal" else x
                out = np.exp(-0.5 * ((y - q["mu"]) / q["sigma"]) ** 2) / (q["sigma"] * math.sqrt(2 * math.pi)) / (np.maximum(x, 1e-300) if family == "lognormal" else 1.0)
                out = np.where(x > 0, out, 0.0) if family == "lognormal" else out
        return np.nan_to_num(out)

    def cumulated(self, dim: int, x: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """Distribution function, by bisection on the quantiles."""
        x = np.asarray(x, float)
        low, high = np.full(len(x), 1e-15), np.full(len(x), 1 - 1e-15)
        for _ in range(55):
            mid = (low + high) / 2
            less = self.quantile(dim, mid, given) < x
            low, high = np.where(less, mid, low), np.where(less, high, mid)
        return (low + high) / 2

    def joint_density(self, points: np.ndarray) -> np.ndarray:
        out = np.ones(len(points))
        for i, d in enumerate(self.dimensions):
            out = out * self.density(i, points[:, i], None if d.given is None else points[:, d.given])
        return out

    def points(self, u: np.ndarray) -> np.ndarray:
        """Standard normal coordinates to those of the variables."""
        out = np.empty(u.shape)
        for i, d in enumerate(self.dimensions):
            out[:, i] = self.quantile(i, _normal_cdf(u[:, i]), None if d.given is None else out[:, d.given])
        return out

    def parameter_rows(self) -> list[tuple[str, str, str, int, float]]:
        """variable, parameter, form, place of the coefficient, value."""
        rows = []
        for i, name in enumerate(self.names):
            rows += [(name, k, "constant", 0, float(v)) for k, v in self.fixed[i].items()]
            rows += [(name, k, form, j, float(v)) for k, (form, coef) in self.curves[i].items() for j, v in enumerate(coef)]
        return rows


def fit(df: DataFrame, names: list[str], model: str | tuple[Dimension, ...] | Callable[[], tuple[Dimension, ...]] = "hs_tp") -> JointModel:
    """The model of the columns `names`: a preset, its variables, or a function that gives them. Rows with a missing value don't count."""
    dimensions = PRESETS[model] if isinstance(model, str) else model() if callable(model) else model
    if len(dimensions) != len(names):
        raise ValueError(f"the model has {len(dimensions)} variables")
    df = clean(df.select(*names), *names).dropna()
    fixed, curves = [], []
    for d, name in zip(dimensions, names):
        by_sums = d.method == "mom" and d.family not in ("spliced", "gennorm", "expweibull")
        if d.given is None:
            if by_sums:
                fixed.append(_parameters(d.family, df.agg(*_sums(name)).first()))
            else:
                rows = _class_rows(df, name, F.lit(0))
                fixed.append(_by_classes(d, np.array([r["x"] for r in rows]), np.array([r["w"] for r in rows], float)))
            curves.append({})
            continue
        by = names[d.given]
        given = df if d.limits is None else df.where(F.col(by).between(*d.limits))
        low, high = given.agg(F.min(by), F.max(by)).first()
        if low is None:
            raise ValueError(f"{name} has no rows")
        width = d.width or (high - low) / d.intervals or 1.0
        low = d.limits[0] if d.limits else low
        last = max(1, math.ceil((d.limits[1] - d.limits[0]) / width - 1e-9) if d.width and d.limits else d.intervals) - 1
        k = F.least(F.floor((F.col(by) - low) / width), F.lit(last)).alias("k")
        rows = given.groupBy(k).agg(*_sums(name), F.avg(by).alias("at")).where((F.col("n") >= d.least) & (F.col("var") > 0)).orderBy("k").collect()  # one row an interval
        x, n = np.array([r["at"] for r in rows], float), np.array([r["n"] for r in rows], float)
        if by_sums:
            found = [_parameters(d.family, r) for r in rows]
        else:
            classes: dict = {}
            for r in _class_rows(given, name, F.least(F.floor((F.col(by) - low) / width), F.lit(last))):
                classes.setdefault(r["k"], []).append((r["x"], r["w"]))
            found = [_by_classes(d, *map(np.array, zip(*((v, float(w)) for v, w in classes[r["k"]])))) for r in rows]
        own = {}
        for parameter, form in d.forms.items():
            f, start = FORMS[form]
            if len(rows) < len(start):
                raise ValueError(f"{name} has only {len(rows)} intervals with {d.least} rows")
            y = np.array([p[parameter] for p in found], float)
            own[parameter] = (form, tuple(moments.curve(f, x, y, start, n).tolist()))
        fixed.append(dict(d.fixed))
        curves.append(own)
    return JointModel(tuple(dimensions), tuple(names), tuple(fixed), tuple(curves))


def radius(alpha: float, dims: int, method: str = "IFORM") -> float:
    """Of the sphere in standard normal space: the normal quantile, or the root of the chi-squared one (inverse SORM)."""
    if method == "IFORM":
        return float(normal_quantile(np.array([1 - alpha]))[0])
    if method != "ISORM":
        raise ValueError(f"unknown method {method!r}")
    if dims == 2:
        return math.sqrt(-2 * math.log(alpha))
    low, high = 0.0, 50.0
    for _ in range(200):
        r = (low + high) / 2
        inside = math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) * r * math.exp(-r * r / 2)
        low, high = (r, high) if 1 - inside > alpha else (low, r)
    return (low + high) / 2


def contour(spark: SparkSession, model: JointModel, years: float, hours: float = 1.0, points: int = 180, method: str = "IFORM") -> DataFrame:
    """point and the variables along the contour (a circle's image; for three variables a sphere's, evenly spread)."""
    dims = len(model.names)
    r = radius(hours / (years * 365.2422 * 24), dims, method)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            i = batch["id"].to_numpy()
            if dims == 2:
                angle = 2 * math.pi * i / points
                u = np.stack([np.cos(angle), np.sin(angle)], 1)
            else:
                z, angle = 1 - (2 * i + 1) / points, i * math.pi * (3 - math.sqrt(5))
                u = np.stack([np.sqrt(1 - z * z) * np.cos(angle), np.sqrt(1 - z * z) * np.sin(angle), z], 1)
            yield pd.DataFrame({"point": i, **{n: c for n, c in zip(model.names, model.points(r * u).T)}})

    return spark.range(points).mapInPandas(run, "point long, " + ", ".join(f"{n} double" for n in model.names))


def parameters(spark: SparkSession, model: JointModel) -> DataFrame:
    return spark.createDataFrame(model.parameter_rows(), "variable string, parameter string, form string, place int, value double")
