"""Weights of integration rules over given points, so that an integral is a weighted sum."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def trapezoid(x: Sequence[float]) -> list[float]:
    h = np.diff(np.asarray(x, float))
    w = np.zeros(len(x))
    w[:-1] += h / 2
    w[1:] += h / 2
    return w.tolist()


def simpson(x: Sequence[float]) -> list[float]:
    """Simpson's rule over pairs of intervals of any width; a last single interval is integrated under the parabola through the
    last three points. Two points make a trapezoid."""
    x = np.asarray(x, float)
    n, w = len(x), np.zeros(len(x))
    if n < 3:
        return trapezoid(x)
    for i in range(0, n - 2, 2):
        a, b = x[i + 1] - x[i], x[i + 2] - x[i + 1]
        w[i] += (a + b) / 6 * (2 - b / a)
        w[i + 1] += (a + b) ** 3 / (6 * a * b)
        w[i + 2] += (a + b) / 6 * (2 - a / b)
    if n % 2 == 0:
        a, b = x[-2] - x[-3], x[-1] - x[-2]
        w[-1] += (2 * b * b + 3 * a * b) / (6 * (a + b))
        w[-2] += (b * b + 3 * a * b) / (6 * a)
        w[-3] -= b**3 / (6 * a * (a + b))
    return w.tolist()


def widths(x: Sequence[float]) -> list[float]:
    """Half the distance between both neighbours of each point, the whole one at the ends."""
    return [1.0] if len(x) < 2 else np.gradient(np.asarray(x, float), edge_order=1).tolist() if len(x) < 3 else [x[1] - x[0], *((b - a) / 2 for a, b in zip(x, x[2:])), x[-1] - x[-2]]
