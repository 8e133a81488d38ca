"""Derivative-free minimisation of small problems: Nelder-Mead with restarts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _simplex(f: Callable[[np.ndarray], float], start: np.ndarray, step: float, rounds: int, tol: float) -> tuple[np.ndarray, float]:
    n = len(start)
    points = [start] + [start + np.where(np.arange(n) == k, step if start[k] == 0 else step * max(abs(start[k]), 0.1), 0.0) for k in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) <= tol * (abs(values[0]) + tol) and max(np.abs(p - points[0]).max() for p in points[1:]) < 1e-9 + 1e-7:
            break
        center = np.mean(points[:-1], axis=0)
        away = center - points[-1]
        trial = center + away
        v = f(trial)
        if v < values[0]:
            far = center + 2 * away
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (trial, v)
        elif v < values[-2]:
            points[-1], values[-1] = trial, v
        else:
            near = center + (0.5 if v < values[-1] else -0.5) * away
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], values[best]


def minimize(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.2, rounds: int = 0, tol: float = 1e-12, restarts: int = 3) -> np.ndarray:
    """The best point found; a restart rebuilds the simplex around it."""
    x, n = np.asarray(start, float), len(start)
    if n == 0:
        return x
    last = np.inf
    for k in range(restarts):
        x, v = _simplex(f, x, step / 4**k, rounds or 250 * n, tol)
        if last - v < 1e-10 * (1 + abs(v)):
            break
        last = v
    return x
