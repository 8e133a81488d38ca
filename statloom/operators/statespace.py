"""Linear Gaussian state-space models with one observation a step: Kalman filter, smoother,
forecasts; numpy by series, and as a stateful operator over streams (see ``streaming``)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from statloom.operators.timeseries import by_key
from statloom.plans.formula import InvalidInput


@dataclass
class Filtered:
    llf: float
    states: np.ndarray
    covs: np.ndarray
    predicted: np.ndarray
    predicted_covs: np.ndarray
    innovations: np.ndarray
    variances: np.ndarray


@dataclass
class StateSpace:
    """x' = T x + c + noise(Q), y = Z x + d + noise(H), x0 ~ (a, P) before the first step's
    observation. A NaN observation is a gap: the state is only carried on."""

    transition: np.ndarray
    noise: np.ndarray
    design: np.ndarray
    obs_variance: float
    start: np.ndarray
    start_cov: np.ndarray
    obs_mean: float = 0.0

    def filter(self, y: np.ndarray, extra_mean: np.ndarray | None = None) -> Filtered:
        y = np.asarray(y, float)
        if np.isinf(y).any():
            raise InvalidInput("infinite observation")
        n, m = len(y), len(self.start)
        out = Filtered(0.0, np.zeros((n, m)), np.zeros((n, m, m)), np.zeros((n, m)), np.zeros((n, m, m)), np.full(n, np.nan), np.full(n, np.nan))
        a, p, z = self.start, self.start_cov, self.design
        for t in range(n):
            if t:
                a, p = self.transition @ a, self.transition @ p @ self.transition.T + self.noise
            out.predicted[t], out.predicted_covs[t] = a, p
            if not math.isnan(y[t]):
                f = float(z @ p @ z + self.obs_variance)
                v = y[t] - self.obs_mean - (extra_mean[t] if extra_mean is not None else 0.0) - float(z @ a)
                if f <= 0:
                    raise InvalidInput("the innovation variance is not positive")
                gain = p @ z / f
                a = a + gain * v
                p = p - np.outer(gain, z @ p)
                p = (p + p.T) / 2
                out.llf -= 0.5 * (math.log(2 * math.pi * f) + v * v / f)
                out.innovations[t], out.variances[t] = v, f
            out.states[t], out.covs[t] = a, p
        return out

    def smooth(self, f: Filtered) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed states and covariances (backward pass over a filter's output)."""
        s, c = f.states.copy(), f.covs.copy()
        for t in range(len(s) - 2, -1, -1):
            gain = f.covs[t] @ self.transition.T @ np.linalg.pinv(f.predicted_covs[t + 1])
            s[t] = f.states[t] + gain @ (s[t + 1] - f.predicted[t + 1])
            c[t] = f.covs[t] + gain @ (c[t + 1] - f.predicted_covs[t + 1]) @ gain.T
        return s, c

    def smooth_series(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.smooth(self.filter(y))

    def forecast_from(self, state: np.ndarray, cov: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        mean, variance = [], []
        for _ in range(steps):
            state, cov = self.transition @ state, self.transition @ cov @ self.transition.T + self.noise
            mean.append(self.obs_mean + float(self.design @ state))
            variance.append(float(self.design @ cov @ self.design + self.obs_variance))
        return np.array(mean), np.array(variance)

    def forecast(self, f: Filtered, steps: int) -> tuple[np.ndarray, np.ndarray]:
        return self.forecast_from(f.states[-1], f.covs[-1], steps)


def arma_model(mu: float, ar, ma, sigma2: float) -> StateSpace:
    """ARMA in companion form, started from its stationary distribution."""
    ar, ma = np.asarray(ar, float), np.asarray(ma, float)
    m = max(len(ar), len(ma) + 1)
    t = np.zeros((m, m))
    t[: len(ar), 0] = ar
    t[:-1, 1:] += np.eye(m - 1)
    if np.abs(np.linalg.eigvals(t)).max() >= 1:
        raise InvalidInput("the autoregression is not stationary")
    r = np.zeros(m)
    r[0] = 1.0
    r[1 : 1 + len(ma)] = ma
    q = sigma2 * np.outer(r, r)
    p = np.linalg.solve(np.eye(m * m) - np.kron(t, t), q.ravel()).reshape(m, m)
    z = np.zeros(m)
    z[0] = 1.0
    return StateSpace(t, q, z, 0.0, np.zeros(m), (p + p.T) / 2, mu)


def local_level(obs_variance: float, level_variance: float, level: float = 0.0, variance: float = 1e6) -> StateSpace:
    one = np.eye(1)
    return StateSpace(one, one * level_variance, np.ones(1), obs_variance, np.array([level]), one * variance)


def kalman_by_key(df: DataFrame, key: str, order: str, y: str, model: StateSpace, smooth: bool = False) -> DataFrame:
    """Filter (and smooth) every series: key, position, state, variance, innovation."""

    def run(name: str, pdf: pd.DataFrame) -> pd.DataFrame:
        f = model.filter(pdf[y].to_numpy())
        s, c = model.smooth(f) if smooth else (f.states, f.covs)
        return pd.DataFrame({"key": name, "t": np.arange(len(pdf)), "level": s @ model.design + model.obs_mean, "variance": np.einsum("i,nij,j->n", model.design, c, model.design), "innovation": f.innovations, "llf": f.llf})

    return by_key(df, key, order, [y], run, "key string, t long, level double, variance double, innovation double, llf double")


def local_level_by_key(df: DataFrame, key: str, order: str, y: str, obs_variance: float, level_variance: float, steps: int = 1) -> DataFrame:
    """Local level of every series: key, level, variance, llf and a flat forecast. The
    level starts at the series' first value with a diffuse variance."""

    def run(name: str, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[y].to_numpy()
        seen = v[~np.isnan(v)]
        m = local_level(obs_variance, level_variance, float(seen[0]) if len(seen) else 0.0)
        f = m.filter(v)
        return pd.DataFrame([{"key": name, "level": f.states[-1, 0], "variance": f.covs[-1, 0, 0], "llf": f.llf, "forecast": [float(f.states[-1, 0])] * steps}])

    return by_key(df, key, order, [y], run, "key string, level double, variance double, llf double, forecast array<double>")
