"""Seasonal decomposition and exponential smoothing."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.optimize import minimize
from statloom.operators.timeseries import by_key
from statloom.plans.formula import InsufficientData, InvalidInput


def seasonal_decompose(df: DataFrame, y: str, order: str, period: int, model: str = "additive", key: str | None = None) -> DataFrame:
    """Trend by a centred moving average (half weights at the ends of an even period),
    season by phase means, and what is left; windows by series, so ``key`` spreads work.
    Edges without a full window have a null trend and residual."""
    if period < 2 or model not in ("additive", "multiplicative"):
        raise InvalidInput("a period of two or more; additive or multiplicative")
    rows = df.select((F.col(key) if key else F.lit("all")).cast("string").alias("key"), F.col(order).alias("ord"), F.col(y).cast("double").alias("y"))
    w = Window.partitionBy("key").orderBy("ord")
    half = period // 2
    inner = w.rowsBetween(-half, half)
    if period % 2:
        trend = F.sum("y").over(inner) / period
    else:
        trend = (F.sum("y").over(inner) - 0.5 * (F.lag("y", half).over(w) + F.lead("y", half).over(w))) / period
    rows = rows.withColumns({"phase": (F.row_number().over(w) - 1) % period, "trend": F.when(F.count(F.lit(1)).over(inner) == 2 * half + 1, trend)})
    add = model == "additive"
    rows = rows.withColumn("__d", F.col("y") - F.col("trend") if add else F.col("y") / F.col("trend"))
    phases = rows.groupBy("key", "phase").agg(F.avg("__d").alias("__m"))
    level = phases.groupBy("key").agg(F.avg("__m").alias("__a"))
    phases = phases.join(level, "key").select("key", "phase", (F.col("__m") - F.col("__a") if add else F.col("__m") / F.col("__a")).alias("seasonal"))
    out = rows.join(phases, ["key", "phase"])
    resid = F.col("y") - F.col("trend") - F.col("seasonal") if add else F.col("y") / F.col("trend") / F.col("seasonal")
    return out.select("key", "ord", "y", "trend", "seasonal", resid.alias("resid"))


# ---------------------------------------------------------------- STL


def _loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: int, degree: int, weight: np.ndarray) -> np.ndarray:
    """Local regression with tricube weights on sorted, evenly spaced x."""
    n, out = len(x), np.empty(len(at))
    q = min(span, n)
    for k, v in enumerate(at):
        left = int(np.clip(np.searchsorted(x, v) - q // 2 - (q % 2 == 0), 0, n - q))
        while left + q < n and abs(x[left + q] - v) < abs(x[left] - v):
            left += 1
        while left > 0 and abs(x[left - 1] - v) < abs(x[left + q - 1] - v):
            left -= 1
        xs, ys = x[left : left + q], y[left : left + q]
        width = np.abs(xs - v).max()
        if span > n:
            width += (span - n) / 2
        r = np.abs(xs - v) / max(width, 1e-12)
        w = np.where(r < 0.999, np.where(r > 0.001, (1 - r**3) ** 3, 1.0), 0.0) * weight[left : left + q]
        total = w.sum()
        if total <= 0:
            out[k] = ys.mean()
            continue
        w = w / total
        mean = w @ xs
        spread = w @ (xs - mean) ** 2
        fit = w @ ys
        if degree and math.sqrt(max(spread, 0)) > 0.001 * (x[-1] - x[0] + 1e-12):
            fit += (v - mean) * (w @ ((xs - mean) * ys)) / spread
        out[k] = fit
    return out


def _mean_filter(x: np.ndarray, width: int) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(x)])
    return (c[width:] - c[:-width]) / width


def stl(y: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, low_pass: int | None = None, robust: bool = False, seasonal_degree: int = 1, trend_degree: int = 1, inner: int | None = None, outer: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, resid, weights) by seasonal-trend decomposition with loess."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 2 * period:
        raise InsufficientData(2 * period, n)
    odd = lambda v: int(v) + (int(v) % 2 == 0)
    trend = trend or odd(math.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    low_pass = low_pass or odd(period + 1)
    inner = inner if inner is not None else 2 if robust else 5
    outer = outer if outer is not None else 15 if robust else 0
    t, weight, tr, season = np.arange(n, dtype=float), np.ones(n), np.zeros(n), np.zeros(n)
    for turn in range(outer + 1):
        for _ in range(inner):
            bare = y - tr
            cycle = np.zeros(n + 2 * period)
            for phase in range(period):
                own = np.arange(phase, n, period)
                x = np.arange(len(own), dtype=float)
                cycle[phase :: period][: len(own) + 2] = _loess(x, bare[own], np.arange(-1, len(own) + 1, dtype=float), seasonal, seasonal_degree, weight[own])
            low = _mean_filter(_mean_filter(_mean_filter(cycle, period), period), 3)
            low = _loess(t, low, t, low_pass, 1, np.ones(n))
            season = cycle[period : period + n] - low
            tr = _loess(t, y - season, t, trend, trend_degree, weight)
        if turn < outer:
            r = np.abs(y - season - tr)
            h = 6 * np.median(r)
            u = r / max(h, 1e-300)
            weight = np.where(u <= 0.001, 1.0, np.where(u < 0.999, (1 - u**2) ** 2, 0.0))
    return tr, season, y - tr - season, weight


def stl_by_key(df: DataFrame, key: str, order: str, y: str, period: int, **options) -> DataFrame:
    def run(name: str, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[y].to_numpy()
        tr, se, re, _ = stl(v, period, **options)
        return pd.DataFrame({"key": name, "t": np.arange(len(v)), "y": v, "trend": tr, "seasonal": se, "resid": re})

    return by_key(df, key, order, [y], run, "key string, t long, y double, trend double, seasonal double, resid double")


# ---------------------------------------------------------------- exponential smoothing


@dataclass
class Smoothing:
    """Level, trend (none, add or damped) and season (none, add or mul), additive errors."""

    trend: str = "none"
    seasonal: str = "none"
    period: int = 0
    alpha: float | None = None
    beta: float | None = None
    gamma: float | None = None
    phi: float | None = None
    level0: float | None = None
    trend0: float | None = None
    season0: list[float] | None = None

    def initial(self, y: np.ndarray) -> tuple[float, float, np.ndarray]:
        m = self.period if self.seasonal != "none" else 0
        if m:
            if len(y) < 2 * m:
                raise InsufficientData(2 * m, len(y))
            one, two = y[:m].mean(), y[m : 2 * m].mean()
            level, slope = one, (two - one) / m
            season = y[:m] - one if self.seasonal == "add" else y[:m] / one
        else:
            level, slope, season = y[0], (y[1] - y[0] if len(y) > 1 else 0.0), np.zeros(0)
        level = self.level0 if self.level0 is not None else level
        slope = self.trend0 if self.trend0 is not None else slope
        return level, slope if self.trend != "none" else 0.0, np.array(self.season0, float) if self.season0 is not None else season


@dataclass
class SmoothingFit:
    model: Smoothing
    alpha: float
    beta: float
    gamma: float
    phi: float
    level: float
    slope: float
    season: np.ndarray
    fitted: np.ndarray = field(repr=False)
    sse: float = math.nan

    def forecast(self, steps: int) -> np.ndarray:
        out, damp = [], 0.0
        m = len(self.season)
        for h in range(1, steps + 1):
            damp += self.phi**h
            v = self.level + damp * self.slope
            if m:
                s = self.season[(h - 1) % m]
                v = v + s if self.model.seasonal == "add" else v * s
            out.append(v)
        return np.array(out)


def _smooth(y: np.ndarray, model: Smoothing, a: float, b: float, g: float, phi: float) -> SmoothingFit:
    level, slope, season = model.initial(y)
    season, fitted, m = list(season), np.empty(len(y)), len(season)
    for t, v in enumerate(y):
        base = level + phi * slope
        s = season[0] if m else 0.0
        fitted[t] = base + s if model.seasonal != "mul" else base * s
        free = v - s if model.seasonal == "add" else v / s if model.seasonal == "mul" else v
        new = a * free + (1 - a) * base
        slope = b * (new - level) + (1 - b) * phi * slope
        if m:
            own = v - base if model.seasonal == "add" else v / base
            season = [*season[1:], g * own + (1 - g) * s]
        level = new
    return SmoothingFit(model, a, b, g, phi, level, slope, np.array(season), fitted, float(((y - fitted) ** 2).sum()))


def exponential_smoothing(y: np.ndarray, model: Smoothing) -> SmoothingFit:
    """Parameters that are not given minimise the squared one-step errors."""
    y = np.asarray(y, float)
    use = [("alpha", model.alpha, 0.5, True), ("beta", model.beta, 0.1, model.trend != "none"), ("gamma", model.gamma, 0.1, model.seasonal != "none"), ("phi", model.phi, 0.98 if model.trend == "damped" else 1.0, model.trend == "damped")]
    fixed = {n: (v if v is not None else (0.0 if n != "phi" else 1.0)) for n, v, _, on in use if v is not None or not on}
    free = [n for n, v, _, on in use if v is None and on]

    def unpack(z: np.ndarray) -> dict[str, float]:
        got = dict(fixed)
        for n, v in zip(free, z, strict=True):
            got[n] = 0.8 + 0.198 / (1 + math.exp(-np.clip(v, -30, 30))) if n == "phi" else 1 / (1 + math.exp(-np.clip(v, -30, 30)))
        if "gamma" in free:
            got["gamma"] = min(got["gamma"], 1 - got["alpha"])
        return got

    def run(z: np.ndarray) -> SmoothingFit:
        p = unpack(z)
        return _smooth(y, model, p["alpha"], p["beta"], p["gamma"], p["phi"])

    if not free:
        return run(np.zeros(0))
    best = None
    for start in (0.2, 0.5, 0.8):
        z0 = np.array([math.log(start / (1 - start)) if n == "alpha" else 0.0 if n == "phi" else -2.0 for n in free])
        with np.errstate(all="ignore"):
            fit = run(minimize(lambda z: (lambda s: s if math.isfinite(s) else 1e300)(run(z).sse), z0, step=1.0))
        if best is None or fit.sse < best.sse:
            best = fit
    return best


def simple_smoothing(y: np.ndarray, alpha: float | None = None) -> SmoothingFit:
    return exponential_smoothing(y, Smoothing(alpha=alpha))


def holt(y: np.ndarray, damped: bool = False, **more) -> SmoothingFit:
    return exponential_smoothing(y, Smoothing(trend="damped" if damped else "add", **more))


def smoothing_by_key(df: DataFrame, key: str, order: str, y: str, model: Smoothing, steps: int = 1) -> DataFrame:
    """Fit every series: key, parameters, sse and forecasts."""

    def run(name: str, pdf: pd.DataFrame) -> pd.DataFrame:
        f = exponential_smoothing(pdf[y].to_numpy(), model)
        return pd.DataFrame([{"key": name, "n": len(pdf), "alpha": f.alpha, "beta": f.beta, "gamma": f.gamma, "phi": f.phi, "level": f.level, "slope": f.slope, "sse": f.sse, "forecast": list(f.forecast(steps))}])

    return by_key(df, key, order, [y], run, "key string, n long, alpha double, beta double, gamma double, phi double, level double, slope double, sse double, forecast array<double>")
