"""Time series: lag windows and Gram sums for whole series, numpy by key for sequential fits.

A series is (key, t, y); operators on one long series take an ``order`` column and cut
the lag windows in blocks, operators that fit many series run by key in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.optimize import minimize
from statloom.operators.base import Model
from statloom.operators.linear import fit_ols
from statloom.plans.formula import Design, InsufficientData, InvalidInput
from statloom.plans.gram import cross, solve_spd, sums
from statloom.plans.order import numbered, running, with_lags


def _series(df: DataFrame, order: str, *columns: str) -> DataFrame:
    return df.select(F.col(order).alias("ord"), *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)])


# ---------------------------------------------------------------- autocorrelation


def acf(df: DataFrame, y: str, order: str, lags: int) -> np.ndarray:
    """Biased autocorrelations, lag 0 first."""
    s = _series(df, order, y)
    n, total = sums(s, [F.lit(1), F.col("v0")])
    if n <= lags:
        raise InsufficientData(lags + 1, int(n))
    mean = total / n
    rows = with_lags(s, ["v0"], list(range(1, lags + 1)))
    c = F.col("v0") - mean
    got = sums(rows, [c * c, *[c * (F.col(f"v0_{k}") - mean) for k in range(1, lags + 1)]])
    return got / got[0]


def _levinson(r: np.ndarray) -> np.ndarray:
    out, phi, error = [1.0], np.zeros(0), 1.0
    for k in range(1, len(r)):
        last = (r[k] - phi @ r[k - 1 : 0 : -1]) / error if k > 1 else r[1]
        phi = np.concatenate([phi - last * phi[::-1], [last]])
        error *= 1 - last * last
        out.append(last)
    return np.array(out)


def pacf(df: DataFrame, y: str, order: str, lags: int, method: str = "yw") -> np.ndarray:
    """Partial autocorrelations: by Durbin-Levinson ("yw", "dl") or regressions ("ols")."""
    if method in ("yw", "dl"):
        return _levinson(acf(df, y, order, lags))
    rows = with_lags(_series(df, order, y), ["v0"], list(range(1, lags + 1)))
    out = [1.0]
    for k in range(1, lags + 1):
        g, _ = cross(rows.filter(F.col(f"v0_{k}").isNotNull()), [F.lit(1.0), *[F.col(f"v0_{j}") for j in range(1, k + 1)], F.col("v0")])
        out.append(float(solve_spd(g[:-1, :-1], g[:-1, -1])[0][-1]))
    return np.array(out)


def ljung_box(df: DataFrame, y: str, order: str, lags: int) -> list[tuple[int, float, float]]:
    """(lag, Q, p) for each lag."""
    n = df.count()
    r = acf(df, y, order, lags)
    q = n * (n + 2) * np.cumsum(r[1:] ** 2 / (n - np.arange(1, lags + 1)))
    return [(k, float(v), dist.chi2_sf(v, k)) for k, v in enumerate(q, 1)]


# ---------------------------------------------------------------- lag regressions


def _lag_design(rows: DataFrame, target: str, names: list[str], intercept: bool = True) -> Design:
    rows = rows.select(F.col(target).alias("y"), *[F.col(c).alias(f"x{k}") for k, c in enumerate(names)])
    keep = F.lit(True)
    for k in range(len(names)):
        keep = keep & F.col(f"x{k}").isNotNull()
    return Design(rows.filter(keep), names, intercept)


def autoregression(df: DataFrame, y: str, order: str, p: int) -> Model:
    """AR(p) with a constant by least squares; ``.last`` holds the newest p values."""
    s = _series(df, order, y)
    m = fit_ols(_lag_design(with_lags(s, ["v0"], list(range(1, p + 1))), "v0", [f"v0_{k}" for k in range(1, p + 1)]))
    m.last = [r["v0"] for r in s.orderBy(F.desc("ord")).limit(p).collect()]
    return m


def ar_forecast(m: Model, steps: int) -> list[float]:
    past, out = list(m.last), []
    for _ in range(steps):
        out.append(float(m.coef[0] + m.coef[1:] @ np.array(past)))
        past = [out[-1], *past[:-1]]
    return out


@dataclass
class UnitRoot:
    statistic: float
    p_value: float
    lags: int
    critical: dict[str, float]


#: Fixed critical values and the p-values that go with them.
_ADF = {"1%": -3.43, "5%": -2.86, "10%": -2.57}
_KPSS_LEVEL = {"10%": 0.347, "5%": 0.463, "1%": 0.739}
_KPSS_TREND = {"10%": 0.119, "5%": 0.146, "1%": 0.216}
_COINTEGRATION = {"1%": -3.90, "5%": -3.34, "10%": -3.04}


def _adf_regression(s: DataFrame, lags: int, intercept: bool) -> float:
    rows = with_lags(s, ["v0"], [1])
    rows = rows.withColumn("v1", F.col("v0") - F.col("v0_1")).withColumnRenamed("v0_1", "level")
    if lags:
        rows = with_lags(rows.select("ord", "level", "v1"), ["v1"], list(range(1, lags + 1)))
    # one usable row fewer than there could be: the series starts after lags + 1 differences
    first = numbered(rows.filter(F.col("v1").isNotNull()), "ord", "i").filter(F.col("i") > lags + 1)
    m = fit_ols(_lag_design(first, "v1", ["level", *[f"v1_{k}" for k in range(1, lags + 1)]], intercept))
    return float(m.statistic[1 if intercept else 0])


def adf(df: DataFrame, y: str, order: str, lags: int = 1) -> UnitRoot:
    """Augmented Dickey-Fuller with a constant; p interpolated, not below 0.01."""
    t = _adf_regression(_series(df, order, y), lags, True)
    p = float(np.interp(t, [-3.43, -2.86, -2.57, -1.94, -0.44, 0.6], [0.01, 0.05, 0.10, 0.31, 0.90, 0.99]))
    return UnitRoot(t, p, lags, dict(_ADF))


def kpss(df: DataFrame, y: str, order: str, lags: int, trend: bool = False) -> UnitRoot:
    """Stationarity around a level or a trend, with Bartlett's long-run variance."""
    s = numbered(_series(df, order, y), "ord", "i")
    x = [F.lit(1.0), F.col("i").cast("double")] if trend else [F.lit(1.0)]
    g, (n,) = cross(s, [*x, F.col("v0")], extra=[F.lit(1)])
    beta, _ = solve_spd(g[:-1, :-1], g[:-1, -1])
    fit = sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
    rows = running(s.select("ord", (F.col("v0") - fit).alias("e")), {"e_s": ("sum", F.col("e"))}, "ord")
    lagged = with_lags(rows, ["e"], list(range(1, lags + 1)))
    got = sums(lagged, [F.col("e_s") ** 2, F.col("e") ** 2, *[F.col("e") * F.col(f"e_{k}") for k in range(1, lags + 1)]])
    variance = got[1] + 2 * sum((1 - k / (lags + 1)) * got[1 + k] for k in range(1, lags + 1))
    stat = got[0] / n**2 / (variance / n)
    return UnitRoot(stat, math.nan, lags, dict(_KPSS_TREND if trend else _KPSS_LEVEL))


def granger(df: DataFrame, y: str, x: str, order: str, lag: int) -> tuple[float, float]:
    """F test that x's lags help to predict y."""
    rows = with_lags(_series(df, order, y, x), ["v0", "v1"], list(range(1, lag + 1)))
    own, both = [f"v0_{k}" for k in range(1, lag + 1)], [f"v{c}_{k}" for c in (0, 1) for k in range(1, lag + 1)]
    small, full = fit_ols(_lag_design(rows, "v0", own)), fit_ols(_lag_design(rows, "v0", both))
    f = (small.ssr - full.ssr) / lag / (full.ssr / full.dof)
    return f, dist.f_sf(f, lag, full.dof)


def engle_granger(df: DataFrame, y: str, x: str, order: str, lags: int = 1) -> UnitRoot:
    """Cointegration: a unit-root test without constant on the residuals of y on x."""
    s = _series(df, order, y, x)
    m = fit_ols(Design(s.select(F.col("v0").alias("y"), F.col("v1").alias("x0"), "ord"), ["x"]))
    resid = s.select("ord", (F.col("v0") - float(m.coef[0]) - float(m.coef[1]) * F.col("v1")).alias("v0"))
    return UnitRoot(_adf_regression(resid, lags, False), math.nan, lags, dict(_COINTEGRATION))


# ---------------------------------------------------------------- several series


@dataclass
class Var:
    """``coef``: a row for each equation: constant, then lag 1 of all series, lag 2, ...,
    then the exogenous columns."""

    names: list[str]
    p: int
    coef: np.ndarray
    sigma: np.ndarray
    n: int
    aic: float
    bic: float
    last: np.ndarray  # newest row first
    exog: int = 0

    def matrices(self) -> list[np.ndarray]:
        k = len(self.names)
        return [self.coef[:, 1 + i * k : 1 + (i + 1) * k] for i in range(self.p)]

    def forecast(self, steps: int, exog: np.ndarray | None = None) -> np.ndarray:
        past, out = list(self.last), []
        for h in range(steps):
            row = np.concatenate([[1.0], *past[: self.p], *([exog[h]] if self.exog else [])])
            out.append(self.coef @ row)
            past = [out[-1], *past]
        return np.array(out)

    def responses(self, periods: int) -> list[np.ndarray]:
        """Moving-average matrices, the identity first."""
        a, out = self.matrices(), [np.eye(len(self.names))]
        for h in range(1, periods + 1):
            out.append(sum((a[j] @ out[h - 1 - j] for j in range(min(self.p, h))), np.zeros_like(out[0])))
        return out

    def impulse_response(self, periods: int, include_impact: bool = False) -> list[np.ndarray]:
        """Orthogonalised responses; without ``include_impact`` the first is one step after."""
        k = len(self.names)
        root = np.linalg.cholesky(self.sigma * (self.n - 1 - k * self.p - self.exog) / self.n)
        out = [m @ root for m in self.responses(periods)]
        return out if include_impact else out[1:]

    def forecast_interval(self, steps: int, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        point, total, q, se = self.forecast(steps), np.zeros_like(self.sigma), dist.norm_ppf(1 - alpha / 2), []
        for m in self.responses(steps)[:steps]:
            total = total + m @ self.sigma @ m.T
            se.append(np.sqrt(np.diag(total)))
        return point, point - q * np.array(se), point + q * np.array(se)


def var(df: DataFrame, columns: list[str], order: str, p: int, exog: list[str] | None = None) -> Var:
    """Vector autoregression (with exogenous columns): one Gram matrix for all equations."""
    k, exog = len(columns), list(exog or [])
    s = _series(df, order, *columns, *exog)
    rows = with_lags(s, [f"v{j}" for j in range(k)], list(range(1, p + 1))).filter(F.col(f"v0_{p}").isNotNull())
    x = [F.lit(1.0), *[F.col(f"v{j}_{lag}") for lag in range(1, p + 1) for j in range(k)], *[F.col(f"v{k + j}") for j in range(len(exog))]]
    y = [F.col(f"v{j}") for j in range(k)]
    g, (n,) = cross(rows, [*x, *y], extra=[F.lit(1)])
    q = len(x)
    beta, _ = solve_spd(g[:q, :q], g[:q, q:])
    resid = []
    for j in range(k):
        resid.append(y[j] - sum((float(b) * c for b, c in zip(beta[:, j], x, strict=True)), F.lit(0.0)))
    e, _ = cross(rows, resid)
    llf = sum(-n / 2 * (math.log(2 * math.pi * e[j, j] / n) + 1) for j in range(k))
    last = [[r[f"v{j}"] for j in range(k)] for r in s.orderBy(F.desc("ord")).limit(p).collect()]
    return Var(list(columns), p, beta.T, e / (n - q), int(n), 2 * k * q - 2 * llf, k * q * math.log(n) - 2 * llf, np.array(last), len(exog))


def varmax(df: DataFrame, columns: list[str], exog: list[str], order: str, p: int) -> Var:
    return var(df, columns, order, p, exog)


@dataclass
class Vecm:
    eigenvalues: np.ndarray
    trace: np.ndarray
    beta: np.ndarray
    alpha: np.ndarray
    n: int


def vecm(df: DataFrame, columns: list[str], order: str, lags: int = 1, rank: int = 1, compat: bool = False) -> Vecm:
    """Johansen's procedure without deterministic terms, from one Gram matrix of the
    differences, levels and lagged differences. ``compat`` symmetrises the eigenproblem's
    matrix and takes absolute eigenvalues, as the older convention has it."""
    k = len(columns)
    rows = with_lags(_series(df, order, *columns), [f"v{j}" for j in range(k)], [1])
    rows = rows.select("ord", *[(F.col(f"v{j}") - F.col(f"v{j}_1")).alias(f"d{j}") for j in range(k)], *[F.col(f"v{j}_1").alias(f"l{j}") for j in range(k)])
    if lags:
        rows = with_lags(rows, [f"d{j}" for j in range(k)], list(range(1, lags + 1)))
    short = [F.col(f"d{j}_{i}") for i in range(1, lags + 1) for j in range(k)]
    rows = rows.filter(F.col(f"d0_{lags}" if lags else "d0").isNotNull())
    g, (n,) = cross(rows, [*[F.col(f"d{j}") for j in range(k)], *[F.col(f"l{j}") for j in range(k)], *short], extra=[F.lit(1)])
    m = g[: 2 * k, : 2 * k]
    if short:
        m = m - g[: 2 * k, 2 * k :] @ np.linalg.solve(g[2 * k :, 2 * k :], g[2 * k :, : 2 * k])
    m = m / n
    s00, s01, s11 = m[:k, :k], m[:k, k:], m[k:, k:]
    if compat:
        core = np.linalg.solve(s11, s01.T) @ np.linalg.solve(s00, s01)
        value, vector = np.linalg.eigh((core + core.T) / 2)
        value = np.abs(value)
    else:
        root = np.linalg.inv(np.linalg.cholesky(s11))
        value, vector = np.linalg.eigh(root @ s01.T @ np.linalg.solve(s00, s01) @ root.T)
        vector = root.T @ vector
    order_ = np.argsort(value)[::-1]
    value, vector = np.clip(value[order_], 0, 1 - 1e-15), vector[:, order_]
    trace = -n * np.cumsum(np.log1p(-value)[::-1])[::-1]
    return Vecm(value, trace, vector[:, :rank], s01 @ vector[:, :rank], int(n))


# ---------------------------------------------------------------- ARIMA by key


def _poly(ar: np.ndarray, seasonal: np.ndarray, s: int, sign: float) -> np.ndarray:
    """Coefficients of the product polynomial 1 + sign*ar(B) times 1 + sign*seasonal(B^s)."""
    a = np.concatenate([[1.0], sign * ar])
    b = np.zeros(1 + s * len(seasonal))
    b[0] = 1.0
    for k, v in enumerate(seasonal, 1):
        b[k * s] = sign * v
    return np.convolve(a, b)


def _css(y: np.ndarray, mean: float, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Conditional residuals of an ARMA whose polynomials are given without the 1."""
    z, e = y - mean, np.zeros(len(y))
    p, q = len(ar), len(ma)
    for t in range(p, len(y)):
        e[t] = z[t] - (ar @ z[t - p : t][::-1] if p else 0.0)
        for j in range(1, min(q, t - p) + 1):
            e[t] -= ma[j - 1] * e[t - j]
    return e[p:]


@dataclass(frozen=True)
class ArimaSpec:
    p: int = 0
    d: int = 0
    q: int = 0
    P: int = 0
    D: int = 0
    Q: int = 0
    s: int = 1
    method: str = "css"  # or "exact"


@dataclass
class ArimaFit:
    spec: ArimaSpec
    mean: float
    ar: np.ndarray
    ma: np.ndarray
    seasonal_ar: np.ndarray
    seasonal_ma: np.ndarray
    sigma2: float
    llf: float
    aic: float
    bic: float
    n: int
    y: np.ndarray = field(repr=False)

    def polynomials(self) -> tuple[np.ndarray, np.ndarray]:
        """AR and MA parts of the product polynomials, without the leading 1."""
        s = self.spec.s
        return -_poly(self.ar, self.seasonal_ar, s, -1.0)[1:], _poly(self.ma, self.seasonal_ma, s, 1.0)[1:]

    def forecast(self, steps: int) -> np.ndarray:
        sp = self.spec
        levels, z = [], self.y
        for lag, times in ((1, sp.d), (sp.s, sp.D)):
            for _ in range(times):
                levels.append((lag, z))
                z = z[lag:] - z[:-lag]
        ar, ma = self.polynomials()
        e = np.concatenate([np.zeros(len(ar)), _css(z, self.mean, ar, ma)])
        w = list(z - self.mean)
        e = list(e)
        for _ in range(steps):
            value = sum(ar[k] * w[-1 - k] for k in range(min(len(ar), len(w)))) + sum(ma[k] * e[-1 - k] for k in range(min(len(ma), len(e))))
            w.append(value)
            e.append(0.0)
        out = np.array(w[len(z) :]) + self.mean
        for lag, before in reversed(levels):
            full = list(before)
            for v in out:
                full.append(v + full[-lag])
            out = np.array(full[len(before) :])
        return out

    def standard_errors(self, steps: int) -> np.ndarray:
        return forecast_standard_errors(self.ar, self.ma, self.spec.d, self.seasonal_ar, self.seasonal_ma, self.spec.D, self.spec.s, self.sigma2, steps)

    def forecast_interval(self, steps: int, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        point, se, q = self.forecast(steps), self.standard_errors(steps), dist.norm_ppf(1 - alpha / 2)
        return point, point - q * se, point + q * se


def forecast_standard_errors(ar, ma, d: int, seasonal_ar, seasonal_ma, ds: int, s: int, sigma2: float, steps: int) -> np.ndarray:
    """Standard errors of forecasts by the psi weights of the integrated process."""
    a = _poly(np.asarray(ar, float), np.asarray(seasonal_ar, float), s, -1.0)
    for lag, times in ((1, d), (s, ds)):
        for _ in range(times):
            diff = np.zeros(lag + 1)
            diff[0], diff[-1] = 1.0, -1.0
            a = np.convolve(a, diff)
    b = _poly(np.asarray(ma, float), np.asarray(seasonal_ma, float), s, 1.0)
    psi = np.zeros(steps)
    for j in range(steps):
        psi[j] = (b[j] if j < len(b) else 0.0) - sum(a[i] * psi[j - i] for i in range(1, min(j, len(a) - 1) + 1))
    return np.sqrt(sigma2 * np.cumsum(psi**2))


def arima_fit(y: np.ndarray, spec: ArimaSpec) -> ArimaFit:
    """Fit one series held in memory."""
    from statloom.operators.statespace import arma_model

    z = np.asarray(y, float)
    for lag, times in ((1, spec.d), (spec.s, spec.D)):
        for _ in range(times):
            z = z[lag:] - z[:-lag]
    sizes = [spec.p, spec.q, spec.P, spec.Q]
    most = spec.p + spec.s * spec.P
    if len(z) < most + sum(sizes) + 3:
        raise InsufficientData(most + sum(sizes) + 3, len(z))
    if spec.method == "exact" and (spec.P or spec.Q or spec.D):
        raise InvalidInput("exact likelihood is for models without seasonal parts; use css")
    edge = np.cumsum([1, *sizes])

    def parts(v: np.ndarray):
        return v[0], v[1 : edge[1]], v[edge[1] : edge[2]], v[edge[2] : edge[3]], v[edge[3] : edge[4]]

    def residuals(v: np.ndarray) -> np.ndarray:
        m, ar, ma, sar, sma = parts(v)
        return _css(z, m, -_poly(ar, sar, spec.s, -1.0)[1:], _poly(ma, sma, spec.s, 1.0)[1:])

    def loss(v: np.ndarray) -> float:
        if np.abs(v[1:]).max(initial=0) > 5:
            return 1e12
        e = residuals(v)
        total = float(e @ e)
        return math.log(total / len(e)) if np.isfinite(total) and total > 0 else 1e12

    start = np.zeros(edge[-1])
    start[0] = z.mean()
    if spec.p:
        centered = z - z.mean()
        x = np.stack([centered[spec.p - k - 1 : len(z) - k - 1] for k in range(spec.p)], 1)
        start[1 : edge[1]] = np.linalg.lstsq(x, centered[spec.p :], rcond=None)[0]
    start[edge[1] : edge[2]] = 0.05
    scale = np.concatenate([[max(z.std(), 1e-8)], np.ones(len(start) - 1)])
    best = minimize(lambda u: loss(u * scale), start / scale) * scale
    e = residuals(best)
    sigma2 = float(e @ e) / len(e)
    k, n = len(best), len(e)
    llf = -n / 2 * (math.log(2 * math.pi * sigma2) + 1)
    if spec.method == "exact":
        def nll(v: np.ndarray) -> float:
            try:
                return -arma_model(v[0] * scale[0], v[1 : edge[1]], v[edge[1] : edge[2]], math.exp(v[-1])).filter(z).llf
            except (ValueError, np.linalg.LinAlgError):
                return 1e12

        v = minimize(nll, np.concatenate([best / scale, [math.log(sigma2)]]))
        best, sigma2, llf, k, n = v[:-1] * scale, math.exp(v[-1]), -nll(v), k + 1, len(z)
    m, ar, ma, sar, sma = parts(best)
    return ArimaFit(spec, float(m), ar, ma, sar, sma, sigma2, llf, 2 * k - 2 * llf, k * math.log(n) - 2 * llf, n, np.asarray(y, float))


def by_key(df: DataFrame, key: str, order: str, columns: list[str], run: Callable[[str, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run(key, rows in order)`` for every series, in parallel over keys."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(order).alias("ord"), *[F.col(c).cast("double").alias(c) for c in columns])

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf["key"].iloc[0], pdf.sort_values("ord"))

    return rows.groupBy("key").applyInPandas(each, schema)


def arima(df: DataFrame, key: str, order: str, y: str, spec: ArimaSpec, steps: int = 0, alpha: float = 0.05) -> DataFrame:
    """Fit every series: key, parameters, llf, aic, bic, and forecasts with intervals."""

    def run(name: str, pdf: pd.DataFrame) -> pd.DataFrame:
        f = arima_fit(pdf[y].to_numpy(), spec)
        point, low, high = f.forecast_interval(steps, alpha) if steps else ([], [], [])
        return pd.DataFrame([{"key": name, "n": f.n, "mean": f.mean, "ar": list(f.ar), "ma": list(f.ma), "seasonal_ar": list(f.seasonal_ar), "seasonal_ma": list(f.seasonal_ma), "sigma2": f.sigma2, "llf": f.llf, "aic": f.aic, "bic": f.bic, "forecast": list(point), "lower": list(low), "upper": list(high)}])

    lists = ", ".join(f"{c} array<double>" for c in ("ar", "ma", "seasonal_ar", "seasonal_ma"))
    return by_key(df, key, order, [y], run, f"key string, n long, mean double, {lists}, sigma2 double, llf double, aic double, bic double, forecast array<double>, lower array<double>, upper array<double>")


def sarimax(df: DataFrame, key: str, order: str, y: str, exog: list[str], spec: ArimaSpec) -> DataFrame:
    """Regression on exogenous columns, then an ARIMA of what is left, for every series."""

    def run(name: str, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), pdf[exog].to_numpy()])
        beta = np.linalg.lstsq(x, pdf[y].to_numpy(), rcond=None)[0]
        f = arima_fit(pdf[y].to_numpy() - x @ beta, spec)
        return pd.DataFrame([{"key": name, "exog": list(beta), "mean": f.mean, "ar": list(f.ar), "ma": list(f.ma), "sigma2": f.sigma2, "llf": f.llf, "aic": f.aic}])

    return by_key(df, key, order, [y, *exog], run, "key string, exog array<double>, mean double, ar array<double>, ma array<double>, sigma2 double, llf double, aic double")
