"""What all fitted models share: coefficients with inference, and robust covariances.

A model object holds small driver arrays only. Row-level output (fitted values,
residuals, leverage, predictions) stays a lazy projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.plans.formula import Design, InvalidInput
from statloom.plans.gram import cross, quadratic, sums
from statloom.plans.order import with_lags


@dataclass(frozen=True)
class Cov:
    """Kind of covariance: nonrobust, hc0 to hc3, hac (lags, ordered by column ``ord``)
    or cluster (by column ``grp``)."""

    kind: str = "nonrobust"
    lags: int = 0

    @staticmethod
    def of(x: Cov | str | None) -> Cov:
        if isinstance(x, Cov):
            return x
        x = (x or "nonrobust").lower()
        x = "hc1" if x == "robust" else x
        if x not in ("nonrobust", "hc0", "hc1", "hc2", "hc3", "cluster"):
            raise InvalidInput(f"unknown covariance {x!r}")
        return Cov(x)


def hac(lags: int) -> Cov:
    return Cov("hac", lags)


@dataclass
class WaldTest:
    statistic: float
    p_value: float
    f_statistic: float
    f_p_value: float
    df: int


def wald_test(beta: np.ndarray, cov: np.ndarray, r, q=None, df_resid: float = math.inf) -> WaldTest:
    """R beta = q as chi-squared and F."""
    r = np.atleast_2d(np.asarray(r, float))
    q = np.zeros(len(r)) if q is None else np.asarray(q, float)
    gap = r @ beta - q
    stat = float(gap @ np.linalg.solve(r @ cov @ r.T, gap))
    k = len(r)
    f = stat / k
    fp = dist.f_sf(f, k, df_resid) if math.isfinite(df_resid) else dist.chi2_sf(stat, k)
    return WaldTest(stat, dist.chi2_sf(stat, k), f, fp, k)


@dataclass
class Coefficients:
    """Estimates with standard errors; t inference where ``df_resid`` is finite."""

    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    df_resid: float = math.inf

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    @property
    def statistic(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.coef / self.se

    @property
    def p_values(self) -> np.ndarray:
        return np.array([dist.two_sided_t(t, self.df_resid) for t in self.statistic])

    def confidence_intervals(self, alpha: float = 0.05) -> np.ndarray:
        if not 0 < alpha < 1:
            raise InvalidInput("alpha lies between 0 and 1")
        q = dist.norm_ppf(1 - alpha / 2) if math.isinf(self.df_resid) else dist.t_ppf(1 - alpha / 2, self.df_resid)
        return np.column_stack([self.coef - q * self.se, self.coef + q * self.se])

    def wald_test(self, r, q=None) -> WaldTest:
        return wald_test(self.coef, self.cov, r, q, self.df_resid)

    def contrast(self, weights) -> WaldTest:
        return self.wald_test([list(weights)])

    def table(self, alpha: float = 0.05) -> list[tuple]:
        ci = self.confidence_intervals(alpha)
        return [(n, float(c), float(s), float(t), float(p), float(lo), float(hi)) for n, c, s, t, p, (lo, hi) in zip(self.names, self.coef, self.se, self.statistic, self.p_values, ci, strict=True)]

    def coef_table(self, spark: SparkSession, alpha: float = 0.05) -> DataFrame:
        return spark.createDataFrame(self.table(alpha), "term string, coef double, se double, statistic double, p_value double, lower double, upper double")

    def summary(self) -> str:
        def stars(p: float) -> str:
            return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "." if p < 0.1 else ""

        lines = [f"{'term':<20}{'coef':>14}{'se':>12}{'stat':>10}{'p':>10}"]
        lines += [f"{n:<20}{c:>14.6f}{s:>12.6f}{t:>10.3f}{p:>10.4f} {stars(p)}" for n, c, s, t, p, *_ in self.table()]
        return "\n".join(lines)


@dataclass
class Model(Coefficients):
    """A fitted regression: the design it came from, and its figures by name."""

    design: Design | None = None
    stats: dict[str, float] = field(default_factory=dict)
    converged: bool = True
    iterations: int = 0
    link: str = "identity"

    def __getattr__(self, name: str):
        stats = self.__dict__.get("stats", {})
        if name in stats:
            return stats[name]
        raise AttributeError(name)

    # ------------------------------------------------------------ rows

    def score_design(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """``df`` with predictor columns for scoring, by the training levels."""
        rows, x = self.design.rows(df)
        return rows, [F.lit(1.0), *x] if self.design.intercept else x

    def predict(self, df: DataFrame, name: str = "prediction", linear: bool = False) -> DataFrame:
        """``df`` with the fitted mean (or linear predictor) of each row."""
        rows, x = self.score_design(df)
        eta = F.lit(0.0)
        for b, c in zip(self.coef[: len(x)], x, strict=False):
            eta = eta + F.lit(float(b)) * c
        return rows.withColumn(name, eta if linear else inverse_link(self.link, eta)).drop(*[c for c in rows.columns if c.startswith("__x")])

    def predict_interval(self, df: DataFrame, alpha: float = 0.05) -> DataFrame:
        """``df`` with prediction, lower and upper: a Wald interval of the mean."""
        rows, x = self.score_design(df)
        q = dist.norm_ppf(1 - alpha / 2)
        k = len(x)
        eta = F.lit(0.0)
        for b, c in zip(self.coef[:k], x, strict=False):
            eta = eta + F.lit(float(b)) * c
        se = F.sqrt(F.greatest(quadratic(self.cov[:k, :k], x), F.lit(0.0)))
        one, two = inverse_link(self.link, eta - q * se), inverse_link(self.link, eta + q * se)
        out = rows.withColumns({"prediction": inverse_link(self.link, eta), "lower": F.least(one, two), "upper": F.greatest(one, two)})
        return out.drop(*[c for c in rows.columns if c.startswith("__x")])


def inverse_link(link: str, eta: Column) -> Column:
    if link == "identity":
        return eta
    if link == "log":
        return F.exp(F.greatest(F.least(eta, F.lit(700.0)), F.lit(-700.0)))
    if link == "logit":
        return F.when(eta >= 0, 1 / (1 + F.exp(-eta))).otherwise(F.exp(eta) / (1 + F.exp(eta)))
    if link == "inverse":
        return 1 / eta
    if link == "inverse_squared":
        return 1 / F.sqrt(eta)
    if link == "probit":
        return norm_cdf_column(eta)
    raise InvalidInput(f"unknown link {link!r}")


#: Fixed coefficients of Cody's rational Chebyshev approximations of erf and erfc.
_ERF = ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
_ERFC = ((2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3), (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3))
_TAIL = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def _ratio(tables: tuple, x: Column) -> Column:
    out = []
    for table in tables:
        total = F.lit(table[0])
        for c in table[1:]:
            total = total * x + c
        out.append(total)
    return out[0] / out[1]


def norm_cdf_column(x: Column) -> Column:
    """Standard normal CDF inside codegen, to double precision (Spark has no erf)."""
    z = F.abs(x) / math.sqrt(2)
    small = 0.5 * (1 - z * _ratio(_ERF, z * z))
    middle = 0.5 * F.exp(-z * z) * _ratio(_ERFC, z)
    r = 1 / (z * z)
    large = 0.5 * F.exp(-z * z) / z * (1 / math.sqrt(math.pi) - r * _ratio(_TAIL, r))
    upper = F.when(z <= 0.46875, small).when(z <= 4, middle).otherwise(large)
    return F.when(x >= 0, 1 - upper).otherwise(upper)


# ---------------------------------------------------------------- robust covariances


def sandwich(df: DataFrame, x: list[Column], score: Column, bread: np.ndarray, cov: Cov, n: int, leverage: Column | None = None) -> np.ndarray:
    """bread * meat * bread, the meat from rows of x * score.

    hc0/hc1 need one aggregate; hc2/hc3 the rows' leverage; cluster two aggregates
    (by group, then over groups); hac lagged scores over column ``ord``."""
    k = len(x)
    if cov.kind in ("hc0", "hc1", "hc2", "hc3"):
        weight = score * score
        if cov.kind in ("hc2", "hc3"):
            weight = weight / F.pow(F.greatest(1 - leverage, F.lit(1e-12)), F.lit(1.0 if cov.kind == "hc2" else 2.0))
        meat, _ = cross(df, x, weight=weight)
        if cov.kind == "hc1":
            meat = meat * n / (n - k)
    elif cov.kind == "cluster":
        by = df.groupBy("grp").agg(*[F.sum(c * score).alias(f"g{j}") for j, c in enumerate(x)])
        meat, (groups,) = cross(by, [F.col(f"g{j}") for j in range(k)], extra=[F.lit(1)])
        if groups < 2:
            raise InvalidInput("cluster covariance needs two groups")
        meat = meat * groups / (groups - 1) * (n - 1) / (n - k)
    elif cov.kind == "hac":
        rows = df.select("ord", *[(c * score).alias(f"g{j}") for j, c in enumerate(x)])
        g = [F.col(f"g{j}") for j in range(k)]
        meat, _ = cross(rows, g)
        lagged = with_lags(rows, [f"g{j}" for j in range(k)], list(range(1, cov.lags + 1)))
        for lag in range(1, cov.lags + 1):
            part, _ = cross(lagged, g, [F.coalesce(F.col(f"g{j}_{lag}"), F.lit(0.0)) for j in range(k)])
            meat = meat + (1 - lag / (cov.lags + 1)) * (part + part.T)
    else:
        raise InvalidInput(f"no sandwich for {cov.kind}")
    return bread @ meat @ bread


def log_likelihood_ratio(full: float, restricted: float, df: int) -> tuple[float, float]:
    stat = max(0.0, 2 * (full - restricted))
    return stat, dist.chi2_sf(stat, df)


def count_rows(df: DataFrame) -> int:
    return int(sums(df, [F.lit(1)])[0])
