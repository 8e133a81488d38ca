"""Generalised linear and discrete-choice models.

The design is cached once; an iteration is one aggregate whose expressions hold the
current coefficients as literals, and a small solve on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.operators.base import Cov, Model, inverse_link, log_likelihood_ratio, norm_cdf_column, sandwich
from statloom.operators.linear import _design, fit_ols
from statloom.plans.formula import Design, InsufficientData, InvalidInput, StatError
from statloom.plans.gram import cross, quadratic, solve_spd, sums


class NotConverged(StatError):
    pass


@dataclass(frozen=True)
class Family:
    """Per-row pieces of a family with a link, as functions of columns."""

    name: str
    link: str

    def mean(self, eta: Column) -> Column:
        return inverse_link(self.link, eta)

    def slope(self, eta: Column, mu: Column) -> Column:
        """d mu / d eta."""
        return {"identity": F.lit(1.0), "log": mu, "logit": mu * (1 - mu), "inverse": -mu * mu, "inverse_squared": -0.5 * mu * mu * mu}[self.link]

    def variance(self, mu: Column) -> Column:
        return {"gaussian": F.lit(1.0), "binomial": mu * (1 - mu), "poisson": mu, "gamma": mu * mu, "inverse_gaussian": mu * mu * mu}[self.name]

    def deviance(self, y: Column, mu: Column) -> Column:
        if self.name == "gaussian":
            return (y - mu) ** 2
        if self.name == "binomial":
            return -2 * F.when(y > 0, F.log(F.greatest(mu, F.lit(1e-300)))).otherwise(F.log(F.greatest(1 - mu, F.lit(1e-300))))
        if self.name == "poisson":
            return 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu))
        if self.name == "gamma":
            return 2 * ((y - mu) / mu - F.log(y / mu))
        return (y - mu) ** 2 / (y * mu * mu)

    def likelihood(self, y: Column, mu: Column, scale: float) -> Column:
        if self.name == "binomial":
            return F.when(y > 0, F.log(F.greatest(mu, F.lit(1e-300)))).otherwise(F.log(F.greatest(1 - mu, F.lit(1e-300))))
        if self.name == "poisson":
            return y * F.log(F.greatest(mu, F.lit(1e-300))) - mu - log_gamma(y + 1)
        if self.name == "gamma":
            a = 1 / scale
            return a * F.log(a * y / mu) - F.log(y) - a * y / mu - math.lgamma(a)
        if self.name == "inverse_gaussian":
            return -0.5 * ((y - mu) ** 2 / (scale * y * mu * mu) + F.log(2 * math.pi * scale * y * y * y))
        return -0.5 * (math.log(2 * math.pi * scale) + (y - mu) ** 2 / scale)


def log_gamma(x: Column) -> Column:
    """ln Gamma of a column by Stirling's series after shifting up by eight."""
    product = F.lit(1.0)
    for k in range(8):
        product = product * (x + k)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


_DEFAULT_LINK = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "inverse", "inverse_gaussian": "log"}
#: Fixed names of the families.
_ALIASES = {"normal": "gaussian", "logit": "binomial", "logistic": "binomial", "inversegaussian": "inverse_gaussian", "invgauss": "inverse_gaussian"}


def family_of(name: str, link: str | None = None) -> Family:
    name = _ALIASES.get(name.lower(), name.lower())
    if name not in _DEFAULT_LINK:
        raise InvalidInput(f"unknown family {name!r}")
    return Family(name, link or _DEFAULT_LINK[name])


def glm(df: DataFrame, formula, family: str | Family = "gaussian", link: str | None = None, cov: Cov | str | None = None, group: str | None = None, order: str | None = None, exposure: str | None = None, max_iter: int = 100, tol: float = 1e-8) -> Model:
    """A GLM by iteratively reweighted least squares. Offsets of the formula enter every
    family as they are; ``exposure`` enters as its logarithm. Raises NotConverged."""
    fam = family if isinstance(family, Family) else family_of(family, link)
    cov = Cov.of(cov)
    d = _design(df, formula, None, group, order, **({"exposure": exposure} if exposure else {}))
    if fam.name == "gaussian" and fam.link == "identity" and not d.has_offset:
        return fit_ols(d, cov)
    shift = F.col("offset") if d.has_offset else F.lit(0.0)
    if exposure:
        shift = shift + F.log(F.col("exposure").cast("double"))
    d = d.with_df(d.df.withColumn("__shift", shift.cast("double")).persist())
    try:
        return _fit_glm(d, fam, cov, max_iter, tol)
    finally:
        d.df.unpersist()


def _fit_glm(d: Design, fam: Family, cov: Cov, max_iter: int, tol: float) -> Model:
    x, y, shift = d.x(), F.col("y"), F.col("__shift")
    k = len(x)
    wrong = {"binomial": ~y.isin(0.0, 1.0), "poisson": y < 0, "gaussian": F.isnan(y)}.get(fam.name, y <= 0)
    n, total, bad, push = sums(d.df, [F.lit(1), y, F.when(wrong | y.isNull(), 1).otherwise(0), F.exp(shift)])
    if bad:
        raise InvalidInput(f"{bad:.0f} responses are outside the family's domain")
    if n <= k:
        raise InsufficientData(k + 1, int(n))
    mean = total / n
    beta = np.zeros(k)
    start = {"log": math.log(max(total / push, 1e-12)), "logit": 0.0, "identity": mean, "inverse": 1 / mean if mean else 0, "inverse_squared": 1 / mean**2 if mean else 0}[fam.link]
    first_mu = (y + mean) / 2
    if d.intercept:
        beta[0] = start
    used, done = 0, False
    for used in range(1, max_iter + 1):
        if used == 1 and not d.intercept and fam.link in ("inverse", "inverse_squared", "log"):
            mu = F.greatest(first_mu, F.lit(1e-8))
            eta = {"inverse": 1 / mu, "inverse_squared": 1 / (mu * mu), "log": F.log(mu)}[fam.link]
        else:
            eta = d.linear(beta) + shift
            mu = fam.mean(eta)
        slope = fam.slope(eta, mu)
        variance = F.greatest(fam.variance(mu), F.lit(1e-12))
        w = F.greatest(slope * slope / variance, F.lit(1e-12))
        z = eta - shift + (y - mu) / F.when(F.abs(slope) > 1e-12, slope).otherwise(1e-12)
        g, _ = cross(d.df, [*x, z], weight=w)
        new, _ = solve_spd(g[:k, :k], g[:k, k])
        step, beta = float(np.abs(new - beta).max()), new
        if step < tol * max(1.0, float(np.abs(beta).max())):
            done = True
            break
    if not done:
        raise NotConverged(f"{fam.name} regression did not settle in {max_iter} steps")
    eta = d.linear(beta) + shift
    mu = fam.mean(eta)
    slope, variance = fam.slope(eta, mu), F.greatest(fam.variance(mu), F.lit(1e-12))
    w = slope * slope / variance
    g, (dev, pearson) = cross(d.df, x, weight=w, extra=[fam.deviance(y, mu), (y - mu) ** 2 / variance])
    _, inverse = solve_spd(g, np.zeros(k))
    scale = 1.0 if fam.name in ("binomial", "poisson") else pearson / (n - k)
    if cov.kind == "nonrobust":
        covariance = inverse * scale
    else:
        covariance = sandwich(d.df, x, (y - mu) * slope / variance, inverse, cov, int(n), quadratic(inverse, x) * w)
    null_mu = F.lit(mean) if not d.has_offset else F.exp(shift) * (total / push) if fam.link == "log" else F.lit(mean)
    llf, null_llf, null_dev = sums(d.df, [fam.likelihood(y, mu, scale), fam.likelihood(y, null_mu, scale), fam.deviance(y, null_mu)])
    stats = {"n": int(n), "llf": llf, "llnull": null_llf, "deviance": dev, "null_deviance": null_dev, "pearson_chi2": pearson, "scale": scale, "pseudo_r2": 1 - llf / null_llf if null_llf else math.nan, "aic": 2 * k - 2 * llf, "bic": k * math.log(n) - 2 * llf, "df_residual": n - k}
    out = Model(d.coef_names, beta, covariance, math.inf, design=d, stats=stats, iterations=used, link=fam.link)
    out.family, out.inverse = fam, inverse
    return out


def logistic(df: DataFrame, formula, **more) -> Model:
    return glm(df, formula, "binomial", **more)


def poisson(df: DataFrame, formula, **more) -> Model:
    return glm(df, formula, "poisson", **more)


def gamma(df: DataFrame, formula, link: str = "inverse", **more) -> Model:
    return glm(df, formula, "gamma", link, **more)


def inverse_gaussian(df: DataFrame, formula, link: str = "log", **more) -> Model:
    return glm(df, formula, "inverse_gaussian", link, **more)


# ---------------------------------------------------------------- after the fit


def glm_rows(m: Model) -> DataFrame:
    """Fitted mean and response, Pearson and deviance residuals of the training rows."""
    d, y = m.design, F.col("y")
    shift = F.col("__shift") if "__shift" in d.df.columns else F.lit(0.0)
    mu = m.family.mean(d.linear(m.coef) + shift)
    sign = F.when(y >= mu, 1.0).otherwise(-1.0)
    return d.df.withColumns({"fitted": mu, "resid_response": y - mu, "resid_pearson": (y - mu) / F.sqrt(F.greatest(m.family.variance(mu), F.lit(1e-300))), "resid_deviance": sign * F.sqrt(F.greatest(m.family.deviance(y, mu), F.lit(0.0)))})


def likelihood_ratio(m: Model) -> tuple[float, float]:
    """Against the constant alone."""
    return log_likelihood_ratio(m.llf, m.llnull, len(m.coef) - m.design.intercept)


def ratios(m: Model) -> dict[str, float]:
    """Odds ratios or incidence-rate ratios: exponentiated coefficients."""
    return {n: math.exp(b) for n, b in zip(m.names, m.coef, strict=True)}


def average_marginal_effects(m: Model, alpha: float = 0.05) -> list[tuple]:
    """Of a logit: (name, effect, se, z, p, lower, upper) by the delta method."""
    d = m.design
    p = m.family.mean(d.linear(m.coef))
    v = p * (1 - p)
    x = d.x()
    got = sums(d.df, [F.lit(1), v, *[(1 - 2 * p) * v * c for c in x]])
    n, mean, slope = got[0], got[1] / got[0], got[2:] / got[0]
    q, out = dist.norm_ppf(1 - alpha / 2), []
    for j in range(int(d.intercept), len(m.coef)):
        grad = m.coef[j] * slope
        grad[j] += mean
        effect, se = m.coef[j] * mean, math.sqrt(max(grad @ m.cov @ grad, 0))
        out.append((m.names[j], effect, se, effect / se, dist.two_sided_normal(effect / se), effect - q * se, effect + q * se))
    return out


# ---------------------------------------------------------------- probit, NB2


def _probit_rows(d: Design, beta: np.ndarray) -> tuple[DataFrame, Column, Column, Column]:
    """The design's rows with the linear predictor, its CDF and density as columns."""
    eta = d.linear(beta)
    p = F.greatest(F.least(norm_cdf_column(F.col("__eta")), F.lit(1 - 1e-12)), F.lit(1e-12))
    rows = d.df.withColumn("__eta", eta).withColumns({"__cdf": p, "__pdf": F.exp(-F.col("__eta") ** 2 / 2) / math.sqrt(2 * math.pi)})
    return rows, F.col("__eta"), F.col("__cdf"), F.col("__pdf")


def probit(df: DataFrame, formula, cov: Cov | str | None = None, group: str | None = None, order: str | None = None, max_iter: int = 100, tol: float = 1e-8) -> Model:
    """Fisher scoring; tells by ``converged`` whether it settled."""
    cov = Cov.of(cov)
    d = _design(df, formula, None, group, order)
    d = d.with_df(d.df.persist())
    try:
        x, y = d.x(), F.col("y")
        k, beta, done, used = len(x), np.zeros(len(x)), False, 0
        n, total = sums(d.df, [F.lit(1), y])
        for used in range(1, max_iter + 1):
            rows, eta, p, phi = _probit_rows(d, beta)
            w = phi * phi / (p * (1 - p))
            g, _ = cross(rows, [*x, eta + (y - p) / F.greatest(phi, F.lit(1e-300))], weight=w)
            new, _ = solve_spd(g[:k, :k], g[:k, k])
            step, beta = float(np.abs(new - beta).max()), new
            if step < tol:
                done = True
                break
        rows, eta, p, phi = _probit_rows(d, beta)
        g, (llf,) = cross(rows, x, weight=phi * phi / (p * (1 - p)), extra=[F.when(y > 0, F.log(p)).otherwise(F.log(1 - p))])
        _, inverse = solve_spd(g, np.zeros(k))
        covariance = inverse if cov.kind == "nonrobust" else sandwich(rows, x, (y - p) * phi / (p * (1 - p)), inverse, cov, int(n), quadratic(inverse, x))
    finally:
        d.df.unpersist()
    share = total / n
    null = n * (share * math.log(share) + (1 - share) * math.log(1 - share))
    return Model(d.coef_names, beta, covariance, math.inf, design=d, stats={"n": int(n), "llf": llf, "llnull": null, "aic": 2 * k - 2 * llf, "bic": k * math.log(n) - 2 * llf, "pseudo_r2": 1 - llf / null}, converged=done, iterations=used, link="probit")


def negative_binomial(df: DataFrame, formula, alpha: float | None = None, max_iter: int = 100, tol: float = 1e-6) -> Model:
    """NB2: reweighted least squares for the coefficients and Newton steps for the size
    1/alpha in turn. Sums of digammas come from the counts of each distinct response."""
    d = _design(df, formula)
    d = d.with_df(d.df.persist())
    try:
        base = _fit_glm(d.with_df(d.df.withColumn("__shift", F.lit(0.0))), family_of("poisson"), Cov(), 100, 1e-8)
        x, y, k, beta, n = d.x(), F.col("y"), len(d.x()), base.coef, base.n
        fixed = alpha is not None
        mu = F.exp(d.linear(beta))
        if not fixed:
            top, bottom = sums(d.df, [(y - mu) ** 2 - mu, mu * mu])
            alpha = max(top / bottom, 0.01)
        # responses are counts: their distinct values are few next to the rows
        values = [(float(r["y"]), r["count"]) for r in d.df.groupBy("y").count().collect()]
        done, used = False, 0
        for used in range(1, max_iter + 1):
            mu = F.exp(d.linear(beta))
            g, _ = cross(d.df, [*x, d.linear(beta) + (y - mu) / mu], weight=mu / (1 + alpha * mu))
            new, _ = solve_spd(g[:k, :k], g[:k, k])
            step, beta = float(np.abs(new - beta).max()), new
            if not fixed:
                r = 1 / alpha
                for _ in range(20):
                    mu = F.exp(d.linear(beta))
                    a, b = sums(d.df, [F.log(r / (r + mu)) + 1 - (y + r) / (r + mu), 1 / r - 2 / (r + mu) + (y + r) / (r + mu) ** 2])
                    score = a + sum(c * (dist.digamma(v + r) - dist.digamma(r)) for v, c in values)
                    bend = b + sum(c * (dist.trigamma(v + r) - dist.trigamma(r)) for v, c in values)
                    change = score / bend if bend < 0 else -math.copysign(0.1 * r, -score)
                    new_r = min(max(r - change, r / 4), r * 4)
                    small, r = abs(new_r - r) < 1e-9 * r, new_r
                    if small:
                        break
                step, alpha = max(step, abs(1 / r - alpha)), 1 / r
            if step < tol:
                done = True
                break
        mu, r = F.exp(d.linear(beta)), 1 / alpha
        g, (llf, curve, mixed) = cross(d.df, x, weight=mu / (1 + alpha * mu), extra=[y * F.log(alpha * mu / (1 + alpha * mu)) - r * F.log(1 + alpha * mu), F.lit(0.0), F.lit(0.0)])
        llf += sum(c * (math.lgamma(v + r) - math.lgamma(r) - math.lgamma(v + 1)) for v, c in values)
        _, inverse = solve_spd(g, np.zeros(k))
    finally:
        d.df.unpersist()
    free = k + (not fixed)
    return Model(d.coef_names, beta, inverse, math.inf, design=d, stats={"n": n, "alpha": alpha, "llf": llf, "aic": 2 * free - 2 * llf, "bic": free * math.log(n) - 2 * llf}, converged=done, iterations=used, link="log")


# ---------------------------------------------------------------- several classes


@dataclass
class ClassModel:
    """A model of classes: ``coef`` is classes-1 by predictors (multinomial) or slopes and
    cut points (ordered)."""

    classes: list
    names: list[str]
    coef: np.ndarray
    se: np.ndarray
    design: Design
    llf: float
    aic: float
    bic: float
    n: int
    converged: bool
    cuts: np.ndarray | None = None
    cut_se: np.ndarray | None = None

    def probabilities(self, x: list[Column] | None = None) -> list[Column]:
        """Of each class, for the rows of the design, or for predictors ``x``."""
        own = x or [F.col(f"x{k}") for k in range(len(self.design.names))]
        line = lambda beta, of: sum((F.lit(float(b)) * c for b, c in zip(beta, of, strict=True)), F.lit(0.0))
        if self.cuts is None:
            etas = [F.lit(0.0), *[line(b, [F.lit(1.0), *own] if self.design.intercept else own) for b in self.coef]]
            top = F.greatest(*etas)
            parts = [F.exp(e - top) for e in etas]
            total = sum(parts[1:], parts[0])
            return [p / total for p in parts]
        eta = line(self.coef, own)
        below = [F.lit(0.0), *[inverse_link("logit", F.lit(float(c)) - eta) for c in self.cuts], F.lit(1.0)]
        return [b - a for a, b in zip(below, below[1:], strict=False)]

    def predict_proba(self, df: DataFrame | None = None) -> DataFrame:
        """Rows with ``probabilities`` by rising class, and the likeliest class: of the
        design, or of any frame that holds the formula's predictors."""
        if df is None:
            rows, x = self.design.df, None
        else:
            rows, x = self.design.rows(df)
        rows = rows.withColumn("probabilities", F.array(*self.probabilities(x)))
        best = F.get(F.array(*[F.lit(c) for c in self.classes]), (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))
        return rows.withColumn("predicted_class", best).drop(*[f"__x{k}" for k in range(len(self.design.names))])


def multinomial(df: DataFrame, formula, max_iter: int = 200, tol: float = 1e-8) -> ClassModel:
    """Softmax regression by Newton steps; the smallest class is the base."""
    d = _design(df, formula)
    d = d.with_df(d.df.persist())
    try:
        classes = [r["y"] for r in d.df.select("y").distinct().orderBy("y").collect()]
        if len(classes) < 2:
            raise InvalidInput("a single class")
        x, q, m = d.x(), len(d.x()), len(classes) - 1
        b, done, llf, hess, n = np.zeros((m, q)), False, 0.0, np.eye(m * q), 0
        for _ in range(max_iter):
            probe = ClassModel(classes, [], b, b, d, 0, 0, 0, 0, False)
            p = probe.probabilities()
            hit = [(F.col("y") == F.lit(c)).cast("double") for c in classes]
            own = sum((h * F.log(F.greatest(v, F.lit(1e-300))) for h, v in zip(hit[1:], p[1:], strict=True)), hit[0] * F.log(F.greatest(p[0], F.lit(1e-300))))
            pairs = [(i, j) for i in range(m) for j in range(i, m)]
            cells = [(i, j) for i in range(q) for j in range(i, q)]
            columns = [(hit[i + 1] - p[i + 1]) * x[j] for i in range(m) for j in range(q)]
            columns += [p[a + 1] * ((1.0 if a == c else 0.0) - p[c + 1]) * x[i] * x[j] for a, c in pairs for i, j in cells]
            got = _wide_sums(d.df, [*columns, own, F.lit(1)])
            grad, llf, n = got[: m * q], got[-2], int(got[-1])
            hess = np.zeros((m * q, m * q))
            for v, ((a, c), (i, j)) in zip(got[m * q : -2], [(u, w) for u in pairs for w in cells], strict=True):
                for (r, s), (e, f) in (((a, c), (i, j)), ((a, c), (j, i)), ((c, a), (i, j)), ((c, a), (j, i))):
                    hess[r * q + e, s * q + f] = v
            step = np.linalg.solve(hess + 1e-12 * np.eye(m * q), grad)
            b = b + step.reshape(m, q)
            if np.abs(step).max() < tol:
                done = True
                break
        se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hess)), 0)).reshape(m, q)
    finally:
        d.df.unpersist()
    return ClassModel(classes, d.coef_names, b, se, d, llf, 2 * m * q - 2 * llf, m * q * math.log(n) - 2 * llf, n, done)


def _wide_sums(df: DataFrame, columns: list[Column], at_once: int = 60) -> np.ndarray:
    """Sums of many columns, in a few aggregates of a size that still compiles."""
    return np.concatenate([sums(df, columns[k : k + at_once]) for k in range(0, len(columns), at_once)])


def ordered_logit(df: DataFrame, formula, max_iter: int = 200, tol: float = 1e-8) -> ClassModel:
    """Proportional odds by Newton steps on outer products of scores, with halving."""
    d = _design(df, formula)
    d = Design(d.df.persist(), d.names, False, d.formula, d.levels)
    try:
        rows = d.df.groupBy("y").count().orderBy("y").collect()
        classes, counts = [r["y"] for r in rows], np.array([r["count"] for r in rows], float)
        if len(classes) < 3:
            raise InvalidInput("ordered classes need three levels")
        n, q, m = int(counts.sum()), len(d.names), len(classes) - 1
        share = counts.cumsum()[:-1] / n
        cuts, beta, done = np.log(share / (1 - share)), np.zeros(q), False
        x = [F.col(f"x{k}") for k in range(q)]

        def scores(beta: np.ndarray, cuts: np.ndarray) -> tuple[list[Column], Column]:
            eta = F.lit(0.0)
            for b, c in zip(beta, x, strict=True):
                eta = eta + F.lit(float(b)) * c
            up, down = F.lit(1.0), F.lit(0.0)
            for k, c in enumerate(classes):
                if k < m:
                    up = F.when(F.col("y") == F.lit(c), inverse_link("logit", F.lit(float(cuts[k])) - eta)).otherwise(up)
                if k > 0:
                    down = F.when(F.col("y") == F.lit(c), inverse_link("logit", F.lit(float(cuts[k - 1])) - eta)).otherwise(down)
            p = F.greatest(up - down, F.lit(1e-300))
            du, dd = up * (1 - up), down * (1 - down)
            own = [-(du - dd) / p * c for c in x]
            own += [F.when(F.col("y") == F.lit(classes[k]), du / p).when(F.col("y") == F.lit(classes[k + 1]), -dd / p).otherwise(0.0) for k in range(m)]
            return own, F.log(p)

        own, ll = scores(beta, cuts)
        llf = sums(d.df, [ll])[0]
        bhhh = np.eye(q + m)
        for _ in range(max_iter):
            own, _ = scores(beta, cuts)
            bhhh, grad = cross(d.df, own, extra=own)
            step = np.linalg.solve(bhhh + 1e-8 * np.eye(q + m), grad)
            scale = 1.0
            for _ in range(15):
                b, c = beta + scale * step[:q], cuts + scale * step[q:]
                if (np.diff(c) > 0).all():
                    new = sums(d.df, [scores(b, c)[1]])[0]
                    if new >= llf:
                        break
                scale /= 2
            else:
                break
            moved, beta, cuts, llf = scale * float(np.abs(step).max()), b, c, new
            if moved < max(tol, 1e-7):
                done = True
                break
        cov = np.linalg.inv(bhhh + 1e-8 * np.eye(q + m))
        se = np.sqrt(np.diag(cov))
    finally:
        d.df.unpersist()
    free = q + m
    return ClassModel(classes, d.names, beta, se[:q], d, llf, 2 * free - 2 * llf, free * math.log(n) - 2 * llf, n, done, cuts, se[q:])


@dataclass
class ZeroInflated:
    """Both parts of a zero-inflated Poisson model."""

    count: Model
    inflation: Model
    llf: float
    aic: float
    bic: float
    n: int
    converged: bool


def zip_poisson(df: DataFrame, formula, inflation: list[str] | None = None, max_iter: int = 50, tol: float = 1e-6) -> ZeroInflated:
    """EM: each step weighs a row's zero by the chance that it is structural, then
    reweights a Poisson and a fractional logistic regression. Without ``inflation``
    columns both parts share the formula's."""
    d = _design(df, formula, **({f"z{k}": c for k, c in enumerate(inflation)} if inflation else {}))
    d = d.with_df(d.df.withColumn("__lg", log_gamma(F.col("y") + 1)).persist())
    try:
        x, y = d.x(), F.col("y")
        zs = [F.lit(1.0), *[F.col(f"z{k}").cast("double") for k in range(len(inflation))]] if inflation else x
        z_names = ["const", *inflation] if inflation else d.coef_names
        base = _fit_glm(d.with_df(d.df.withColumn("__shift", F.lit(0.0))), family_of("poisson"), Cov(), 100, 1e-8)
        beta, gam, n, last, done = base.coef, np.zeros(len(zs)), base.n, -math.inf, False
        zeros = sums(d.df, [(y == 0).cast("double")])[0] / n
        gam[0] = math.log(max(zeros, 0.01) / max(1 - zeros, 0.01)) - 1

        def parts(beta: np.ndarray, gam: np.ndarray) -> tuple[Column, Column, Column, Column]:
            mu = F.exp(F.greatest(F.least(d.linear(beta), F.lit(700.0)), F.lit(-700.0)))
            lin = F.lit(0.0)
            for g, c in zip(gam, zs, strict=True):
                lin = lin + F.lit(float(g)) * c
            pi = inverse_link("logit", lin)
            zero = pi + (1 - pi) * F.exp(-mu)
            ll = F.when(y == 0, F.log(F.greatest(zero, F.lit(1e-300)))).otherwise(F.log(F.greatest(1 - pi, F.lit(1e-300))) + y * F.log(mu) - mu - F.col("__lg"))
            return mu, pi, F.when(y == 0, pi / F.greatest(zero, F.lit(1e-300))).otherwise(0.0), ll

        for _ in range(max_iter):
            _, _, tau, _ = parts(beta, gam)
            fixed = d.df.withColumn("__tau", tau)
            t = F.col("__tau")
            for _ in range(5):
                mu, pi, _, _ = parts(beta, gam)
                g, _ = cross(fixed, [*x, d.linear(beta) + (y - mu) / mu], weight=(1 - t) * mu)
                beta, _ = solve_spd(g[:-1, :-1], g[:-1, -1])
                w = F.greatest(pi * (1 - pi), F.lit(1e-10))
                h, (*grad,) = cross(fixed, zs, weight=w, extra=[(t - pi) * c for c in zs])
                gam = gam + np.linalg.solve(h + 1e-10 * np.eye(len(zs)), np.array(grad))
            llf = sums(d.df, [parts(beta, gam)[3]])[0]
            if abs(llf - last) < tol * max(1.0, abs(llf)):
                done = True
                break
            last = llf
        mu, pi, tau, _ = parts(beta, gam)
        own = [(1 - tau) * (y - mu) * c for c in x] + [(tau - pi) * c for c in zs]
        info, _ = cross(d.df, own)
        cov = np.linalg.pinv(info)
    finally:
        d.df.unpersist()
    k = len(x)
    free = k + len(zs)
    count = Model(d.coef_names, beta, cov[:k, :k], math.inf, design=d, link="log")
    extra = Model(z_names, gam, cov[k:, k:], math.inf, design=d, link="logit")
    return ZeroInflated(count, extra, llf, 2 * free - 2 * llf, free * math.log(n) - 2 * llf, n, done)


# ---------------------------------------------------------------- clustered responses


def gee(df: DataFrame, formula, group: str, family: str = "binomial", correlation: str = "independence", order: str | None = None, max_iter: int = 20, tol: float = 1e-6) -> Model:
    """Generalised estimating equations. With independent or exchangeable working
    correlation a cluster enters only through sums over its rows (two aggregates); ar1
    uses each row and the one before it within the cluster along ``order``."""
    if correlation not in ("independence", "exchangeable", "ar1"):
        raise InvalidInput(f"unknown working correlation {correlation!r}")
    fam = family_of(family)
    if correlation == "ar1" and not order:
        raise InvalidInput("ar1 needs an order column")
    d = _design(df, formula, None, group, order)
    d = d.with_df(d.df.withColumn("__shift", F.lit(0.0)).persist())
    try:
        start = _fit_glm(d, fam, Cov(), 100, 1e-8)
        x, y, k, beta, rho, done, used = d.x(), F.col("y"), len(d.x()), start.coef, 0.0, False, 0
        from pyspark.sql import Window

        for used in range(1, max_iter + 1):
            eta = d.linear(beta)
            mu = fam.mean(eta)
            root = F.sqrt(F.greatest(fam.variance(mu), F.lit(1e-12)))
            rows = d.df.select("grp", *(["ord"] if order else []), ((y - mu) / root).alias("r"), *[(fam.slope(eta, mu) / root * c).alias(f"d{j}") for j, c in enumerate(x)])
            names = ["r", *[f"d{j}" for j in range(k)]]
            if correlation == "ar1":
                w = Window.partitionBy("grp").orderBy("ord")
                rows = rows.withColumns({f"{c}_p": F.lag(c).over(w) for c in names})
                pair, have = sums(rows, [F.col("r") * F.col("r_p"), F.when(F.col("r_p").isNotNull(), 1)])
                rho = float(np.clip(pair / max(have, 1), -0.95, 0.95))
                # rows whitened by the one before them have an AR(1) inverse of one
                s = math.sqrt(1 - rho * rho)
                rows = rows.select("grp", *[F.when(F.col("r_p").isNull(), F.col(c)).otherwise((F.col(c) - rho * F.col(f"{c}_p")) / s).alias(c) for c in names])
                u = [F.col(f"d{j}") * F.col("r") for j in range(k)]
                h, grad = cross(rows, [F.col(f"d{j}") for j in range(k)], extra=u)
                by = rows.groupBy("grp").agg(*[F.sum(c).alias(f"u{j}") for j, c in enumerate(u)])
            else:
                cells = [(i, j) for i in range(k) for j in range(i, k)]
                by = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("r").alias("sr"), F.sum(F.col("r") ** 2).alias("srr"), *[F.sum(f"d{j}").alias(f"s{j}") for j in range(k)], *[F.sum(F.col(f"d{j}") * F.col("r")).alias(f"t{j}") for j in range(k)], *[F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"h{i}_{j}") for i, j in cells])
                if correlation == "exchangeable":
                    pair, have = sums(by, [(F.col("sr") ** 2 - F.col("srr")) / 2, F.col("m") * (F.col("m") - 1) / 2])
                    rho = float(np.clip(pair / max(have, 1), -0.95, 0.95))
                a = 1 / (1 - rho)
                b = F.lit(rho) / ((1 - rho) * (1 - rho + rho * F.col("m")))
                by = by.select(*[(a * F.col(f"t{j}") - b * F.col(f"s{j}") * F.col("sr")).alias(f"u{j}") for j in range(k)], *[(a * F.col(f"h{i}_{j}") - b * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"h{i}_{j}") for i, j in cells])
                got = _wide_sums(by, [*[F.col(f"h{i}_{j}") for i, j in cells], *[F.col(f"u{j}") for j in range(k)]])
                h, grad = np.zeros((k, k)), got[len(cells) :]
                for v, (i, j) in zip(got, cells, strict=False):
                    h[i, j] = h[j, i] = v
            meat, (groups,) = cross(by, [F.col(f"u{j}") for j in range(k)], extra=[F.lit(1)])
            step, inverse = solve_spd(h, grad)
            cov = inverse @ meat @ inverse
            if np.abs(step).max() < tol:
                done = True
                break
            beta = beta + step
    finally:
        d.df.unpersist()
    out = Model(d.coef_names, beta, cov, math.inf, design=d, stats={"n": start.n, "rho": rho, "clusters": int(groups)}, converged=done, iterations=used, link=fam.link)
    out.family = fam
    return out
