"""Panel and mixed models, treatment effects, imputation, and multivariate operators."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.operators.base import Cov, Model
from statloom.operators.glm import logistic
from statloom.operators.linear import _design, fit_ols
from statloom.plans.formula import Design, InsufficientData, InvalidInput
from statloom.plans.gram import cross, solve_spd, sums

# ---------------------------------------------------------------- fixed effects


def _means(df: DataFrame, key: str, names: list[str], suffix: str) -> DataFrame:
    """Group means joined back: groups are summed up before the shuffle, so a group that
    holds a third of all rows is no single task (a window would make it one)."""
    means = df.groupBy(key).agg(*[F.avg(c).alias(f"{c}{suffix}") for c in names], F.count(F.lit(1)).alias(f"n{suffix}"))
    return df.join(means, key)


def _within(d: Design, key: str) -> Design:
    names = ["y", *[f"x{k}" for k in range(len(d.names))]]
    rows = _means(d.df, key, names, "_m")
    rows = rows.withColumns({c: F.col(c) - F.col(f"{c}_m") for c in names})
    return Design(rows.drop(*[f"{c}_m" for c in names], "n_m"), d.names, False)


def fixed_effects(df: DataFrame, formula, entity: str | None = None, time: str | None = None, cov: Cov | str | None = None, group: str | None = None, order: str | None = None, within_df: bool = False, max_iter: int = 200, tol: float = 1e-12) -> Model:
    """Entity, time or two-way fixed effects by demeaning. ``within_df`` counts absorbed
    effects in the degrees of freedom. Cluster covariance goes by ``group`` or else by the
    absorbed id."""
    if not entity and not time:
        raise InvalidInput("name an entity or a time column")
    keys = [k for k in (entity, time) if k]
    extra = {"e": entity, "t": time}
    d = _design(df, formula, None, group or (keys[0] if Cov.of(cov).kind == "cluster" else None), order, **{k: v for k, v in extra.items() if v})
    settled = True
    if len(keys) == 1:
        out = _within(d, "e" if entity else "t")
        absorbed = [out.df.select("e" if entity else "t").distinct().count()]
    else:
        out, absorbed, settled = _two_way(d, max_iter, tol)
    n = out.df.count()
    loss = len(d.names) + (sum(absorbed) - (len(absorbed) > 1) if within_df else 0)
    m = fit_ols(out, cov, df_resid=n - loss)
    m.stats["absorbed"] = sum(absorbed)
    m.converged = settled
    return m


def _two_way(d: Design, max_iter: int, tol: float) -> tuple[Design, list[int], bool]:
    """Balanced panels have a closed form; others solve for the two sets of effects on
    cell totals, which are as many as entities plus times."""
    names = ["y", *[f"x{k}" for k in range(len(d.names))]]
    cells = d.df.groupBy("e", "t").agg(F.count(F.lit(1)).alias("n"))
    count, entities, times, most = cells.agg(F.count(F.lit(1)), F.countDistinct("e"), F.countDistinct("t"), F.max("n")).first()
    if count == entities * times and most == 1:
        total = d.df.agg(*[F.avg(c) for c in names]).first()
        rows = _means(_means(d.df, "e", names, "_e"), "t", names, "_t")
        rows = rows.withColumns({c: F.col(c) - F.col(f"{c}_e") - F.col(f"{c}_t") + F.lit(float(total[k])) for k, c in enumerate(names)})
        return Design(rows.select(*d.df.columns), d.names, False), [entities, times], True
    rows, columns, settled = d.df, d.df.columns, False
    from statloom.sources.tables import durable

    for _ in range(max_iter):
        before = rows
        for key in ("e", "t"):
            rows = _within(Design(rows.select(*columns), d.names, False), key).df.select(*columns)
        rows = durable(rows, "within")
        e = rows.groupBy("e").agg(*[F.avg(c).alias(c) for c in names])
        gap = e.agg(*[F.max(F.abs(c)) for c in names]).first()
        if max(float(v or 0) for v in gap) < max(tol, 1e-10):
            settled = True
            break
        del before
    return Design(rows.select(*columns), d.names, False), [entities, times], settled


def cluster_ids(df: DataFrame, entity: str, time: str, name: str = "cluster_id") -> DataFrame:
    """The intersection id of entity and time."""
    return df.withColumn(name, F.struct(F.col(entity), F.col(time)))


def random_effects(df: DataFrame, formula, entity: str) -> Model:
    """Swamy-Arora: residual variance from the within regression, entity variance from
    the between one with the harmonic mean of group sizes; then quasi-demeaning."""
    d = _design(df, formula, e=entity)
    names = ["y", *[f"x{k}" for k in range(len(d.names))]]
    k = len(d.names)
    within = _within(d, "e")
    n, groups = d.df.agg(F.count(F.lit(1)), F.countDistinct("e")).first()
    if n - k - groups <= 0:
        raise InsufficientData(k + groups + 1, n)
    fe = fit_ols(within, df_resid=n - k - groups)
    s_e = fe.ssr / (n - k - groups)
    between = Design(d.df.groupBy("e").agg(*[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("m")), d.names, True)
    b = fit_ols(between)
    (inverse,) = sums(between.df, [1 / F.col("m")])
    s_u = max(b.ssr / (groups - k - 1) - s_e * inverse / groups, 0.0)
    rows = _means(d.df, "e", names, "_m")
    theta = 1 - F.sqrt(F.lit(s_e) / (F.col("n_m") * s_u + s_e))
    rows = rows.withColumn("theta", theta).select("e", "theta", (1 - F.col("theta")).alias("x0"), *[(F.col(c) - F.col("theta") * F.col(f"{c}_m")).alias("y" if c == "y" else f"x{int(c[1:]) + 1}") for c in names])
    m = fit_ols(Design(rows, ["intercept", *d.names], False))
    out = Model(m.names, m.coef, m.cov, m.df_resid, design=d, stats=m.stats | {"sigma2_e": s_e, "sigma2_u": s_u, "entities": groups})
    out.theta = rows.groupBy("e").agg(F.first("theta").alias("theta"))
    return out


@dataclass
class Hausman:
    statistic: float
    df: int
    p_value: float


def hausman(fe: Model, re: Model) -> Hausman:
    """Fixed against random effects on the slopes."""
    gap = fe.coef - re.coef[1:]
    v = fe.cov - re.cov[1:, 1:] + 1e-14 * np.eye(len(gap))
    stat = max(0.0, float(gap @ np.linalg.solve(v, gap)))
    return Hausman(stat, len(gap), dist.chi2_sf(stat, len(gap)))


# ---------------------------------------------------------------- mixed models


def mixed(df: DataFrame, formula, group: str, slope: str | None = None, max_iter: int = 200, tol: float = 1e-6) -> Model:
    """Linear mixed model with a random intercept (and an independent random slope on
    ``slope``), by REML over the variance ratios. A group enters only by its cross
    products, so each likelihood is one aggregate over a table of groups."""
    d = _design(df, formula, g=group, **({"z": slope} if slope else {}))
    d = Design(d.df, d.names, True, d.formula, d.levels)
    x, q = [*d.x(), F.col("y")], len(d.x())
    z = [F.lit(1.0), F.col("z").cast("double")] if slope else [F.lit(1.0)]
    cells = [(i, j) for i in range(q + 1) for j in range(i, q + 1)]
    by = d.df.groupBy("g").agg(F.count(F.lit(1)).alias("m"), *[F.sum(x[i] * x[j]).alias(f"c{i}_{j}") for i, j in cells], *[F.sum(a * c).alias(f"z{s}_{j}") for s, a in enumerate(z) for j, c in enumerate(x)], *([F.sum(z[1]).alias("zz01"), F.sum(z[1] * z[1]).alias("zz11")] if slope else [])).persist()
    try:
        groups, n = by.agg(F.count(F.lit(1)), F.sum("m")).first()

        def evaluate(ratios: tuple[float, ...]) -> tuple[float, np.ndarray, np.ndarray, float]:
            """(-2 REML, beta, (X'V^-1X)^-1, sigma2) at variances relative to the residual's."""
            a = F.lit(ratios[0])
            if slope:
                b = F.lit(ratios[1])
                p, r, s = 1 + a * F.col("m"), F.sqrt(a * b) * F.col("zz01"), 1 + b * F.col("zz11")
                det = p * s - r * r
                own = [F.sqrt(a), F.sqrt(b)]
                term = lambda i, j: (own[0] ** 2 * s * F.col(f"z0_{i}") * F.col(f"z0_{j}") - own[0] * own[1] * r * (F.col(f"z0_{i}") * F.col(f"z1_{j}") + F.col(f"z1_{i}") * F.col(f"z0_{j}")) + own[1] ** 2 * p * F.col(f"z1_{i}") * F.col(f"z1_{j}")) / det
            else:
                det = 1 + a * F.col("m")
                term = lambda i, j: a / det * F.col(f"z0_{i}") * F.col(f"z0_{j}")
            got = sums(by, [*[F.col(f"c{i}_{j}") - term(i, j) for i, j in cells], F.log(det)])
            m = np.zeros((q + 1, q + 1))
            for v, (i, j) in zip(got, cells, strict=False):
                m[i, j] = m[j, i] = v
            beta, inverse = solve_spd(m[:q, :q], m[:q, q])
            rss = float(m[q, q] - beta @ m[:q, q])
            s2 = rss / (n - q)
            value = (n - q) * (math.log(2 * math.pi * s2) + 1) + got[-1] + float(np.linalg.slogdet(m[:q, :q])[1])
            return value, beta, inverse, s2

        logs, step = [0.0] * len(z), 2.0
        best = evaluate(tuple(math.exp(v) for v in logs))[0]
        used, settled = 0, False
        for used in range(1, max_iter + 1):  # coordinate search on the log ratios
            moved = False
            for k in range(len(logs)):
                for move in (step, -step):
                    trial = [v + move * (i == k) for i, v in enumerate(logs)]
                    if -30 < trial[k] < 30 and (value := evaluate(tuple(math.exp(v) for v in trial))[0]) < best - 1e-12:
                        best, logs, moved = value, trial, True
                        break
            if not moved:
                step /= 4
                if step < tol:
                    settled = True
                    break
        _, beta, inverse, s2 = evaluate(tuple(math.exp(v) for v in logs))
    finally:
        by.unpersist()
    var = [math.exp(v) * s2 for v in logs]
    out = Model(d.coef_names, beta, inverse * s2, n - q - (len(z) - 1) * q, design=d, stats={"n": int(n), "groups": groups, "var_residual": s2, "var_random": var[0], **({"var_slope": var[1]} if slope else {}), "llf": -best / 2, "icc": var[0] / (var[0] + s2)}, converged=settled, iterations=used)
    resid = F.col("y") - d.linear(beta)
    ratio = var[0] / s2
    if not slope:
        out.random_effects = d.df.groupBy("g").agg((F.lit(ratio) * F.sum(resid) / (1 + F.lit(ratio) * F.count(F.lit(1)))).alias("effect"))
    return out


# ---------------------------------------------------------------- treatment effects


@dataclass
class Ipw:
    ate: float
    att: float
    treated_mean: float
    control_mean: float
    propensity: Model


def propensity_score(df: DataFrame, treatment: str, x: list[str]) -> Model:
    return logistic(df, f"{treatment} ~ {' + '.join(x)}")


def ipw(df: DataFrame, treatment: str, outcome: str, x: list[str], clip: float = 1e-3) -> Ipw:
    """Inverse-propensity weighting with normalised weights: one projection, one sum."""
    m = propensity_score(df, treatment, x)
    p = F.greatest(F.least(F.col("__p"), F.lit(1 - clip)), F.lit(clip))
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    rows = m.predict(df, "__p")
    odds = p / (1 - p)
    a, b, c, e, f, g, h, i = sums(rows, [t / p * y, t / p, (1 - t) / (1 - p) * y, (1 - t) / (1 - p), t * y, t, (1 - t) * odds * y, (1 - t) * odds])
    return Ipw(a / b - c / e, f / g - h / i, a / b, c / e, m)


def balance(df: DataFrame, treatment: str, x: list[str]) -> DataFrame:
    """Standardised mean difference of each covariate: variable, treated, control, smd."""
    t = F.col(treatment).cast("double")
    row = df.agg(*[e for c in x for e in (F.avg(F.when(t == 1, F.col(c))), F.avg(F.when(t == 0, F.col(c))), F.coalesce(F.var_samp(F.when(t == 1, F.col(c))), F.lit(0.0)), F.coalesce(F.var_samp(F.when(t == 0, F.col(c))), F.lit(0.0)))]).first()
    out = []
    for k, c in enumerate(x):
        one, two, v1, v0 = (float(v) for v in row[4 * k : 4 * k + 4])
        sd = math.sqrt((v1 + v0) / 2)
        out.append((c, one, two, (one - two) / sd if sd > 0 else 0.0))
    return df.sparkSession.createDataFrame(out, "variable string, treated double, control double, smd double")


# ---------------------------------------------------------------- imputation


def mean_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(columns, means, strict=True)})


def mice_impute(df: DataFrame, columns: list[str], sweeps: int = 5) -> DataFrame:
    """Chained regressions: each sweep refits every column with gaps on the others, from
    the rows where it is observed. Only coefficients change, so the frame stays one
    projection over the data; its lineage is cut after each sweep."""
    from statloom.sources.tables import durable

    seen = {c: f"__o_{k}" for k, c in enumerate(columns)}
    rows = df.withColumns({o: F.col(c).isNotNull() for c, o in seen.items()})
    rows = mean_impute(rows, columns)
    gaps = [c for c, v in zip(columns, rows.agg(*[F.count_if(~F.col(o)) for o in seen.values()]).first(), strict=True) if v]
    for _ in range(sweeps):
        for c in gaps:
            others = [F.col(o).cast("double") for o in columns if o != c]
            x = [F.lit(1.0), *others]
            g, (n,) = cross(rows.filter(F.col(seen[c])), [*x, F.col(c)], extra=[F.lit(1)])
            if n <= len(x):
                continue
            try:
                beta, _ = solve_spd(g[:-1, :-1], g[:-1, -1])
            except ValueError:
                continue
            fit = sum((float(b) * v for b, v in zip(beta[1:], others, strict=True)), F.lit(float(beta[0])))
            rows = rows.withColumn(c, F.when(F.col(seen[c]), F.col(c)).otherwise(fit))
        rows = durable(rows, "sweep")
    return rows.drop(*seen.values())


# ---------------------------------------------------------------- multivariate


@dataclass
class Manova:
    wilks: float
    f: float
    df_hypothesis: float
    df_error: float
    p_value: float


def manova(df: DataFrame, columns: list[str], group: str) -> Manova:
    """One-way MANOVA: Wilks' lambda with Rao's F."""
    p = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    by = df.groupBy(group).agg(F.count(F.lit(1)).alias("m"), *[F.sum(c).alias(f"s{k}") for k, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)])
    s = [F.col(f"s{k}") for k in range(p)]
    got = sums(by, [F.lit(1), F.col("m"), *s, *[F.col(f"c{i}_{j}") for i in range(p) for j in range(i, p)], *[s[i] * s[j] / F.col("m") for i in range(p) for j in range(i, p)]])
    g, n, total = got[0], got[1], got[2 : 2 + p]
    half = p * (p + 1) // 2
    sym = np.zeros((2, p, p))
    for r, part in enumerate((got[2 + p : 2 + p + half], got[2 + p + half :])):
        for v, (i, j) in zip(part, [(i, j) for i in range(p) for j in range(i, p)], strict=True):
            sym[r, i, j] = sym[r, j, i] = v
    within = sym[0] - sym[1]
    between = sym[1] - np.outer(total, total) / n
    ridge = 1e-10 * np.eye(p)
    wilks = float(np.linalg.det(within + ridge) / np.linalg.det(within + between + ridge))
    q = g - 1
    s_ = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    d1, m = p * q, n - 1 - (p + q + 1) / 2
    d2 = m * s_ - p * q / 2 + 1
    root = wilks ** (1 / s_)
    f = (1 - root) / root * d2 / d1
    return Manova(wilks, f, d1, d2, dist.f_sf(f, d1, d2))


@dataclass
class Pca:
    mean: np.ndarray
    components: np.ndarray  # columns are loadings
    variance: np.ndarray
    ratio: np.ndarray
    columns: list[str]

    def transform(self, df: DataFrame, components: int | None = None) -> DataFrame:
        k = components or len(self.columns)
        scores: dict[str, Column] = {}
        for c in range(k):
            total = F.lit(0.0)
            for j, name in enumerate(self.columns):
                total = total + float(self.components[j, c]) * (F.col(name).cast("double") - float(self.mean[j]))
            scores[f"pc{c + 1}"] = total
        return df.withColumns(scores)


def pca(df: DataFrame, columns: list[str]) -> Pca:
    """Principal components of the sample covariance: centred, not scaled. Each loading's
    largest entry is positive."""
    x = [F.col(c).cast("double") for c in columns]
    got = sums(df, [F.lit(1), *x])
    mean = got[1:] / got[0]
    g, _ = cross(df, [c - float(m) for c, m in zip(x, mean, strict=True)])
    value, vector = np.linalg.eigh(g / (got[0] - 1))
    value, vector = value[::-1], vector[:, ::-1]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(len(columns))])
    return Pca(mean, vector, value, value / value.sum(), list(columns))
