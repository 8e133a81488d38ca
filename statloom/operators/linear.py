"""Linear regression: one Gram aggregate, a small solve, one aggregate of the residuals.

Row order never matters except where an ``order`` column is asked for (hac, rolling,
recursive, AR(1) errors); groups come from a ``group`` column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.operators.base import Cov, Model, sandwich
from statloom.plans.formula import Design, InsufficientData, InvalidInput, design
from statloom.plans.gram import cross, percentiles, quadratic, solve_spd, sums
from statloom.plans.order import numbered, with_lags


def _design(df: DataFrame, formula, weight=None, group=None, order=None, **more) -> Design:
    extra = {k: v for k, v in (("weight", weight), ("grp", group), ("ord", order)) if v}
    return formula if isinstance(formula, Design) else design(df, formula, extra | more)


def ols(df: DataFrame, formula, weight: str | None = None, cov: Cov | str | None = None, group: str | None = None, order: str | None = None) -> Model:
    """OLS, or WLS where ``weight`` names a column of positive weights.

    R² is centred with and without an intercept; the F test has one degree of freedom a
    coefficient besides the constant. Robust covariances of WLS weight the design but
    not the residuals."""
    return fit_ols(_design(df, formula, weight, group, order), cov, weight is not None)


def fit_ols(d: Design, cov: Cov | str | None = None, weighted: bool = False, df_resid: int | None = None) -> Model:
    cov = Cov.of(cov)
    x, y = d.x(), F.col("y")
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    extra = [F.lit(1), w * y, w, F.log(w) if weighted else F.lit(0), F.when(w > 0, 0).otherwise(1)]
    gram, tail = cross(d.df, [*x, y], weight=w if weighted else None, extra=extra)
    n, k = int(tail[0]), len(x)
    if tail[4]:
        raise InvalidInput("weights must be positive")
    if n < 3 or n <= k:
        raise InsufficientData(max(3, k + 1), n)
    xtx, xty = gram[:k, :k], gram[:k, k]
    beta, inverse = solve_spd(xtx, xty)
    resid = y - d.linear(beta)
    # residual sums by a pass of their own: y'y - b'X'y would cancel
    mean = tail[1] / tail[2]
    ssr, sst = sums(d.df, [w * resid * resid, w * (y - mean) * (y - mean)])
    dof = n - k if df_resid is None else df_resid
    s2 = ssr / dof
    if cov.kind == "nonrobust":
        covariance = inverse * s2
    else:
        root = F.sqrt(w)
        scaled = [root * c for c in x] if weighted else x
        covariance = sandwich(d.df, scaled, resid, inverse, cov, n, quadratic(inverse, scaled))
    model = k - d.intercept
    r2 = 1 - ssr / sst if sst > 0 else math.nan
    f = (sst - ssr) / max(model, 1) / s2 if s2 > 0 else math.inf
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / n) + 1) + 0.5 * tail[3]
    eig = np.linalg.eigvalsh(xtx)
    stats = {
        "n": n, "ssr": ssr, "sst": sst, "ess": sst - ssr, "s2": s2, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - d.intercept) / dof, "f": f,
        "f_p": dist.f_sf(f, max(model, 1), dof) if math.isfinite(f) else 0.0, "llf": llf, "aic": 2 * k - 2 * llf, "bic": k * math.log(n) - 2 * llf,
        "df_model": model, "condition_number": math.sqrt(max(eig[-1], 0) / max(eig[0], 1e-300)), "dof": dof,
    }
    out = Model(d.coef_names, beta, covariance, dof if cov.kind == "nonrobust" else math.inf, design=d, stats=stats)
    out.inverse = inverse
    return out


def rows_of(m: Model) -> DataFrame:
    """The design's rows with fitted values and residuals."""
    fit = m.design.linear(m.coef)
    return m.design.df.withColumns({"fitted": fit, "resid": F.col("y") - fit})


def influence(m: Model) -> DataFrame:
    """Leverage, internally studentised residual, Cook's distance and DFFITS of each row."""
    k = len(m.coef)
    rows = rows_of(m).withColumn("leverage", quadratic(m.inverse, m.design.x()))
    left = F.greatest(1 - F.col("leverage"), F.lit(1e-15))
    student = F.col("resid") / F.sqrt(F.lit(m.s2) * left)
    rows = rows.withColumn("studentized", student)
    ratio = F.col("leverage") / left
    return rows.withColumns({"cooks_d": F.col("studentized") ** 2 / k * ratio, "dffits": F.col("studentized") * F.sqrt(ratio)})


def residual_diagnostics(m: Model, order: str = "ord") -> dict[str, float]:
    """Durbin-Watson (along ``ord``, if the design has it), Jarque-Bera, condition number."""
    rows = rows_of(m)
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.skewness("resid").alias("s"), F.kurtosis("resid").alias("k")).first()
    jb = row["n"] / 6 * (row["s"] ** 2 + row["k"] ** 2 / 4)
    out = {"jarque_bera": jb, "jarque_bera_p": dist.chi2_sf(jb, 2), "skew": row["s"], "kurtosis": row["k"] + 3, "condition_number": m.condition_number}
    if order in rows.columns:
        lagged = with_lags(rows.select(order, "resid"), ["resid"], [1], order)
        top, bottom = sums(lagged, [(F.col("resid") - F.col("resid_1")) ** 2, F.col("resid") ** 2])
        out["durbin_watson"] = top / bottom
    return out


# ---------------------------------------------------------------- correlated errors


def gls(df: DataFrame, formula, omega: np.ndarray, order: str) -> Model:
    """GLS with a known error covariance. A dense n by n matrix is small-n by nature, so
    the rows are gathered (``omega`` itself already sits on the driver)."""
    d = _design(df, formula, order=order)
    n = len(omega)
    rows = d.df.orderBy("ord").limit(n + 1).toPandas()
    if len(rows) != n:
        raise InvalidInput(f"omega is for {n} rows")
    x = np.column_stack([np.ones(n), *[rows[f"x{k}"] for k in range(len(d.names))]]) if d.intercept else rows[[f"x{k}" for k in range(len(d.names))]].to_numpy()
    y = rows["y"].to_numpy()
    root = np.linalg.cholesky(np.asarray(omega, float))
    xs, ys = np.linalg.solve(root, x), np.linalg.solve(root, y)
    beta, inverse = solve_spd(xs.T @ xs, xs.T @ ys)
    s2 = float(((ys - xs @ beta) ** 2).sum() / (n - x.shape[1]))
    e = y - x @ beta
    r2 = max(0.0, 1 - float(e @ e) / float(((y - y.mean()) ** 2).sum()))
    return Model(d.coef_names, beta, inverse * s2, n - x.shape[1], design=d, stats={"n": n, "s2": s2, "r2": r2})


def fgls(df: DataFrame, formula, order: str, max_iter: int = 50, tol: float = 1e-8) -> Model:
    """Feasible GLS with AR(1) errors: Prais-Winsten steps until rho settles."""
    d = _design(df, formula, order=order)
    names = ["y", *[f"x{k}" for k in range(len(d.names))]]
    lagged = with_lags(d.df.withColumn("one", F.lit(1.0)), [*names, "one"], [1]).persist()
    try:
        m = fit_ols(d)
        rho, used = 0.0, 0
        for used in range(1, max_iter + 1):
            e = F.col("y") - d.linear(m.coef)
            before = F.col("y_1")
            for b, c in zip(m.coef, ["one_1", *[f"{x}_1" for x in names[1:]]] if d.intercept else [f"{x}_1" for x in names[1:]], strict=True):
                before = before - float(b) * F.col(c)
            both, own = sums(lagged, [e * before, F.when(before.isNotNull(), before * before)])
            new = both / own
            first = F.lit(math.sqrt(max(1 - new * new, 1e-12)))
            shift = lambda c, r=new, s=first: F.when(F.col("y_1").isNull(), s * F.col(c)).otherwise(F.col(c) - r * F.col(f"{c}_1"))
            columns = [shift("y").alias("y"), *[shift(f"x{k}").alias(f"x{k + d.intercept}") for k in range(len(d.names))]]
            if d.intercept:
                columns.append(shift("one").alias("x0"))
            white = Design(lagged.select(*columns), d.coef_names, False)
            m = fit_ols(white)
            done, rho = abs(new - rho) < tol, new
            if done:
                break
    finally:
        lagged.unpersist()
    return Model(d.coef_names, m.coef, m.cov, m.df_resid, design=d, stats=m.stats | {"rho": rho}, converged=used < max_iter, iterations=used)


def iv2sls(df: DataFrame, y: str, x: list[str], instruments: list[str]) -> Model:
    """Two-stage least squares. ``instruments`` hold the exogenous regressors, too."""
    if len(instruments) < len(x):
        raise InvalidInput("fewer instruments than regressors")
    d = Design(df.select(F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(x)], *[F.col(c).cast("double").alias(f"z{k}") for k, c in enumerate(instruments)]), list(x))
    xs, zs = d.x(), [F.lit(1.0), *[F.col(f"z{k}") for k in range(len(instruments))]]
    g, (n, total) = cross(d.df, [*zs, *xs, F.col("y")], extra=[F.lit(1), F.col("y")])
    z, k = len(zs), len(xs)
    zz, zx, zy = g[:z, :z], g[:z, z : z + k], g[:z, -1]
    half = np.linalg.solve(zz, zx)
    beta, inverse = solve_spd(zx.T @ half, half.T @ zy)
    e = F.col("y") - d.linear(beta)
    ssr, sst = sums(d.df, [e * e, (F.col("y") - total / n) ** 2])
    s2 = ssr / (n - k)
    return Model(d.coef_names, beta, inverse * s2, n - k, design=d, stats={"n": int(n), "ssr": ssr, "s2": s2, "r2": 1 - ssr / sst})


# ---------------------------------------------------------------- robust and quantile


def robust(df: DataFrame, formula, c: float = 1.345, max_iter: int = 50, tol: float = 1e-8) -> Model:
    """Huber M-estimator by reweighting; the scale is the median of the absolute residuals
    over 0.6745. Has a constant always."""
    d = _design(df, formula)
    d = Design(d.df.persist(), d.names, True, d.formula, d.levels)
    try:
        m = fit_ols(d)
        beta, used, x, y = m.coef, 0, d.x(), F.col("y")
        middle, near = None, None
        for used in range(1, max_iter + 1):
            e = y - d.linear(beta)
            before, (middle,) = middle, percentiles(d.df, F.abs(e), [0.5], near)
            # the next median lies near: the steps shrink
            near = None if before is None else (middle - 2 * abs(middle - before) - 1e-5 * middle, middle + 2 * abs(middle - before) + 1e-5 * middle)
            scale = max(middle / 0.6745, 1e-12)
            w = F.when(F.abs(e) <= c * scale, 1.0).otherwise(c * scale / F.abs(e))
            g, _ = cross(d.df, [*x, y], weight=w)
            new, _ = solve_spd(g[:-1, :-1], g[:-1, -1])
            step, beta = float(np.abs(new - beta).max()), new
            if step < tol:
                break
        e = y - d.linear(beta)
        u = e / scale
        inside = (F.abs(u) <= c).cast("double")
        psi = F.greatest(F.least(u, F.lit(c)), F.lit(-c))
        g, (n, psi2, slope) = cross(d.df, x, extra=[F.lit(1), psi * psi, inside])
        _, inverse = solve_spd(g, np.zeros(len(x)))
        k = len(x)
        mean = slope / n
        spread = mean * (1 - mean)
        kappa = 1 + k / n * spread / mean**2
        cov = kappa**2 * (psi2 / (n - k)) * scale**2 / mean**2 * inverse
    finally:
        d.df.unpersist()
    return Model(d.coef_names, beta, cov, math.inf, design=d, stats={"n": int(n), "scale": scale}, converged=used < max_iter, iterations=used)


#: Numbers (rows by columns) that the driver holds of the rows near a plane.
NEAR = 600_000


def _near(d: Design, beta: np.ndarray, q: float, max_iter: int, tol: float, floor: float) -> tuple[np.ndarray, int, bool]:
    """(coefficients, steps, settled) of the reweighting's fixed point. A row beyond a band
    around the plane gives X'psi the same on its side of it, so these rows are one sum, the
    steps run on the band's rows, and a pass over all rows confirms that no row outside has
    changed sides. Otherwise the band moves to the new plane."""
    x, y, k = d.x(), F.col("y"), len(beta)
    psi = lambda e: F.when(e >= 0, q).otherwise(q - 1)
    width = None
    for _ in range(8):  # towards the plane, by wide floors
        e = y - d.linear(beta)
        if width is None:
            n, total = sums(d.df, [F.lit(1), F.abs(e)])
            width = total / n
        weight = F.abs(psi(e)) / F.greatest(F.abs(e), F.lit(max(width, floor)))
        g, _ = cross(d.df, [*x, y], weight=weight)
        beta, width = solve_spd(g[:-1, :-1], g[:-1, -1])[0], width / 3
    used = 0
    for _ in range(30):
        e = y - d.linear(beta)
        most = NEAR // (k + 1)
        band = math.inf if n <= most else float(d.df.agg(F.percentile_approx(F.abs(e), float(0.7 * most / n), 10_000)).first()[0])
        inside = F.abs(e) <= band
        rest = sums(d.df, [inside.cast("double"), *[F.when(inside, 0.0).otherwise(psi(e) * c) for c in x]])
        if rest[0] > most or band <= 2 * floor:
            return beta, 0, False
        held = d.df.filter(inside).select(*[c.cast("double").alias(f"c{j}") for j, c in enumerate([*x, y])]).toArrow()
        m = np.column_stack([np.asarray(held.column(j)) for j in range(k + 1)])
        xs, ys, start, done = m[:, :-1], m[:, -1], beta, False
        while used < max_iter and not done:
            used += 1
            r = ys - xs @ beta
            w = np.minimum(np.where(r >= 0, q, 1 - q) / np.maximum(np.abs(r), floor), 1e12)
            new, _ = solve_spd((xs.T * w) @ xs, xs.T @ (w * ys) + rest[1:])
            step, beta = float(np.abs(new - beta).max()), new
            done = step < tol
            if np.abs(xs @ (beta - start)).max() > band:
                break
        if math.isinf(band):
            return beta, used, done
        now = y - d.linear(beta)
        changed = sums(d.df, [(~inside & ((psi(now) != psi(e)) | (F.abs(now) < floor))).cast("double")])[0]
        if done and not changed:
            return beta, used, True
        if used >= max_iter:
            break
    return beta, used, False


def quantile(df: DataFrame, formula, q: float = 0.5, max_iter: int = 1000, tol: float = 1e-8, floor: float = 1e-6) -> Model:
    """Quantile regression by reweighting with floored residuals. Most rows lie far from the
    plane and only their side counts, so the steps run on the rows near it (``_near``); where
    these do not settle, over all rows."""
    if not 0 < q < 1:
        raise InvalidInput("the quantile lies between 0 and 1")
    d = _design(df, formula)
    d = Design(d.df.persist(), d.names, d.intercept, d.formula, d.levels)
    try:
        beta, x, y = fit_ols(d).coef, d.x(), F.col("y")
        beta, used, done = _near(d, beta, q, max_iter, tol, floor)
        for used in range(used + 1, 0 if done else max_iter + 1):
            e = y - d.linear(beta)
            side = F.when(e >= 0, q).otherwise(1 - q)
            g, _ = cross(d.df, [*x, y], weight=F.least(side / F.greatest(F.abs(e), F.lit(floor)), F.lit(1e12)))
            new, _ = solve_spd(g[:-1, :-1], g[:-1, -1])
            step, beta = float(np.abs(new - beta).max()), new
            if step < tol:
                done = True
                break
        e = y - d.linear(beta)
        gram, (n, loss) = cross(d.df, x, extra=[F.lit(1), e * F.when(e >= 0, q).otherwise(q - 1)])
        center = percentiles(d.df, y, [q])[0]
        base = sums(d.df, [(y - center) * F.when(y >= center, q).otherwise(q - 1)])[0]
        h = float(min(max(n ** (-1 / 3) * max(math.sqrt(q * (1 - q)), 0.05), 0.02), 0.20))
        low, high = percentiles(d.df, e, [max(q - h, 0.001), min(q + h, 0.999)])
        sparsity = max((high - low) / (min(q + h, 0.999) - max(q - h, 0.001)), 1e-12)
        _, inverse = solve_spd(gram, np.zeros(len(x)))
    finally:
        d.df.unpersist()
    return Model(d.coef_names, beta, q * (1 - q) * sparsity**2 * inverse, math.inf, design=d, stats={"n": int(n), "pseudo_r1": 1 - loss / base, "q": q}, converged=done, iterations=used)


# ---------------------------------------------------------------- penalised


def _centered(d: Design) -> tuple[np.ndarray, np.ndarray, float, int, np.ndarray, float]:
    """X'X, X'y of the (centred, with a constant) design, from one pass over the data."""
    x, y = [F.col(f"x{k}") for k in range(len(d.names))], F.col("y")
    g, tail = cross(d.df, [*x, y], extra=[F.lit(1), *x, y])
    n, mean = tail[0], tail[1:] / max(tail[0], 1)
    if not d.intercept:
        mean = mean * 0
    g = g - n * np.outer(mean, mean)
    return g[:-1, :-1], g[:-1, -1], float(g[-1, -1]), int(n), mean[:-1], float(mean[-1])


def ridge(df: DataFrame, formula, alpha: float) -> Model:
    """(X'X + alpha n I) b = X'y, the constant unpenalised; in closed form from one Gram."""
    d = _design(df, formula)
    g, c, total, n, mx, my = _centered(d)
    beta = np.linalg.solve(g + alpha * n * np.eye(len(g)), c)
    return _penalised(d, beta, mx, my, g, c, total, n, {"alpha": alpha, "l1_ratio": 0.0}, 1, True)


def elastic_net(df: DataFrame, formula, alpha: float, l1_ratio: float = 0.5, max_iter: int = 5000, tol: float = 1e-10) -> Model:
    """Coordinate descent for 1/(2n) RSS + alpha (l1 |b|_1 + (1 - l1)/2 |b|²), on the Gram
    matrix: one pass over the data, whatever the number of sweeps."""
    d = _design(df, formula)
    g, c, total, n, mx, my = _centered(d)
    beta, used = np.zeros(len(c)), 0
    for used in range(1, max_iter + 1):
        most = 0.0
        for j in range(len(c)):
            if g[j, j] <= 0:
                continue
            rho = (c[j] - g[j] @ beta + g[j, j] * beta[j]) / n
            new = math.copysign(max(abs(rho) - alpha * l1_ratio, 0), rho) / (g[j, j] / n + alpha * (1 - l1_ratio))
            most, beta[j] = max(most, abs(new - beta[j])), new
        if most < tol:
            break
    return _penalised(d, beta, mx, my, g, c, total, n, {"alpha": alpha, "l1_ratio": l1_ratio}, used, used < max_iter)


def lasso(df: DataFrame, formula, alpha: float, **more) -> Model:
    return elastic_net(df, formula, alpha, 1.0, **more)


def _penalised(d: Design, beta, mx, my, g, c, total, n, stats, used, done) -> Model:
    ssr = total - 2 * beta @ c + beta @ g @ beta
    coef = np.concatenate([[my - mx @ beta], beta]) if d.intercept else beta
    zero = np.full((len(coef), len(coef)), np.nan)
    return Model(d.coef_names, coef, zero, math.inf, design=d, stats=stats | {"n": n, "r2": 1 - ssr / total, "ssr": ssr}, converged=done, iterations=used)


# ---------------------------------------------------------------- rolling and recursive


def rolling_ols(df: DataFrame, formula, order: str, window: int, key: str | None = None) -> DataFrame:
    """OLS in every window of ``window`` rows: ord, coefficients, r2. Gram cells are window
    sums (partitioned by ``key``, or by blocks of an unkeyed series); a vectorised solve
    follows batch by batch."""
    d = _design(df, formula, order=order, **({"key": key} if key else {}))
    k = len(d.names)
    names = [f"x{j}" for j in range(k)]
    cells = [("one", "one"), *[("one", c) for c in [*names, "y"]], *[(a, b) for i, a in enumerate([*names, "y"]) for b in [*names, "y"][i:]]]
    rows = d.df.withColumn("one", F.lit(1.0))
    if key:
        parts, keep = ["key"], F.lit(True)
    else:
        size = max(50_000, 4 * window)
        rows = numbered(rows, "ord", "__rn").withColumn("__b", F.floor((F.col("__rn") - 1) / size))
        tail = F.col("__rn") - F.col("__b") * size > size - window
        both = F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("g")), F.struct((F.col("__b") + 1).alias("b"), F.lit(True).alias("g")))
        rows = rows.withColumn("__c", F.explode(F.when(tail, both).otherwise(F.slice(both, 1, 1)))).withColumns({"__k": F.col("__c.b"), "__g": F.col("__c.g")}).drop("__c")
        parts, keep = ["__k"], ~F.col("__g")
    w = Window.partitionBy(*parts).orderBy("ord").rowsBetween(-(window - 1), 0)
    made = {f"s_{a}_{b}": F.sum(F.col(a) * F.col(b)).over(w) for a, b in cells}
    rows = rows.withColumns(made).withColumn("__n", F.count(F.lit(1)).over(w)).filter(keep & (F.col("__n") == window))
    own = (["one"] if d.intercept else []) + names
    labels = d.coef_names

    def solve(batches):
        for pdf in batches:
            n = len(pdf)
            get = lambda a, b: pdf[f"s_{a}_{b}" if f"s_{a}_{b}" in pdf else f"s_{b}_{a}"].to_numpy()
            g = np.stack([np.stack([get(a, b) for b in own], 1) for a in own], 1)
            c = np.stack([get(a, "y") for a in own], 1)
            beta = np.full((n, len(own)), np.nan)
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", g), 1e-300))
            rank = np.linalg.cond(g / scale[:, :, None] / scale[:, None, :]) < 1e12
            if rank.any():
                beta[rank] = np.linalg.solve(g[rank], c[rank][:, :, None])[:, :, 0]
            yy = get("y", "y") - get("one", "y") ** 2 / window
            ssr = get("y", "y") - (beta * c).sum(1)
            out = {"ord": pdf["ord"], **({"key": pdf["key"]} if key else {}), **{f"b{j}": beta[:, j] for j in range(len(own))}, "r2": 1 - ssr / yy}
            yield type(pdf)(out)

    kinds = dict(rows.dtypes)
    schema = f"ord {kinds['ord']}, " + (f"key {kinds['key']}, " if key else "") + "".join(f"b{j} double, " for j in range(len(own))) + "r2 double"
    out = rows.mapInPandas(solve, schema)
    return out.select("ord", *(["key"] if key else []), *[F.col(f"b{j}").alias(n) for j, n in enumerate(labels)], "r2")


def recursive_ols(df: DataFrame, y: str, x: list[str], order: str, key: str | None = None) -> DataFrame:
    """Recursive least squares by series: after each row the coefficients, the scaled
    one-step residual, its CUSUM and the 5 % bound. Sequential, so it runs by ``key``."""
    import pandas as pd

    k = len(x) + 1
    rows = df.select((F.col(key) if key else F.lit("all")).cast("string").alias("key"), F.col(order).alias("ord"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(x)])
    kind = dict(rows.dtypes)["ord"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        m = np.column_stack([np.ones(len(pdf)), *[pdf[f"x{j}"] for j in range(len(x))]])
        v = pdf["y"].to_numpy()
        n = len(v)
        coef, resid = np.full((n, k), np.nan), np.full(n, np.nan)
        if n > k and np.linalg.matrix_rank(m[:k]) == k:
            p = np.linalg.inv(m[:k].T @ m[:k])
            b = p @ m[:k].T @ v[:k]
            coef[k - 1] = b
            for t in range(k, n):
                u = m[t]
                f = 1 + u @ p @ u
                e = v[t] - u @ b
                gain = p @ u / f
                b = b + gain * e
                p = p - np.outer(gain, u @ p)
                coef[t], resid[t] = b, e / math.sqrt(f)
        seen = resid[k:]
        sigma = float(np.std(seen, ddof=1)) if len(seen) > 1 else math.nan
        cusum = np.concatenate([np.full(min(k, n), np.nan), np.cumsum(seen) / sigma if len(seen) else seen])
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "ord": pdf["ord"].to_numpy(), **{f"b{j}": coef[:, j] for j in range(k)}, "recursive_resid": resid, "cusum": cusum, "bound": 0.948 * math.sqrt(max(n - k, 0))})

    schema = f"key string, ord {kind}, " + "".join(f"b{j} double, " for j in range(k)) + "recursive_resid double, cusum double, bound double"
    out = rows.groupBy("key").applyInPandas(run, schema)
    return out.select("key", "ord", *[F.col(f"b{j}").alias(c) for j, c in enumerate(["const", *x])], "recursive_resid", "cusum", "bound")


def cusum_reject(rows: DataFrame) -> DataFrame:
    """By key: whether the CUSUM ever leaves its bound."""
    return rows.groupBy("key").agg((F.max(F.abs("cusum")) > F.max("bound")).alias("reject"))


# ---------------------------------------------------------------- additive models


@dataclass(frozen=True)
class Spline:
    column: str
    knots: tuple[float, ...]
    degree: int = 3


def gam(df: DataFrame, y: str, splines: list[Spline], linear: tuple[str, ...] = (), penalty: float | str | None = None) -> Model:
    """Gaussian additive model on truncated powers: x..x^d and (x - k)+^d of each term.
    ``penalty`` is a ridge weight on the knot columns, or "gcv" to choose it on a grid;
    the grid needs only the Gram matrix, so the data are read once."""
    made, names, knotty = [], [], []
    for s in splines:
        if not 1 <= s.degree <= 5:
            raise InvalidInput("degrees run from 1 to 5")
        x = F.col(s.column).cast("double")
        for p in range(1, s.degree + 1):
            made.append(F.pow(x, F.lit(float(p))))
            names.append(f"{s.column}^{p}")
            knotty.append(False)
        for knot in s.knots:
            made.append(F.pow(F.greatest(x - knot, F.lit(0.0)), F.lit(float(s.degree))))
            names.append(f"({s.column}-{knot:g})+^{s.degree}")
            knotty.append(True)
    for c in linear:
        made.append(F.col(c).cast("double"))
        names.append(c)
        knotty.append(False)
    columns = [F.col(y).cast("double").alias("y"), *[c.alias(f"x{k}") for k, c in enumerate(made)]]
    d = Design(df.select(*columns), names, made=tuple(made))
    if penalty is None:
        return fit_ols(d)
    g, tail = cross(d.df, [*d.x(), F.col("y")], extra=[F.lit(1)])
    n, xtx, xty, yy = tail[0], g[:-1, :-1], g[:-1, -1], g[-1, -1]
    pen = np.diag([0.0, *map(float, knotty)])

    def at(weight: float) -> tuple[float, np.ndarray, float, float]:
        beta = np.linalg.solve(xtx + weight * pen, xty)
        edf = float(np.trace(np.linalg.solve(xtx + weight * pen, xtx)))
        ssr = float(yy - 2 * beta @ xty + beta @ xtx @ beta)
        return n * ssr / (n - edf) ** 2, beta, edf, ssr

    weights = np.logspace(-8, 8, 81) if penalty == "gcv" else [float(penalty)]
    best = min(weights, key=lambda v: at(v)[0])
    gcv, beta, edf, ssr = at(best)
    cov = np.linalg.inv(xtx + best * pen) * ssr / (n - edf)
    return Model(d.coef_names, beta, cov, math.inf, design=d, stats={"n": int(n), "lambda": float(best), "gcv": gcv, "edf": edf, "ssr": ssr})
